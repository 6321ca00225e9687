import hashlib
import random
import re

from pyspark.sql import functions as F

from ruleloom.llm import pii
from ruleloom.llm.registry import QUERIES

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def _base(text):
    out = []
    for k, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), list(FORMS).index(k), m.end(), k))
    return sorted(out)


def _shown(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def _check(got, texts):
    for row in got:
        want = _base(texts[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(x[3] == k for x in want) for k in FORMS], texts[row.doc_id]
        assert row.base_sha256 == hashlib.sha256(_shown(want).encode()).hexdigest(), (texts[row.doc_id][:200], row.spans, _shown(want))


def _random_texts(n):
    r = random.Random(2)
    bits = ["a@b.c", "x.y%z@d-e.f.g", "1.2.3.4", "255.255.255.255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "+1 (555) 010-9999", "+44 20 7946 0958", "@", ".", "-", " ", "+", "0", "7", "é", "😀", "\x01", "(", "\n", "word", "00000000000000", "1.2.3.4.5.6.7.8", "b@c.d@e.f"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def test_base_spans_against_brute_force(spark):
    texts = dict(enumerate([None, "", *_random_texts(1500), "a" * 20_000 + "@b.c", "1 2" * 9000, "+1" + " 2" * 5000, "a@" + "b." * 9000 + "c", "1.1.1.1 " * 3000]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("key", F.lit("x")).withColumn("_spans", F.lit(2))
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(texts)
    _check(got, texts)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "mail a@b.cc"), (1, "mail a@b.cc"), (1, "mail a@b.cc"), (2, None)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", "email:5:11"), ("1", "email:5:11"), ("2", ""), ("None", "email:5:11")]


def _contexts():
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    say = lambda: " ".join(r.choice(words) for _ in range(6))
    seen = [f"{say()} reach me at +1 555 010 {1000 + k} {say()}" for k in range(30)]
    unseen = [f"{say()} reach me at 555-010-{2000 + k}, {say()}" for k in range(4)]
    clean = [f"{say()} item number 555-010-{3000 + k} {say()}" for k in range(4)] + [f"reach me at {k} o'clock" for k in range(1, 3)]
    return seen, unseen, clean


def test_trusted_contexts_find_unseen_identifiers_and_leave_others(spark):
    seen, unseen, clean = _contexts()
    texts = dict(enumerate([*seen, *unseen, *clean]))
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    _check(got.values(), texts)
    for i, text in texts.items():
        found = [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].spans.split(",") if x)]
        if text in unseen:
            assert found == [re.search(r"555-010-\d+", text).group()], (text, found)
            assert got[i].spans.startswith("phone:") and got[i].n_discovered == 1
        elif text in clean:
            assert found == []


def test_redaction(spark):
    rows = [(1, "é a@b.cc 😀 1.2.3.4!"), (2, None), (3, "clean"), (4, "+4111111111111111"), (5, "+123456789012345678 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "é [EMAIL] 😀 [IP]!", 2: None, 3: "clean", 4: "+[CARD]", 5: "+123456789012345678 x"}
    assert pii.redact(df).columns == df.columns


def test_query_on_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op4_personal_data"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    _check(got, texts)


def test_found_instances_support_further_patterns_and_unseen_right_shapes_do_not_count_against(spark):
    """Six phones in full form behind "ring me", three local ones there, and those three with more behind "reach us"."""
    full = [f"+49 30 90182{k}4{k}" for k in range(6)]
    local = [f"555-01{k}7-88{k}" for k in range(6)]
    rows = [f"please ring me {x} today" for x in full] + [f"please ring me {x} today" for x in local]
    rows += [f"or reach us {x} soon" for x in local] + ["or reach us 555-7777-991 soon", "or order part 12345678 now"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for k in range(6, 12):
        assert got[k] == f"phone:15:{15 + len(local[k - 6])}"
    assert got[18] == "phone:12:24" and got[19] == ""


def test_redact_keeps_any_columns_and_long_texts(spark):
    long = "x " * 100_000
    df = spark.createDataFrame([(1, long + "a@b.example", 5), (2, None, 6), (2, None, 6)], "`a.b` long, text string, spans int").withColumn("own", F.lit("o")).withColumn("key", F.lit("k")).withColumn("c1", F.lit(0))
    out = pii.redact(df)
    assert out.columns == df.columns and pii.redact(df.limit(0)).count() == 0
    assert sorted(((r["a.b"], r.text, r.spans, r.own, r.key, r.c1) for r in out.collect()), key=str) == [(1, long + "[EMAIL]", 5, "o", "k", 0), (2, None, 6, "o", "k", 0), (2, None, 6, "o", "k", 0)]
