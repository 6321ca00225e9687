import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ruleloom.llm import language_id as m
from ruleloom.llm.registry import QUERIES


def _buckets(text):
    b = (text or "").lower().encode()
    mask = 0xFFFFFFFF
    return [((((b[i] * 0x9E3779B1 & mask) ^ (b[i + 1] * 0x85EBCA77 & mask) ^ (b[i + 2] * 0xC2B2AE3D & mask)) * 0x27D4EB2F) & mask) >> 19 for i in range(len(b) - 2) if not {*b[i : i + 3]} & {*b"0123456789"}]


def _brute(rows):
    """(text, declared, host, suffix) -> (language, posterior)."""
    langs, L = m.LANGUAGES, len(m.LANGUAGES)
    rows = [(t, None if d is None else d if d in langs else "other", h, s) for t, d, h, s in rows]
    counts = [Counter() for _ in langs]
    for t, d, _, _ in rows:
        if d in langs:
            counts[langs.index(d)].update(_buckets(t))
    tables = [[math.log((c[k] + 0.5) / (c.total() + 0.5 * m.BUCKETS)) for k in range(m.BUCKETS)] for c in counts]
    scores = [[m.TEMPER * sum(t[b] for b in _buckets(r[0])) for t in tables] + [-m.TEMPER * len(_buckets(r[0])) * math.log(m.BUCKETS)] for r in rows]
    best = [max(range(L + 1), key=lambda k: s[k]) if _buckets(r[0]) else L for r, s in zip(rows, scores, strict=True)]
    every = Counter(best)
    overall = [(every[k] + 1) / (sum(every[j] for j in range(L)) + L) for k in range(L)]

    def shares(pick, key, towards):
        own = Counter(b for r, b in zip(rows, best, strict=True) if pick(r) == key and b < L)
        return [(own[k] + m.SMOOTHING * towards[k]) / (own.total() + m.SMOOTHING) for k in range(L)]

    said = [*langs, "other"]
    seen = Counter((r[1], b) for r, b in zip(rows, best, strict=True))
    by_text = [[seen[d, k] + 1 for d in said] for k in range(L + 1)]
    out = []
    for (t, d, h, s), score in zip(rows, scores, strict=True):
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 1.0))
            continue
        prior = overall if s is None else shares(lambda r: r[3], s, overall)
        prior = prior if h is None else shares(lambda r: (r[2], r[3]), (h, s), prior)
        fused = [score[k] + math.log(prior[k] * (1 - m.UNDETERMINED_PRIOR)) for k in range(L)] + [score[L] + math.log(m.UNDETERMINED_PRIOR)]
        if d is not None:
            j = said.index(d)
            for k in range(L):
                fused[k] += math.log(by_text[k][j] / sum(by_text[k]))
            fused[L] += math.log(sum(r[j] for r in by_text) / sum(map(sum, by_text)))
        top = max(fused)
        out.append(((*langs, "und")[fused.index(top)], 1 / sum(math.exp(x - top) for x in fused)))
    return out


def _rows():
    r = random.Random(4)
    words = {"en": "the of and that with is on".split(), "de": "der die und ein für über ist".split(), "fr": "le la des été où une est".split(), "es": "el los que año una por en".split()}
    rows = [(None, None, None, None), ("", "en", "a", "com"), ("12 345 67.", "en", "a", "com"), ("the 4111111111111111 of 2 the", "en", None, None), ("ab", "fr", None, "org"), ("the of the of", "zz", None, None), ("жизнь и судьба " * 8, "en", "a.com", "com")]
    for k in range(160):
        lang = r.choice(list(words))
        text = " ".join(r.choice(words[lang]) for _ in range(r.choice([1, 2, 5, 60])))
        rows.append((text, r.choice([lang, lang, lang, None, "xx", "en"]), r.choice([f"{lang}.com", "mixed.org", None]), r.choice(["com", "org", None])))
    return [*rows, *rows[:20]]


def test_against_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "n long, text string, d string, h string, s string").withColumn("language", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = m.identify(df, "text", F.col("d"), F.col("h"), F.col("s")).orderBy("n").collect()
    for row, (lang, p) in zip(got, _brute(rows), strict=True):
        assert row.language == lang, (row, lang, p)
        assert abs(row.posterior - p) < 1e-6
        assert row.accepted == (lang != "und" and p >= 0.5)
    assert m.identify(df.limit(0), "text", F.col("d")).count() == 0


def test_trigrams_do_not_cross_texts():
    texts = ["abc", "", None, "a", "zz", "abcd", "é1", "ab1cde 2", "777"]
    got = [(first + k, code[begins[k] : begins[k + 1]].tolist()) for first, code, begins in m.trigrams(pa.array(texts)) for k in range(len(begins) - 1)]
    assert got == [(i, _buckets(t)) for i, t in enumerate(texts)]


def test_held_out_languages_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = docs.withColumn("shown", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = m.identify(hidden, "text", F.col("shown"), F.col("source")).where("doc_id % 3 = 0 AND n_chars > 100")
    assert got.where("language = lang").count() >= 0.97 * got.count()


def test_queries_cover_their_tables(spark, sf_dir):
    for name, t in (("op5_language_id", "documents"), ("language_id_pages", "pages")):
        got = QUERIES[name](spark, sf_dir)
        assert got.count() == spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
        assert got.where("accepted").count() > 0.95 * got.count()
