import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import divergence as d
from ruleloom.llm.registry import ORACLE_SQL, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=30, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(lower))
        groups.add((lang, source))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        v = len(kept)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(n[g])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        p, q = {g[1]: share(n[g]) for g in groups if g[0] == lang}, share(whole)
        for a in p:
            far = [(-sum(abs(p[a][t] - p[b][t]) for t in kept), b.encode(), b) for b in p if b != a]
            near = [(q[t] - p[a][t], t.encode(), t) for t in kept if n[lang, a][t] > 0 and p[a][t] > q[t]]
            out += [(lang, a, "pair", x[2], -x[0], k + 1) for k, x in enumerate(sorted(far))]
            out += [(lang, a, "term", x[2], -x[0], k + 1) for k, x in enumerate(sorted(near)[:top])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    df = df.withColumns({"term": F.lit(1), "n": F.lit("x"), "digest": F.lit(2), "slice": F.lit(3)})
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in d.divergence(df).collect())


def test_words():
    for text in ("", "One two-ONE's É É naïve x2y z\nŒuf", "\0a\x7fb`c{d@e[f", "日本語 ZZ"):
        assert [w.decode() for w in d.words(text.encode())] == TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_small_tables(spark):
    some = ["alpha beta", "alpha Beta gamma gamma", "delta; ALPHA alpha", None, "", "été beta"]
    rows = [(some[k % 6], ["en", "de", None, ""][k % 4], ["web", "Book", None, "été", "ab"][(k * k) % 5 if k % 3 else k % 5]) for k in range(900)]
    rows += [("alpha beta", "en", "web")] * 400 + [("alpha beta", "en", s) for s in "pqrstuvw"] + [("rare words", "fr", "only"), ("", "fr", "void"), (None, "xx", None)]
    rows += [("long alpha " * 50_000, "en", "web")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_handed_on_in_pieces(spark, monkeypatch):
    rows = [(f"w{chr(97 + k % 26)} w{chr(97 + k % 7)} common", "en", f"s{k % 9}") for k in range(2000)]
    want = plain(rows)
    monkeypatch.setattr(d, "HELD", 20)
    assert run(spark, rows) == want


@pytest.mark.parametrize("copies", [1, 3])
def test_counts_are_weighted_by_copies(spark, copies):
    rows = [(f"x{chr(97 + k % 5)} y", "en", f"s{k % 3}") for k in range(120)] * copies
    assert run(spark, rows) == plain(rows)


def test_query_against_sql_on_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_source_divergence"])
    got = QUERIES["op13_source_divergence"](spark, sf_dir)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
