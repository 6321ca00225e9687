import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm.fill_in_middle import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, boundaries, digests, fill_in_middle, restored
from ruleloom.llm.registry import ORACLE_SQL, QUERIES


def test_every_rank_of_every_kind_of_container():
    r = np.random.default_rng(1)
    sparse = np.arange(0, 60_000, 71)
    dense = 65_536 + np.sort(r.choice(65_536, 30_000, replace=False))
    runs = np.concatenate([np.arange(200_000, 200_900), np.arange(240_000, 250_000)])
    far = np.array([5_000_000])
    places = np.unique(np.concatenate([sparse, dense, runs, far]))
    s = BoundarySet(places)
    kinds = {type(c) for c in s.containers}
    assert kinds == {ArrayContainer, BitmapContainer, RunContainer}
    assert [s.select(k) for k in range(len(places))] == places.tolist()
    for k in (-1, len(places)):
        with pytest.raises(IndexError):
            s.select(k)
    full = BoundarySet(np.arange(65_536))
    assert [full.select(k) for k in (0, 1, 65_535)] == [0, 1, 65_535]


def test_boundaries_are_the_ends_of_lines():
    for text in ("", "\n", "a", "a\n", "a\nb", "\n\né\n", "x\r\ny z\n😀"):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert boundaries(text).tolist() == np.cumsum([0, *map(len, units)]).tolist()


def plain(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts_and_the_way_back(spark):
    texts = [None, "", "\n", "one", "a\nb", "<P>", "x <M> y\n", "<\nP>\n<", "$1\\E$2\n(.*)\n", "é😀\n\r\n \0", "a <S\n> b\n", "\n" * 70_000 + "end", "line of text\n" * 60_000, "word " * 400_000]
    rows = [(k, t) for k, t in enumerate(texts * 6)] + [(None, "a\nb\nc"), (7, "\n"), (-3, "x\ny\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit(1), "n": F.lit("x"), "id": F.lit(2), "shown": F.lit(3)})
    out = fill_in_middle(df)
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1:]))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((d, *plain(d, t)) for d, t in rows), key=key)
    assert sorted(((r.doc_id, r.back) for r in got), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert digests(fill_in_middle(df.limit(0))).count() == 0


def test_rates(spark):
    rows = [(k, f"a\nb {k}\nc") for k in range(400)]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=30, spm=90).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.form != "plain") == sorted((d, *x) for d, t in rows if (x := plain(d, t, 30, 90))[1] != "plain")
    assert 60 < sum(r.form != "plain" for r in got) < 180


def test_query_against_sql_on_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op12_fill_in_middle"])
    got = QUERIES["op12_fill_in_middle"](spark, sf_dir)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
