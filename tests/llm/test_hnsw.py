import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import hnsw
from ruleloom.llm.registry import QUERIES


def _usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def _brute(rows, asked, k):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and _usable(v)})
    out = {}
    for q, u in sorted({(i, tuple(v)) for i, v in asked if i is not None and _usable(v)}):
        found = sorted((-float(np.dot(u, v)), i) for i, v in rows if i != q and len(v) == len(u))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def _got(df, id_col="vec_id"):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r[id_col], r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_search_reaches_all_of_a_small_shard_in_order():
    r = np.random.default_rng(1)
    x = (r.normal(size=(100, 8)) * r.uniform(0.1, 3, (100, 1))).astype(np.float32)
    found = hnsw.search(x, hnsw.build(x), x[:10])
    assert (found[:, 100:] == -1).all()
    assert (found[:, :100] == np.argsort(-(x[:10] @ x.T), axis=1, kind="stable")).mean() > 0.99


@pytest.mark.parametrize("kind", ["normal", "clusters", "lengths"])
def test_recall_in_a_full_shard(kind):
    """One shard of the size that the operator itself makes, whose nodes a beam doesn't all come by."""
    r = np.random.default_rng(5)
    n, d, k = hnsw.SHARD_NODES, 64, 20
    x = {"normal": lambda: r.normal(size=(n, d)), "clusters": lambda: 3 * r.normal(size=(300, d))[r.integers(0, 300, n)] + 0.3 * r.normal(size=(n, d)), "lengths": lambda: r.normal(size=(n, d)) * r.uniform(0.1, 3, (n, 1))}[kind]().astype(np.float32)
    found = hnsw.search(x, hnsw.build(x), x[:512])[:, :k]
    want = np.argsort(-(x[:512] @ x.T), axis=1)[:, :k]
    assert np.mean([len({*a} & {*b}) / k for a, b in zip(found.tolist(), want.tolist(), strict=True)]) >= 0.95


def test_one_node_and_none():
    one = np.ones((1, 3), np.float32)
    assert hnsw.search(one, hnsw.build(one), one)[0, 0] == 0


def test_ties_nulls_repeats_and_bad_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 2.0]) for i in range(120)] + [rows[7]] * 50
    rows += [(2000, None), (2020, [0.0] * 4), (2040, [1.0, float("nan"), 0.0, 0.0]), (2060, [1.0, None, 0.0, 0.0]), (2080, [1.0, float("inf"), 0.0, 0.0]), (None, [1.0] * 4), (2100, [1.0, 2.0]), (2120, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    asked = df.where("vec_id % 20 = 0")
    got = _got(hnsw.nearest(df, asked))
    want = _brute(rows, [x for x in rows if x[0] is not None and x[0] % 20 == 0], 20)
    assert got.keys() == want.keys() - {q for q, found in want.items() if not found}
    for q, found in want.items():
        assert got.get(q, []) == found, q
    assert hnsw.nearest(df.limit(0), asked.limit(0)).count() == 0


def test_recall_on_the_whole_table(spark, sf_dir):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = _got(QUERIES["op10_nearest_neighbours"](spark, sf_dir)), _brute(rows, [x for x in rows if x[0] % 20 == 0], 20)
    assert got.keys() == want.keys()
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.98
    exact = dict(rows)
    for q, found in got.items():
        for i, score in found:
            assert abs(score - float(np.dot(np.array(exact[q], float), np.array(exact[i], float)))) < 1e-12


@pytest.mark.parametrize("size", [1e-200, 1.0, 1e150])
def test_components_beyond_single_precision_and_groups_of_blocks(spark, monkeypatch, size):
    r = np.random.default_rng(9)
    x = r.normal(size=(900, 6)) * size
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 8)
    monkeypatch.setattr(hnsw, "GROUPED", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = _got(hnsw.nearest(df, df.where("vec_id % 20 = 0"))), _brute(rows, rows[::20], 20)
    assert got.keys() == want.keys() and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
