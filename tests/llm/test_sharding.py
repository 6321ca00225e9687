import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ruleloom.llm import sharding
from ruleloom.llm.registry import QUERIES
from ruleloom.llm.storage import fresh_path


def plain(sizes, shards):
    """The method with sets of items: largest spread first, fullest with emptiest."""
    parts = [([(s, [k])] + [(0, [])] * (shards - 1), k) for k, s in enumerate(sizes)]
    number = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0][0] - p[0][-1][0]), p[1]))
        a, b = parts[0][0], parts[1][0]
        joined = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        parts = [*parts[2:], (joined, number)]
        number += 1
    return parts[0][0] if parts else []


def test_differencing_as_the_plain_method():
    r = np.random.default_rng(5)
    for n, shards in ((0, 3), (1, 3), (2, 2), (5, 4), (60, 4), (200, 24)):
        sizes = r.integers(0, 1000, n)
        got = sharding.differenced(sizes, shards)
        groups = {tuple(sorted(g)) for _, g in plain(sizes.tolist(), shards) if g}
        assert {tuple(np.flatnonzero(got == s)) for s in range(shards) if (got == s).any()} == groups


def test_differencing_is_tighter_than_greedy():
    r = np.random.default_rng(6)
    sizes = (r.lognormal(8, 1.5, 5000)).astype(np.int64)
    mine = np.bincount(sharding.differenced(sizes, 24), sizes, minlength=24)
    greedy = np.zeros(24)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert np.ptp(mine) <= np.ptp(greedy) and np.ptp(mine) < 1e-4 * sizes.sum() / 24


def _check(rows, got, shards):
    want = sorted(((r[0] is not None, r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id is not None, r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    slots, loads = defaultdict(list), defaultdict(int)
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return loads


def test_whole_table_groups_stay_together_and_loads_are_near_equal(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_sharding"](spark, sf_dir).collect()
    loads = _check(rows, got, 24)
    text = {r.doc_id: r.text or "" for r in rows}
    shards, group = defaultdict(set), defaultdict(int)
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
        group[text[r.doc_id]] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    rest = [v for v in loads.values() if v < max(group.values())]
    mean = sum(loads.values()) / 24
    assert max(loads.values()) <= max(1.01 * mean, max(group.values())) or np.ptp(rest) <= 0.05 * mean


def test_small_groups_go_by_bundles(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", 2)
    rows = [(k, f"text {k} " * (1 + k % 7)) for k in range(4000)] + [(4000 + k, "large " * 3000) for k in range(3)]
    loads = _check(rows, sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)
    assert np.ptp(list(loads.values())) < 0.02 * np.mean(list(loads.values()))


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, None), (2, ""), (None, "a"), (None, "a"), (3, "é\n"), (3, "é\n"), (4, "long " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(9), "_digest": F.lit("x"), "slot": F.lit(1), "size": F.lit(0)})
    got = sharding.assign(df, 3).collect()
    _check(rows, got, 3)
    assert len({r.shard for r in got if r["size"] == 8}) == 1 and len({r.shard for r in got if r.doc_id == 3}) == 1
    assert sharding.assign(df.limit(0), 3).count() == 0


def test_hot_group_has_a_shard_to_itself(spark):
    rows = [(k, "the same text") for k in range(500)] + [(500 + k, f"other {k}") for k in range(1000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    loads = _check(rows, got, 8)
    hot = {r.shard for r in got if r.doc_id < 500}
    assert len(hot) == 1 and not any(r.shard in hot for r in got if r.doc_id >= 500)
    assert np.ptp([v for s, v in loads.items() if s not in hot]) <= 20


def test_written_shards_are_the_assigned_ones(spark):
    rows = [(k, f"text {k % 40} " * (k % 9)) for k in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_size", F.lit("kept"))
    back = sharding.write_shards(df, fresh_path(spark, "shards"), 5)
    assert sorted(map(repr, back.drop("shard_no").collect())) == sorted(map(repr, df.collect()))
    want = {(r.doc_id, r.shard) for r in sharding.assign(df, 5).collect()}
    assert {(r.doc_id, r.shard_no) for r in back.collect()} == want
