"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph a shard.

Vectors that are equal are one node.  Nodes are dealt to shards by a hash, and near
means a large inner product, in the graph as in the search.  Every node has a level
by a geometric law.  Levels are built from the top: nodes are inserted in batches
that grow with what is there, each searching the level for near nodes from where
the levels above lead it, and are tied to near ones thinned so that they point in
different directions, and these back to them.  A graph is flat arrays of
neighbours, padded with -1, in one row of a table.

Queries go through in blocks.  A block descends the levels together: on each, a
greedy walk, on the lowest a beam of BEAM nodes.  Lists of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

#: Nodes a shard, about; shards at least, so that a small table has work for several machines; queries a block.
SHARD_NODES = 16_384
MIN_SHARDS = 6
QUERY_BLOCK = 256
#: Blocks of queries that meet a shard in one task, about.
GROUPED = 64
#: Edges that a node chooses on a level, and most that it keeps with those back; nodes it chooses from; most nodes inserted at once.
CHOSEN, KEPT, NEAR, INSERTED = 16, 32, 64, 256
#: Nodes in the beam of a search, and those of them that are left at once.
BEAM = 192
EXPANDED = 4


def _levels(ids: np.ndarray) -> np.ndarray:
    """Levels of nodes numbered ``ids``: each higher one holds one in CHOSEN of the nodes below, always the same."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    u = ((x >> np.uint64(11)).astype(float) + 1) / 2.0**53
    return np.floor(-np.log(u) / np.log(CHOSEN)).astype(np.int8)


def _thinned(points: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's ``near`` (closest first, -1 none) at most ``most``: one is left out if nearer to one kept than to the node.

    Where that leaves places, the closest of those left out take them.
    """
    n, width = near.shape
    around = points[near]
    own = np.matmul(around, points[nodes][:, :, None])[:, :, 0]
    pair = np.matmul(around, around.transpose(0, 2, 1))
    count = np.zeros(n, np.int64)
    kept = np.zeros((n, width), bool)
    for j in range(width):
        close = (kept[:, :j] & (pair[:, j, :j] > own[:, j, None])).any(axis=1)
        kept[:, j] = (near[:, j] >= 0) & ~close & (count < most)
        count += kept[:, j]
    order = np.argsort(np.where(kept, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((n, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def _walk(points: np.ndarray, near: np.ndarray, entry: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """From each query's entry on to the best neighbour, until none is better."""
    rows = np.arange(len(queries))
    best = np.einsum("qd,qd->q", queries, points[entry])
    while True:
        around = near[entry]
        scores = np.where(around >= 0, np.einsum("qd,qwd->qw", queries, points[around]), -np.inf)
        top = scores.argmax(axis=1)
        better = scores[rows, top] > best
        if not better.any():
            return entry
        entry = np.where(better, around[rows, top], entry)
        best = np.where(better, scores[rows, top], best)


def _beam(points: np.ndarray, near: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best of the ``n`` nodes that a beam comes by, best first (-1: fewer), and their products."""
    q = len(queries)
    rows = np.arange(q)
    seen = np.zeros((q, n + 1), bool)
    held = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    held[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", queries, points[entry]), False
    seen[rows, entry] = True
    active = rows
    while len(active):
        open_ = np.where(done[active], -np.inf, score[active])
        pick = np.argsort(-open_, axis=1, kind="stable")[:, :EXPANDED]
        chosen = np.take_along_axis(open_, pick, 1) > -np.inf
        active, pick, chosen = active[chosen[:, 0]], pick[chosen[:, 0]], chosen[chosen[:, 0]]
        if len(active) == 0:
            break
        done[active[:, None], pick] = True
        from_ = np.where(chosen, held[active[:, None], pick], -1)
        around = np.where(from_[:, :, None] >= 0, near[np.maximum(from_, 0)], -1).reshape(len(active), -1)
        around = np.sort(np.where(around < 0, n, around), axis=1)
        fresh = (around < n) & ~seen[active[:, None], around]
        fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
        seen[active[:, None], np.where(fresh, around, n)] = True
        which, column = np.nonzero(fresh)
        new = np.full(fresh.shape, -np.inf, np.float32)
        new[which, column] = np.einsum("ed,ed->e", queries[active[which]], points[around[which, column]])
        all_score = np.concatenate([score[active], new], axis=1)
        all_held = np.concatenate([held[active], np.where(fresh, around, -1)], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[active], held[active], done[active] = (np.take_along_axis(x, keep, 1) for x in (all_score, all_held, all_done))
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(np.where(np.isneginf(score), -1, held), order, 1), np.take_along_axis(score, order, 1)


def _tie_back(points: np.ndarray, near: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Gives each ``target`` an edge to its ``source``; where a node then has too many, they are thinned."""
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begins = np.unique(target, return_index=True)
    place = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
    more = np.full((len(nodes), int(place.max(initial=-1)) + 1), -1, np.int32)
    more[np.searchsorted(nodes, target), place] = source
    every = np.concatenate([near[nodes], more], axis=1)
    every[:, KEPT:][(every[:, KEPT:, None] == every[:, None, :KEPT]).any(axis=2)] = -1
    own = np.where(every >= 0, np.matmul(points[every], points[nodes][:, :, None])[:, :, 0], -np.inf)
    every = np.take_along_axis(every, np.argsort(-own, axis=1, kind="stable"), 1)
    full = (every >= 0).sum(axis=1) > KEPT
    near[nodes[~full]] = every[~full][:, :KEPT]
    for begin in range(0, int(full.sum()), 512):
        some = np.flatnonzero(full)[begin : begin + 512]
        near[nodes[some]] = _thinned(points, nodes[some], every[some], KEPT)


def _insert(points: np.ndarray, above: list[np.ndarray]) -> np.ndarray:
    """Neighbours on one level of all ``points``; ``above`` are those on the levels above, whose nodes are its first ones."""
    n = len(points)
    near = np.full((n, KEPT), -1, np.int32)
    there = 1
    while there < n:
        new = np.arange(there, min(n, there + min(INSERTED, max(1, there // 4))))
        asked = points[new]
        entry = np.zeros(len(new), np.int64)
        for level in above:
            entry = _walk(points, level, entry, asked)
        # an entry that is itself still to be inserted leads nowhere: begin with the first node instead
        entry = np.where(entry < there, entry, 0)
        found, score = _beam(points, near, entry, asked, NEAR, there)
        among = np.where(np.eye(len(new), dtype=bool), -np.inf, asked @ asked.T).astype(np.float32)
        beside = np.argsort(-among, axis=1, kind="stable")[:, : min(CHOSEN, len(new) - 1)]
        candidates = np.concatenate([found, new[beside]], axis=1)
        best = np.argsort(-np.concatenate([score, np.take_along_axis(among, beside, 1)], axis=1), axis=1, kind="stable")[:, :NEAR]
        chosen = _thinned(points, new, np.take_along_axis(candidates, best, 1), CHOSEN)
        near[new, :CHOSEN] = chosen
        source, target = np.repeat(new, CHOSEN), chosen.reshape(-1)
        _tie_back(points, near, source[target >= 0], target[target >= 0])
        there += len(new)
    return near


def build(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The graph of one shard, lowest level first: (nodes of the level, neighbours of each as node numbers)."""
    level = _levels(np.arange(len(vectors)))
    order = np.argsort(-level, kind="stable")  # so the nodes of a level are the first ones, whatever the level
    points = vectors.astype(np.float32)[order]
    above: list[np.ndarray] = []
    graph = []
    for at in range(int(level.max(initial=0)), -1, -1):
        size = int(np.count_nonzero(level >= at))
        if size:
            above.append(_insert(points[:size], above))
            graph.append((order[:size].astype(np.int32), np.where(above[-1] >= 0, order[above[-1]], -1).astype(np.int32)))
    return graph[::-1]


def search(vectors: np.ndarray, graph: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """For each query the nodes of its beam by inner product, best first; -1 where the shard has fewer."""
    n = len(vectors)
    entry = np.full(len(queries), graph[-1][0][0])
    every = np.full((n, KEPT), -1, np.int32)
    for nodes, near in reversed(graph[1:]):
        every[nodes] = near
        entry = _walk(vectors, every, entry, queries)
    every[graph[0][0]] = graph[0][1]
    return _beam(vectors, every, entry, queries, beam, n)[0]


def _single(vectors: np.ndarray, axis: int | None) -> np.ndarray:
    """In single precision; all together, or each row, are scaled where components are too large for products, or too small to keep."""
    most = np.abs(vectors).max(axis=axis, keepdims=True, initial=np.finfo(float).tiny)
    return (vectors / np.where(most > 1e15, most / 1e15, np.where(most < 1e-9, most, 1.0))).astype(np.float32)


def _usable(vector: Column) -> Column:
    """Not null, finite throughout, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows of ``df`` with the largest inner product found for each query, but its own.

    Rows whose vector is null, zero, or holds a null or a number that is not finite
    take no part, nor do rows or queries with a null id, nor pairs of different
    length.  Ties go to the smaller id; rows that are equal in id and vector count
    once.  Equal vectors are one node that keeps its ``k + 1`` smallest ids, all
    that any query can need.  Scores are summed in double precision from the
    vectors as they are stored.  Other columns are not read.
    """
    spark = df.sparkSession
    vector = lambda c: F.col(c).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector(vector_col).alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), vector(vector_col).alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v"))).distinct()

    low = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.distinct().withColumn("low", low).where(F.col("low") <= k + 1)
    nodes = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-nodes")
    lengths = [r[0] for r in nodes.select(F.size("v")).distinct().limit(2).collect()]
    shards = max(MIN_SHARDS, -(-nodes.count() // SHARD_NODES))
    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    key = F.struct(F.size("v").alias("d"), shard.alias("s")) if len(lengths) > 1 else F.struct(F.lit(lengths[0] if lengths else 0).alias("d"), shard.alias("s"))

    graph_schema = pa.schema([("d", pa.int32()), ("s", pa.int32()), ("vectors", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary()), ("levels", pa.list_(pa.binary())), ("near", pa.list_(pa.binary()))])

    def make(shard: pa.Table) -> pa.Table:
        d = shard["d"][0].as_py()
        exact = np.frombuffer(b"".join(shard["raw"].to_pylist()), "<f8").reshape(-1, d)
        ids = shard["ids"].combine_chunks()
        graph = build(_single(exact, None))
        owners = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype("<i8")
        row = {
            "d": [d], "s": [shard["s"][0].as_py()], "vectors": [exact.tobytes()], "owners": [owners.tobytes()], "ids": [ids.flatten().to_numpy().astype("<i8").tobytes()],
            "levels": [[nodes.astype("<i4").tobytes() for nodes, _ in graph]], "near": [[near.astype("<i4").tobytes() for _, near in graph]],
        }
        return pa.Table.from_pydict(row, schema=graph_schema)

    def packed(batches: Iterator[pa.RecordBatch], extra: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(extra).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(extra).value_lengths().to_numpy())
            raw = [x.astype("<f8").tobytes() for x in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array(raw, pa.binary()), *batch.columns[extra + 1 :]], names=[*batch.schema.names[:extra], "raw", *batch.schema.names[extra + 1 :]])

    flat = nodes.select(key.alias("k"), "v", "ids").select("k.d", "k.s", "v", "ids").mapInArrow(lambda b: packed(b, 2), "d int, s int, raw binary, ids array<long>")
    index = written(flat.groupBy("d", "s").applyInArrow(make, "d int, s int, vectors binary, owners binary, ids binary, levels array<binary>, near array<binary>"), "hnsw")

    per = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK)))).cast("int")
    blocks = asked.select(F.size("v").alias("d"), per.alias("b"), "id", "v").mapInArrow(lambda b: packed(b, 3), "d int, b int, id long, raw binary")
    blocks = blocks.groupBy("d", "b").agg(F.collect_list(F.struct("id", "raw")).alias("q"))
    blocks = written(blocks.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), "hnsw-queries")

    hit_schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def find(asks: pa.Table, shard: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        for row in shard.to_batches(max_chunksize=1):
            d, raw, owners, ids, levels, near = (row.column(name)[0] for name in ("d", "vectors", "owners", "names", "levels", "near"))
            exact = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, d.as_py())
            points = _single(exact, None)
            owner, names = np.frombuffer(owners.as_buffer(), "<i8"), np.frombuffer(ids.as_buffer(), "<i8")
            graph = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(b.as_buffer(), "<i4").reshape(-1, KEPT)) for a, b in zip(levels.values, near.values, strict=True)]
            for block in (q for chunk in asks["q"].chunks for q in chunk):
                own = block.values.field("id").to_numpy(zero_copy_only=False)
                vec = np.stack([np.frombuffer(x, "<f8") for x in block.values.field("raw").to_pylist()])
                found = search(points, graph, _single(vec, 1), max(BEAM, k + 1))
                for i in range(len(own)):
                    hit = found[i][found[i] >= 0]
                    score = np.repeat(exact[hit] @ vec[i], owner[hit + 1] - owner[hit])
                    every = np.concatenate([names[owner[h] : owner[h + 1]] for h in hit])
                    score, every = score[every != own[i]], every[every != own[i]]
                    order = np.lexsort((every, -score))[:k]
                    out_q.append(np.full(len(order), own[i]))
                    out_i.append(every[order])
                    out_s.append(score[order])
        none = [np.zeros(0)]
        return pa.Table.from_arrays([pa.array(np.concatenate(x or none), t) for x, t in ((out_q, pa.int64()), (out_i, pa.int64()), (out_s, pa.float64()))], schema=hit_schema)

    # a shard goes once to each group of blocks, and is read once there
    groups = max(1, -(-asked.count() // (QUERY_BLOCK * GROUPED)))
    group = F.pmod("b", F.lit(groups)).alias("g")
    there = index.withColumnRenamed("ids", "names").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    hits = blocks.select("d", "s", group, "q").groupBy("d", "s", "g").cogroup(there.groupBy("d", "s", "g")).applyInArrow(find, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
