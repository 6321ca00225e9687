"""Shards of near-equal bytes, where documents of one text stay together, by Karmarkar-Karp differencing.

An item starts as a partial partition: its size in one shard, nothing in the others.
The two partial partitions of largest spread are combined, the fullest shard of one
with the emptiest of the other, until one is left; what each combination did is then
read backwards and says the shard of every item.

Items are groups of equal texts.  A group of over ``1 / FINE`` of a shard's share is an
item of its own, and there can't be more than ``shards * FINE`` of those; the smaller
ones fall into ``shards * BUNDLES`` bundles by their digest, and a bundle is an item.  So
what is differenced is bounded by two constants at any size of the corpus, and a
bundle weighs a small part of a shard.  A document finds its shard by its digest in
two tables of those bounds; no text and no row is shuffled for it.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

#: A group above this part of a shard's share of bytes is placed by itself.
FINE = 1024
#: Bundles of small groups, for each shard.
BUNDLES = 64
#: Rows that one numbering sorts, on average.
RUN_ROWS = 65_536
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def differenced(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; items of one size go by their place in ``sizes``, so equal input gives equal output."""
    n = len(sizes)
    sums: list[np.ndarray | None] = [np.concatenate([[s], np.zeros(shards - 1, np.int64)]) for s in np.asarray(sizes, np.int64)]
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order] - total[order[-1]]
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(total[0]), n + len(joined)))
        sums.append(total)
        joined.append((a, b, order))
    places: dict[int, np.ndarray] = {n + len(joined) - 1: np.arange(shards)}
    for k in range(len(joined) - 1, -1, -1):
        a, b, order = joined[k]
        own = np.empty(shards, np.int64)
        own[order] = places.pop(n + k)
        places[a], places[b] = own, own[::-1]
    return np.array([places[k][0] for k in range(n)], np.int64)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(_text(text_col), 256))


def _bundle(shards: int) -> Column:
    return F.pmod(F.xxhash64("_digest"), F.lit(shards * BUNDLES))


def _placed(rows: DataFrame, shards: int, fixed: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Adds ``_shard`` to rows with ``_digest``: of the group if it is placed by itself, else of its bundle."""
    alone, bundles = fixed
    found = rows.withColumn("_bundle", _bundle(shards)).join(F.broadcast(alone), "_digest", "left").join(F.broadcast(bundles), "_bundle", "left")
    return found.withColumn("_shard", F.coalesce("_alone", "_of_bundle")).drop("_bundle", "_alone", "_of_bundle")


def plan(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The two tables of bounded size that place rows ``(_digest, _size)``: ``(_digest, _alone)`` and ``(_bundle, _of_bundle)``.

    The driver gets fewer than ``shards * (FINE + BUNDLES)`` rows, whatever the input.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("_size")).first()[0] or 0
    groups = rows.groupBy("_digest").agg(F.sum("_size").alias("bytes"))
    large = groups.where(F.col("bytes") > F.lit(total) / (shards * FINE)).withColumn("bundle", _bundle(shards)).collect()
    left = np.zeros(shards * BUNDLES, np.int64)
    for bundle, size in rows.groupBy(_bundle(shards)).agg(F.sum("_size")).collect():
        left[bundle] = size
    for r in large:
        left[r.bundle] -= r.bytes
    large.sort(key=lambda r: (-r.bytes, bytes(r._digest)))
    shard = differenced(np.concatenate([np.array([r.bytes for r in large], np.int64), left]), shards).tolist()
    alone = spark.createDataFrame([(r._digest, s) for r, s in zip(large, shard, strict=False)], "_digest binary, _alone int")
    return alone, spark.createDataFrame(list(enumerate(shard[len(large) :])), "_bundle long, _of_bundle int")


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` of every row; law is ``bytes`` and ``grown_shard`` null.

    Size: UTF-8 bytes of the text and eight more.  A null text is an empty one: size
    eight, crc 0, one group with the empty texts.  Rows that repeat an id or a whole
    row each get a slot of their own; null ids are allowed.  A group that outweighs a
    shard's share has a shard to itself, as far as sizes go.  Slots count from 0 without a gap; runs of rows are
    numbered apart, so a shard with a third of all rows takes many tasks.  An empty
    table gives no rows; other columns, whatever their names, aren't read.
    """
    text = _text(text_col)
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    slim = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), _digest(text_col).alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    slim = written(slim, "sharded")
    rows = _placed(slim, shards, plan(slim, shards))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = max(4 * parts, -(-slim.count() // RUN_ROWS))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_digest", F.coalesce(F.col("_id").cast("string"), F.col("_row").cast("string"))), F.lit(runs)))
    sizes = rows.groupBy("_shard", "_run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).groupBy("_run").agg(F.map_from_entries(F.collect_list(F.struct("_shard", "before"))).alias("_starts"))
    own = F.row_number().over(Window.partitionBy("_run", "_shard").orderBy("_id", "_digest", "_row")) - 1
    slot = (F.element_at("_starts", F.col("_shard")) + own).cast("long")
    rows = rows.join(starts, "_run").withColumn("_slot", slot)
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = 24, text_col: str = "text") -> DataFrame:
    """Writes ``docs``, all columns, into folders ``shard_no=0`` and on of ``folder``; returns them read back, with ``shard_no``.

    The shards are those of :func:`assign`.  A shard is written by as many tasks as
    its share of the rows calls for.  Nulls, repeats and an empty table are as there.
    """
    spark = docs.sparkSession
    names = [f"c{k}" for k in range(len(docs.columns))]
    aside = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    rows = aside.withColumn("_digest", _digest(text)).withColumn("_size", (F.octet_length(_text(text)) + OVERHEAD).cast("long"))
    placed = _placed(rows, shards, plan(written(rows.select("_digest", "_size"), "shard-sizes"), shards))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*names), F.lit(max(1, parts // shards)))
    out = placed.drop("_digest", "_size").withColumnRenamed("_shard", "shard_no").repartition(parts, "shard_no", spread)
    out.write.partitionBy("shard_no").parquet(folder)
    read = spark.read.schema(out.schema).parquet(folder)
    return read.select(*[F.col(c).alias(name) for c, name in zip(names, docs.columns, strict=True)], "shard_no")
