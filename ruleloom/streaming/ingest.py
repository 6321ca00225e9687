"""Incremental ingest as a stream: files arrive, each batch is registered once, ids stay what they were."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

REGISTRY = "id long, sha string, url string, text string, batch long"


def register(batch: DataFrame, known: DataFrame, number: int) -> DataFrame:
    """Rows of ``batch(url, text)`` that are new by content, with ids after the greatest known one.

    Equal contents in one batch are one document, that of the least address, a missing one last.  Ids
    follow the order of content digests, so a batch that is run again gives the same.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    one = batch.withColumn("sha", sha).groupBy("sha").agg(F.min(F.struct(F.col("url").isNull().alias("no"), "url", "text")).alias("x")).select("sha", "x.text", "x.url")
    new = one.join(known.select("sha"), "sha", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # ids within ranges of the digest: a count a range, then a running number inside it
    new = new.withColumn("part", F.substring("sha", 1, 2))
    sizes = new.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("sha"))
    return new.join(F.broadcast(before), "part").select((F.lit(top) + F.col("before") + own).alias("id"), "sha", "url", "text", F.lit(number).cast("long").alias("batch"))


def ingest(spark: SparkSession, source: str, registry: str, checkpoint: str) -> StreamingQuery:
    """Reads new JSON lines ``(url, text)`` under ``source`` and adds what is new to the Parquet table ``registry``.

    A batch goes to a folder named by its number, written over on a retry, so each counts once.
    """
    os.makedirs(registry, exist_ok=True) if "://" not in registry else None
    stream = spark.readStream.schema("url string, text string").json(source)

    def merge(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(REGISTRY).option("recursiveFileLookup", True).parquet(registry).where(F.col("batch") < number)
        register(batch, known, number).write.mode("overwrite").parquet(f"{registry}/batch-{number:08d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"ingest-{uuid.uuid4().hex[:8]}").start()


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts by hour and type, for streams and tables alike; a stream drops what is later than ``late``."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
