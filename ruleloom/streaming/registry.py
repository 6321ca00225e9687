"""A registry of documents that takes batches: one entry a content, one content an address, ids that stay.

Entries lie in folders by the first signs of their content's digest and, a second time, by those of their
address's, so a batch reads the few folders that its own rows can meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

ENTRY = "id long, sha string, url string, jurisdiction string, batch long"
INCOMING = "url string, text string, jurisdiction string"
#: Hexadecimal digits of a folder's name: 4,096 folders.
DIGITS = 3


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _state(jurisdiction: Column) -> Column:
    return F.substring_index(jurisdiction, ", ", -1)


def decided(batch: DataFrame, entries: DataFrame, manifest: DataFrame, last: int, number: int) -> DataFrame:
    """``(url, sha, decision, id, jurisdiction, note, batch)`` of every distinct row of a batch.

    ``batch(url, text, jurisdiction)``; ``entries`` those of the registry that share a content or an address with it;
    ``manifest(url, jurisdiction, has_text)`` what the corpus began with.  Decisions, the first that holds:
    ``registered`` (same content and address: the known id), ``refused`` (with the reason as note), ``new``.
    Refused are: a known content under another address; an address with another content, in
    the registry, in the manifest or earlier in the batch (contents in order of their
    digests); a jurisdiction that is no ``ST`` or ``City, ST`` of the manifest's states,
    differs from the address's known one, or is unknown.  New ids follow ``last`` in order of digests.
    """
    flat = F.nullif(F.trim(F.regexp_replace("jurisdiction", r"\s+", " ")), F.lit(""))
    rows = batch.select(F.trim("url").alias("url"), _digest(F.col("text")).alias("sha"), flat.alias("given")).groupBy("url", "sha").agg(F.min("given").alias("given"))
    by_sha = entries.groupBy("sha").agg(F.min(F.struct("id", "url", "jurisdiction")).alias("k"))
    by_url = entries.groupBy("url").agg(F.min("sha").alias("other"), F.min("jurisdiction").alias("at_url"))
    begun = manifest.groupBy("url").agg(F.max("has_text").alias("has_text"), F.array_sort(F.collect_set("jurisdiction")).alias("told"))
    states = manifest.select(_state(F.col("jurisdiction")).alias("s")).distinct()
    rows = rows.join(by_sha, "sha", "left").join(by_url, "url", "left").join(begun, "url", "left")
    rows = rows.withColumn("jurisdiction", F.coalesce("given", F.when(F.size("told") == 1, F.get("told", F.lit(0)))))
    rows = rows.join(states, _state(F.col("jurisdiction")) == F.col("s"), "left")
    # addresses are unique within the batch too: the first content of one that nobody has refused so far
    contents = Window.partitionBy("url").orderBy("sha")
    places = Window.partitionBy("sha").orderBy("url")
    rows = rows.withColumn("nth", F.row_number().over(contents)).withColumn("mth", F.row_number().over(places))
    told = F.coalesce(F.size("told"), F.lit(0)) > 0
    known = F.col("k.id").isNotNull()
    no = (
        F.when(known & (F.col("k.url") != F.col("url")), "content is known under another address").when(known & F.col("given").isNotNull() & ~F.col("given").eqNullSafe(F.col("k.jurisdiction")), "registered with another jurisdiction")
        .when(known, None).when(F.col("other").isNotNull(), "address has another content").when(F.col("has_text"), "the manifest has this document").when(F.col("nth") > 1, "address comes with another content").when(F.col("mth") > 1, "content comes under another address")
        .when(F.col("jurisdiction").isNull(), "jurisdiction unknown").when(~F.col("jurisdiction").rlike("^(?:[^,]+, )?[A-Z]{2}$"), "no such jurisdiction").when(F.col("s").isNull(), "state not in the manifest")
        .when(told & ~F.array_contains("told", F.col("jurisdiction")), "differs from the manifest's")
    )
    rows = rows.withColumn("no", no).withColumn("decision", F.when(F.col("no").isNotNull(), "refused").when(known, "registered").otherwise("new"))
    fresh = rows.where("decision = 'new'").withColumn("part", F.substring("sha", 1, DIGITS))
    sizes = fresh.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ids = fresh.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("sha"))).join(before, "part").select("url", "sha", (F.lit(last) + F.col("before") + F.col("own")).alias("fresh"))
    note = F.coalesce("no", F.when(known, "registered before"), F.when(told, "supplies a text that the manifest lacks"))
    out = rows.join(ids, ["url", "sha"], "left")
    own = F.when(F.col("decision") == "registered", F.col("k.jurisdiction")).otherwise(F.col("jurisdiction"))
    return out.select("url", "sha", "decision", F.when(F.col("decision") == "registered", F.col("k.id")).otherwise(F.col("fresh")).alias("id"), own.alias("jurisdiction"), note.alias("note"), F.lit(number).cast("long").alias("batch"))


def _touched(spark: SparkSession, root: str, number: int, names: list[str]) -> DataFrame:
    """Entries of earlier batches in the named folders; only those folders are listed and read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = [f"{root}/part={name}" for name in names]
    there = [p for p in at if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    read = spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(*there) if there else spark.createDataFrame([], ENTRY)
    return read.where(F.col("batch") < number)


def _put(entries: DataFrame, by: Column, root: str, number: int) -> None:
    """Adds a batch's entries under ``root``, in a folder of its number in each part; a retry writes the same folders over."""
    rows = entries.withColumn("part", F.substring(by, 1, DIGITS)).withColumn("in_batch", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "in_batch").parquet(root)


def ingest(spark: SparkSession, source: str, registry: str, manifest: DataFrame, checkpoint: str) -> StreamingQuery:
    """Reads new JSON lines ``(url, text, jurisdiction)`` under ``source`` into the registry; decisions of each batch go to ``decisions``.

    The last id of a batch is in the next one's start: a number a batch, never a scan.
    A batch that is run again writes its own folders over.
    """
    stream = spark.readStream.schema(INCOMING).json(source)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("sha", _digest(F.col("text"))).persist()
        parts = lambda c: [r[0] for r in rows.select(F.substring(c, 1, DIGITS)).distinct().collect()]
        of_url = F.sha2(F.coalesce(F.trim("url"), F.lit("")), 256)
        known = _touched(spark, f"{registry}/by-content", number, parts(F.col("sha"))).unionByName(_touched(spark, f"{registry}/by-address", number, parts(of_url))).distinct()
        counted = spark.read.schema("batch long, last long").option("recursiveFileLookup", True).json(f"{registry}/counts")
        last = counted.where(F.col("batch") < number).agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
        told = decided(batch, known, manifest, last, number).persist()
        told.write.mode("overwrite").parquet(f"{registry}/decisions/batch-{number:08d}")
        new = told.where("decision = 'new'").select("id", "sha", "url", "jurisdiction", "batch")
        _put(new, F.col("sha"), f"{registry}/by-content", number)
        _put(new, F.sha2(F.coalesce("url", F.lit("")), 256), f"{registry}/by-address", number)
        new.agg(F.lit(number).cast("long").alias("batch"), F.coalesce(F.max("id"), F.lit(last)).alias("last")).write.mode("overwrite").json(f"{registry}/counts/batch-{number:08d}")
        told.unpersist()
        rows.unpersist()

    start = spark.createDataFrame([(-1, 0)], "batch long, last long")
    start.write.mode("overwrite").json(f"{registry}/counts/start")
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"registry-{uuid.uuid4().hex[:8]}").start()
