"""Readers and writers with declared schemas: nothing is inferred, nothing is collected."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sinks import refuse

MANIFEST = "doc_id string, jurisdictions string, url string, source_type string, capture string, retrieved_at string, sha256 string, text_file string, status string"
ADDRESSES = "address_id string, street_address string, postal_city string, state string, zip string, year_built string, units string, use_code string, use_description string, source_dataset string, retrieved_at string"
AUDIT = "ts string, stage string, decision string, reason string, detail string"


#: Fixed value: rows that a task sorts or groups at once, on average.
ROWS_A_PART = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by their keys in as many parts as they call for, so that what a task sorts or groups doesn't grow with the table.

    Rows that need no more parts than a shuffle surely has, though Spark may join its small ones, stay as they are.
    They are counted first, which for a file's own columns reads its footers alone.
    """
    spark, parts = rows.sparkSession, -(-rows.count() // ROWS_A_PART)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys) if parts > least else rows


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"')


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str, under: str | None = None) -> DataFrame:
    """A JSON array, or the array under one key of a JSON object."""
    if under is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.schema(f"`{under}` array<struct<{schema}>>").json(path, multiLine=True).select(F.inline(under))


def dimension(text: str) -> list | dict:
    """A small YAML file kept by hand; without a YAML library it has to keep to JSON's syntax, comment lines aside."""
    try:
        import yaml
    except ImportError:
        return json.loads("\n".join(x for x in text.splitlines() if not x.lstrip().startswith("#")))
    return yaml.safe_load(text)


def yaml_rows(spark: SparkSession, path: str, schema: str, under: str | None = None) -> DataFrame:
    """The list of a YAML file, or that under one key of it, as rows; read by Spark, so from any store it knows."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    found = dimension(text)
    rows = [(json.dumps(x),) for x in (found[under] if under is not None else found)]
    return spark.createDataFrame(rows, "x string").select(F.from_json("x", schema).alias("x")).select("x.*")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text, sha256, problem)`` of every file that isn't empty (Spark lists no others); bytes that aren't UTF-8 are a problem and have no text."""
    files = spark.read.format("binaryFile").load(path)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(good, F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"), F.when(~good, "not UTF-8").alias("problem"))


def manifest_union(first: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of both; of one key those of ``first`` win, and one row stays."""
    rows = first.withColumn("_origin", F.lit(0)).unionByName(more.withColumn("_origin", F.lit(1)))
    own = Window.partitionBy(key).orderBy("_origin", *[c for c in first.columns if c != key])
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_origin")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_checked(df: DataFrame, problems: DataFrame, path: str) -> None:
    """Writes only if ``problems`` has no row.

    The new table is whole before the old one steps aside (as ``path.old``) and is deleted last; if
    the new one can't take its place the old one returns.
    """
    refuse(problems)
    new, aside = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at, made, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, aside))
    system = at.getFileSystem(conf)
    if system.exists(at):
        system.delete(old, True)
        if not system.rename(at, old):
            raise OSError(f"{path} could not be moved aside")
    if not system.rename(made, at):
        system.rename(old, at)
        raise OSError(f"{new} could not be moved to {path}")
    system.delete(old, True)
