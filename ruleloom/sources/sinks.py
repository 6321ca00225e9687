"""Tables written in order and taken over as a whole: a version is written beside the old one, then named as the current."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, at, at.getFileSystem(conf), conf


def refuse(problems: DataFrame | None, most: int = 5) -> None:
    """Raises with the first ``most`` problems if there are any; a problem's first column says what it is."""
    if problems is not None and (found := problems.limit(most).collect()):
        raise ValueError("not written: " + "; ".join(str(r[0]) for r in found))


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the version that counts; null before the first."""
    pkg, _, fs, _ = _fs(spark, path)
    at = pkg.Path(f"{path}/{CURRENT}")
    return spark.read.text(f"{path}/{CURRENT}").first()[0] if fs.exists(at) else None


def _commit(spark: SparkSession, path: str, version: str) -> None:
    """Names a version as the current one, by one rename that replaces the old name."""
    pkg, _, fs, conf = _fs(spark, path)
    made = pkg.Path(f"{path}/.{CURRENT}-{version}")
    out = fs.create(made, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = pkg.FileContext.getFileContext(fs.getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(made), fs.makeQualified(pkg.Path(f"{path}/{CURRENT}")), overwrite)


def write_ordered(df: DataFrame, order: list[str], path: str, problems: DataFrame | None = None) -> str:
    """Writes JSON lines whose files, in order of their names, hold the rows in ``order``; returns the version's name.

    Rows go to tasks by range of the order, so no task sorts the whole. With a problem nothing is written. Until the
    last step readers see the old version, and an interrupted write leaves it; the version before the old one is deleted.
    """
    refuse(problems)
    spark, version, old = df.sparkSession, f"v-{uuid.uuid4().hex[:12]}", current(df.sparkSession, path)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", False).json(f"{path}/{version}")
    _commit(spark, path, version)
    pkg, at, fs, _ = _fs(spark, path)
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("v-") and name not in (version, old):
            fs.delete(x.getPath(), True)
    return version


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the current version."""
    version = current(spark, path)
    return spark.read.schema(schema).json(f"{path}/{version}") if version else spark.createDataFrame([], schema)
