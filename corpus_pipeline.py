"""The training-data pipeline over ``documents``: each stage reads what the one before it kept.

Between stages the rows are a Parquet table in the cluster's shared folder, so a
lost executor costs a stage's tasks and never the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import decontaminate, language_id, near_dedup, pii, word_bpe
from ruleloom.llm.registry import tokenizer
from ruleloom.llm.storage import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language, or in none with confidence."""
    aside = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    column = {name: F.col(f"c{k}") for k, name in enumerate(docs.columns)}
    found = language_id.identify(aside, f"c{docs.columns.index('text')}", column["lang"], column["source"], prefix="_found_")
    return found.where("_found_accepted").select(*aside.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-duplicates the document with the least id."""
    return near_dedup.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of each span of personal data; all documents stay."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and their digest, and the digest of the text they decode to."""
    return word_bpe.digests(word_bpe.encode_decode(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("personal data", redact_personal_data),
    ("BPE encoding", encode),
]

#: ProbMinHash classes, fused posteriors and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
