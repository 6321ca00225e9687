"""Language identification by Bayesian fusion of what the text, its markup and its address say.

Four pieces of evidence are taken for independent given the language and their
logarithms added:

* the text: byte trigrams without a digit of the lower-cased text, hashed to BUCKETS,
  under one multinomial per language counted over all rows that declare that language, and
  tempered by TEMPER since neighbouring trigrams are not independent;
* the declared language: how often rows whose text says ``l`` declare ``d``;
* the address suffix and the host: shares of the languages by text alone, each host
  smoothed towards its suffix and each suffix towards all rows by SMOOTHING rows.

A class ``und`` stands beside the languages: its trigrams are uniform, so a text in
no known language, or none at all, ends there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import SLICE_BYTES
from .storage import written
from .worker import begin

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 13
TEMPER = 0.3
SMOOTHING = 20.0
UNDETERMINED = "und"
UNDETERMINED_PRIOR = 0.01
MIN_POSTERIOR = 0.5


def trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of runs of texts: number of the first, buckets of all their trigrams, where each text's begin (and the end)."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        b = data[offsets[at] : offsets[end]].astype(np.uint32)
        sizes = np.maximum(np.diff(offsets[at : end + 1]) - 2, 0)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if begins[-1]:
            code = ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 13)
            inside = np.ones(len(b), bool)
            for back in (1, 2):
                ends = offsets[at + 1 : end + 1] - offsets[at] - back
                inside[ends[ends >= offsets[at:end] - offsets[at]]] = False
            digit = (b >= ord("0")) & (b <= ord("9"))  # numbers and keys are in no language
            told = ~(digit[:-2] | digit[1:-1] | digit[2:])[inside[: len(code)]]
            code = code[inside[: len(code)]][told]
            begins = np.concatenate([[0], np.cumsum(told)])[begins]
        else:
            code = np.zeros(0, np.uint32)
        yield at, code, begins
        at = end


def text_model(df: DataFrame, text_col: str, declared: Column, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities (language, bucket), each smoothed by one half, and a uniform last row for ``und``.

    Counted over every row that declares one of ``languages``; what reaches the driver is one number a language and bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        totals = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            label = pc.fill_null(pc.index_in(batch.column(0), pa.array(languages)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, code, begins in trigrams(batch.column(1)):
                mine = np.repeat(label[first : first + len(begins) - 1], np.diff(begins))
                totals += np.bincount(mine[mine >= 0] * BUCKETS + code[mine >= 0], minlength=len(totals))
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], names=["cell", "n"])

    rows = df.select(declared.alias("declared"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(languages) * BUCKETS)
    for cell, n in rows:
        counts[cell] = n
    counts = counts.reshape(len(languages), BUCKETS) + 0.5
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.vstack([model, np.full((1, BUCKETS), -np.log(BUCKETS))])


def text_scores(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """Tempered log-likelihood of each text under each row of the model; zeros where there is no trigram."""
    out = np.zeros((len(column), len(model)))
    for first, code, begins in trigrams(column):
        full = np.flatnonzero(np.diff(begins) > 0)
        if len(full):
            for k, row in enumerate(model):
                out[first + full, k] = np.add.reduceat(row[code], begins[full])
    return TEMPER * out


def declared_in_markup(html: Column) -> Column:
    """The primary language subtag of the ``lang`` attribute of ``<html>``, lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]+)", 1)), F.lit(""))


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and its suffix (what follows the last dot), lower case; null where the address has none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return host, F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def visible_text(html: Column) -> Column:
    """Markup blanked out: scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def identify(
    df: DataFrame, text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, languages: tuple[str, ...] = LANGUAGES, prefix: str = ""
) -> DataFrame:
    """``df`` with ``{prefix}language``, ``{prefix}posterior`` and ``{prefix}accepted`` added.

    A row is accepted where its language is not ``und`` and has a posterior of
    MIN_POSTERIOR at least.  A null declaration, suffix or host says nothing; a
    declaration that is none of ``languages`` counts as one value "other".  A text
    without a letter (null, empty, numbers) is ``und``; one too short for a trigram
    rests on the other evidence; a very long one is read whole.  Ties go to the language
    first in order, ``und`` last.  Repeated rows count as often as they occur.  A
    column of ``df`` that already has an added name is replaced.

    Rows go through unshuffled unless the table of hosts is too large to broadcast;
    then they are joined on the host, whose large partitions Spark can split.
    """
    declared = F.lit(None).cast("string") if declared is None else declared
    host = F.lit(None).cast("string") if host is None else host.cast("string")
    suffix = F.lit(None).cast("string") if suffix is None else suffix.cast("string")
    declared = F.when(declared.isin(*languages), declared).when(declared.isNotNull(), F.lit("other"))
    classes, said = [*languages, UNDETERMINED], [*languages, "other"]
    model = text_model(df, text_col, declared, languages)
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            scores = text_scores(batch.column(3), shipped.value)
            top = np.where(scores.any(axis=1), scores.argmax(axis=1), len(languages))  # without a trigram the text says nothing
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(top, pa.int32())], names=["h", "s", "d", "best"])

    counts = df.select(host.alias("h"), suffix.alias("s"), declared.alias("d"), F.col(text_col).cast("string")).mapInArrow(best, "h string, s string, d string, best int")
    counts = written(counts.groupBy("h", "s", "d", "best").agg(F.count("*").alias("n")), "language-counts")

    seen = {(r.d, r.best): r.n for r in counts.groupBy("d", "best").agg(F.sum("n").alias("n")).collect()}
    every = [sum(n for (_, b), n in seen.items() if b == k) for k in range(len(languages))]
    overall = [(n + 1) / (sum(every) + len(every)) for n in every]
    by_text = [[seen.get((d, k), 0) + 1 for d in said] for k in range(len(classes))]
    marginal = [sum(row[j] for row in by_text) for j in range(len(said))]
    given = {d: [float(np.log(by_text[k][j] / sum(by_text[k]))) for k in range(len(languages))] + [float(np.log(marginal[j] / sum(marginal)))] for j, d in enumerate(said)}

    def shares(keys: list[str], tag: str) -> DataFrame:
        found = counts.where(F.col("best") < len(languages))
        return found.groupBy(*keys).agg(*[F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)).alias(f"{tag}{k}") for k in range(len(languages))])

    def smoothed(tag: str, towards: list[Column]) -> list[Column]:
        n = [F.coalesce(F.col(f"{tag}{k}"), F.lit(0)) for k in range(len(languages))]
        total = sum(n[1:], n[0])
        return [(n[k] + SMOOTHING * towards[k]) / (total + SMOOTHING) for k in range(len(languages))]

    ranges = range(len(languages))
    by_suffix = shares(["s"], "sn").select("s", *[x.alias(f"sp{k}") for k, x in enumerate(smoothed("sn", [F.lit(p) for p in overall]))])
    known = counts.select("h", "s").distinct().join(shares(["h", "s"], "hn").withColumnsRenamed({"h": "h2", "s": "s2"}), F.col("h").eqNullSafe(F.col("h2")) & F.col("s").eqNullSafe(F.col("s2")), "left").drop("h2", "s2")
    known = known.join(by_suffix.withColumnRenamed("s", "s2"), F.col("s") == F.col("s2"), "left")
    wider = [F.coalesce(F.col(f"sp{k}"), F.lit(overall[k])) for k in ranges]
    own = [F.when(F.col("h").isNull(), wider[k]).otherwise(x) for k, x in enumerate(smoothed("hn", wider))]
    priors = written(known.select(F.col("h").alias("_h"), F.col("s").alias("_s"), F.array(*[F.log(x * (1 - UNDETERMINED_PRIOR)) for x in own], F.lit(float(np.log(UNDETERMINED_PRIOR)))).alias("_prior")), "language-priors")

    names = [f"{prefix}{x}" for x in ("language", "posterior", "accepted")]
    kept = [c for c in df.columns if c not in names]
    text_at = len(kept) + 4
    wide = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], host.alias("_host"), suffix.alias("_suffix"), declared.alias("_declared"), (~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"\p{L}")).alias("_empty"), F.col(text_col).cast("string").alias("_text"))
    out = T.StructType([*wide.schema.fields[:text_at], T.StructField("_scores", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            scores = text_scores(batch.column(text_at), shipped.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * scores.shape[1], pa.int32()), pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], lists], names=out.names)

    scored = wide.mapInArrow(score, out).join(priors, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_suffix").eqNullSafe(F.col("_s")), "left")
    says = F.create_map(*[x for d in said for x in (F.lit(d), F.array(*map(F.lit, given[d])))])
    silent = F.array(*[F.lit(0.0)] * len(classes))
    fused = F.zip_with(F.zip_with("_scores", "_prior", lambda a, b: a + b), F.coalesce(says[F.col("_declared")], silent), lambda a, b: a + b)
    scored = scored.withColumn("_fused", fused).withColumn("_top", F.array_max("_fused"))
    empty = F.col("_empty")
    at = F.when(empty, F.lit(len(languages))).otherwise(F.array_position("_fused", F.col("_top")).cast("int") - 1)
    posterior = F.when(empty, F.lit(1.0)).otherwise(1 / F.aggregate("_fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top"))))
    scored = scored.withColumn("_at", at).withColumn("_posterior", posterior)
    return scored.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        F.element_at(F.array(*map(F.lit, classes)), F.col("_at") + 1).alias(names[0]),
        F.col("_posterior").alias(names[1]),
        ((F.col("_at") < len(languages)) & (F.col("_posterior") >= MIN_POSTERIOR)).alias(names[2]),
    )
