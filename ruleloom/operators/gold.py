"""Reviewed passages matched with ours by where they stand in a document, and what share of them agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between two passages that still belong together; characters of a bin.
GAP, BIN = 200, 1024


def matched(gold: DataFrame, ours: DataFrame, gap: int = GAP, width: int = BIN) -> DataFrame:
    """``(gold_id, rule_id, overlap, gap)`` of every gold passage: the one of ours that overlaps it most, else the nearest within ``gap``; nulls if there is none.

    ``gold(gold_id, doc_id, start, end, category)``, ``ours(rule_id, doc_id, start, end, category)``, ends exclusive; a
    gold id may have several passages. Ties: the same category, then the greatest id.
    Passages are dealt to bins of the text, so those of one document meet only their
    neighbours, however many it has; a pair that shares bins is met in its first one.
    """
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    first = lambda a: F.floor(a / width)
    g = gold.select("gold_id", "doc_id", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("category").alias("gc"), F.explode(bins(F.col("start"), F.greatest(F.col("end"), F.col("start")))).alias("bin"))
    low, high = F.greatest(F.col("start") - gap, F.lit(0)), F.greatest(F.col("end"), F.col("start")) + gap
    o = ours.select("rule_id", "doc_id", F.col("start").alias("os"), F.col("end").alias("oe"), F.col("category").alias("oc"), first(low).alias("from"), F.explode(bins(low, high)).alias("bin"))
    met = g.join(o, ["doc_id", "bin"]).where((F.col("bin") == F.greatest(first(F.col("gs")), F.col("from"))))
    room = F.least("ge", "oe") - F.greatest("gs", "os")
    met = met.withColumn("overlap", F.greatest(room, F.lit(0))).withColumn("away", F.greatest(-room, F.lit(0))).where((F.col("overlap") > 0) | (F.col("away") <= gap))
    best = met.groupBy("gold_id").agg(F.max(F.struct("overlap", (-F.col("away")).alias("near"), F.coalesce(F.col("gc") == F.col("oc"), F.lit(False)).alias("same"), "rule_id")).alias("x"))
    return gold.select("gold_id").distinct().join(best, "gold_id", "left").select("gold_id", F.col("x.rule_id").alias("rule_id"), F.col("x.overlap").alias("overlap"), (-F.col("x.near")).alias("gap"))


def accuracy(matches: DataFrame, gold: DataFrame, ours: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """``(by, gold, matched, *fields)``: how many gold records have a match, and of each field how many agree; nulls agree with nulls."""
    rows = gold.select("gold_id", by, *[F.col(f).alias(f"_{f}") for f in fields]).join(matches.select("gold_id", "rule_id"), "gold_id").join(ours.select("rule_id", *fields), "rule_id", "left")
    agree = [F.count_if(F.col("rule_id").isNotNull() & F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f) for f in fields]
    return rows.groupBy(by).agg(F.count("*").alias("gold"), F.count("rule_id").alias("matched"), *agree)


def result_class(expected: Column, got: Column, also: Column | None = None) -> Column:
    """correct, over_cautious (unknown for a definite answer), missed (no row for one that is expected), or wrong; a null ``got`` is no row."""
    got = F.coalesce(got, F.lit("absent"))
    right = (got == expected) | (F.coalesce(F.array_contains(also, got), F.lit(False)) if also is not None else F.lit(False))
    return F.when(right, "correct").when(got == "unknown", "over_cautious").when(got == "absent", "missed").otherwise("wrong")


def city_class(expected: Column, got: Column) -> Column:
    """skipped (the reviewer was uncertain), correct, unresolved (none for one that is expected), or wrong; ``none`` expects no city."""
    return F.when(expected == "uncertain", "skipped").when(got.eqNullSafe(F.when(expected != "none", expected)), "correct").when(got.isNull(), "unresolved").otherwise("wrong")
