"""Rules for parcels on a day: jurisdiction join, coverage, status, precedence, conflicts, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..functions import tristate as tri
from .predicates import coverage, missing_facts, outcome

RESULT_ORDER = ("applies", "superseded", "unknown", "not_yet_effective", "pending")


def jurisdiction_pairs(parcels: DataFrame, rules: DataFrame) -> DataFrame:
    """Each parcel with the rules of its state and of its city: two equi-joins, for levels don't overlap.

    Rules grow with places, not with parcels: while they are few, Spark broadcasts them and parcels stay where they are.
    """
    own = rules.drop("state")
    state = parcels.join(own.where("level = 'state'"), F.col("jurisdiction") == F.col("state"))
    city = parcels.join(own.where("level = 'city'"), F.col("jurisdiction") == F.col("city"))
    return state.unionByName(city)


def base_results(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``result``, ``presumed`` and ``missing``; failed rules and those that don't cover the parcel go."""
    strict, lenient = coverage(as_of)
    rows = pairs.withColumn("strict", strict).withColumn("lenient", lenient)
    value, presumed = outcome(F.col("strict"), F.col("lenient"))
    rows = rows.withColumn("value", value).withColumn("presumed", presumed).withColumn("missing", missing_facts(F.col("strict")))
    status = dates.status_on(F.col("hint"), F.col("effective"), as_of)
    result = (
        F.when(status.isin("pending", "not_yet_effective"), status)
        .when((F.col("level") == "city") & (F.col("confidence") == "low"), "unknown")
        .when(F.col("value") == tri.TRUE, "applies")
        .otherwise("unknown")
    )
    return rows.where((F.col("value") != tri.FALSE) & (F.col("hint") != "failed")).withColumn("result", result).drop("strict", "lenient", "value")


def with_precedence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """State rules that defer yield to city rules of their category, in one pass over rows grouped by ``keys`` and category.

    A city rule that applies and says whom it covers supersedes; one that may apply
    makes the state rule unknown.  Adds ``superseded_by`` and ``conflict``: two rules
    that contradict one another are both flagged while either can hold.
    """
    group = Window.partitionBy(*keys, "category")
    city = F.col("level") == "city"
    sure = city & (F.col("result") == "applies") & (F.col("form") > 0)
    first = F.min(F.when(sure, F.col("rule_id"))).over(group)
    maybe = F.max(city & ~sure & F.col("result").isin("applies", "unknown")).over(group)
    live = F.col("result").isin("applies", "unknown")
    yields = F.col("defers") & (F.col("result") == "applies")
    rows = rows.withColumn("_first", first).withColumn("_maybe", maybe)
    rows = rows.withColumn("_city", F.max(city & live).over(group)).withColumn("_against", F.max(F.col("conflicts") & live).over(group))
    conflict = live & ((F.col("conflicts") & F.col("_city")) | (city & F.col("_against")))
    by = F.when(yields, F.col("_first"))
    result = F.when(yields & F.col("_first").isNotNull(), "superseded").when(yields & F.col("_maybe"), "unknown").otherwise(F.col("result"))
    return rows.withColumn("superseded_by", by).withColumn("conflict", conflict).withColumn("result", result).drop("_first", "_maybe", "_city", "_against")


def confidence_cents() -> Column:
    """Ninety hundredths less what is doubtful, ten at least, sixty at most in a conflict."""
    less = F.when(F.col("confidence") == "low", 30).when(F.col("confidence") == "medium", 10).otherwise(0)
    less = less + 5 * F.size("missing") + F.when(F.col("presumed"), 5).otherwise(0)
    score = F.greatest(F.lit(10), 90 - less)
    return F.when(F.col("conflict"), F.least(score, F.lit(60))).otherwise(score).cast("int")


def lookup(parcels: DataFrame, rules: DataFrame, as_of: Column | str) -> DataFrame:
    """``(address_id, rule_id, category, level, result, superseded_by, conflict, confidence_cents, missing)``."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    rows = with_precedence(base_results(jurisdiction_pairs(parcels, rules), day), ["address_id"])
    return rows.select("address_id", "rule_id", "category", "level", "result", "superseded_by", "conflict", confidence_cents().alias("confidence_cents"), F.array_join("missing", ",").alias("missing"))


def lookup_on(parcels: DataFrame, rules: DataFrame, days: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """The same for several days at once, with ``as_of`` and ``more`` columns of parcels and rules; the days are the caller's short list."""
    pairs = jurisdiction_pairs(parcels, rules).withColumn("as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in days])))
    rows = with_precedence(base_results(pairs, F.col("as_of")), ["address_id", "as_of"])
    return rows.select("address_id", "as_of", "rule_id", "category", "level", "result", "conflict", *more)


def result_rank(result: Column, order: tuple[str, ...] = RESULT_ORDER) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), result).cast("int")
