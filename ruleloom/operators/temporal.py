"""Results over time: key dates, transitions, snapshots, and what changes between two days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key_dates(rules: DataFrame, as_of: str) -> DataFrame:
    """The day asked about and every later day on which an enacted rule begins."""
    first = rules.where((F.col("hint") == "enacted") & (F.col("effective") > F.lit(as_of).cast("date"))).select(F.col("effective").alias("day"))
    return first.union(rules.sparkSession.range(1).select(F.lit(as_of).cast("date"))).distinct()


def transitions(rows: DataFrame, keys: list[str], days: list[str]) -> DataFrame:
    """``(*keys, day, before, after)`` where a result differs from that of the day before in ``days``; absent is null.

    Each key's few results become one map by day, so the days between need no rows.
    """
    by_day = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("as_of").cast("string"), "result"))).alias("at"))
    steps = [F.struct(F.lit(b).cast("date").alias("day"), F.col("at")[F.lit(a)].alias("before"), F.col("at")[F.lit(b)].alias("after")) for a, b in zip(days, days[1:], strict=False)]
    return by_day.select(*keys, F.inline(F.array(*steps))).where(~F.col("before").eqNullSafe(F.col("after")))


def result_as_of(changes: DataFrame, base: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``(*keys, result)`` on a day from the base results and their transitions: the latest change not after it, else what the first began from."""
    d = F.lit(day).cast("date")
    seen = changes.groupBy(*keys).agg(
        F.max_by("after", F.when(F.col("day") <= d, F.col("day"))).alias("later"), F.max(F.when(F.col("day") <= d, F.col("day"))).alias("at"), F.min_by("before", "day").alias("first"), F.count("*").alias("n")
    )
    rows = base.join(seen, keys, "full")
    return rows.select(*keys, F.when(F.col("at").isNotNull(), F.col("later")).when(F.col("n").isNotNull(), F.col("first")).otherwise(F.col("result")).alias("result")).where("result IS NOT NULL")


def snapshots(rows: DataFrame, rank) -> DataFrame:
    """``(address_id, as_of, category, result, conflict, n)``: the best result of each category on each day."""
    return rows.groupBy("address_id", "as_of", "category").agg(F.min_by("result", rank).alias("result"), F.bool_or("conflict").alias("conflict"), F.count("*").alias("n"))


def code_of(best: DataFrame, keys: list[str], results: tuple[str, ...]) -> DataFrame:
    """``(*keys, code)``: a snapshot as one string, two signs a category in order: its number, and a letter for result and conflict.

    ``best(*keys, category, result, conflict)`` with one row a category, whose numbers are below 10.
    """
    rank = F.array_position(F.array(*map(F.lit, results)), F.col("result"))
    sign = F.concat(F.col("category").cast("string"), F.chr(95 + 2 * rank + F.when(F.col("conflict"), 1).otherwise(0)))
    return best.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(sign)), "").alias("code"))


def decoded(codes: DataFrame, keys: list[str], results: tuple[str, ...]) -> DataFrame:
    """``(*keys, category, result, conflict)`` back from :func:`code_of`'s strings; an empty or null code has no row."""
    signs = codes.select(*keys, F.explode(F.regexp_extract_all("code", F.lit("[0-9][a-z]"), 0)).alias("sign"))
    place = F.ascii(F.substring("sign", 2, 1)) - 97
    result = F.element_at(F.array(*map(F.lit, results)), (F.floor(place / 2) + 1).cast("int"))
    return signs.select(*keys, F.substring("sign", 1, 1).cast("int").alias("category"), result.alias("result"), (place % 2 == 1).alias("conflict"))


def affected(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Addresses whose set of (rule, result) differs between two days: one grouped pass, no self-join."""
    side = lambda d: F.sort_array(F.collect_list(F.when(F.col("as_of") == F.lit(d).cast("date"), F.struct("rule_id", "result"))))
    sets = rows.where(F.col("as_of").isin(F.lit(before).cast("date"), F.lit(after).cast("date"))).groupBy("address_id").agg(side(before).alias("a"), side(after).alias("b"))
    return sets.where(~F.col("a").eqNullSafe(F.col("b"))).select("address_id")


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``df`` with ``island``: intervals of one key that overlap, through others too, have one number, in order of start."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
