"""Queries over several days, and change tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lookup as lk
from ..operators import temporal as tp
from ..sources.readers import dealt, table
from ..sources.views import AS_OF, SQL_VIEWS, parcels, rules
from .catalogue import query

DAYS = ["2024-01-01", "2025-07-01", "2026-10-01", "2027-07-01"]
#: The lookup of plans.rules over a list of days, for an SQL engine.
SQL_DAYS = SQL_VIEWS + f""", days AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in DAYS)}]) AS as_of),
leaves AS (SELECT *, CASE WHEN units_min >= min_units THEN true WHEN units_max < min_units THEN false END AS u, year_built < year AS y,
    CASE WHEN year_built < year(as_of) - years THEN true WHEN year_built > year(as_of) - years THEN false END AS age FROM pairs, days),
covered AS (SELECT *, CASE form WHEN 0 THEN true WHEN 1 THEN u AND y WHEN 2 THEN u OR y WHEN 3 THEN u AND NULL ELSE age END AS strict, CASE form WHEN 0 THEN true WHEN 1 THEN u AND y WHEN 2 THEN u OR y WHEN 3 THEN u ELSE age END AS lenient FROM leaves),
base AS (SELECT *, CASE WHEN hint = 'bill' THEN 'pending' WHEN effective > as_of THEN 'not_yet_effective' WHEN level = 'city' AND confidence = 'low' THEN 'unknown' WHEN coalesce(strict, lenient) IS TRUE THEN 'applies' ELSE 'unknown' END AS base_result
    FROM covered WHERE hint <> 'failed' AND strict IS DISTINCT FROM false),
grouped AS (SELECT address_id, as_of, category, min(CASE WHEN level = 'city' AND base_result = 'applies' AND form > 0 THEN rule_id END) AS sure,
    bool_or(level = 'city' AND (base_result = 'unknown' OR (base_result = 'applies' AND form = 0))) AS maybe, bool_or(level = 'city' AND base_result IN ('applies', 'unknown')) AS live, bool_or(conflicts AND base_result IN ('applies', 'unknown')) AS said FROM base GROUP BY ALL),
looked AS (SELECT b.address_id, b.as_of, b.rule_id, b.category, b.level, CASE WHEN defers AND base_result = 'applies' AND sure IS NOT NULL THEN 'superseded' WHEN defers AND base_result = 'applies' AND maybe THEN 'unknown' ELSE base_result END AS result,
    base_result IN ('applies', 'unknown') AND ((conflicts AND live) OR (level = 'city' AND said)) AS conflict FROM base b JOIN grouped USING (address_id, as_of, category)),
changed AS (SELECT k.address_id, k.rule_id, d.b AS day, x.result AS before, y.result AS after FROM (SELECT DISTINCT address_id, rule_id FROM looked) k
    CROSS JOIN (VALUES {', '.join(f"(DATE '{a}', DATE '{b}')" for a, b in zip(DAYS, DAYS[1:], strict=False))}) d(a, b)
    LEFT JOIN looked x ON x.address_id = k.address_id AND x.rule_id = k.rule_id AND x.as_of = d.a LEFT JOIN looked y ON y.address_id = k.address_id AND y.rule_id = k.rule_id AND y.as_of = d.b
    WHERE x.result IS DISTINCT FROM y.result)
"""
RANK = "CASE result WHEN 'applies' THEN 1 WHEN 'superseded' THEN 2 WHEN 'unknown' THEN 3 WHEN 'not_yet_effective' THEN 4 ELSE 5 END"


def _rows(spark, sf):
    return lk.lookup_on(parcels(spark, sf), rules(spark, sf), DAYS)


@query(SQL_VIEWS + f"SELECT DATE '{AS_OF}' AS day UNION SELECT effective FROM rules WHERE hint = 'enacted' AND effective > DATE '{AS_OF}'")
def key_dates(spark, sf):
    return tp.key_dates(rules(spark, sf), AS_OF)


@query(SQL_DAYS + "SELECT as_of, result, count(*) AS n FROM looked GROUP BY ALL")
def results_by_day(spark, sf):
    return _rows(spark, sf).groupBy("as_of", "result").agg(F.count("*").alias("n"))


@query(SQL_DAYS + "SELECT * FROM changed")
def timeline_transitions(spark, sf):
    return tp.transitions(_rows(spark, sf), ["address_id", "rule_id"], DAYS)


@query(SQL_DAYS + "SELECT address_id, rule_id, result FROM looked WHERE as_of = DATE '2025-07-01'")
def result_as_of(spark, sf):
    """Results of one day rebuilt from the first day's and the transitions."""
    rows = _rows(spark, sf)
    changes = tp.transitions(rows, ["address_id", "rule_id"], DAYS)
    return tp.result_as_of(changes, rows.where(F.col("as_of") == F.lit(DAYS[0]).cast("date")).select("address_id", "rule_id", "result"), ["address_id", "rule_id"], DAYS[1])


@query(SQL_DAYS + f"SELECT address_id, as_of, category, arg_min(result, {RANK}) AS result, bool_or(conflict) AS conflict, count(*) AS n FROM looked GROUP BY ALL")
def snapshots(spark, sf):
    return tp.snapshots(_rows(spark, sf), lk.result_rank(F.col("result")))


@query(
    SQL_DAYS
    + f""", best AS (SELECT address_id, as_of, category, min({RANK}) AS r, bool_or(conflict) AS conflict FROM looked GROUP BY ALL)
SELECT address_id, as_of, string_agg(CAST(category AS VARCHAR) || chr(CAST(95 + 2 * r + CASE WHEN conflict THEN 1 ELSE 0 END AS INTEGER)), '' ORDER BY category) AS code FROM best GROUP BY ALL"""
)
def snapshot_codes(spark, sf):
    """A day's snapshot of an address as one short string."""
    best = _rows(spark, sf).groupBy("address_id", "as_of", "category").agg(F.min(lk.result_rank(F.col("result"))).alias("r"), F.bool_or("conflict").alias("conflict"))
    code = F.concat(F.col("category").cast("string"), F.chr(95 + 2 * F.col("r") + F.when(F.col("conflict"), 1).otherwise(0)))
    return best.groupBy("address_id", "as_of").agg(F.array_join(F.sort_array(F.collect_list(code)), "").alias("code"))


@query(SQL_DAYS + f"SELECT address_id, as_of, category, arg_min(result, {RANK}) AS result, bool_or(conflict) AS conflict FROM looked GROUP BY ALL")
def snapshots_decoded(spark, sf):
    """Snapshots coded as strings and read back: each category's best result and whether it is in conflict."""
    best = tp.snapshots(_rows(spark, sf), lk.result_rank(F.col("result")))
    return tp.decoded(tp.code_of(best, ["address_id", "as_of"], lk.RESULT_ORDER), ["address_id", "as_of"], lk.RESULT_ORDER)


@query(SQL_DAYS + "SELECT DISTINCT address_id FROM changed WHERE day = DATE '2025-07-01'")
def change_affected(spark, sf):
    return tp.affected(_rows(spark, sf), DAYS[0], DAYS[1])


@query(SQL_DAYS + """SELECT p.state, count(*) AS parcels, count(*) FILTER (WHERE p.address_id IN (SELECT address_id FROM changed WHERE day = DATE '2027-07-01')) AS affected,
count(*) FILTER (WHERE p.address_id IN (SELECT address_id FROM looked WHERE as_of = DATE '2027-07-01' AND conflict)) AS flagged FROM parcels p GROUP BY ALL""")
def change_by_state(spark, sf):
    rows = _rows(spark, sf)
    hit = tp.affected(rows, DAYS[2], DAYS[3]).withColumn("hit", F.lit(True))
    flagged = rows.where(F.col("conflict") & (F.col("as_of") == F.lit(DAYS[3]).cast("date"))).select("address_id").distinct().withColumn("flag", F.lit(True))
    every = parcels(spark, sf).select("address_id", "state").join(hit, "address_id", "left").join(flagged, "address_id", "left")
    return every.groupBy("state").agg(F.count("*").alias("parcels"), F.count("hit").alias("affected"), F.count("flag").alias("flagged"))


@query(SQL_DAYS + "SELECT p.city, count(DISTINCT l.address_id) AS inside FROM looked l JOIN parcels p USING (address_id) WHERE l.level = 'city' AND l.result = 'applies' AND l.as_of = DATE '2026-10-01' GROUP BY ALL")
def change_boundary(spark, sf):
    rows = _rows(spark, sf).where((F.col("level") == "city") & (F.col("result") == "applies") & (F.col("as_of") == F.lit(DAYS[2]).cast("date")))
    one = rows.select("address_id").distinct().join(parcels(spark, sf).select("address_id", "city"), "address_id")
    return one.groupBy("city").agg(F.count("*").alias("inside"))


@query(SQL_VIEWS + """, leaves AS (SELECT *, CASE WHEN units_min >= min_units THEN true WHEN units_max < min_units THEN false END AS u, year_built < year AS y FROM pairs WHERE hint = 'bill')
SELECT rule_id, form, count(*) FILTER (WHERE CASE form WHEN 1 THEN NOT (u AND y) WHEN 2 THEN NOT (u OR y) WHEN 3 THEN NOT u ELSE false END) AS outside, count(*) AS asked FROM leaves GROUP BY ALL""")
def change_pending(spark, sf):
    """Whom any bill would not cover, whatever its form; without a day an age is open, so it leaves nobody out."""
    from ..operators.predicates import coverage

    strict, _ = coverage(F.lit(None).cast("date"))
    rows = lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf).where("hint = 'bill'"))
    return rows.groupBy("rule_id", "form").agg(F.count_if(strict == 0).alias("outside"), F.count("*").alias("asked"))


@query(SQL_DAYS + "SELECT count(*) AS violations FROM looked l JOIN parcels p USING (address_id) JOIN rules r USING (rule_id) WHERE r.level = 'state' AND p.state <> r.state")
def change_negative(spark, sf):
    rows = _rows(spark, sf).where("level = 'state'").join(parcels(spark, sf).select("address_id", F.col("state").alias("own")), "address_id").join(rules(spark, sf).select("rule_id", "state"), "rule_id")
    return rows.agg(F.count_if(F.col("own") != F.col("state")).alias("violations"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
n AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a >= max(b) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(a) AS start_day, max(b) AS end_day, count(*) AS spans FROM g GROUP BY ALL""")
def merge_overlapping_spans(spark, sf):
    day = F.col("l_shipdate").cast("date")
    rows = dealt(table(spark, sf, "lineitem"), "l_orderkey").select("l_orderkey", day.alias("a"), F.date_add(day, F.col("l_quantity").cast("int")).alias("b"))
    return tp.islands(rows, ["l_orderkey"], "a", "b").groupBy("l_orderkey", F.col("island").cast("long").alias("island")).agg(F.min("a").alias("start_day"), F.max("b").alias("end_day"), F.count("*").alias("spans"))


@query("""SELECT user_id, event_id, ts, value, (SELECT max(e2.ts) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'purchase' AND e2.ts <= e.ts) AS last_purchase FROM events e""")
def as_of_join(spark, sf):
    """Each event with its user's latest purchase at or before it: one ordered pass a user."""
    order = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(order).alias("last_purchase"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, day, n, day + 1 = lead(day) OVER (PARTITION BY user_id ORDER BY day) AS runs_on FROM d""")
def consecutive_days(spark, sf):
    days = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    after = F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))
    return days.withColumn("runs_on", F.date_add("day", 1) == after)
