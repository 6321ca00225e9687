"""Change tests over the views: each rule has a test of its own, of four types and one unknown, so all customers are in some scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import documents as dc
from ..operators import lookup as lk
from ..operators.predicates import coverage
from ..sources.views import AS_OF, parcels, places, rules
from .catalogue import query
from .temporal import DAYS, SQL_DAYS

#: A test's columns from its rule's, for Spark and for SQL: every third is about one state, every seventh maps to no rule, a boundary test names the next city now and then.
_TEST = {
    "type": "CASE WHEN hint = 'bill' AND rule_id % 2 = 0 THEN 'pending' WHEN hint = 'failed' AND rule_id % 2 = 0 THEN 'negative' WHEN rule_id % 5 = 0 THEN 'as_of' WHEN rule_id % 5 = 1 THEN 'boundary' WHEN rule_id % 5 = 2 THEN 'pending' WHEN rule_id % 5 = 3 THEN 'negative' ELSE 'other' END",
    "before": f"DATE '{DAYS[0]}'", "after": f"CASE WHEN rule_id % 4 = 0 THEN DATE '{DAYS[3]}' ELSE DATE '{DAYS[2]}' END", "named": "rule_id % 7 <> 0", "in_state": "rule_id % 3 <> 0 OR level = 'city'",
    "other_id": "CASE WHEN rule_id % 2 = 0 THEN rule_id + 1 END", "own_category": "CASE WHEN rule_id % 11 <> 0 THEN category END",
}


def tests(spark, sf):
    """``(test_id, type, before, after, states, rule_ids, conflict_ids, conflict_city, place, category)``."""
    made = rules(spark, sf).withColumns({k: F.expr(v) for k, v in _TEST.items()})
    city = places(spark, sf).select(F.col("nationkey").alias("_n"), F.col("city").alias("conflict_city"))
    made = made.join(city, F.col("_n") == F.col("rule_id") % 25, "left")
    one = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<int>"))
    return made.select(
        F.col("rule_id").alias("test_id"), "type", "before", "after", F.when(F.col("in_state"), F.array("state")).alias("states"), one(F.col("named"), F.col("rule_id")).alias("rule_ids"), one(F.col("other_id").isNotNull(), F.col("other_id")).alias("conflict_ids"),
        F.when(F.col("rule_id") % 2 == 1, F.col("conflict_city")).alias("conflict_city"), F.when((F.col("level") == "city") & (F.col("rule_id") % 6 != 1), F.col("jurisdiction")).otherwise(F.col("conflict_city")).alias("place"), F.col("own_category").alias("category"),
    )


def _outcomes(spark, sf):
    t, p, r = tests(spark, sf), ch.alike(parcels(spark, sf)), rules(spark, sf)
    rows = lk.lookup_on(p, r, DAYS, ("state", "city", "n"))
    strict, _ = coverage(F.lit(None).cast("date"))
    open_rows = lk.jurisdiction_pairs(p, r).select("address_id", "n", "rule_id", "state", (strict != 0).alias("covers"))
    return ch.outcomes(t, rows, p, r, open_rows)


_test_sql = ", ".join(f"{v} AS {k}" for k, v in _TEST.items())
SQL_TESTS = SQL_DAYS + f""", t AS (SELECT r.rule_id AS test_id, r.*, c.city AS conflict_place, {_test_sql} FROM rules r LEFT JOIN places c ON c.nationkey = r.rule_id % 25),
tests AS (SELECT *, CASE WHEN rule_id % 2 = 1 THEN conflict_place END AS conflict_city, CASE WHEN level = 'city' AND rule_id % 6 <> 1 THEN jurisdiction ELSE conflict_place END AS place FROM t),
scopes AS (SELECT t.test_id, count(p.address_id) AS scope, count(p.city) AS in_city FROM tests t LEFT JOIN parcels p ON NOT t.in_state OR p.state = t.state GROUP BY ALL),
seen AS (SELECT l.*, p.state, p.city FROM looked l JOIN parcels p USING (address_id)),
met AS (SELECT t.test_id, t.type, t.before, t.after, t.place, t.conflict_city, t.other_id, NOT t.in_state OR s.state = t.state AS in_scope, s.* FROM tests t JOIN seen s ON s.rule_id = t.rule_id WHERE t.named),
turned AS (SELECT test_id, address_id, in_scope, city, conflict_city, other_id, after, max(result) FILTER (as_of = before) AS b, max(result) FILTER (as_of = after) AS a FROM met WHERE type = 'as_of' AND as_of IN (before, after) GROUP BY ALL),
as_of_counts AS (SELECT test_id, count(*) FILTER (a IS DISTINCT FROM b) AS affected, count(*) FILTER (in_scope AND b = 'not_yet_effective') AS early, count(*) FILTER (in_scope AND a = 'applies') AS late,
    count(*) FILTER (a IN ('applies', 'superseded', 'unknown') AND (city = conflict_city OR EXISTS (SELECT 1 FROM seen s WHERE s.address_id = turned.address_id AND s.rule_id = turned.other_id AND s.as_of = turned.after AND s.result IN ('applies', 'superseded', 'unknown')))) AS flagged FROM turned GROUP BY test_id),
hits AS (SELECT test_id, count(*) AS hit, count(*) FILTER (city IS DISTINCT FROM place) AS outside FROM met WHERE type = 'boundary' AND as_of = after GROUP BY test_id),
bills AS (SELECT test_id, count(*) FILTER (result NOT IN ('pending', 'not_yet_effective')) AS in_force, count(*) FILTER (in_scope AND city IS NOT NULL AND result = 'pending') AS told FROM met WHERE type = 'pending' AND as_of = after GROUP BY test_id),
bare AS (SELECT *, CASE WHEN units_min >= min_units THEN true WHEN units_max < min_units THEN false END AS u, year_built < year AS y FROM pairs),
reach AS (SELECT t.test_id, count(*) FILTER (CASE l.form WHEN 1 THEN (l.u AND l.y) IS DISTINCT FROM false WHEN 2 THEN (l.u OR l.y) IS DISTINCT FROM false WHEN 3 THEN l.u IS DISTINCT FROM false ELSE true END) AS reach
    FROM tests t JOIN bare l ON l.rule_id = t.rule_id WHERE t.named AND t.type = 'pending' AND (NOT t.in_state OR l.state = t.state) GROUP BY t.test_id),
wrong AS (SELECT t.test_id, count(DISTINCT s.rule_id) AS wrong FROM tests t JOIN seen s ON s.category = t.own_category AND s.as_of = t.after WHERE s.level = 'city' AND s.result IN ('applies', 'superseded', 'unknown') AND (NOT t.in_state OR s.state = t.state) GROUP BY t.test_id),
shown AS (SELECT test_id, count(DISTINCT rule_id) AS shown FROM met WHERE as_of = after GROUP BY test_id),
inside AS (SELECT city, count(*) AS there FROM parcels GROUP BY city),
told AS (SELECT t.test_id, t.type, t.named, t.hint, t.own_category, s.scope, s.in_city, coalesce(a.affected, 0) AS changed, coalesce(early, 0) AS early, coalesce(late, 0) AS late, coalesce(flagged, 0) AS flagged, coalesce(hit, 0) AS hit, coalesce(outside, 0) AS outside,
    coalesce(in_force, 0) AS in_force, coalesce(bills.told, 0) AS told, coalesce(reach, 0) AS reach, coalesce(wrong, 0) AS wrong, coalesce(shown, 0) AS shown, coalesce(there, 0) AS there
    FROM tests t JOIN scopes s USING (test_id) LEFT JOIN as_of_counts a USING (test_id) LEFT JOIN hits USING (test_id) LEFT JOIN bills USING (test_id) LEFT JOIN reach USING (test_id) LEFT JOIN wrong USING (test_id) LEFT JOIN shown USING (test_id) LEFT JOIN inside ON inside.city = t.place),
checked AS (SELECT *, CASE type WHEN 'as_of' THEN CASE WHEN named THEN [early = scope, late = scope] ELSE [NULL] END WHEN 'boundary' THEN [CASE WHEN named THEN outside = 0 END] WHEN 'pending' THEN CASE WHEN named THEN [in_force = 0, told = in_city, reach = scope] ELSE [NULL] END
    WHEN 'negative' THEN [CASE WHEN named THEN hint = 'failed' END, shown = 0, CASE WHEN own_category IS NOT NULL THEN wrong = 0 END] ELSE [false] END AS checks FROM told),
outcomes AS (SELECT test_id, type, CASE type WHEN 'as_of' THEN CASE WHEN named THEN changed ELSE 0 END WHEN 'boundary' THEN CASE WHEN named THEN hit ELSE there END WHEN 'pending' THEN CASE WHEN named THEN reach ELSE 0 END ELSE 0 END AS affected,
    CASE WHEN type = 'as_of' THEN flagged ELSE 0 END AS conflicts, array_to_string([CASE WHEN c THEN 'passed' WHEN NOT c THEN 'failed' ELSE 'open' END FOR c IN checks], ',') AS checks, CASE WHEN list_contains(checks, false) THEN 'fail' WHEN list_contains(checks, true) THEN 'pass' ELSE 'not checkable' END AS outcome FROM checked)
"""


@query(SQL_TESTS + f"SELECT o.*, CASE WHEN t.type = 'negative' THEN 'failed' WHEN t.type = 'pending' THEN 'pending' WHEN t.type = 'as_of' AND t.after > DATE '{AS_OF}' THEN 'not_yet_effective' ELSE 'enacted' END AS kind FROM outcomes o JOIN tests t USING (test_id)")
def change_tests(spark, sf):
    """Every test's affected and conflicting addresses, its checks and outcome, and what it is about."""
    told = tests(spark, sf).select("test_id", dc.change_kind(F.col("type"), F.col("after"), F.lit(AS_OF).cast("date")).alias("kind"))
    said = F.array_join(F.transform("checks", lambda c: F.when(c["passed"], "passed").when(~c["passed"], "failed").otherwise("open")), ",")
    return _outcomes(spark, sf).withColumn("checks", said).join(told, "test_id")


@query(SQL_TESTS + "SELECT type, outcome, count(*) AS n FROM outcomes GROUP BY ALL")
def change_outcomes(spark, sf):
    """Passed, failed and not checkable tests by type."""
    return ch.tally(_outcomes(spark, sf))
