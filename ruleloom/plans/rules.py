"""Queries of the rule engine over the views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import tristate as tri
from ..operators import lookup as lk
from ..operators import gold as gd
from ..operators import pages as pg
from ..operators import predicates as pr
from ..sources.readers import table
from ..sources.views import AS_OF, SQL_VIEWS, category_name, parcels, rules
from .catalogue import query

DAY = f"DATE '{AS_OF}'"
SQL_BASE = SQL_VIEWS + f""",
leaves AS (SELECT *, CASE WHEN units_min >= min_units THEN true WHEN units_max < min_units THEN false END AS u, year_built < year AS y,
    CASE WHEN year_built < year({DAY}) - years THEN true WHEN year_built > year({DAY}) - years THEN false END AS age FROM pairs),
covered AS (SELECT *, CASE form WHEN 0 THEN true WHEN 1 THEN u AND y WHEN 2 THEN u OR y WHEN 3 THEN u AND NULL ELSE age END AS strict,
    CASE form WHEN 0 THEN true WHEN 1 THEN u AND y WHEN 2 THEN u OR y WHEN 3 THEN u ELSE age END AS lenient FROM leaves),
base AS (SELECT *, strict IS NULL AND lenient IS TRUE AS presumed,
    CASE WHEN strict IS NULL THEN [x FOR x IN [CASE WHEN form IN (1, 2, 3) AND u IS NULL THEN 'units' END, CASE WHEN form IN (1, 2, 4) AND year_built IS NULL THEN 'year_built' END, CASE WHEN form = 3 THEN 'owner_occupied' END] IF x IS NOT NULL] ELSE [] END AS missing,
    CASE WHEN hint = 'bill' THEN 'pending' WHEN effective > {DAY} THEN 'not_yet_effective' WHEN level = 'city' AND confidence = 'low' THEN 'unknown' WHEN coalesce(strict, lenient) IS TRUE THEN 'applies' ELSE 'unknown' END AS base_result
    FROM covered WHERE hint <> 'failed' AND strict IS DISTINCT FROM false),
city_rows AS (SELECT address_id, category, min(CASE WHEN base_result = 'applies' AND form > 0 THEN rule_id END) AS sure, bool_or(base_result = 'unknown' OR (base_result = 'applies' AND form = 0)) AS maybe,
    bool_or(base_result IN ('applies', 'unknown')) AS live FROM base WHERE level = 'city' GROUP BY ALL),
against AS (SELECT address_id, category, bool_or(conflicts AND base_result IN ('applies', 'unknown')) AS said FROM base GROUP BY ALL),
final AS (SELECT b.*, CASE WHEN defers AND base_result = 'applies' THEN sure END AS superseded_by,
    CASE WHEN defers AND base_result = 'applies' AND sure IS NOT NULL THEN 'superseded' WHEN defers AND base_result = 'applies' AND coalesce(maybe, false) THEN 'unknown' ELSE base_result END AS result,
    base_result IN ('applies', 'unknown') AND ((conflicts AND coalesce(live, false)) OR (level = 'city' AND said)) AS conflict
    FROM base b LEFT JOIN city_rows USING (address_id, category) JOIN against USING (address_id, category)),
looked AS (SELECT *, CAST(CASE WHEN conflict THEN least(score, 60) ELSE score END AS INTEGER) AS confidence_cents FROM (SELECT *, greatest(10, 90 - CASE confidence WHEN 'low' THEN 30 WHEN 'medium' THEN 10 ELSE 0 END - 5 * len(missing) - CASE WHEN presumed THEN 5 ELSE 0 END) AS score FROM final))
"""


def _lookup(spark, sf):
    return lk.lookup(parcels(spark, sf), rules(spark, sf), AS_OF)


@query(SQL_VIEWS + "SELECT * FROM parcels")
def parcel_facts(spark, sf):
    return parcels(spark, sf)


@query(SQL_VIEWS + "SELECT rule_id, level, jurisdiction, state, category, hint, effective, defers, conflicts FROM rules")
def rule_table(spark, sf):
    return rules(spark, sf).select("rule_id", "level", "jurisdiction", "state", "category", "hint", "effective", "defers", "conflicts")


@query(
    SQL_VIEWS
    + """SELECT address_id, t.n AS value, CASE WHEN units_min >= t.n THEN 'true' WHEN units_max < t.n THEN 'false' ELSE 'unknown' END AS at_least,
CASE WHEN units_max < t.n THEN 'true' WHEN units_min >= t.n THEN 'false' ELSE 'unknown' END AS below,
CASE WHEN units_min = units_max AND units_min = t.n THEN 'true' WHEN t.n < units_min OR t.n > units_max THEN 'false' ELSE 'unknown' END AS equal,
CASE WHEN units_min = units_max AND units_min = t.n THEN 'false' WHEN t.n < units_min OR t.n > units_max THEN 'true' ELSE 'unknown' END AS unequal
FROM parcels, (VALUES (2), (3), (5)) t(n)"""
)
def interval_compare(spark, sf):
    rows = parcels(spark, sf).withColumn("value", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))))
    is_ = lambda op: tri.named(tri.compare(op, F.col("units_min"), F.col("units_max"), F.col("value")))
    return rows.select("address_id", "value", is_(">=").alias("at_least"), is_("<").alias("below"), is_("==").alias("equal"), is_("!=").alias("unequal"))


@query(SQL_VIEWS + "SELECT level, rule_id, count(*) AS parcels FROM pairs GROUP BY ALL")
def jurisdiction_join(spark, sf):
    return lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf)).groupBy("level", "rule_id").agg(F.count("*").alias("parcels"))


@query(SQL_BASE + "SELECT form, CASE WHEN strict THEN 'true' WHEN NOT strict THEN 'false' ELSE 'unknown' END AS strict, CASE WHEN lenient THEN 'true' WHEN NOT lenient THEN 'false' ELSE 'unknown' END AS lenient, count(*) AS n FROM covered GROUP BY ALL")
def coverage_counts(spark, sf):
    strict, lenient = pr.coverage(F.lit(AS_OF).cast("date"))
    rows = lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf)).select("form", tri.named(strict).alias("strict"), tri.named(lenient).alias("lenient"))
    return rows.groupBy("form", "strict", "lenient").agg(F.count("*").alias("n"))


@query(SQL_BASE + "SELECT address_id, rule_id, form, CASE WHEN strict THEN 2 WHEN NOT strict THEN 0 ELSE 1 END AS value FROM covered")
def coverage_tree_fold(spark, sf):
    """The five forms of tree as data: no condition, units and year, units or year, units and an unknown owner, age."""
    nodes = spark.createDataFrame(
        [(0, "always", None, 0, "leaf"), (1, "root", None, 0, "all"), (1, "u", "root", 1, "leaf"), (1, "y", "root", 1, "leaf"), (2, "root", None, 0, "any"), (2, "u", "root", 1, "leaf"), (2, "no", "root", 1, "not"), (2, "late", "no", 2, "leaf")]
        + [(3, "root", None, 0, "all"), (3, "u", "root", 1, "leaf"), (3, "no", "root", 1, "not"), (3, "owner", "no", 2, "leaf"), (4, "age", None, 0, "leaf")],
        "tree int, node string, parent string, depth int, kind string",
    )
    pairs = lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf))
    units, year = tri.compare(">=", F.col("units_min"), F.col("units_max"), F.col("min_units")), tri.compare(">=", F.col("year_built"), F.col("year_built"), F.col("year"))
    age = tri.compare_year_to_date("<", F.col("year_built"), dates.years_before(F.lit(AS_OF).cast("date"), F.col("years")))
    leaf = lambda node, value: F.struct(F.lit(node).alias("node"), value.cast("int").alias("value"))
    u = leaf("u", units)
    found = F.when(F.col("form") == 0, F.array(leaf("always", F.lit(tri.TRUE)))).when(F.col("form") == 1, F.array(u, leaf("y", tri.negated(year)))).when(F.col("form") == 2, F.array(u, leaf("late", year)))
    found = found.when(F.col("form") == 3, F.array(u, leaf("owner", F.lit(tri.UNKNOWN)))).otherwise(F.array(leaf("age", age)))
    leaves = pairs.select("address_id", "rule_id", "form", F.col("form").cast("int").alias("tree"), F.inline(found))
    return pr.fold(leaves, nodes, ["address_id", "rule_id", "form"], 1)


@query(SQL_BASE + "SELECT address_id, rule_id, array_to_string(missing, ',') AS missing FROM base WHERE len(missing) > 0")
def coverage_missing_facts(spark, sf):
    rows = lk.base_results(lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf)), F.lit(AS_OF).cast("date"))
    return rows.where(F.size("missing") > 0).select("address_id", "rule_id", F.array_join("missing", ",").alias("missing"))


@query(SQL_BASE + "SELECT address_id, rule_id, base_result AS result, presumed FROM base")
def base_result(spark, sf):
    return lk.base_results(lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf)), F.lit(AS_OF).cast("date")).select("address_id", "rule_id", "result", "presumed")


@query(SQL_BASE + "SELECT address_id, rule_id, category, level, result, superseded_by, conflict, confidence_cents, array_to_string(missing, ',') AS missing FROM looked")
def lookup_full(spark, sf):
    return _lookup(spark, sf)


@query(SQL_BASE + "SELECT level, result, count(*) AS n, count(*) FILTER (WHERE conflict) AS in_conflict FROM looked GROUP BY ALL")
def lookup_result_counts(spark, sf):
    return _lookup(spark, sf).groupBy("level", "result").agg(F.count("*").alias("n"), F.count_if("conflict").alias("in_conflict"))


@query(SQL_BASE + "SELECT rule_id, superseded_by, count(*) AS parcels FROM looked WHERE result = 'superseded' GROUP BY ALL")
def precedence_superseded(spark, sf):
    return _lookup(spark, sf).where("result = 'superseded'").groupBy("rule_id", "superseded_by").agg(F.count("*").alias("parcels"))


@query(SQL_BASE + "SELECT a.rule_id AS state_rule, b.rule_id AS city_rule, count(*) AS parcels FROM looked a JOIN looked b USING (address_id, category) WHERE a.conflict AND b.conflict AND a.conflicts AND b.level = 'city' GROUP BY ALL")
def conflict_pairs(spark, sf):
    rows = _lookup(spark, sf).where("conflict").select("address_id", "category", "level", "rule_id")
    against = rules(spark, sf).where("conflicts").select("rule_id")
    states = rows.where("level = 'state'").join(against, "rule_id").select("address_id", "category", F.col("rule_id").alias("state_rule"))
    cities = rows.where("level = 'city'").select("address_id", "category", F.col("rule_id").alias("city_rule"))
    return states.join(cities, ["address_id", "category"]).groupBy("state_rule", "city_rule").agg(F.count("*").alias("parcels"))


@query(SQL_BASE + "SELECT confidence_cents, conflict, count(*) AS n FROM looked GROUP BY ALL")
def confidence_scores(spark, sf):
    return _lookup(spark, sf).groupBy("confidence_cents", "conflict").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'failed' WHEN CAST(o_orderdate AS DATE) > DATE '1998-06-01' THEN 'not_yet_effective' ELSE 'in_force' END AS status FROM orders")
def status_on_date(spark, sf):
    hint = F.when(F.col("o_orderstatus") == "P", "bill").when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0), "failed").otherwise("enacted")
    return table(spark, sf, "orders").select("o_orderkey", dates.status_on(hint, F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date")).alias("status"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN make_date(year(o_orderdate), 12, 31) WHEN 1 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END AS last_day FROM orders""")
def partial_dates(spark, sf):
    key = F.col("o_orderkey") % 3
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(key == 0, F.substring(text, 1, 4)).when(key == 1, F.substring(text, 1, 7)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", dates.last_day_of_partial(text).alias("last_day"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', d + to_months(CAST(n AS INTEGER))) AS DATE) AS nth_month, d + CAST(n AS INTEGER) AS nth_day, make_date(year(d) + 1, 1, 1) AS january, CAST(d - to_years(CAST(n AS INTEGER)) AS DATE) AS years_ago
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 1 + o_orderkey % 12 AS n FROM orders)""")
def date_rules(spark, sf):
    d, n = F.col("o_orderdate").cast("date"), (1 + F.col("o_orderkey") % 12).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", dates.first_of_nth_month_after(d, n).alias("nth_month"), dates.days_after(d, n).alias("nth_day"), dates.january_after(d).alias("january"), dates.years_before(d, n).alias("years_ago"))


@query(SQL_BASE + """, asked AS (SELECT c_custkey AS address_id, CASE WHEN c_custkey % 5 = 0 THEN 1975 END AS said FROM customer)
SELECT address_id, rule_id, CASE WHEN form = 4 AND coalesce(year_built, said) < year(DATE '2026-10-01') - years THEN 'true' WHEN form = 4 AND coalesce(year_built, said) > year(DATE '2026-10-01') - years THEN 'false' ELSE 'unknown' END AS answer
FROM pairs JOIN asked USING (address_id) WHERE form = 4 AND year_built IS NULL""")
def whatif_facts(spark, sf):
    """What a user adds counts where the record is silent."""
    rows = parcels(spark, sf).where("year_built IS NULL").withColumn("year_built", F.when(F.col("address_id") % 5 == 0, 1975))
    strict, _ = pr.coverage(F.lit(AS_OF).cast("date"))
    return lk.jurisdiction_pairs(rows, rules(spark, sf).where("form = 4")).select("address_id", "rule_id", tri.named(strict).alias("answer"))


@query(SQL_BASE + """, ranked AS (SELECT address_id, category, rule_id, result, row_number() OVER (PARTITION BY address_id, category ORDER BY CASE result WHEN 'applies' THEN 1 WHEN 'superseded' THEN 2 WHEN 'unknown' THEN 3 WHEN 'not_yet_effective' THEN 4 ELSE 5 END, CASE level WHEN 'city' THEN 0 ELSE 1 END, confidence_cents DESC, rule_id) AS n FROM looked)
SELECT address_id, ['rent', 'eviction', 'deposit', 'fees', 'notice', 'registry'][category + 1] AS category, rule_id, result FROM ranked WHERE n = 1""")
def headline_rows(spark, sf):
    """The rule to show first in each category: the least of a composite rank, by partial aggregation."""
    rank = F.struct(lk.result_rank(F.col("result")).alias("a"), F.when(F.col("level") == "city", 0).otherwise(1).alias("b"), (-F.col("confidence_cents")).alias("c"), F.col("rule_id").alias("d"))
    best = _lookup(spark, sf).groupBy("address_id", "category").agg(F.min_by(F.struct("rule_id", "result"), rank).alias("x"))
    return best.select("address_id", category_name(F.col("category")).alias("category"), "x.rule_id", "x.result")


@query(SQL_BASE + """, dim AS (SELECT unnest(range(6)) AS category)
SELECT p.address_id, CAST(d.category AS INTEGER) AS category, count(l.rule_id) AS n, coalesce(string_agg(CAST(l.rule_id AS VARCHAR), ',' ORDER BY l.rule_id), '') AS rule_ids
FROM parcels p CROSS JOIN dim d LEFT JOIN looked l ON l.address_id = p.address_id AND l.category = d.category GROUP BY ALL""")
def category_blocks(spark, sf):
    """Six blocks a parcel, empty ones kept; the categories are a fixed list, so they are exploded, not joined."""
    every = parcels(spark, sf).select("address_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("category"))
    rows = _lookup(spark, sf).groupBy("address_id", "category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("rule_id")), lambda x: x.cast("string")), ",").alias("rule_ids"))
    return every.join(rows, ["address_id", "category"], "left").select("address_id", "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rule_ids", F.lit("")).alias("rule_ids"))


@query(SQL_BASE + "SELECT jurisdiction, " + ", ".join(f"count(*) FILTER (WHERE category = {k}) AS c{k}" for k in range(6)) + " FROM rules GROUP BY jurisdiction")
def coverage_matrix(spark, sf):
    counted = rules(spark, sf).groupBy("jurisdiction").pivot("category", list(range(6))).count().na.fill(0)
    return counted.select("jurisdiction", *[F.col(str(k)).alias(f"c{k}") for k in range(6)])


@query(SQL_BASE + """SELECT problem, count(*) AS n FROM (
SELECT 'superseded without a city rule' AS problem FROM looked WHERE result = 'superseded' AND superseded_by IS NULL
UNION ALL SELECT 'city rule away from its city' FROM looked WHERE level = 'city' AND city IS DISTINCT FROM jurisdiction
UNION ALL SELECT 'no rule at all' FROM parcels WHERE address_id NOT IN (SELECT address_id FROM looked)) GROUP BY ALL""")
def lookup_sanity(spark, sf):
    """Constraint queries over the results; no row means no problem."""
    rows = _lookup(spark, sf)
    a = rows.where("result = 'superseded' AND superseded_by IS NULL").select(F.lit("superseded without a city rule").alias("problem"))
    placed = rows.where("level = 'city'").join(rules(spark, sf).select("rule_id", "jurisdiction"), "rule_id").join(parcels(spark, sf).select("address_id", "city"), "address_id")
    b = placed.where(~F.col("city").eqNullSafe(F.col("jurisdiction"))).select(F.lit("city rule away from its city"))
    c = parcels(spark, sf).join(rows.select("address_id").distinct(), "address_id", "left_anti").select(F.lit("no rule at all"))
    return a.union(b).union(c).groupBy("problem").agg(F.count("*").alias("n"))


#: Words that tell which rule answers a category's question, by category: strong, weak, demoting.
_WORDS = {0: (["cap", "rent control"], ["limit"], ["notice"]), 1: (["just cause", "reason"], ["evict"], ["relocation"]), 2: (["month's rent", "return"], ["deposit"], ["interest"]), 3: (["screening fee"], ["fee", "fees"], ["receipt"])}
_RULE_TITLES = ("Cap on rent", "Notice of a cap", "Just cause to evict", "Return of a deposit", "Screening fee, and its receipt", "Fees", "One month’s rent at most")
_title_sql = "[" + ", ".join("'" + t + "'" for t in _RULE_TITLES) + f"][rule_id % {len(_RULE_TITLES)} + 1]"
_flat = lambda c: f"translate(lower({c}), '‘’ʼ`', repeat(chr(39), 4))"


def _has_sql(column: str, word: str) -> str:
    return f"regexp_matches({column}, '(^|[^a-z0-9]){word.replace(chr(39), chr(39) * 2)}($|[^a-z0-9])')"


def _score_sql(words) -> str:
    strong, weak, demote = words
    parts = [f"CASE WHEN {_has_sql('t', w)} THEN {3 * n} WHEN {_has_sql('b', w)} THEN {n} ELSE 0 END" for some, n in ((strong, 2), (weak, 1)) for w in some]
    return " + ".join(parts) + " - CASE WHEN " + " OR ".join(_has_sql("t", w) for w in demote) + " THEN 8 ELSE 0 END"


@query(SQL_BASE + f""", worded AS (SELECT *, {_flat(_title_sql)} AS t, CASE WHEN rule_id % 3 = 0 THEN 'the limit and the fees' ELSE '' END AS b, rule_id % 3 AS fields FROM looked WHERE result <> 'pending'),
scored AS (SELECT *, CAST(CASE category {" ".join(f"WHEN {k} THEN {_score_sql(w)}" for k, w in _WORDS.items())} ELSE 0 END AS INTEGER) AS s FROM worded),
placed AS (SELECT *, row_number() OVER (PARTITION BY address_id, category ORDER BY CASE result WHEN 'applies' THEN 0 WHEN 'unknown' THEN 1 WHEN 'not_yet_effective' THEN 2 ELSE 9 END, s DESC, fields DESC, CASE level WHEN 'city' THEN 0 ELSE 1 END, rule_id) AS n, count(*) OVER (PARTITION BY address_id, category) - 1 AS others FROM scored)
SELECT address_id, category, rule_id, result, s AS score, others FROM placed WHERE n = 1""")
def headlines_scored(spark, sf):
    """Each category's rule to show first, by its result and how its title and text answer the category's question."""
    r = F.col("rule_id")
    title = F.element_at(F.array(*map(F.lit, _RULE_TITLES)), r % len(_RULE_TITLES) + 1)
    rows = _lookup(spark, sf).withColumns({"title": title, "body": F.when(r % 3 == 0, "the limit and the fees").otherwise(""), "fields": r % 3})
    return pg.headlines(rows, _WORDS)


@query(SQL_BASE + """, f AS (SELECT jurisdiction, list(rule_id ORDER BY rule_id) AS ids FROM rules WHERE hint = 'failed' GROUP BY jurisdiction),
b AS (SELECT address_id, category, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY CASE result WHEN 'applies' THEN 1 WHEN 'superseded' THEN 2 WHEN 'unknown' THEN 3 WHEN 'not_yet_effective' THEN 4 ELSE 5 END, CASE level WHEN 'city' THEN 0 ELSE 1 END, rule_id) AS ids FROM looked GROUP BY ALL),
w AS (SELECT p.address_id, string_agg(coalesce(b.ids, ''), '|' ORDER BY k) AS blocks FROM parcels p CROSS JOIN range(6) t(k) LEFT JOIN b ON b.address_id = p.address_id AND b.category = k GROUP BY p.address_id)
SELECT p.address_id, 'state: ' || p.state || CASE WHEN city IS NULL THEN '' WHEN confidence = 'low' THEN '|city unconfirmed: ' || city ELSE '|city: ' || city END AS stack, blocks, array_to_string(list_concat(coalesce(s.ids, []), coalesce(c.ids, [])), ',') AS notes
FROM parcels p JOIN w USING (address_id) LEFT JOIN f s ON s.jurisdiction = p.state LEFT JOIN f c ON c.jurisdiction = p.city""")
def address_pages(spark, sf):
    """Every customer's page: who governs, six blocks of rules in order, and what failed there."""
    found = pg.pages(parcels(spark, sf), _lookup(spark, sf), rules(spark, sf), 6, lk.RESULT_ORDER)
    blocks = F.array_join(F.transform("blocks", lambda b: F.array_join(F.transform(b, lambda x: x.cast("string")), ",")), "|")
    return found.select("address_id", F.array_join("stack", "|").alias("stack"), blocks.alias("blocks"), F.array_join("notes", ",").alias("notes"))


_EXPECTED = "CASE WHEN (address_id + rule_id) % 7 = 0 THEN 'absent' WHEN (address_id * 3 + rule_id) % 5 < 3 THEN 'applies' WHEN (address_id + rule_id) % 2 = 0 THEN 'superseded' ELSE 'pending' END"


@query(SQL_BASE + f""", g AS (SELECT address_id, rule_id, category, {_EXPECTED} AS expected FROM pairs), j AS (SELECT g.*, coalesce(result, 'absent') AS got FROM g LEFT JOIN looked USING (address_id, rule_id))
SELECT category, CASE WHEN got = expected OR (rule_id % 4 = 0 AND got IN ('unknown', 'not_yet_effective')) THEN 'correct' WHEN got = 'unknown' THEN 'over_cautious' WHEN got = 'absent' THEN 'missed' ELSE 'wrong' END AS class, count(*) AS n FROM j GROUP BY ALL""")
def lookup_classes(spark, sf):
    """The lookup against a reviewer's answers for every address and rule of its place: right, too cautious, missed or wrong, by category."""
    asked = lk.jurisdiction_pairs(parcels(spark, sf), rules(spark, sf)).select("address_id", "rule_id", "category", F.expr(_EXPECTED).alias("expected"))
    also = F.when(F.col("rule_id") % 4 == 0, F.array(F.lit("unknown"), F.lit("not_yet_effective")))
    rows = asked.join(_lookup(spark, sf).select("address_id", "rule_id", "result"), ["address_id", "rule_id"], "left")
    return rows.groupBy("category", gd.result_class(F.col("expected"), F.col("result"), also).alias("class")).agg(F.count("*").alias("n"))


@query(SQL_BASE + "SELECT address_id // 100 AS block, md5(array_to_string(list_sort(list(concat_ws(':', CAST(address_id AS VARCHAR), CAST(rule_id AS VARCHAR), result))), ',')) AS digest, true AS same FROM looked GROUP BY ALL")
def determinism_runs(spark, sf):
    """The lookup worked out twice, the second time from parcels dealt otherwise: digests of blocks, and whether they agree."""

    def digests(p):
        rows = lk.lookup(p, rules(spark, sf), AS_OF).select(F.floor(F.col("address_id") / 100).alias("block"), F.concat_ws(":", "address_id", "rule_id", "result").alias("row"))
        return rows.groupBy("block").agg(F.md5(F.array_join(F.array_sort(F.collect_list("row")), ",").cast("binary")).alias("digest"))

    first, again = digests(parcels(spark, sf)), digests(parcels(spark, sf).repartition(7, "year_built"))
    both = first.join(again.withColumnRenamed("digest", "_again"), "block", "full")
    return both.select("block", "digest", F.col("digest").eqNullSafe(F.col("_again")).alias("same"))
