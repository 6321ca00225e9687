"""Queries over what rules say of one another. Rules are parts: 48 to a state, in three cities and the state itself, so groups don't grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wordings as wd
from ..operators import lookup as lk
from ..operators import relations as rel
from ..operators import verdicts as vd
from ..sources.readers import table
from ..sources.views import AS_OF, parcels
from ..sources.views import rules as rule_views
from .catalogue import query
from .rules import SQL_BASE

_SAID = (
    "A local ordinance adopted by the voters shall govern the amount.",
    "No city\nmay enact a limit on   section 12.5 units.",
    "A unit shall not be subject to both this section and a municipal code.",
    "",
    "Units already subject to a city rent stabilization ordinance.",
    "Notice is given in writing.",
    "Housing under local rent control at an amount less than the limit of this section.",
    "State law preempts the field; local rules stay.",
    "A local law shall prevail where it conflicts with this section.",
    "Dwellings are exempt from any local fee.",
    "Local rules adopted before 2019 shall control.",
    "Units subject to the city's RSO.",
    "Any matter is governed by this chapter and not by an ordinance.",
)


def _rules(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n: F.element_at(F.array(*map(F.lit, _SAID)), ((k * n) % len(_SAID) + 1).cast("int"))
    return table(spark, sf, "part").select(
        k.cast("long").alias("rule_id"), F.when(k % 4 == 0, "state").otherwise("city").alias("level"), F.floor(k / 48).alias("state"), F.when(k % 4 != 0, k % 4).alias("city"), (k % 3).alias("category"),
        (k % 17 == 0).alias("failed"), pick(7).alias("interaction"), F.when(k % 5 != 0, pick(5)).alias("exemptions"), F.when(k % 16 == 0, F.lit(2).cast("long")).alias("scope"),
        F.when(k % 6 == 0, F.array(F.struct(pick(3).alias("text"), F.when(k % 12 == 0, "3").alias("scope")))).alias("provenance"),
    )


def _says(text, phrases):
    return f"regexp_matches({wd.sql_spelled(text)}, '{wd.any_of(phrases)}')"


_quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in _SAID).replace("\n", "' || chr(10) || '")
SQL_FOUND = f"""WITH rules AS (SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 4 = 0 THEN 'state' ELSE 'city' END AS level, p_partkey // 48 AS state, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 4 END AS city, p_partkey % 3 AS category,
    trim(regexp_replace([{_quoted}][(p_partkey * 7) % {len(_SAID)} + 1], '\\s+', ' ', 'g')) AS interaction, CASE WHEN p_partkey % 5 <> 0 THEN trim(regexp_replace([{_quoted}][(p_partkey * 5) % {len(_SAID)} + 1], '\\s+', ' ', 'g')) ELSE '' END AS exemptions,
    CASE WHEN p_partkey % 16 = 0 THEN 2 END AS scope, CASE WHEN p_partkey % 6 = 0 THEN trim(regexp_replace([{_quoted}][(p_partkey * 3) % {len(_SAID)} + 1], '\\s+', ' ', 'g')) ELSE '' END AS further FROM part WHERE p_partkey % 17 <> 0),
every AS (SELECT *, 0 AS k, interaction AS text, scope AS at FROM rules UNION ALL SELECT *, 1, further, CASE WHEN rule_id % 12 = 0 THEN 3 END FROM rules UNION ALL SELECT *, 2, exemptions, scope FROM rules),
said AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY k) - 1 AS nth FROM (SELECT * FROM every WHERE text <> '' QUALIFY k = min(k) OVER (PARTITION BY rule_id, text))),
read AS (SELECT *, {_says("text", rel.STRICTER_ONLY)} AS stricter, {_says("text", rel.CONDITIONAL)} AS open, text = exemptions AS listed, {_says("text", rel.DEFERS)} AS d, {_says("text", rel.OVERRIDES)} AS o FROM said),
marked AS (SELECT *, d AND level = 'state' AND (stricter OR NOT listed) AS defers, o AND NOT listed AS over FROM read),
found AS (SELECT r.rule_id AS source, r.nth, CASE WHEN over OR open THEN 'conflict' ELSE 'yields_to_local' END AS kind, o.rule_id AS target, stricter AND NOT over AND NOT open AS stricter_only, text
    FROM marked r JOIN rules o ON o.state = r.state AND o.category = r.category AND o.level <> r.level WHERE (defers OR over) AND (r.level = 'city' OR r.at IS NULL OR r.at = o.city))
"""


@query(SQL_FOUND + "SELECT source, CAST(nth AS INTEGER) AS nth, kind, target, stricter_only, text FROM found")
def relations_found(spark, sf):
    """Relations read from the rules' texts, a row a pair."""
    return rel.relations(_rules(spark, sf))


@query(SQL_FOUND + """, targets AS (SELECT source, nth, kind, stricter_only, text, string_agg(CAST(target AS VARCHAR), ', ' ORDER BY target) AS ids FROM found GROUP BY ALL),
words AS (SELECT source AS rule_id, source, nth, CASE WHEN kind = 'conflict' THEN 'unresolved against ' WHEN stricter_only THEN 'gives way to stricter ' ELSE 'gives way to ' END || ids || ': "' || text || '"' AS said FROM targets
    UNION ALL SELECT target, source, nth, CASE WHEN kind = 'conflict' THEN 'unresolved against ' ELSE 'comes before ' END || source FROM found),
firsts AS (SELECT rule_id, said, min((source, nth)) AS first FROM words GROUP BY ALL), spoken AS (SELECT rule_id, string_agg(said, '; ' ORDER BY first, said) AS interaction FROM firsts GROUP BY rule_id),
ties AS (SELECT rule_id, string_agg(DISTINCT CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) AS overrides FROM (SELECT source AS rule_id, target AS other FROM found UNION SELECT target, source FROM found) GROUP BY rule_id)
SELECT p_partkey AS rule_id, coalesce(overrides, '') AS overrides, interaction FROM part LEFT JOIN ties ON ties.rule_id = p_partkey LEFT JOIN spoken ON spoken.rule_id = p_partkey""")
def relation_links(spark, sf):
    """The rules each rule is tied to, and how, in words."""
    rules = _rules(spark, sf)
    found = rel.linked(rules, rel.spoken(rules))
    return found.select("rule_id", F.array_join(F.sort_array(F.transform("overrides", lambda x: x.cast("string"))), ",").alias("overrides"), "interaction")


#: What the sentences and confidences need beside the lookup's columns, for Spark and for SQL.
_MORE = {
    "stricter": "defers AND rule_id % 2 = 0", "exempts": "rule_id % 2 = 0", "disputed": "rule_id % 13 = 0", "own_cents": "CASE WHEN rule_id % 3 > 0 THEN 70 + rule_id % 26 END", "derived": "form = 4",
    "described": "form IN (1, 2, 3) AND address_id % 4 = 0",
}
_doubt = {
    "derived": "derived", "presumed": "presumed", "described": "described", "partly_exempt": "exempts AND form > 0", "exempt": "exempts AND form = 0", "city_open": "level = 'city' AND confidence = 'low'",
    "city_near": "level = 'city' AND confidence = 'medium'", "not_compared": "by_stricter", "governor_open": "reason = 'may_be_superseded'",
}
_more_sql = ", ".join(f"{v} AS {k}" for k, v in _MORE.items())
_reasons_sql = ", ".join(f"CASE WHEN {_doubt[d]} THEN '-{cost} {d}' END" for d, cost in vd.PENALTIES.items())
_label = "CASE x WHEN 'units' THEN 'number of units' WHEN 'owner_occupied' THEN 'owner occupancy' ELSE replace(x, '_', ' ') END"
_and = lambda xs: f"(CASE WHEN len({xs}) < 2 THEN coalesce({xs}[1], '') ELSE array_to_string({xs}[1:len({xs}) - 1], ', ') || ' and ' || {xs}[len({xs})] END)"
SQL_DECIDED = SQL_BASE + f""", grouped AS (SELECT *, base_result IN ('applies', 'unknown') AS live, level = 'city' AND base_result = 'applies' AND form > 0 AS sure FROM base),
around AS (SELECT address_id, category, min(rule_id) FILTER (sure) AS first_sure, min(rule_id) FILTER (level = 'city' AND live AND NOT sure) AS first_maybe,
    coalesce(list(rule_id ORDER BY rule_id) FILTER (level = 'city' AND live), []) AS cities, coalesce(list(rule_id ORDER BY rule_id) FILTER (conflicts AND live), []) AS sayers FROM grouped GROUP BY ALL),
reasoned AS (SELECT g.*, CASE WHEN base_result IN ('pending', 'not_yet_effective') THEN 'status' WHEN defers AND base_result = 'applies' AND first_sure IS NOT NULL THEN 'superseded' WHEN defers AND base_result = 'applies' AND first_maybe IS NOT NULL THEN 'may_be_superseded'
    WHEN level = 'city' AND base_result = 'unknown' AND confidence = 'low' THEN 'jurisdiction' ELSE 'coverage' END AS reason, CASE WHEN defers AND live THEN coalesce(first_sure, first_maybe) END AS other,
    CASE WHEN conflicts AND live THEN cities WHEN level = 'city' AND live THEN sayers ELSE [] END AS against, strict IS NULL AND NOT presumed AS uncovered, {_more_sql} FROM grouped g JOIN around USING (address_id, category)),
decided AS (SELECT *, CASE reason WHEN 'superseded' THEN 'superseded' WHEN 'may_be_superseded' THEN 'unknown' ELSE base_result END AS result, reason = 'superseded' AND stricter AS by_stricter, coalesce(own_cents, 90) AS own FROM reasoned),
scored AS (SELECT *, greatest(10, own - {" - ".join(f"CASE WHEN {_doubt[d]} THEN {cost} ELSE 0 END" for d, cost in vd.PENALTIES.items())}) AS score FROM decided)
"""


@query(SQL_DECIDED + f"""SELECT address_id, rule_id, result, reason, other, array_to_string(against, ',') AS against, array_to_string([x FOR x IN [CASE WHEN reason = 'coverage' AND other IS NOT NULL THEN 'whether ' || other || ' governs instead' END,
    CASE WHEN len(against) > 0 THEN 'what holds between this rule and ' || array_to_string(against, ', ') END, CASE WHEN reason = 'may_be_superseded' THEN 'whether ' || other || ' covers the unit' END,
    CASE WHEN by_stricter THEN 'whether the local limit is stricter' END] IF x IS NOT NULL], '|') AS notes, CAST(CASE WHEN len(against) > 0 THEN least(score, 60) ELSE score END AS INTEGER) AS cents,
array_to_string([x FOR x IN ['own ' || own, {_reasons_sql}, CASE WHEN len(against) > 0 AND score > 60 THEN 'at most 60 in a conflict' END] IF x IS NOT NULL], '|') AS reasons FROM scored""")
def verdicts(spark, sf):
    """Every result of the lookup with what decided it, what is open between rules, and its confidence with reasons."""
    cents, why = vd.confidence()
    rows = _decided(spark, sf)
    return rows.select("address_id", "rule_id", "result", "reason", "other", F.array_join("against", ",").alias("against"), F.array_join(vd.notes(), "|").alias("notes"), cents.alias("cents"), F.array_join(why, "|").alias("reasons"))


def _decided(spark, sf):
    pairs = lk.base_results(lk.jurisdiction_pairs(parcels(spark, sf), rule_views(spark, sf)), F.lit(AS_OF).cast("date"))
    more = {k: F.expr(v) for k, v in _MORE.items()}
    return vd.decided(pairs.withColumns(more).withColumn("uncovered", F.expr("size(missing) > 0 AND NOT presumed")), ["address_id"])


@query(SQL_DECIDED + f""", facts AS (SELECT *, 'Sec. ' || rule_id || ', ' || jurisdiction AS head, [{_label} FOR x IN missing] AS m, 'Sec. ' || other AS o, 'Sec. ' || against[1] AS a,
    [x FOR x IN [CASE WHEN form IN (1, 2, 3) AND (units_min IS NOT NULL OR units_max IS NOT NULL) THEN 'number of units' END, CASE WHEN form IN (1, 2, 4) AND year_built IS NOT NULL THEN CASE WHEN derived THEN 'year built, taken for the day of the certificate' ELSE 'year built' END END] IF x IS NOT NULL] AS used,
    [x FOR x IN [CASE WHEN presumed AND form = 3 THEN 'exemptions that turn on owner occupancy' END, CASE WHEN exempts AND result IN ('applies', 'superseded', 'unknown') THEN CASE WHEN presumed AND form = 3 THEN 'its other exemptions' ELSE 'its exemptions' END END,
    CASE WHEN by_stricter THEN 'which limit is stricter' END, CASE WHEN confidence = 'low' AND city IS NOT NULL AND reason <> 'jurisdiction' THEN 'the city the law counts' END, CASE WHEN city IS NULL THEN 'rules of a city' END] IF x IS NOT NULL] AS lacks FROM decided),
worded AS (SELECT *, CASE WHEN len(m) > 0 AND uncovered THEN '; its reach here turns on ' || {_and("m")} ELSE '' END AS open FROM facts)
SELECT address_id, rule_id, array_to_string(lacks, '|') AS unchecked, head || CASE WHEN result = 'pending' THEN ' is proposed and not law on that day' || open WHEN result = 'not_yet_effective' THEN ' is enacted and not in effect on that day' || open
    WHEN reason = 'superseded' THEN ' reaches this building and gives way to ' || CASE WHEN by_stricter THEN 'the stricter ' ELSE '' END || o WHEN reason = 'jurisdiction' THEN ' may apply once the city that counts in law is known'
    WHEN reason = 'may_be_superseded' THEN ' reaches this building unless ' || o || ' does, which is open' WHEN result = 'unknown' THEN ' may apply; not known: ' || CASE WHEN len(m) > 0 THEN {_and("m")} ELSE 'facts of its coverage' END
    WHEN form = 0 THEN ' applies, with no condition to test' WHEN len(used) = 0 THEN ' applies, its conditions being met' ELSE ' applies by ' || {_and("used")} END || '.' || CASE WHEN len(lacks) > 0 THEN ' Not checked: ' || array_to_string(lacks, ', ') || '.' ELSE '' END
    || CASE WHEN len(against) > 0 THEN ' Under review: it may contradict ' || a || CASE WHEN len(against) > 1 THEN ' and others' ELSE '' END || '.' WHEN disputed THEN ' Under review: its sources differ.' ELSE '' END AS explanation FROM worded""")
def explanations(spark, sf):
    """Every result of the lookup in words, with what was not checked and what is under review."""
    form, none = F.col("form"), F.array().cast("array<string>")
    used = F.array_compact(F.array(F.when(form.isin(1, 2, 3) & (F.col("units_min").isNotNull() | F.col("units_max").isNotNull()), "units"), F.when(form.isin(1, 2, 4) & F.col("year_built").isNotNull(), "year_built")))
    presumed = F.when(F.col("presumed") & (form == 3), F.array(F.lit("owner_occupied"))).otherwise(none)
    rows = _decided(spark, sf).withColumns({"used": used, "presumed_facts": presumed})
    rows = rows.withColumn("unchecked", vd.unchecked())
    cite = lambda c: F.concat(F.lit("Sec. "), c.cast("string"))
    text = vd.explained(cite(F.col("rule_id")), cite(F.col("other")), cite(F.get("against", F.lit(0))))
    return rows.select("address_id", "rule_id", F.array_join("unchecked", "|").alias("unchecked"), text.alias("explanation"))
