"""Queries over records as they come: facts in text columns, ids of others, and the form of rule records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as ct
from ..operators import detail as dt
from ..operators import facts as fc
from ..operators import test_ids as ti
from ..sources.readers import table
from ..sources.views import SQL_VIEWS, places, rules
from .catalogue import query

_RAW = {
    "units": "CASE k % 9 WHEN 0 THEN '7' WHEN 1 THEN ' 12 ' WHEN 2 THEN '7.0' WHEN 3 THEN '7.5' WHEN 4 THEN 'many' WHEN 5 THEN '' WHEN 6 THEN '1e1' END", "units_min": "CASE WHEN k % 4 > 0 THEN CAST(k % 15 AS {s}) END", "units_max": "CASE WHEN k % 5 > 0 THEN CAST(k % 11 AS {s}) || '.0' END",
    "units_source": "CASE WHEN k % 3 = 0 THEN ' use_description ' WHEN k % 3 = 1 THEN '' END", "year_built": "CASE WHEN k % 6 = 0 THEN 'unknown' WHEN k % 6 <> 5 THEN CAST(1900 + k % 120 AS {s}) END", "use_description": "CASE WHEN k % 7 = 0 THEN '  ' WHEN k % 7 <> 6 THEN 'flats' END",
    "city": "CASE WHEN k % 8 = 0 THEN ' ' ELSE 'Paris' END", "confidence": "CASE k % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium ' WHEN 2 THEN 'low' WHEN 3 THEN 'sure' END",
}
_raw = lambda s: ", ".join(f"{v.format(s=s)} AS {c}" for c, v in _RAW.items())
_whole = lambda c: f"CASE WHEN TRY_CAST(trim({c}) AS DOUBLE) = floor(TRY_CAST(trim({c}) AS DOUBLE)) THEN CAST(TRY_CAST(trim({c}) AS DOUBLE) AS INTEGER) END"
SQL_FACTS = f"""WITH raw AS (SELECT k, {_raw('VARCHAR')} FROM (SELECT c_custkey AS k FROM customer)), n AS (SELECT k, {_whole('units')} AS u, {_whole('units_min')} AS a, {_whole('units_max')} AS b, {_whole('year_built')} AS year_built, nullif(trim(units_source), '') AS src, nullif(trim(use_description), '') AS use_description, nullif(trim(city), '') AS city,
    CASE WHEN trim(confidence) IN ('high', 'medium', 'low') THEN trim(confidence) ELSE 'low' END AS confidence FROM raw),
w AS (SELECT *, CASE WHEN u IS NULL THEN a ELSE least(u, a) END AS l, CASE WHEN u IS NULL THEN b ELSE greatest(u, b) END AS h FROM n), r AS (SELECT *, CASE WHEN l > h THEN NULL ELSE l END AS units_min, CASE WHEN l > h THEN NULL ELSE h END AS units_max FROM w),
facts AS (SELECT k AS address_id, city, confidence, year_built, units_min, units_max, CASE WHEN units_min IS NOT NULL OR units_max IS NOT NULL THEN coalesce(src, CASE WHEN u IS NOT NULL THEN 'units' END) END AS units_source, use_description FROM r)"""
_gone = "array_to_string([x FOR x IN [CASE WHEN year_built IS NULL THEN 'year_built' END, CASE WHEN units_min IS NULL AND units_max IS NULL THEN 'units' END, CASE WHEN use_description IS NULL THEN 'use_description' END] IF x IS NOT NULL], ',') AS missing"
_more = f"{_gone}, city IS NOT NULL AND confidence IN ('high', 'medium') AS city_confirmed, CASE WHEN units_min = units_max THEN units_min END AS units_exact"


def _facts(spark, sf):
    keys = table(spark, sf, "customer").selectExpr("c_custkey AS k")
    return fc.normalised(keys.selectExpr("k AS address_id", *[f"{v.format(s='STRING')} AS {c}" for c, v in _RAW.items()]))


@query(SQL_FACTS + f" SELECT *, {_more} FROM facts")
def facts_normalised(spark, sf):
    """Facts of every customer's building from text columns with blanks, fractions, words and ranges upside down."""
    return _facts(spark, sf).withColumn("missing", F.array_join("missing", ","))


_STATED = {"year_built": "CASE WHEN k % 4 = 0 THEN 1950 + k % 100 WHEN k % 4 = 1 THEN 1200 END", "units": "CASE WHEN k % 3 = 0 THEN k % 20 END", "units_min": "CASE WHEN k % 5 = 1 THEN k % 12 END", "units_max": "CASE WHEN k % 5 = 1 OR k % 10 = 2 THEN k % 8 END"}


@query(SQL_FACTS + f""", stated AS (SELECT k AS address_id, {', '.join(f'CAST({v} AS INTEGER) AS s_{c}' for c, v in _STATED.items())} FROM (SELECT c_custkey AS k FROM customer) WHERE k % 2 = 0 OR k % 3 = 0),
j AS (SELECT facts.*, stated.* EXCLUDE (address_id), CASE WHEN s_year_built NOT BETWEEN 1600 AND 2100 THEN 'year_built out of bounds' WHEN s_units_min > s_units_max THEN 'units_min above units_max' WHEN s_units IS NOT NULL AND (s_units_min IS NOT NULL OR s_units_max IS NOT NULL) THEN 'units and a range' END AS problem FROM facts LEFT JOIN stated USING (address_id)),
m AS (SELECT address_id, city, confidence, use_description, problem, problem IS NULL AND (s_units IS NOT NULL OR s_units_min IS NOT NULL OR s_units_max IS NOT NULL) AS given, array_to_string([x FOR x IN [CASE WHEN problem IS NULL THEN 'year_built=' || s_year_built END, CASE WHEN problem IS NULL THEN 'units=' || s_units END, CASE WHEN problem IS NULL THEN 'units_min=' || s_units_min END, CASE WHEN problem IS NULL THEN 'units_max=' || s_units_max END] IF x IS NOT NULL], ',') AS used,
    CASE WHEN given THEN coalesce(s_units, s_units_min) ELSE units_min END AS units_min, CASE WHEN given THEN coalesce(s_units, s_units_max) ELSE units_max END AS units_max, CASE WHEN given THEN 'user_input' ELSE units_source END AS units_source, CASE WHEN problem IS NULL THEN coalesce(s_year_built, year_built) ELSE year_built END AS year_built FROM j)
SELECT address_id, problem, used, units_min, units_max, units_source, year_built, {_more} FROM m""")
def facts_stated(spark, sf):
    """What users state put in place of the record, or why it isn't."""
    keys = table(spark, sf, "customer").selectExpr("c_custkey AS k").where("k % 2 = 0 OR k % 3 = 0")
    stated = keys.selectExpr("k AS address_id", *[f"CAST({v} AS INT) AS {c}" for c, v in _STATED.items()])
    rows = fc.with_stated(_facts(spark, sf), stated, "address_id")
    return rows.select("address_id", "problem", F.array_join("used", ",").alias("used"), "units_min", "units_max", "units_source", "year_built", F.array_join("missing", ",").alias("missing"), "city_confirmed", "units_exact")


_KINDS = ("RENT", "EVICT", "DEP", "FEE", "NOTE", "REG")
_ORG = "CASE WHEN k % 23 = 0 THEN 'no id' ELSE place || '-' || ['RENT', 'EVICT', 'DEP', 'FEE', 'NOTE', 'REG', 'ODD'][k % 7 + 1] || '-' || CASE WHEN k % 3 = 0 THEN 'P' ELSE '' END || (k % 5) END"


@query(SQL_VIEWS + f""", ids AS (SELECT DISTINCT {_ORG} AS org_id, CASE WHEN k % 23 <> 0 THEN place END AS place, CASE WHEN k % 23 <> 0 AND k % 7 < 6 THEN CAST(k % 7 AS INTEGER) END AS category, CASE WHEN k % 23 = 0 THEN NULL WHEN k % 3 = 0 THEN 'pending_or_failed' ELSE 'enacted' END AS status_class
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN r_name WHEN c_custkey % 4 = 1 THEN 'nation' || c_nationkey % 10 ELSE 'NATION' || c_nationkey END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)),
cities AS (SELECT i.place, count(DISTINCT n_name) AS n, min(n_name) AS city FROM (SELECT DISTINCT place FROM ids WHERE place NOT IN (SELECT r_name FROM region)) i LEFT JOIN nation ON starts_with(regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g'), lower(i.place)) OR substring(lower(n_name), 1, 1) = lower(i.place) GROUP BY i.place),
j AS (SELECT i.*, r_name IS NOT NULL AS is_state, coalesce(r_name, CASE WHEN n = 1 THEN city END) AS jurisdiction FROM ids i LEFT JOIN region ON r_name = i.place LEFT JOIN cities USING (place)),
pools AS (SELECT jurisdiction, level, category, CASE WHEN hint IN ('bill', 'failed') THEN 'pending_or_failed' ELSE 'enacted' END AS status_class, list(rule_id ORDER BY rule_id) AS found FROM rules GROUP BY ALL),
f AS (SELECT j.*, CASE WHEN is_state THEN 'state' WHEN j.jurisdiction IS NOT NULL THEN 'city' END AS lvl, coalesce(p.found, []) AS found, CASE WHEN j.org_id LIKE '%-RENT-1' THEN [1, 2] END AS kept FROM j LEFT JOIN pools p ON p.jurisdiction = j.jurisdiction AND p.category = j.category AND p.status_class = j.status_class AND p.level = CASE WHEN is_state THEN 'state' ELSE 'city' END)
SELECT org_id, jurisdiction, lvl AS level, category, status_class, array_to_string(coalesce(kept, found), ',') AS rule_ids, CASE WHEN kept IS NOT NULL THEN NULL WHEN place IS NULL THEN 'no such form of id' WHEN category IS NULL THEN 'kind not known' WHEN jurisdiction IS NULL THEN 'no place or several' WHEN len(found) = 0 THEN 'no such rule' END AS problem,
CASE WHEN kept IS NOT NULL THEN 'reviewed' ELSE 'matched' END AS how, kept IS NOT NULL AND kept <> found AS differs FROM f""")
def test_ids_matched(spark, sf):
    """An organiser's ids, one a customer, matched with our rules by place, kind and number; reviewed ones as they were reviewed."""
    k = F.col("c_custkey")
    there = table(spark, sf, "customer").join(places(spark, sf), F.col("c_nationkey") == F.col("nationkey"))
    place = F.when(k % 4 == 0, F.col("state")).when(k % 4 == 1, F.concat(F.lit("nation"), F.col("c_nationkey") % 10)).otherwise(F.concat(F.lit("NATION"), "c_nationkey"))
    kind = F.element_at(F.array(*map(F.lit, (*_KINDS, "ODD"))), (k % 7 + 1).cast("int"))
    ids = there.select(F.when(k % 23 == 0, "no id").otherwise(F.concat_ws("-", place, kind, F.concat(F.when(k % 3 == 0, "P").otherwise(""), (k % 5).cast("string")))).alias("org_id"))
    kinds = spark.createDataFrame([(x, i) for i, x in enumerate(_KINDS)], "kind string, category int")
    states = table(spark, sf, "region").select(F.col("r_name").alias("state"))
    ours = rules(spark, sf).select("rule_id", "jurisdiction", "level", "category", F.when(F.col("hint") == "bill", "pending").when(F.col("hint") == "failed", "failed").otherwise("in_force").alias("status"))
    reviewed = ids.distinct().where("org_id LIKE '%-RENT-1'").select("org_id", F.array(F.lit(2), F.lit(1)).alias("rule_ids"))
    return ti.matched(ids, kinds, states, places(spark, sf), ours, reviewed).withColumn("rule_ids", F.array_join("rule_ids", ","))


_REC = {
    "rule_id": "CASE WHEN k % 19 = 0 THEN 'x' || k WHEN k % 10 = 1 THEN 'r-' || lpad(CAST(k - 1 AS {s}), 6, '0') ELSE 'r-' || lpad(CAST(k AS {s}), 6, '0') END", "title": "CASE WHEN k % 12 = 0 THEN ' ' ELSE p_name END", "category": "CASE k % 4 WHEN 0 THEN 'rent' WHEN 1 THEN 'eviction' WHEN 2 THEN 'deposit' ELSE p_type END",
    "jurisdiction": "CASE WHEN k % 2 = 0 THEN 'CA' ELSE 'Town, CA' END", "level": "CASE WHEN k % 14 = 0 THEN 'city' WHEN k % 15 = 1 THEN NULL WHEN k % 2 = 0 THEN 'state' ELSE 'city' END", "status": "CASE k % 6 WHEN 0 THEN 'in_force' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'not_yet_effective' WHEN 4 THEN 'in_force' ELSE 'repealed' END",
    "effective_date": "CASE k % 8 WHEN 0 THEN '2026-01-01' WHEN 1 THEN '2026-13' WHEN 2 THEN '2026' WHEN 3 THEN 'soon' WHEN 4 THEN '1026-05-01' WHEN 5 THEN '2026-07' END", "citation": "CASE WHEN k % 16 <> 0 THEN p_brand END", "quoted_span": "CASE WHEN k % 18 <> 0 THEN p_name END", "confidence": "CAST(k % 105 AS DOUBLE) / 100",
    "doc_id": "CASE WHEN k % 21 <> 0 THEN k % 1500 END", "superseded_by": "CASE WHEN k % 20 = 0 THEN 'r-' || lpad(CAST(k AS {s}), 6, '0') WHEN k % 20 = 10 THEN 'r-999999999' END",
}
_rec = lambda s: ", ".join(f"{v.format(s=s)} AS {c}" for c, v in _REC.items())


@query(f"""WITH r AS (SELECT {_rec('VARCHAR')} FROM (SELECT *, p_partkey AS k FROM part)), n AS (SELECT *, count(*) OVER (PARTITION BY rule_id) AS same FROM r), ids AS (SELECT DISTINCT rule_id FROM r),
p AS (SELECT n.*, [x FOR x IN [CASE WHEN NOT regexp_matches(n.rule_id, '^r-[0-9]{{4,}}$') THEN 'id has another form' END, CASE WHEN trim(coalesce(title, '')) = '' THEN 'title is missing' END, CASE WHEN trim(coalesce(citation, '')) = '' THEN 'citation is missing' END, CASE WHEN trim(coalesce(quoted_span, '')) = '' THEN 'quoted_span is missing' END,
    CASE WHEN category NOT IN ('rent', 'eviction', 'deposit') THEN 'category not known' END, CASE WHEN level IS DISTINCT FROM CASE WHEN contains(jurisdiction, ', ') THEN 'city' ELSE 'state' END THEN 'level is not the jurisdiction''s' END, CASE WHEN status = 'repealed' THEN 'status not known' END,
    CASE WHEN NOT regexp_matches(effective_date, '^[0-9]{{4}}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$') THEN 'date has another form' END, CASE WHEN status = 'in_force' AND effective_date < '1600' THEN 'in force without a date''s year' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of bounds' END,
    CASE WHEN superseded_by = n.rule_id THEN 'supersedes itself' END, CASE WHEN same > 1 THEN 'id repeats' END, CASE WHEN doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents) THEN 'document not there' END, CASE WHEN superseded_by IS NOT NULL AND ids.rule_id IS NULL THEN 'successor not there' END] IF x IS NOT NULL] AS ps FROM n LEFT JOIN ids ON ids.rule_id = n.superseded_by)
SELECT rule_id, unnest(ps) AS problem FROM p""")
def rule_problems(spark, sf):
    """All that is wrong with rule records made of the parts: forms, values, repeated ids, documents and successors that aren't there."""
    records = table(spark, sf, "part").selectExpr("*", "p_partkey AS k").selectExpr(*[f"{v.format(s='STRING')} AS {c}" for c, v in _REC.items()])
    return ct.rule_problems(records, table(spark, sf, "documents").select("doc_id"), ("rent", "eviction", "deposit"))


@query("""WITH s AS (SELECT doc_id * 2 + r AS k, doc_id + CASE WHEN doc_id % 19 = 0 THEN 100000000 ELSE 0 END AS rule_id, CASE WHEN r = 0 THEN 'tenant' ELSE 'owner' END AS role, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'You may, ' || doc_id END AS answer,
    CASE WHEN doc_id % 5 = 0 THEN sha256('older') WHEN doc_id % 5 <> 1 THEN sha256(coalesce(text, '')) END AS sha FROM documents, range(2) t(r)), j AS (SELECT s.*, sha256(coalesce(d.text, '')) AS now, d.doc_id FROM s LEFT JOIN documents d ON d.doc_id = s.rule_id),
w AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'orphan' WHEN sha IS DISTINCT FROM now THEN 'stale' WHEN trim(answer) = '' THEN 'empty' ELSE 'shown' END AS state FROM j) SELECT rule_id, role, CASE WHEN state = 'shown' THEN answer END AS answer, state FROM w""")
def summaries_guarded(spark, sf):
    """Two answers a document's rule, shown only while they are of the whole text that the rule quotes now."""
    docs, k = table(spark, sf, "documents"), F.col("doc_id")
    sha = F.when(k % 5 == 0, F.sha2(F.lit("older"), 256)).when(k % 5 != 1, F.sha2(F.coalesce("text", F.lit("")), 256))
    id_ = k + F.when(k % 19 == 0, 100_000_000).otherwise(0)
    made = docs.select(id_.alias("rule_id"), F.explode(F.array(F.lit("tenant"), F.lit("owner"))).alias("role"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("You may, "), k)).alias("answer"), sha.alias("quote_sha"))
    return dt.guarded_answers(docs.select(k.alias("rule_id"), F.col("text").alias("quoted_span")), made)


@query("""WITH r AS (SELECT p_partkey AS id, ['c' || p_partkey, 'c' || (p_partkey + 1)] AS c, p_partkey // 3 AS chunk, p_partkey // 10 AS doc FROM part), l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'verify' WHEN 1 THEN 'extract' WHEN 2 THEN 'ingest' ELSE 'serve' END AS stage, user_id FROM events)
SELECT id AS rule_id, event_id AS line_id, stage FROM r JOIN l ON stage = 'verify' AND user_id = id WHERE event_id % 3 = 0 OR list_contains(c, 'c' || (user_id + event_id % 3 - 1 + event_id % 2)) UNION ALL
SELECT id, event_id, stage FROM r JOIN l ON stage = 'extract' AND user_id = chunk UNION ALL SELECT id, event_id, stage FROM r JOIN l ON stage = 'ingest' AND user_id = doc""")
def audit_matched(spark, sf):
    """Events as audit lines, matched with the rules they are about by stage: by rule and candidates, by chunk, by document."""
    k, u, e = F.col("p_partkey"), F.col("user_id"), F.col("event_id")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    rules_ = table(spark, sf, "part").select(k.cast("long").alias("rule_id"), F.array(name(k), name(k + 1)).alias("candidates"), F.array(F.floor(k / 3).cast("string")).alias("chunks"), F.array(F.floor(k / 10).cast("string")).alias("docs"))
    stage = F.when(e % 4 == 0, "verify").when(e % 4 == 1, "extract").when(e % 4 == 2, "ingest").otherwise("serve")
    named = F.when(e % 3 != 0, F.array(name(u + e % 3 - 1 + e % 2)))
    lines = table(spark, sf, "events").select(e.alias("line_id"), stage.alias("stage"), u.cast("long").alias("rule_id"), named.alias("candidates"), u.cast("string").alias("chunk_id"), u.cast("string").alias("doc_id"))
    return dt.audit_of(rules_, lines)
