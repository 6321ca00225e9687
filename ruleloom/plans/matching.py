"""Queries that match records: sources, places, checklists, geocodes, tests, and lists of bounded length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as mt
from ..operators.lookup import lookup
from ..sources.readers import table
from ..sources.views import AS_OF, parcels, places
from ..sources.views import rules as rule_views
from .catalogue import query
from .rules import SQL_BASE


@query("""SELECT l_orderkey * 10 + l_linenumber AS rule_id, CASE WHEN o.o_orderkey IS NULL THEN 'document not in the manifest' ELSE 'address differs from the manifest' END AS problem
FROM lineitem LEFT JOIN orders o ON o.o_orderkey = l_orderkey + CASE WHEN l_suppkey % 10 = 0 THEN 1000000000 ELSE 0 END
WHERE o.o_orderkey IS NULL OR ('u/' || o_custkey || CASE WHEN l_partkey % 50 = 0 THEN '?x' ELSE '' END) IS DISTINCT FROM 'u/' || o_custkey""")
def source_problems(spark, sf):
    """Lines as rules and orders as the manifest: which rules name no document of it, or another address."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    far = F.col("l_orderkey") + F.when(F.col("l_suppkey") % 10 == 0, 1_000_000_000).otherwise(0)
    said = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rules = said.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"), far.alias("doc_id"), F.concat(F.lit("u/"), "o_custkey", F.when(F.col("l_partkey") % 50 == 0, "?x").otherwise("")).alias("url"))
    return mt.source_problems(rules, orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("u/"), "o_custkey").alias("url")))


@query(SQL_BASE + """SELECT c_custkey AS address_id, n_name AS city, r_name AS state, concat_ws('|', CASE WHEN n_name IS NULL AND c_custkey % 13 <> 0 THEN 'place not known' END, CASE WHEN n_regionkey <> r_regionkey THEN 'place lies in another state' END, CASE WHEN r_name <> s.state THEN 'postal state differs' END) AS problems
FROM customer JOIN (SELECT nationkey, state FROM places) s ON s.nationkey = c_nationkey LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN c_nationkey + 100 ELSE c_nationkey END
LEFT JOIN region ON r_regionkey = (SELECT n2.n_regionkey FROM nation n2 WHERE n2.n_nationkey = c_nationkey) + CASE WHEN c_custkey % 19 = 0 AND c_nationkey % 5 = 0 THEN 1 ELSE 0 END WHERE r_name IS NOT NULL""")
def points_located(spark, sf):
    """Customers as points with geographic ids: city and state, and where ids and post contradict each other."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("c_custkey")
    home = table(spark, sf, "customer").join(places(spark, sf), F.col("c_nationkey") == F.col("nationkey")).join(nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("home")), "nationkey")
    points = home.select(
        key.alias("address_id"), F.when(key % 13 == 0, None).when(key % 17 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("place_geoid"),
        (F.col("home") + F.when((key % 19 == 0) & (F.col("c_nationkey") % 5 == 0), 1).otherwise(0)).alias("state_geoid"), F.col("state").alias("postal_state"),
    )
    found = mt.located(points, nation.select(F.col("n_nationkey").alias("place_geoid"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("state_geoid")), region.select(F.col("r_regionkey").alias("state_geoid"), F.col("r_name").alias("state")))
    return found.where("state IS NOT NULL").select("address_id", "city", "state", F.array_join("problems", "|").alias("problems"))


@query("""WITH hit AS (SELECT s_suppkey, s_nationkey, coalesce(bool_or(p_partkey = s_suppkey * 20 OR contains(lower(p_name), split_part(lower(s_cite), ' ', 1))), false) AS found
FROM (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 'Ring' WHEN 1 THEN 'Small' ELSE NULL END AS s_cite FROM supplier) LEFT JOIN part ON p_partkey % 25 = s_nationkey AND p_size % 6 = s_suppkey % 6 GROUP BY ALL)
SELECT s_nationkey AS jurisdiction, count(*) AS items, count(*) FILTER (WHERE found) AS found FROM hit GROUP BY s_nationkey""")
def checklist_recall(spark, sf):
    """Suppliers as a checklist over parts as rules: how many of each jurisdiction's items some rule answers."""
    s = F.col("s_suppkey")
    items = table(spark, sf, "supplier").select(s.alias("item_id"), F.col("s_nationkey").alias("jurisdiction"), (s % 6).alias("category"), (s * 20).alias("doc_id"), F.when(s % 3 == 0, "Ring").when(s % 3 == 1, "Small").alias("citation"))
    rules = table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("jurisdiction"), (F.col("p_size") % 6).alias("category"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("citation"))
    found = mt.checklist_found(items, rules).join(items.select("item_id", "jurisdiction"), "item_id")
    return found.groupBy("jurisdiction").agg(F.count("*").alias("items"), F.count_if("found").alias("found"))


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 'MAIN AVENUE' ELSE c_custkey || CASE WHEN c_custkey % 5 = 0 THEN '-' || (c_custkey + 4) ELSE '' END || ' OAK AV' || CASE WHEN c_custkey % 4 = 1 THEN ' Apt 3' ELSE '' END END AS street FROM customer)
SELECT k AS address_id, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 3 = 0 THEN k || ' OAK AVE, TOWN' WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 OR k % 4 = 1 OR true THEN k || ' OAK AVE, CITY' END AS matched,
CASE WHEN k % 9 = 0 THEN 'none' WHEN k % 3 = 0 THEN 'batch' WHEN k % 7 = 0 THEN 'none' ELSE 'retry ' || CASE WHEN k % 5 = 0 THEN CASE WHEN k % 4 = 1 THEN 2 ELSE 1 END ELSE CASE WHEN k % 4 = 1 THEN 2 ELSE 1 END END END AS source FROM a""")
def geocode_cascade(spark, sf):
    """Addresses of customers: the batch's answer where its number agrees, else the first retry that the cache answers."""
    k = F.col("c_custkey")
    n = k
    numbered = F.concat(n, F.when(k % 5 == 0, F.concat(F.lit("-"), n + 4)).otherwise(""), F.lit(" OAK AV"), F.when(k % 4 == 1, " Apt 3").otherwise(""))
    batch = F.when(k % 3 == 0, F.concat(n, F.lit(" OAK AVE, TOWN"))).when(k % 3 == 1, F.concat(n + 50, F.lit(" OAK AVE, TOWN")))
    customers = table(spark, sf, "customer")
    rows = customers.select(k.alias("address_id"), F.when(k % 9 == 0, "MAIN AVENUE").otherwise(numbered).alias("street"), F.lit(None).cast("string").alias("unit"), batch.alias("batch_match"))
    # the cache knows cleaned streets only, and none of every seventh
    cached = customers.where(k % 7 != 0).select(F.concat(n, F.lit(" OAK AVE")).alias("query"), F.concat(n, F.lit(" OAK AVE, CITY")).alias("matched"))
    return mt.geocoded(rows, cached)


@query("""WITH t AS (SELECT s_suppkey AS test_id, CASE s_suppkey % 4 WHEN 0 THEN 'nation' || s_nationkey WHEN 1 THEN 'Nation1' WHEN 2 THEN 'x' ELSE 'nation' || (s_nationkey % 10) END AS prefix FROM supplier),
m AS (SELECT test_id, count(DISTINCT n_name) AS n, min(n_name) AS city FROM t LEFT JOIN nation ON starts_with(regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g'), lower(prefix)) OR substring(lower(n_name), 1, 1) = lower(prefix) GROUP BY test_id)
SELECT test_id, CASE WHEN n = 1 THEN city END AS city FROM m""")
def test_places(spark, sf):
    """The one place that a test's prefix means, if it means one."""
    s = F.col("s_suppkey")
    prefix = F.when(s % 4 == 0, F.concat(F.lit("nation"), "s_nationkey")).when(s % 4 == 1, "Nation1").when(s % 4 == 2, "x").otherwise(F.concat(F.lit("nation"), F.col("s_nationkey") % 10))
    return mt.place_of_prefix(table(spark, sf, "supplier").select(s.alias("test_id"), prefix.alias("prefix")), places(spark, sf))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY k) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) || ' more' ELSE '' END AS said FROM r WHERE k <= 3 GROUP BY o_custkey""")
def lists_cut_short(spark, sf):
    """Each customer's three dearest orders and how many more there are."""
    return mt.first_of(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "o_orderkey")


@query("""WITH a AS (SELECT source, md5(CAST(sum(CAST(crc AS BIGINT)) AS VARCHAR)) AS f FROM (SELECT source, doc_id * 7919 % 10007 AS crc FROM documents) GROUP BY source),
b AS (SELECT source, md5(CAST(sum(CAST(crc AS BIGINT)) AS VARCHAR)) AS f FROM (SELECT CASE WHEN doc_id % 97 = 0 THEN 'moved' ELSE source END AS source, doc_id * 7919 % 10007 AS crc FROM documents) GROUP BY source)
SELECT source, a.f AS before, b.f AS after FROM a FULL JOIN b USING (source) WHERE a.f IS DISTINCT FROM b.f""")
def fingerprints_differ(spark, sf):
    """Sources whose documents are not the same in two runs, by a digest of sums that any order of rows gives."""
    docs = table(spark, sf, "documents").select("source", (F.col("doc_id") * 7919 % 10007).alias("x"), "doc_id")
    digest = lambda df: df.groupBy("source").agg(F.md5(F.sum("x").cast("string").cast("binary")).alias("f"))
    return mt.differing(digest(docs), digest(docs.withColumn("source", F.when(F.col("doc_id") % 97 == 0, "moved").otherwise(F.col("source")))), "source", "f")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 1 AND l_partkey % 4 <> 0 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem),
g AS (SELECT l_orderkey, count(DISTINCT day) AS n, min(day) AS d FROM c GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(day, CASE WHEN n = 1 THEN d END) AS date, CASE WHEN day IS NOT NULL AND n > 1 THEN 'conflicting' WHEN day IS NOT NULL THEN 'own' WHEN n = 1 THEN 'inherited' ELSE 'none' END AS how,
CAST(CASE WHEN day IS NOT NULL AND n > 1 THEN least(60, greatest(30, 90 - 5 * l_linenumber)) ELSE greatest(30, 90 - CASE WHEN day IS NULL AND n <> 1 THEN 10 ELSE 0 END - 5 * l_linenumber) END AS INTEGER) AS confidence_cents FROM c JOIN g USING (l_orderkey)""")
def section_dates(spark, sf):
    """Lines as candidates of an order's section: dates inherited, conflicting ones marked, and the rule's confidence."""
    day = F.when((F.col("l_linenumber") % 3 == 1) & (F.col("l_partkey") % 4 != 0), F.col("l_shipdate").cast("date"))
    rows = mt.inherited_dates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.alias("day")), ["l_orderkey"], "day")
    score = mt.built_confidence(F.when(F.col("date").isNull(), 10).otherwise(0), F.col("l_linenumber"), F.col("how") == "conflicting")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date", "how", score.alias("confidence_cents"))


@query("""SELECT c_custkey, concat_ws(', ', nullif(concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN c_custkey || ' Oak St' END, CASE WHEN c_custkey % 4 = 0 THEN 'Unit ' || c_nationkey END), ''), CASE WHEN c_custkey % 5 <> 0 THEN n_name END, concat_ws(' ', r_name, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END)) AS line
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def address_lines(spark, sf):
    """Every customer's address in one line, blank parts leaving no sign."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(places(spark, sf), F.col("c_nationkey") == F.col("nationkey"))
    line = mt.address_line(F.when(k % 3 != 0, F.concat(k, F.lit(" Oak St"))).otherwise(" "), F.when(k % 4 == 0, F.concat(F.lit("Unit "), "c_nationkey")), F.when(k % 5 != 0, F.col("city")), F.col("state"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 5, "0")))
    return rows.select("c_custkey", line.alias("line"))


@query(SQL_BASE + """SELECT address_id, rule_id, CAST(row_number() OVER (PARTITION BY address_id ORDER BY CASE result WHEN 'applies' THEN CASE WHEN level = 'city' THEN 0 ELSE 1 END WHEN 'unknown' THEN 2 WHEN 'not_yet_effective' THEN 3 WHEN 'superseded' THEN 4 ELSE 5 END, confidence_cents DESC, rule_id) AS INTEGER) AS place,
(SELECT 'Sec. ' || o.rule_id || ' (' || o.jurisdiction || ')' FROM rules o WHERE o.rule_id = looked.superseded_by) AS superseded_by_citation, count(*) FILTER (WHERE result = 'applies') OVER (PARTITION BY address_id) / 6.0 AS ramp FROM looked""")
def rows_in_order(spark, sf):
    """Results in the order of the page, with the citation of what supersedes them and the address's share of rules that apply."""
    from pyspark.sql.window import Window

    rules = rule_views(spark, sf)
    rows = lookup(parcels(spark, sf), rules, AS_OF)
    cited = rules.select(F.col("rule_id").alias("superseded_by"), F.concat(F.lit("Sec. "), "rule_id", F.lit(" ("), "jurisdiction", F.lit(")")).alias("superseded_by_citation"))
    tier = F.when(F.col("result") == "applies", F.when(F.col("level") == "city", 0).otherwise(1)).when(F.col("result") == "unknown", 2).when(F.col("result") == "not_yet_effective", 3).when(F.col("result") == "superseded", 4).otherwise(5)
    address = Window.partitionBy("address_id")
    place = F.row_number().over(address.orderBy(tier, F.desc("confidence_cents"), "rule_id"))
    ramp = F.count_if(F.col("result") == "applies").over(address) / 6
    return rows.join(cited, "superseded_by", "left").select("address_id", "rule_id", place.alias("place"), "superseded_by_citation", ramp.alias("ramp"))


@query("""WITH g AS (SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, 7, toxic FROM labels WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id + 100000000, quality, NULL FROM labels WHERE doc_id % 13 = 0),
p AS (SELECT g.doc_id, quality NOT IN (0, 1) AS bad_value, toxic IS NULL AS missing, d.doc_id IS NULL AS unknown, count(*) OVER (PARTITION BY g.doc_id) > 1 AS repeated FROM g LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id))
SELECT doc_id, problem, count(*) AS n FROM (SELECT doc_id, 'unknown document' AS problem FROM p WHERE unknown UNION ALL SELECT doc_id, 'value not allowed' FROM p WHERE bad_value UNION ALL SELECT doc_id, 'value missing' FROM p WHERE missing UNION ALL SELECT doc_id, 'repeated id' FROM p WHERE repeated) GROUP BY ALL""")
def gold_problems(spark, sf):
    """What is wrong with a gold file, a row an id and problem; labels stand for it, with faults put in."""
    gold = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    gold = gold.union(gold.where("doc_id % 11 = 0").withColumn("quality", F.lit(7))).union(gold.where("doc_id % 13 = 0").select(F.col("doc_id") + 100000000, "quality", F.lit(None).cast("int")))
    known = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("known")).distinct()
    counted = gold.groupBy("doc_id").agg(F.count("*").alias("times"))
    rows = gold.join(known, "doc_id", "left").join(counted, "doc_id")
    problems = F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown document"), F.when(~F.col("quality").isin(0, 1), "value not allowed"), F.when(F.col("toxic").isNull(), "value missing"), F.when(F.col("times") > 1, "repeated id")))
    return rows.select("doc_id", F.explode(problems).alias("problem")).groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


@query(SQL_BASE + """, a AS (SELECT DISTINCT state, address_id, conflict FROM looked JOIN (SELECT address_id AS x, state AS st FROM parcels) ON x = address_id WHERE result IN ('applies', 'unknown')), n AS (SELECT state, count(DISTINCT address_id) AS n, count(DISTINCT CASE WHEN conflict THEN address_id END) AS f FROM a GROUP BY state)
SELECT state, n || ' affected' || CASE WHEN f > 0 THEN ', ' || f || ' flagged' ELSE '' END AS note FROM n""")
def change_notes(spark, sf):
    """What a change comes to in each state, in words."""
    rows = lookup(parcels(spark, sf), rule_views(spark, sf), AS_OF).where("result IN ('applies', 'unknown')").join(parcels(spark, sf).select("address_id", "state"), "address_id")
    each = rows.groupBy("state", "address_id").agg(F.max("conflict").alias("conflict")).groupBy("state").agg(F.count("*").alias("n"), F.count_if("conflict").alias("f"))
    return each.select("state", F.concat(F.col("n"), F.lit(" affected"), F.when(F.col("f") > 0, F.concat(F.lit(", "), F.col("f"), F.lit(" flagged"))).otherwise("")).alias("note"))


