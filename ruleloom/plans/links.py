"""Queries that link records: ids over two runs, places on the sphere, passages in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gold as gd
from ..operators import parcels as pc
from ..operators import sphere as sph
from ..operators import stable_ids as si
from ..sources.readers import table
from ..streaming import registry as rg
from .catalogue import query


def _runs(spark, sf):
    """Orders as sets of their parts' remainders, in a prior run with a third as it is, a third without its last line, and a third unknown."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", (F.col("l_partkey") % 97).cast("string").alias("member"))
    # both runs are read off one list, so lines are grouped once
    orders = lines.groupBy("id").agg(F.collect_list(F.struct("l_linenumber", "member")).alias("lines"))
    members = lambda x: F.transform(x, lambda r: r["member"])
    kept = F.when(F.col("id") % 3 == 0, F.col("lines")).when(F.col("id") % 3 == 1, F.filter("lines", lambda r: r["l_linenumber"] > 1))
    prior = orders.withColumn("lines", kept).where(F.size("lines") > 0).select((F.col("id") * 2).alias("id"), members("lines").alias("members"))
    return prior, orders.select("id", members("lines").alias("members"))


SQL_IDS = """WITH lines AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_partkey % 97 AS VARCHAR) AS m FROM lineitem),
old AS (SELECT id * 2 AS id, list_sort(list_distinct(list(m))) AS s FROM lines WHERE id % 3 = 0 OR (id % 3 = 1 AND n > 1) GROUP BY id), new AS (SELECT id, list_sort(list_distinct(list(m))) AS s FROM lines GROUP BY id),
olds AS (SELECT s, max(id) AS id FROM old GROUP BY s), news AS (SELECT s, min(id) AS id FROM new GROUP BY s), equal AS (SELECT news.id, olds.id AS kept FROM olds JOIN news USING (s)),
lo AS (SELECT * FROM olds ANTI JOIN equal ON equal.kept = olds.id), ln AS (SELECT * FROM new ANTI JOIN equal ON equal.id = new.id),
om AS (SELECT id, unnest(s) AS m, len(s) AS k FROM lo), nm AS (SELECT id, unnest(s) AS m FROM ln), held AS (SELECT om.id AS small, nm.id AS large FROM om JOIN nm USING (m) GROUP BY om.id, nm.id, k HAVING count(*) = k),
alone AS (SELECT small, large FROM held QUALIFY count(*) OVER (PARTITION BY small) = 1 AND count(*) OVER (PARTITION BY large) = 1),
kept AS (SELECT id, kept AS stable, 'equal' AS how FROM equal UNION ALL SELECT large, small, 'contains' FROM alone),
ids AS (SELECT * FROM kept UNION ALL SELECT id, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY id), 'new' FROM new ANTI JOIN kept USING (id))
"""


def _ids(spark, sf):
    prior, current = _runs(spark, sf)
    return si.stable_ids(prior, current, F.floor(F.col("id") / 100_000))


@query(SQL_IDS + "SELECT * FROM ids")
def stable_ids(spark, sf):
    """Every order's id in the new run: taken over from an equal set, from the one set it alone contains, or new after the last."""
    return _ids(spark, sf)


@query(SQL_IDS + ", refs AS (SELECT c_custkey, unnest([c_custkey, 4 * c_custkey, 10 * c_custkey + 7, c_custkey]) AS id, unnest([1, 2, 3, 4]) AS n FROM customer) SELECT c_custkey, string_agg(CAST(coalesce(stable, id) AS VARCHAR), ',' ORDER BY n) AS refs FROM refs LEFT JOIN ids USING (id) GROUP BY c_custkey")
def ids_rewritten(spark, sf):
    """References of customers to orders, in arrays, by the ids of the new run; unknown ones stay."""
    k = F.col("c_custkey")
    refs = table(spark, sf, "customer").select(k, F.array(k, 4 * k, 10 * k + 7, k).alias("refs"))
    return si.rewritten(refs, "c_custkey", "refs", _ids(spark, sf)).select("c_custkey", F.array_join("refs", ",").alias("refs"))


_lat = lambda k: f"CAST(({k} * 7919) % 180001 AS DOUBLE) / 1000 - 90"
_lng = lambda k: f"CAST(({k} * 104729) % 360000 AS DOUBLE) / 1000 - 180"
_distance = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2))))"
SQL_NEAR = f"""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 <> 0 THEN {_lat('c_custkey')} END AS lat, {_lng('c_custkey')} AS lng FROM customer), s AS (SELECT s_suppkey AS site, {_lat('s_suppkey * 13')} AS lat, CASE WHEN s_suppkey % 5 = 0 THEN 179.9 ELSE {_lng('s_suppkey * 17')} END AS lng FROM supplier),
d AS (SELECT id, site, {_distance} AS m FROM p, s WHERE p.lat IS NOT NULL), best AS (SELECT id, min(struct_pack(m := m, site := site)) AS x FROM d GROUP BY id)"""


def _places(spark, sf):
    points = table(spark, sf, "customer").selectExpr("c_custkey AS id", f"CASE WHEN c_custkey % 50 <> 0 THEN {_lat('c_custkey')} END AS lat", f"{_lng('c_custkey')} AS lng")
    return points, table(spark, sf, "supplier").selectExpr("s_suppkey AS site", f"{_lat('s_suppkey * 13')} AS lat", f"CASE WHEN s_suppkey % 5 = 0 THEN 179.9D ELSE {_lng('s_suppkey * 17')} END AS lng")


@query(SQL_NEAR + " SELECT id, x.site AS site, round(x.m, 2) AS metres FROM best WHERE x.m <= 400000")
def nearest_on_sphere(spark, sf):
    """Customers anywhere on the sphere with the nearest supplier within 400 km, across the antimeridian and near the poles."""
    return sph.nearest_within(*_places(spark, sf), 400_000.0).withColumn("metres", F.round("metres", 2))


@query(SQL_NEAR + " SELECT id, x.site AS site, round(x.m, 2) AS metres FROM best")
def nearest_of_all(spark, sf):
    """Every customer's nearest supplier, by rings that grow."""
    return sph.nearest(*_places(spark, sf), 400_000.0).withColumn("metres", F.round("metres", 2))


_OURS = "doc_id * 1000 + i AS rule_id, doc_id, i * 470 + (doc_id * 31 + i * 17) % 300 AS start, i * 470 + (doc_id * 31 + i * 17) % 300 + 30 + (i * 13) % 180 AS stop, CAST((doc_id + i) % 4 AS INT) AS category, CAST(i % 3 AS INT) AS level"
_GOLD = "doc_id * 1000 + i AS gold_id, doc_id, i * 1170 + (doc_id * 7) % 500 AS start, i * 1170 + (doc_id * 7) % 500 + 60 AS stop, CAST((doc_id + i) % 4 AS INT) AS category, CAST(i % 3 AS INT) AS level, lang"
SQL_GOLD = f"""WITH ours AS (SELECT {_OURS} FROM (SELECT doc_id, unnest(range(length(text) // 470)) AS i FROM documents)), gold AS (SELECT {_GOLD} FROM (SELECT doc_id, lang, unnest(range(length(text) // 1170 + 1)) AS i FROM documents)),
met AS (SELECT gold_id, rule_id, least(g.stop, o.stop) - greatest(g.start, o.start) AS room, g.category = o.category AS same FROM gold g JOIN ours o USING (doc_id)),
best AS (SELECT gold_id, max(struct_pack(overlap := greatest(room, 0), near := -greatest(-room, 0), same := same, rule_id := rule_id)) AS x FROM met WHERE room > 0 OR -room <= 200 GROUP BY gold_id)"""


def _passages(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    each = lambda step, more: docs.where(F.floor(F.col("n") / step) + more > 0).select("doc_id", "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / step) + more - 1)).alias("i"))
    ours, gold = (each(*x).selectExpr(*_split(y)).withColumnRenamed("stop", "end") for x, y in (((470, 0), _OURS), ((1170, 1), _GOLD)))
    return gold, ours


def _split(columns):
    return [c.strip() for c in columns.replace("CAST((doc_id + i) % 4 AS INT)", "int((doc_id + i) % 4)").replace("CAST(i % 3 AS INT)", "int(i % 3)").split(", ")]


@query(SQL_GOLD + " SELECT gold_id, x.rule_id AS rule_id, x.overlap AS overlap, -x.near AS gap FROM gold LEFT JOIN best USING (gold_id)")
def gold_passages(spark, sf):
    """Each gold passage of a text with the one of ours that overlaps it most, or lies nearest within 200 characters."""
    return gd.matched(*_passages(spark, sf))


@query(SQL_GOLD + " SELECT lang, count(*) AS gold, count(x) AS matched, count(*) FILTER (o.category = g.category) AS category, count(*) FILTER (o.level = g.level) AS level FROM gold g LEFT JOIN best USING (gold_id) LEFT JOIN ours o ON o.rule_id = x.rule_id GROUP BY lang")
def gold_accuracy(spark, sf):
    """Of each language's gold passages how many are matched, and how many agree in category and level."""
    gold, ours = _passages(spark, sf)
    return gd.accuracy(gd.matched(gold, ours), gold, ours, "lang", ["category", "level"])


#: Candidates of a customer's address: none to three, whose points lie in towns 0 to 9 by their longitude; town 7 is in no state we know.
_CAND = "SELECT k, i AS nth, CASE WHEN k % 4 = 1 THEN 'retry' ELSE 'batch' END AS source, (k + i) % 3 = 0 AS exact, k || ' Main St, ' || lpad(CAST((k + i) % 7 AS {str}), 5, '0') AS matched, CAST((k + i * (k % 2)) % 10 AS {str}) AS lon, CAST(k % 90 AS {str}) AS lat"
SQL_PARCELS = f"""WITH a AS (SELECT c_custkey AS k, 'Town' || (c_custkey % 12) AS postal_city, CASE WHEN c_custkey % 13 = 0 THEN 'NJ' ELSE 'CA' END AS state, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST((c_custkey + 1) % 7 AS VARCHAR), 5, '0') ELSE '' END AS zip FROM customer),
c AS ({_CAND.format(str='VARCHAR')} FROM (SELECT c_custkey AS k, unnest(range(c_custkey % 4)) AS i FROM customer)),
g AS (SELECT DISTINCT lon, lat, CASE WHEN lon <> '5' THEN 'Town' || lon || ', CA' END AS city, CASE WHEN lon = '7' THEN 'NV' ELSE 'CA' END AS found, CASE WHEN lon = '3' THEN ['place not known'] ELSE [] END AS problems FROM c),
e AS (SELECT * FROM c LEFT JOIN g USING (lon, lat)), n AS (SELECT k, count(*) AS n, count(DISTINCT coalesce(city, '')) AS towns, arg_min(source, nth) AS source FROM e GROUP BY k),
x AS (SELECT a.k, e.* EXCLUDE (k) FROM a JOIN e USING (k) QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY CASE WHEN a.zip <> '' AND right(matched, 5) = a.zip THEN 0 ELSE 1 END, nth) = 1),
j AS (SELECT a.*, a.postal_city || ', ' || a.state AS postal, coalesce(n.n, 0) AS n, n.towns > 1 AS several, n.source AS first_source, CASE WHEN n.towns = 1 THEN x END AS x FROM a LEFT JOIN n USING (k) LEFT JOIN x USING (k)),
m AS (SELECT *, CAST(regexp_extract(postal_city, '[0-9]+') AS INTEGER) < 8 AND state = 'CA' AS known, x IS NOT NULL AND x.found IS DISTINCT FROM state AS other_state FROM j),
r AS (SELECT *, x IS NOT NULL AND NOT other_state AND x.city IS NOT NULL AND known AND postal <> x.city AS other_city FROM m)
SELECT k AS address_id, CASE WHEN n = 0 THEN CASE WHEN known THEN postal END WHEN NOT other_state THEN x.city END AS city, x.lon AS lon, x.lat AS lat,
CASE WHEN n = 0 OR several OR other_state THEN 'low' WHEN len(x.problems) > 0 OR other_city THEN 'medium' WHEN first_source = 'batch' AND x.exact THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN n = 0 THEN 'postal' ELSE first_source END AS source,
array_to_string([y FOR y IN list_concat(list_concat([CASE WHEN n = 0 THEN CASE WHEN known THEN 'no match: postal city, unverified' ELSE 'no match: postal city has no rules' END END, CASE WHEN several THEN 'matches in different cities' END, CASE WHEN other_state THEN 'another state' END], coalesce(x.problems, [])), [CASE WHEN other_city THEN 'postal city is another one' END]) IF y IS NOT NULL], '|') AS reasons FROM r"""


@query(SQL_PARCELS)
def parcel_decisions(spark, sf):
    """Every customer's address decided from none to three geocoder answers, their geographies asked once a point."""
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    zip_ = F.when(k % 3 == 0, F.lpad(((k + 1) % 7).cast("string"), 5, "0")).otherwise("")
    addresses = customers.select(k.alias("address_id"), F.concat(F.lit("Town"), k % 12).alias("postal_city"), F.when(k % 13 == 0, "NJ").otherwise("CA").alias("state"), zip_.alias("zip"))
    each = customers.select(k.alias("k"), F.explode(F.when(k % 4 > 0, F.sequence(F.lit(0), (k % 4 - 1).cast("int")))).alias("i"))
    candidates = each.selectExpr("k AS address_id", *[f"{e} AS {n}" for e, n in (("i", "nth"), ("CASE WHEN k % 4 = 1 THEN 'retry' ELSE 'batch' END", "source"), ("(k + i) % 3 = 0", "exact"), ("k || ' Main St, ' || lpad(CAST((k + i) % 7 AS STRING), 5, '0')", "matched"), ("CAST((k + i * (k % 2)) % 10 AS STRING)", "lon"), ("CAST(k % 90 AS STRING)", "lat"))])
    problems = F.when(F.col("lon") == "3", F.array(F.lit("place not known"))).otherwise(F.array().cast("array<string>"))
    places = pc.distinct_points(candidates).select("lon", "lat", F.when(F.col("lon") != "5", F.concat(F.lit("Town"), "lon", F.lit(", CA"))).alias("city"), F.when(F.col("lon") == "7", "NV").otherwise("CA").alias("state"), problems.alias("problems"))
    cities = spark.range(8).select(F.concat(F.lit("Town"), "id", F.lit(", CA")).alias("city"))
    return pc.decided(addresses, candidates, places, cities).withColumn("reasons", F.array_join("reasons", "|"))


SQL_REGISTRY = """WITH b AS (SELECT DISTINCT 'u' || (doc_id % 700) AS url, sha256(coalesce(text, '')) AS sha, CASE WHEN doc_id % 5 = 0 THEN 'Paris, FR' WHEN doc_id % 5 = 1 THEN 'FR' WHEN doc_id % 5 = 2 THEN 'Berlin, DE' WHEN doc_id % 5 = 3 THEN 'nowhere' END AS given FROM documents WHERE doc_id % 3 <> 1),
e AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha, 'u' || (doc_id % 700) AS url, CASE WHEN doc_id % 2 = 0 THEN 'FR' ELSE 'Paris, FR' END AS jurisdiction FROM documents WHERE doc_id % 3 <> 0),
m AS (SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'FR' ELSE 'Lyon, FR' END AS jurisdiction, doc_id % 4 = 0 AS has_text FROM documents WHERE doc_id % 6 = 0),
rows AS (SELECT url, sha, min(given) AS given FROM b GROUP BY ALL), ks AS (SELECT sha, min(struct_pack(id := id, url := url, jurisdiction := jurisdiction)) AS k FROM e GROUP BY sha), ku AS (SELECT url, min(sha) AS other FROM e GROUP BY url), km AS (SELECT url, bool_or(has_text) AS has_text, list_sort(list_distinct(list(jurisdiction))) AS told FROM m GROUP BY url),
j AS (SELECT *, coalesce(given, CASE WHEN len(told) = 1 THEN told[1] END) AS jurisdiction, row_number() OVER (PARTITION BY url ORDER BY sha) AS nth, row_number() OVER (PARTITION BY sha ORDER BY url) AS mth FROM rows LEFT JOIN ks USING (sha) LEFT JOIN ku USING (url) LEFT JOIN km USING (url)),
d AS (SELECT *, CASE WHEN k IS NOT NULL AND k.url <> url THEN 'content is known under another address' WHEN k IS NOT NULL AND given IS NOT NULL AND given <> k.jurisdiction THEN 'registered with another jurisdiction' WHEN k IS NOT NULL THEN NULL WHEN other IS NOT NULL THEN 'address has another content' WHEN has_text THEN 'the manifest has this document'
    WHEN nth > 1 THEN 'address comes with another content' WHEN mth > 1 THEN 'content comes under another address' WHEN jurisdiction IS NULL THEN 'jurisdiction unknown' WHEN NOT regexp_matches(jurisdiction, '^(?:[^,]+, )?[A-Z]{2}$') THEN 'no such jurisdiction' WHEN jurisdiction LIKE '%DE' THEN 'state not in the manifest'
    WHEN told IS NOT NULL AND NOT list_contains(told, jurisdiction) THEN 'differs from the manifest''s' END AS no FROM j),
n AS (SELECT *, CASE WHEN no IS NOT NULL THEN 'refused' WHEN k IS NOT NULL THEN 'registered' ELSE 'new' END AS decision FROM d)
SELECT url, sha, decision, CASE WHEN decision = 'registered' THEN k.id WHEN decision = 'new' THEN 1000000 + count(*) FILTER (decision = 'new') OVER (ORDER BY sha, url ROWS UNBOUNDED PRECEDING) END AS id, CASE WHEN decision = 'registered' THEN k.jurisdiction ELSE jurisdiction END AS jurisdiction,
coalesce(no, CASE WHEN k IS NOT NULL THEN 'registered before' WHEN told IS NOT NULL THEN 'supplies a text that the manifest lacks' END) AS note, 7::BIGINT AS batch FROM n"""


@query(SQL_REGISTRY)
def registry_decisions(spark, sf):
    """Two thirds of the documents as a batch against a registry of two thirds and a manifest: known, refused with why, or new with an id."""
    k, docs = F.col("doc_id"), table(spark, sf, "documents")
    url = F.concat(F.lit("u"), k % 700)
    given = F.when(k % 5 == 0, "Paris, FR").when(k % 5 == 1, "FR").when(k % 5 == 2, "Berlin,  DE").when(k % 5 == 3, "nowhere")
    batch = docs.where("doc_id % 3 <> 1").select(url.alias("url"), "text", given.alias("jurisdiction"))
    entries = docs.where("doc_id % 3 <> 0").select(k.alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), url.alias("url"), F.when(k % 2 == 0, "FR").otherwise("Paris, FR").alias("jurisdiction"))
    manifest = docs.where("doc_id % 6 = 0").select(F.concat(F.lit("u"), k).alias("url"), F.when(k % 2 == 0, "FR").otherwise("Lyon, FR").alias("jurisdiction"), (k % 4 == 0).alias("has_text"))
    return rg.decided(batch, entries, manifest, 1_000_000, 7)
