"""Queries over phrases, chunks, questions, guards, contracts and matching."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import phrases as ph
from ..operators.chunks import chunk
from ..sources.readers import dealt, table
from .catalogue import query


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def find_dates(spark, sf):
    """The one date of a sentence, in three forms; two dates leave it open."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "M/d/yyyy")).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" or January 2, 1970")))
    return table(spark, sf, "orders").select("o_orderkey", ph.single_date(F.concat(F.lit("It takes effect on "), said, F.lit(", by order 12."))).alias("day"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(date_trunc('month', CAST(o_orderdate AS DATE) + to_months(12)) AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) + 90 WHEN 2 THEN CAST(o_orderdate AS DATE) END AS day,
CASE o_orderkey % 4 WHEN 0 THEN 'nth_month' WHEN 1 THEN 'days_after' WHEN 2 THEN 'immediately' ELSE 'not_stated' END AS method FROM orders""")
def resolve_dates(spark, sf):
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "on the first day of the 12th month after enactment").when(k == 1, "90 days after enactment").when(k == 2, "This act takes effect immediately").otherwise("as provided by law")
    found = table(spark, sf, "orders").select("o_orderkey", ph.resolve(said, F.col("o_orderdate").cast("date")).alias("x"))
    return found.select("o_orderkey", "x.day", "x.method")


@query()
def span_normalised(spark, sf):
    """The first place of a quote of up to 40 characters from anywhere in any text, its spaces turned into line breaks; null where the quote is blank."""
    docs = table(spark, sf, "documents").withColumn("begin", F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text"), F.lit(1))).cast("int"))
    quote = F.regexp_replace(F.trim(F.substring("text", F.col("begin") + 1, F.lit(40))), " ", "\n ")
    return docs.select("doc_id", "begin", ph.find_normalised(F.col("text"), quote).cast("long").alias("start"))


def headed(spark, sf):
    """Every document under a heading of its own, every third with a second one in the middle."""
    half = F.floor(F.length("text") / 2).cast("int")
    middle = F.concat(F.substring("text", F.lit(1), half), F.lit("\nSECTION 4. Terms of use\n"), F.substring(F.col("text"), half + 1, F.length("text")))
    text = F.concat(F.lit("§ "), F.col("doc_id"), F.lit(" Scope\n"), F.when(F.col("doc_id") % 3 == 0, middle).otherwise(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("text") != "", text).otherwise(F.col("text")).alias("text"))


@query()
def chunk_docs(spark, sf):
    """Chunks of every whole document with their headings, what was dropped, and a digest of what is sent on; tests hold them to a plain reading."""
    rows = chunk(headed(spark, sf), longest=2000, overlap=200)
    return rows.withColumn("dropped", F.size("dropped").cast("long")).withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


@query(r"""SELECT conv_id, turn, CASE WHEN a >= b AND a > 0 THEN 'article' WHEN b > 0 THEN 'preposition' ELSE 'none' END AS intent FROM (SELECT conv_id, turn, len([w FOR w IN string_split_regex(lower(text), '[^\p{L}]+') IF w IN ('the', 'la', 'der', 'les')]) AS a, 2 * len([w FOR w IN string_split_regex(lower(text), '[^\p{L}]+') IF w IN ('of', 'de', 'von', 'para')]) AS b FROM conversations WHERE role = 'user')""")
def question_intent(spark, sf):
    """The intent with the greatest score; ties go to the first."""
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    a = F.size(F.filter(words, lambda w: w.isin("the", "la", "der", "les")))
    b = 2 * F.size(F.filter(words, lambda w: w.isin("of", "de", "von", "para")))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.when((a >= b) & (a > 0), "article").when(b > 0, "preposition").otherwise("none").alias("intent"))


@query(r"""SELECT failure, count(*) AS n FROM (SELECT unnest([x FOR x IN [CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN length(text) > 600 THEN 'too long' END, CASE WHEN NOT regexp_matches(text, '[.!?]\s*$') THEN 'unfinished' END] IF x IS NOT NULL]) AS failure FROM conversations WHERE role = 'assistant') GROUP BY ALL""")
def guard_failures(spark, sf):
    """How often each guard on an answer fails."""
    found = F.array_compact(F.array(F.when(F.col("text").rlike("[0-9]"), "number"), F.when(F.length("text") > 600, "too long"), F.when(~F.col("text").rlike(r"[.!?][\t\n\f\r ]*\z"), "unfinished")))
    return table(spark, sf, "conversations").where("role = 'assistant'").select(F.explode(found).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


@query("""SELECT problem, count(*) AS n FROM (SELECT 'order without customer' AS problem FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line without order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'two lines of one part' FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)) GROUP BY ALL""")
def contract_checks(spark, sf):
    orders, lines = table(spark, sf, "orders"), dealt(table(spark, sf, "lineitem"), "l_orderkey")
    a = dealt(orders, "o_custkey").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("order without customer").alias("problem"))
    b = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("line without order"))
    c = lines.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("two lines of one part"))
    return a.union(b).union(c).groupBy("problem").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'low' WHEN c_custkey % 7 = 0 THEN 'low' WHEN c_custkey % 5 = 0 THEN 'medium' ELSE 'high' END AS confidence,
CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN NULL ELSE n_name END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def place_confidence(spark, sf):
    """No match: low; matches in several cities: low and no city; an inexact match: medium."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cities = F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.col("n_name"), F.lit("elsewhere"))).otherwise(F.array("n_name", "n_name"))
    distinct = F.array_distinct(cities)
    return rows.select("c_custkey", F.when(F.size(distinct) != 1, "low").when(k % 5 == 0, "medium").otherwise("high").alias("confidence"), F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).alias("city"))


@query("""SELECT user_id, event_id, kind FROM (SELECT user_id, event_id, CASE WHEN e.value > m.top * 0.9 THEN 'near top' WHEN e.value < m.low * 1.1 THEN 'near low' END AS kind FROM events e JOIN (SELECT user_id, max(value) AS top, min(value) AS low FROM events GROUP BY ALL) m USING (user_id)) WHERE kind IS NOT NULL""")
def extremes_by_user(spark, sf):
    own = Window.partitionBy("user_id")
    rows = table(spark, sf, "events").withColumn("top", F.max("value").over(own)).withColumn("low", F.min("value").over(own))
    kind = F.when(F.col("value") > F.col("top") * 0.9, "near top").when(F.col("value") < F.col("low") * 1.1, "near low")
    return rows.select("user_id", "event_id", kind.alias("kind")).where("kind IS NOT NULL")


@query("SELECT c_custkey, lower(substr(c_name, 1, 15)) AS prefix, count(*) OVER (PARTITION BY lower(substr(c_name, 1, 15))) = 1 AS only_one FROM customer")
def place_prefix(spark, sf):
    """Names by their prefix, and whether it is the only one: counts by prefix, joined back by it."""
    names = table(spark, sf, "customer").select("c_custkey", F.lower(F.substring("c_name", 1, 15)).alias("prefix"))
    counted = names.groupBy("prefix").agg((F.count("*") == 1).alias("only_one"))
    return names.join(counted, "prefix")


@query("SELECT c_nationkey, c_mktsegment, c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer WHERE c_acctbal < 0")
def rule_pools(spark, sf):
    """Ids that share all keys of a test, a row each with their number: a pool may be of any size."""
    rows = table(spark, sf, "customer").where("c_acctbal < 0").select("c_nationkey", "c_mktsegment", "c_custkey")
    return rows.join(rows.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), ["c_nationkey", "c_mktsegment"])


@query("""SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_final, bool_or(o_orderstatus = 'P') AS any_pending, count(DISTINCT o_orderpriority) = 1 AS one_priority FROM orders GROUP BY ALL""")
def agreement_folds(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_final"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), (F.count_distinct("o_orderpriority") == 1).alias("one_priority"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01')
SELECT 'gone' AS kind, l_suppkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'new', l_suppkey FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', l_suppkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def set_differences(spark, sf):
    """Ids before and after: one grouped pass gives all three sets."""
    at = F.col("l_shipdate").cast("date")
    seen = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.bool_or(at < "1996-01-01").alias("a"), F.bool_or(at >= "2001-06-01").alias("b"))
    return seen.where("a OR b").select(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "gone").otherwise("new").alias("kind"), "l_suppkey")


@query("""WITH ticks AS (SELECT make_date(y, m, 1) AS tick FROM range(1995, 2003) t(y), range(1, 13, 3) u(m)), near AS (SELECT o_orderkey, tick, abs(CAST(o_orderdate AS DATE) - tick) AS far FROM orders, ticks WHERE abs(CAST(o_orderdate AS DATE) - tick) <= 10)
SELECT o_orderkey, arg_min(tick, far) AS tick FROM near GROUP BY ALL""")
def snap_to_tick(spark, sf):
    """The first day of a quarter within ten days: the only two that can be are computed, not joined."""
    day = F.col("o_orderdate").cast("date")
    before, after = F.trunc(day, "quarter"), F.trunc(F.add_months(day, 3), "quarter")
    near = F.when(F.datediff(day, before) <= 10, before).when(F.datediff(after, day) <= 10, after)
    return table(spark, sf, "orders").select("o_orderkey", near.alias("tick")).where("tick IS NOT NULL")


@query("""SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS code FROM lineitem GROUP BY ALL""")
def compact_codes(spark, sf):
    entries = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x")))), lambda e: e["x"])
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(entries, "").alias("code"))


@query("""SELECT n_name, count(*) AS n, CAST(floor(avg(c_custkey % 180 - 90)) AS BIGINT) AS lat, CAST(floor(avg(c_custkey * 7 % 360 - 180)) AS BIGINT) AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def city_centroids(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.floor(F.avg(F.col("c_custkey") % 180 - 90)).alias("lat"), F.floor(F.avg(F.col("c_custkey") * 7 % 360 - 180)).alias("lng"))
