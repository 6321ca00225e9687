"""Queries over documents as they come, batches of answers, chaptering lines and change tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as dc
from ..sources.readers import table
from .catalogue import query


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, CASE doc_id % 9 WHEN 7 THEN 'ftp://x' ELSE 'https://example.org/' || doc_id END AS url, CASE doc_id % 9 WHEN 5 THEN '2026-13-01 10:00 UTC' WHEN 6 THEN '2026-01-01' ELSE '2026-01-0' || (1 + doc_id % 9) || ' 10:00 UTC' END AS at FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'empty file' WHEN doc_id % 9 = 1 THEN 'byte order mark' WHEN doc_id % 9 = 2 THEN 'not UTF-8' WHEN doc_id % 9 = 3 OR contains(body, chr(13)) THEN 'CR line endings' WHEN doc_id % 9 = 4 THEN 'no header' WHEN doc_id % 9 = 7 THEN 'source is no address'
WHEN doc_id % 9 = 6 THEN 'retrieval time not as agreed' WHEN doc_id % 9 = 5 THEN 'no such retrieval time' WHEN length(regexp_replace(body, '^[\\s\\p{Z}\\x{85}]+|[\\s\\p{Z}\\x{85}]+$', '', 'g')) < 20 THEN 'no text after the header' END AS problem FROM d""")
def document_problems(spark, sf):
    """Every document put into the corpus format, by key with one fault or none: the first reason against it."""
    k = F.col("doc_id") % 9
    url = F.when(k == 7, "ftp://x").otherwise(F.concat(F.lit("https://example.org/"), "doc_id"))
    at = F.when(k == 5, "2026-13-01 10:00 UTC").when(k == 6, "2026-01-01").otherwise(F.concat(F.lit("2026-01-0"), 1 + k, F.lit(" 10:00 UTC")))
    body = F.coalesce("text", F.lit(""))
    whole = F.concat(F.when(k == 4, "SOURCE ").otherwise("SOURCE: "), url, F.when(k == 3, "\r\n").otherwise("\n"), F.lit("RETRIEVED: "), at, F.lit("\n\n"), body)
    content = F.when(k == 0, F.lit("").cast("binary")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), whole.cast("binary"))).when(k == 2, F.concat(whole.cast("binary"), F.unhex(F.lit("FF")))).otherwise(whole.cast("binary"))
    return table(spark, sf, "documents").select("doc_id", dc.document_problem(content).alias("problem"))


@query("""SELECT o_orderkey, i AS id, CASE WHEN i = 2 THEN NULL ELSE 'Match' END AS found, CASE WHEN i = 0 THEN 'main st, ' || o_custkey END AS matched FROM orders, range(3) t(i)""")
def batch_answers(spark, sf):
    """A geocoder's batch answer, CSV in a string: quoted commas, and lines too short."""
    text = F.concat(F.lit('0,Match,"main st, '), "o_custkey", F.lit('"\r\n1,Match\n\n2\n'))
    return dc.parsed_batch(table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "text", "id long, found string, matched string")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN strftime(CAST(o_orderdate AS DATE), '%m/%d/%y') || ' - Chaptered by the Secretary' END AS line FROM orders""")
def chaptering_lines(spark, sf):
    """The one dated line that records chaptering; with two days, or a day that doesn't exist, none."""
    k, d = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "MM/dd/yy")
    line = F.concat(d, F.lit(" - Chaptered by the Secretary"))
    text = F.concat(F.lit("History\n  "), F.when(k == 3, "13/45/25 - Chaptered by nobody").otherwise(line), F.lit("\n01/02/25 - Approved\n"), F.when(k == 1, line).when(k == 2, "01/02/03 - Chaptered again").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", dc.chaptering_record(text).alias("line"))


@query("""SELECT s_suppkey, count(o_orderkey) AS lines, count(*) FILTER (WHERE o_orderstatus = 'F') AS backed FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY s_suppkey""")
def backed_lines(spark, sf):
    """Of each supplier's lines how many are backed by a final order: a semi-join, then counts."""
    lines, orders = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    known = lines.join(orders, "l_orderkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    backed = lines.join(orders.where("o_orderstatus = 'F'"), "l_orderkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("backed"))
    every = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("l_suppkey"))
    return every.join(known, "l_suppkey", "left").join(backed, "l_suppkey", "left").select("s_suppkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("backed", F.lit(0)).alias("backed"))
