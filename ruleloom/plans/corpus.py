"""Queries over texts, addresses and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import corpus as cp
from ..sources.readers import table
from .catalogue import query

SQL_LINES = "WITH lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line, list_sum([length(x) + 1 FOR x IN parts[1:i - 1]]) AS before FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))\n"


@query(SQL_LINES + "SELECT doc_id, line_no, CAST(coalesce(before, 0) AS BIGINT) AS start, md5(line) AS line_md5 FROM lines")
def line_table(spark, sf):
    return cp.lines(table(spark, sf, "documents")).select("doc_id", "line_no", "start", F.md5("line").alias("line_md5"))


@query(SQL_LINES + "SELECT doc_id, line, count(*) AS times FROM lines WHERE length(line) BETWEEN 1 AND 60 AND NOT regexp_matches(line, '[0-9]') AND NOT regexp_matches(line, '[.!?;:]$') GROUP BY ALL HAVING count(*) >= 2")
def junk_lines(spark, sf):
    return cp.junk_lines(cp.lines(table(spark, sf, "documents")), longest=60, repeats=2)


@query()
def junk_line_runs(spark, sf):
    """Repeated short lines inside runs of short lines; each word stands on a line of its own, as few texts have menus."""
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", " ", "\n").alias("text"))
    return cp.junk_runs(cp.lines(docs)).select("doc_id", "line_no", "line")


@query(SQL_LINES + r"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(line, '^(SEC(TION)?\.? |§|ARTICLE |CHAPTER )|^[A-Z][A-Z ]{3,}$') THEN 'heading' WHEN regexp_matches(line, '^\(?[0-9a-z]{1,3}[.)] ') THEN 'item'
WHEN coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '') = '' THEN 'paragraph' ELSE 'line' END AS class FROM lines) GROUP BY ALL""")
def line_classes(spark, sf):
    rows = cp.lines(table(spark, sf, "documents"))
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.select(cp.line_class(F.col("line"), before).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


SQL_ANYWHERE = "WITH placed AS (SELECT doc_id, text, CAST((doc_id * 7919) % greatest(length(text), 1) AS INTEGER) AS begin FROM documents)"


def _anywhere(spark, sf):
    """All documents, each with a place in the whole of its text."""
    return table(spark, sf, "documents").withColumn("begin", (F.col("doc_id") * 7919 % F.greatest(F.length("text"), F.lit(1))).cast("int"))


@query(SQL_ANYWHERE + " SELECT doc_id, begin, instr(text, nullif(substr(text, begin + 1, 12), '')) - 1 AS start FROM placed")
def span_grounding(spark, sf):
    """First place of a quote of up to 12 characters from anywhere in any text; null for an empty one."""
    docs = _anywhere(spark, sf)
    return docs.select("doc_id", "begin", cp.first_span(F.col("text"), F.substring("text", F.col("begin") + 1, F.lit(12)))["start"].cast("long").alias("start"))


@query(SQL_ANYWHERE + """, cut AS (SELECT *, substr(text, greatest(begin - 40, 0) + 1, begin - greatest(begin - 40, 0)) AS lead, substr(text, begin + 1, 20) AS mid, substr(text, least(begin + 20, length(text)) + 1, 40) AS tail FROM placed)
SELECT doc_id, begin, CASE WHEN begin > 40 THEN string_split(lead, chr(10))[-1] ELSE lead END || mid || string_split(tail, chr(10))[1] AS around FROM cut""")
def text_window(spark, sf):
    """The text about a span of up to 20 characters anywhere in any text, snapped to lines."""
    docs = _anywhere(spark, sf)
    end = F.least(F.col("begin") + 20, F.length("text"))
    return docs.select("doc_id", "begin", cp.window_around(F.col("text"), F.col("begin"), end, 40).alias("around"))


@query("""SELECT l_orderkey, l_linenumber, len(list_distinct([x FOR x IN a IF NOT list_contains(b, x)])) AS unsupported FROM (SELECT l_orderkey, l_linenumber,
regexp_extract_all('pay ' || CAST(l_quantity AS INTEGER) || ' of ' || l_linenumber || ' by ' || l_suppkey, '[0-9]+') AS a, regexp_extract_all('due ' || CAST(l_quantity AS INTEGER) || ', line ' || l_linenumber || ', part ' || l_partkey, '[0-9]+') AS b FROM lineitem)""")
def numbers_supported(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    claim, source = F.format_string("pay %d of %d by %d", "q", "l_linenumber", "l_suppkey"), F.format_string("due %d, line %d, part %d", "q", "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", F.size(tx.unsupported_numbers(claim, source)).cast("long").alias("unsupported"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '.' || (o_orderkey % 90 + 10) WHEN 1 THEN 's' || (o_orderkey % 90000 + 10) WHEN 2 THEN 'ab' || (o_custkey % 9000 + 10) ELSE 'cityord' || o_custkey END AS citation FROM orders")
def citation_keys(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cited = F.when(k % 4 == 0, F.format_string("Cal. Civ. Code %d.%d(a)", c, k % 90 + 10)).when(k % 4 == 1, F.format_string("Senate, No. %d", k % 90000 + 10)).when(k % 4 == 2, F.format_string("AB %d (2019)", c % 9000 + 10)).otherwise(F.format_string("City Ord. %d", c))
    return table(spark, sf, "orders").select("o_orderkey", tx.citation_key(cited).alias("citation"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN NULL WHEN 0 THEN p_size WHEN 2 THEN p_size ELSE 2 END AS low, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size WHEN 2 THEN p_size + 3 ELSE 2 END AS high FROM part""")
def units_parse(spark, sf):
    s = F.col("p_size")
    said = F.when(F.col("p_partkey") % 4 == 0, F.format_string("%d units or more", s)).when(F.col("p_partkey") % 4 == 1, F.format_string("Bldg %d units or less", s)).when(F.col("p_partkey") % 4 == 2, F.format_string("Apartment %d to %d Units", s, s + 3)).otherwise("Duplex")
    return table(spark, sf, "part").select("p_partkey", tx.units_described(said).alias("u")).select("p_partkey", "u.low", "u.high")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE least(c_custkey % 9 + 1, c_custkey % 5 + 1) END AS low, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE greatest(c_custkey % 9 + 1, c_custkey % 5 + 1) END AS high FROM customer""")
def units_hull(spark, sf):
    """A count against a described range: their hull, with an open end kept open."""
    k = F.col("c_custkey")
    n, d = k % 9 + 1, k % 5 + 1
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 4 != 1, F.least(n, d)).alias("low"), F.when(k % 4 != 0, F.greatest(n, d)).alias("high"))


@query("SELECT c_custkey, (c_custkey % 500 + 1) || ' ' || (c_custkey % 9 + 1) || 'TH AVE' AS street FROM customer")
def street_clean(spark, sf):
    k = F.col("c_custkey")
    n = k % 500 + 1
    raw = F.concat(F.lit(" "), n, F.when(k % 4 == 0, F.concat(F.lit("-"), n + 2)).when(k % 4 == 1, F.concat(F.lit(" - "), n, F.lit(".5"))).otherwise(""), F.lit("  0"), k % 9 + 1, F.when(k % 3 == 0, "TH AV.").otherwise("TH   AVE"), F.when(k % 5 == 0, "/601 HARRISON").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", tx.clean_street(raw).alias("street"))


@query("SELECT c_custkey, least(c_custkey % 900 + 1, c_custkey % 70 + 1) <= 50 AND greatest(c_custkey % 900 + 1, c_custkey % 70 + 1) >= 50 AS agrees FROM customer")
def house_number_agrees(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", tx.house_numbers(F.concat((k % 900 + 1).cast("string"), F.lit(" & "), (k % 70 + 1).cast("string"), F.lit(" X ST"))).alias("h"))
    return rows.select("c_custkey", ((F.col("h.low") <= 50) & (F.col("h.high") >= 50)).alias("agrees"))


@query("SELECT c_custkey, lower(regexp_replace(c_name || ' of town', '[^A-Za-z0-9]+', '', 'g')) AS squashed, array_to_string([substr(w, 1, 1) FOR w IN string_split_regex(lower(trim(c_name || ' of town')), '\\s+')], '') AS initials FROM customer")
def place_names(spark, sf):
    name = F.concat("c_name", F.lit(" of town"))
    return table(spark, sf, "customer").select("c_custkey", tx.squashed(name).alias("squashed"), tx.initials(name).alias("initials"))


@query("SELECT o_orderkey, 'r-' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 12, '0') AS id FROM orders")
def assign_ids(spark, sf):
    """Running ids over all orders, by day of order and key; a day's orders are one bucket."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderdate")
    return cp.numbered(rows, "day", ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", F.concat(F.lit("r-"), F.lpad(F.col("n").cast("string"), 12, "0")).alias("id"))


@query("""WITH s AS (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM lineitem GROUP BY ALL)
SELECT members, min(l_orderkey) AS first_order, count(*) AS n FROM s GROUP BY members HAVING count(*) > 1""")
def stable_sets(spark, sf):
    """Groups with equal member sets, the join that keeps ids stable, as a grouping on the sorted set."""
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("members"))
    return sets.groupBy("members").agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("n")).where("n > 1")


@query("SELECT l_partkey, arg_min(l_orderkey, struct_pack(a := CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, b := -l_quantity, c := l_orderkey, d := l_linenumber)) AS winner FROM lineitem GROUP BY l_partkey")
def group_winner(spark, sf):
    rank = F.struct(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("a"), (-F.col("l_quantity")).alias("b"), F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("d"))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", rank).alias("winner"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'too large' WHEN p_retailprice < 950 THEN 'too cheap' WHEN p_brand IS NULL THEN 'no brand' END AS reason FROM part""")
def reject_gates(spark, sf):
    """The first gate that fails is the reason."""
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 40, "too large").when(F.col("p_retailprice") < 950, "too cheap").when(F.col("p_brand").isNull(), "no brand").alias("reason"))


@query("""SELECT source, lang, count(*) AS docs, count(*) FILTER (WHERE length(text) = 0) AS empty, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL""")
def doc_availability(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count_if(F.length("text") == 0).alias("empty"), F.sum("n_chars").alias("chars"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def content_keys(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
