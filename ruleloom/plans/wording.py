"""Queries over spans, dates and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import effective as ef
from ..functions import guards as gd
from ..functions import spans as sp
from ..functions import units as un
from ..sources.readers import table
from .catalogue import query


@query("""WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), 'tion') AS x FROM documents), e AS (SELECT doc_id, x, unnest(range(1, len(x))) AS k FROM p)
SELECT doc_id, count(*) AS n, string_agg(CAST(list_sum([length(y) FOR y IN x[1:k]]) + 4 * (k - 1) AS BIGINT)::VARCHAR, ',' ORDER BY k) AS places FROM e GROUP BY doc_id""")
def needle_occurrences(spark, sf):
    """Every place of a needle in every whole document."""
    found = table(spark, sf, "documents").select("doc_id", sp.occurrences(F.col("text"), F.lit("tion")).alias("at"))
    return found.where(F.size("at") > 0).select("doc_id", F.size("at").cast("long").alias("n"), F.array_join("at", ",").alias("places"))


def quotes(spark, sf):
    """``(doc_id, text, quote)``: a quote from anywhere in each text; by key as it stands, spaced otherwise, set otherwise, or broken at a line's end."""
    docs = table(spark, sf, "documents")
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.char_length("text") - 50, F.lit(1))).cast("int")
    quote = F.substring(F.col("text"), at + 1, F.lit(48))
    k = F.pmod(F.hash("doc_id"), F.lit(5))
    changed = F.when(k == 1, F.regexp_replace(quote, r"\s+", "\n  ")).when(k == 2, F.regexp_replace(F.regexp_replace(quote, " ", " "), "e", "e­")).when(k == 3, F.concat(quote, F.lit("?!zz"))).otherwise(quote)
    inside = F.substring(F.col("text"), at + 20, F.lit(2)).rlike(r"^\p{Ll}\p{Ll}$")
    text = F.when((k == 4) & inside, F.concat(F.substring(F.col("text"), F.lit(1), at + 20), F.lit("-\n  "), F.substring(F.col("text"), at + 21, F.char_length("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"), changed.alias("quote"))


@query()
def span_levels(spark, sf):
    """At which level and place a quote is found in its document; no SQL engine takes these patterns, so tests hold it to a plain search."""
    return quotes(spark, sf).select("doc_id", sp.find_span(F.col("text"), F.col("quote")).alias("x")).select("doc_id", "x.start", "x.end", "x.match")


_DAY = "CAST(o_orderdate AS DATE)"


@query(f"""WITH r AS (SELECT *, {_DAY} AS d, o_orderkey % 16 AS k, strftime({_DAY}, '%Y-%m-%d') AS s FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN strftime(date_trunc('month', d + to_months(12)), '%Y-%m-%d') WHEN k = 1 THEN strftime(d + 90, '%Y-%m-%d') WHEN k = 2 THEN strftime(d + 30, '%Y-%m-%d') WHEN k IN (3, 4, 5, 6, 12, 13, 14) THEN s WHEN k = 7 THEN strftime(d, '%Y-%m')
    WHEN k = 15 THEN strftime(d + 180, '%Y-%m-%d') WHEN k = 11 AND o_orderkey % 5 = 0 AND o_orderstatus <> 'P' THEN strftime(make_date(year(d) + 1, 1, 1), '%Y-%m-%d') END AS day,
CASE WHEN k = 0 THEN 'nth_month' WHEN k IN (1, 2, 15) THEN 'days_after' WHEN k = 3 THEN 'immediately' WHEN k IN (4, 6, 7, 12, 13, 14) THEN 'explicit' WHEN k = 5 THEN 'range_start' WHEN k = 11 THEN CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'P' THEN 'january_default' ELSE 'not_stated' END ELSE 'unresolved' END AS method,
CASE WHEN k IN (6, 14) THEN 5 WHEN k = 11 AND o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 10 END ELSE 0 END AS penalty FROM r""")
def effective_dates(spark, sf):
    """Sixteen ways of stating when a law takes effect, each with its order's day; bills that aren't enacted among them."""
    key, d = F.col("o_orderkey") % 16, F.col("o_orderdate").cast("date")
    fmt = lambda p, n=0: F.date_format(F.date_add(d, n), p)
    said = (
        F.when(key == 0, "the first day of the twelfth month following").when(key == 1, "on the 90th day after enactment").when(key == 2, "thirty days\nafter filing").when(key == 3, "This act shall take effect immediately.")
        .when(key == 4, F.concat(F.lit("Effective "), fmt("MMMM d, yyyy"), F.lit("."))).when(key == 5, F.concat(fmt("yyyy-MM-dd"), F.lit(" to "), fmt("yyyy-MM-dd", 400)))
        .when(key == 6, F.concat(F.lit("beginning "), fmt("M/d/yyyy"), F.lit(" and no later, expires "), fmt("M/d/yyyy", 99))).when(key == 7, F.concat(F.lit("in "), fmt("MMMM yyyy"))).when(key == 8, "when the board says so")
        .when(key == 9, F.concat(fmt("yyyy-MM-dd"), F.lit(" or "), fmt("yyyy-MM-dd", 5))).when(key == 10, "the first day of the third month").when(key == 12, F.concat(fmt("MMM"), F.lit(". "), fmt("d"), F.lit("th, "), fmt("yyyy")))
        .when(key == 13, F.concat(F.lit("on "), fmt("MM-dd-yyyy"))).when(key == 14, F.concat(F.lit("it takes effect "), fmt("MMM d yyyy"), F.lit(" but becomes inoperative on "), fmt("MMM d yyyy", 70))).when(key == 15, "one hundred eighty (180) days after approval").otherwise("")
    )
    anchor = F.when(key == 10, "no day here").when((key == 11) & (F.col("o_orderkey") % 5 != 0), "approved").otherwise(F.concat(F.lit("Chaptered "), fmt("MMMM d, yyyy")))
    found = table(spark, sf, "orders").select("o_orderkey", ef.resolve(said, anchor, F.col("o_orderstatus") != "P", F.lit(True)).alias("x"))
    return found.select("o_orderkey", "x.day", "x.method", "x.penalty")


_EN = (
    "You must pay no more than $5 a month.", "Your rent may rise by 5 percent in May 2027.", "You can avoid this; you are exempt if you move.", "The owner gives notice. It is in effect.", "You would owe twenty-one dollars under this bill.",
    "This rule says you must give one-half of the deposit back.", "You can go around this by asking for a work-around.", "You have thirty days\nand 5.50 dollars.", "Note: you may not raise the rent once the law takes effect.",
    "You must keep a record of each and every notice that you have given to a person who lives in the building you own.", "It is not yet law.", "You are limited to 5% unless the board says otherwise.", "",
)
_ES = (
    "Usted debe pagar hasta 5 por ciento en enero.", "Si usted es exento, su límite es 5.", "Usted puede darle la vuelta.", "Usted recibirá setenta por ciento.", "Según la ley, su renta está vigente.", "¿Podría usted evitarlo?", "No es ley; no se aprobó.",
)
_k = "o_orderkey"


def sentences(spark, sf):
    """``(o_orderkey, sentence, quote, role, status, lang)``: a sentence in either language, with each order's number for the 5."""
    k, n = F.col(_k), F.floor(F.col("o_totalprice") / 1000).cast("string")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    lang = F.when(k % 4 == 1, "es").otherwise("en")
    said = F.regexp_replace(F.when(lang == "es", pick(_ES)).otherwise(pick(_EN)), "5", n)
    quote = F.concat(F.lit("The amount is $"), F.when(k % 2 == 0, n).otherwise("21"), F.lit(" or five percent, from January 1, thirty days."))
    status = F.element_at(F.array(*map(F.lit, ("in_force", "pending", "failed", "not_yet_effective", "repealed"))), (k % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select(_k, said.alias("sentence"), quote.alias("quote"), F.when(k % 8 < 4, "owner").otherwise("tenant").alias("role"), status.alias("status"), lang.alias("lang"))


@query()
def guard_reasons(spark, sf):
    """All guards over sentences with each order's numbers; tests hold them to a plain reading."""
    return gd.checked(sentences(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs).replace("\n", "' || chr(10) || '") + "]"
SQL_SENTENCES = f"""SELECT {_k}, replace(CASE WHEN {_k} % 4 = 1 THEN {_list(_ES)}[{_k} % {len(_ES)} + 1] ELSE {_list(_EN)}[{_k} % {len(_EN)} + 1] END, '5', CAST(floor(o_totalprice / 1000) AS BIGINT)::VARCHAR) AS sentence,
CASE WHEN {_k} % 8 < 4 THEN 'owner' ELSE 'tenant' END AS role, ['in_force', 'pending', 'failed', 'not_yet_effective', 'repealed'][{_k} % 5 + 1] AS status, CASE WHEN {_k} % 4 = 1 THEN 'es' ELSE 'en' END AS lang FROM orders"""


@query(f"WITH s AS ({SQL_SENTENCES}) SELECT {_k}, array_to_string({gd.sql_wording_guard('sentence', 'role', 'status', 'lang')}, ',') AS reasons FROM s")
def guard_wordings(spark, sf):
    """The guards of form, status and evasion over the same sentences, by the table of wordings."""
    reasons = gd.wording_guard(F.col("sentence"), F.col("role"), F.col("status"), F.col("lang"))
    return sentences(spark, sf).select(_k, F.array_join(reasons, ",").alias("reasons"))


@query(f"WITH s AS ({SQL_SENTENCES}), r AS (SELECT lang, unnest({gd.sql_wording_guard('sentence', 'role', 'status', 'lang')}) AS reason FROM s) SELECT lang, split_part(reason, ':', 1) AS reason, count(*) AS n FROM r GROUP BY ALL")
def guard_histogram(spark, sf):
    """How often each guard drops a sentence, by language."""
    reasons = gd.wording_guard(F.col("sentence"), F.col("role"), F.col("status"), F.col("lang"))
    rows = sentences(spark, sf).select("lang", F.explode(reasons).alias("reason"))
    return rows.groupBy("lang", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


#: A description a customer, by key; what it says is worked out from the key alone in SQL.
_USE = (
    ("CA", "'Flats ' || a || ' to ' || b || ' units'"), ("CA", "'Apartment ' || b || ' to ' || a || ' UNITS'"), ("CA", "'Apartment ' || a || ' Units or more'"), ("CA", "'TIC Bldg ' || a || ' units or less'"), ("CA", "'Five or more apartments'"), ("CA", "'County code 14-16 (' || a || '+ units)'"),
    ("MA", "'APT ' || a || '-' || b || ' UNITS'"), ("MA", "'LUXURY APARTMENT'"), ("MA", "'MXD >' || a || '-UNIT-APT'"), ("MA", "a || '-' || b || '-UNIT-APT'"), ("NJ", "'3B-' || a || 'U/4 1/2B-' || b || 'U-G'"), ("NJ", "'3SB' || a || 'UG'"),
    ("NJ", "'3B-G/4B-' || a || 'U'"), ("NJ", "'Apartments (class 4C)'"), ("MA", "'Flats 1 to 2 units'"), ("NJ", "' '"),
)
_use_case = "CASE k % 16 " + " ".join(f"WHEN {i} THEN {x}" for i, (_, x) in enumerate(_USE)) + " END"
_use_state = "CASE k % 16 " + " ".join(f"WHEN {i} THEN '{x}'" for i, (x, _) in enumerate(_USE)) + " END"
_use_units = "CASE WHEN k % 5 = 0 THEN CAST(k % 40 AS STRING) WHEN k % 5 = 1 THEN 'many' END"
_use_rows = f"SELECT k, a, b, {_use_state} AS state, {_use_case} AS use_description, {_use_units} AS units FROM (SELECT c_custkey AS k, CAST(c_custkey % 9 + 1 AS INT) AS a, CAST(c_custkey % 9 + 1 + c_custkey % 30 AS INT) AS b FROM customer)"


@query(f"""WITH r AS ({_use_rows.replace('AS STRING', 'AS VARCHAR')}), p AS (SELECT *, CASE k % 16 WHEN 0 THEN a WHEN 1 THEN CASE WHEN a = b THEN a END WHEN 2 THEN a WHEN 4 THEN 5 WHEN 5 THEN a WHEN 6 THEN a WHEN 8 THEN a + 1 WHEN 9 THEN a WHEN 10 THEN a + b END AS low,
    CASE k % 16 WHEN 0 THEN b WHEN 1 THEN CASE WHEN a = b THEN a END WHEN 3 THEN a WHEN 6 THEN b WHEN 9 THEN b WHEN 10 THEN a + b END AS high,
    CASE k % 16 WHEN 1 THEN CASE WHEN a = b THEN 'ok' ELSE 'upside down' END WHEN 7 THEN 'no count stated' WHEN 11 THEN 'ambiguous token' WHEN 12 THEN 'a part without one clear token' WHEN 13 THEN 'no count stated' WHEN 14 THEN 'no parser fits' WHEN 15 THEN 'no description' ELSE 'ok' END AS said, TRY_CAST(units AS INTEGER) AS n FROM r)
SELECT k AS address_id, said, n AS units, CASE WHEN n IS NULL THEN low WHEN n < low OR n > high THEN CASE WHEN low IS NOT NULL THEN least(n, low) END ELSE n END AS low, CASE WHEN n IS NULL THEN high WHEN n < low OR n > high THEN CASE WHEN high IS NOT NULL THEN greatest(n, high) END ELSE n END AS high,
CASE WHEN n IS NOT NULL THEN 'units' WHEN low IS NOT NULL OR high IS NOT NULL THEN 'use_description' END AS source, CASE WHEN n IS NULL AND units IS NOT NULL THEN 'units are no whole number' WHEN n < low OR n > high THEN 'units contradict the description' END AS review FROM p""")
def units_of_descriptions(spark, sf):
    """Units of every customer's building from a description in one of sixteen forms of three states, and from a column where it has a number."""
    keys = table(spark, sf, "customer").selectExpr("c_custkey AS k", "CAST(c_custkey % 9 + 1 AS INT) AS a", "CAST(c_custkey % 9 + 1 + c_custkey % 30 AS INT) AS b")
    rows = keys.selectExpr("k", f"{_use_state} AS state", f"{_use_case} AS use_description", f"{_use_units} AS units")
    found = rows.withColumn("p", un.described(F.col("use_description"), F.col("state"), un.parsers())).withColumn("x", un.resolved(F.col("units"), F.col("p")))
    return found.select(F.col("k").alias("address_id"), "p.said", "x.units", "x.low", "x.high", "x.source", "x.review")
