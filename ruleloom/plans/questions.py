"""Queries over questions, rows that fit them, excerpts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import questions as qs
from ..operators import detail as dt
from ..operators import lookup as lk
from ..sources.readers import table
from ..sources.views import AS_OF, category_name, parcels, rules
from ..sources.views import CATEGORIES as ALL_CATEGORIES
from .catalogue import query

CATEGORIES = ("rent", "eviction", "deposit")
KINDS = ("why_unknown", "conflict", "upcoming", "jurisdiction", "overview")
LEXICON = [
    ("rent", "que la"), ("rent", "ention"), ("rent", "einver"), ("eviction", "die"), ("eviction", "of the"), ("eviction", "tion and"), ("deposit", "eou"), ("deposit", "les"), ("deposit", "enst the"),
    ("why_unknown", "la mente"), ("why_unknown", "nicht"), ("conflict", "and the"), ("conflict", "und"), ("upcoming", "der die"), ("upcoming", "osos"), ("jurisdiction", "in the"), ("overview", "et la"), ("overview", "de la que"),
]


@query()
def question_intents(spark, sf):
    """What every turn of every conversation asks about; the phrases chosen greedily, so tests hold it to a plain loop."""
    words = table(spark, sf, "conversations").withColumn("words", qs.unmarked(qs.tokens(F.col("text"))))
    kept = words.withColumn("kept", qs.greedy(qs.phrase_hits(F.col("words"), LEXICON)))
    found = kept.withColumn("intent", qs.intent(F.col("kept"), CATEGORIES, KINDS))
    return found.select("conv_id", "turn", "intent.kind", "intent.category", F.array_join(F.transform("kept", lambda h: F.concat_ws(":", h["start"], h["len"], h["key"])), ",").alias("matched"))


SQL_MARKS = f"translate(regexp_replace(t, '\\p{{M}}+', '', 'g'), '{qs._marked}', '{qs._plain}')"
SQL_TOKENS = f"[{SQL_MARKS} FOR t IN string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') IF t <> '']"
SQL_CONTENT = f"[t FOR t IN {SQL_TOKENS} IF length(t) >= 4 AND t NOT IN ({', '.join(repr(w) for w in qs.STOPWORDS)})]"


@query(f"""WITH said AS (SELECT conv_id, turn, {SQL_CONTENT} AS w FROM conversations),
q AS (SELECT a.conv_id, a.turn, list_distinct(a.w) AS q, b.w AS r FROM said a JOIN said b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
e AS (SELECT conv_id, turn, unnest(q) AS t, r FROM q),
n AS (SELECT conv_id, turn, count(*) FILTER (WHERE len([x FOR x IN r IF starts_with(x, t) OR starts_with(t, x)]) > 0) AS n FROM e GROUP BY ALL)
SELECT q.conv_id, q.turn, CAST(coalesce(n, 0) AS INTEGER) AS overlap FROM q LEFT JOIN n ON q.conv_id = n.conv_id AND q.turn = n.turn""")
def answer_overlap(spark, sf):
    """How well each turn fits the one that follows, by telling words; an equi-join on the conversation and turn."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", qs.unmarked(qs.tokens(F.col("text"))).alias("w"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("r"))
    return said.join(after, ["conv_id", "turn"]).select("conv_id", "turn", qs.overlap(F.col("w"), F.col("r")).alias("overlap"))


@query("""WITH t AS (SELECT doc_id, trim(text, ' ') AS x FROM documents), h AS (SELECT *, substring(x, 1, 221) AS head FROM t), p AS (SELECT *, strpos(reverse(head), ' ') AS back FROM h)
SELECT doc_id, md5(CASE WHEN length(x) <= 220 THEN x ELSE rtrim(substring(x, 1, CASE WHEN back > 0 AND length(head) - back > 110 THEN length(head) - back ELSE 220 END), ' ') || '…' END) AS excerpt_md5 FROM p""")
def quote_excerpts(spark, sf):
    """Every document's beginning, cut at a blank."""
    return table(spark, sf, "documents").select("doc_id", F.md5(qs.excerpt(F.col("text")).cast("binary")).alias("excerpt_md5"))


_STRONG, _WEAK, _DEMOTE = ["the", "la", "nicht", "de la"], ["and", "que", "der", "et", "a.b"], ["ou", "ses", "in the"]


def _sql_has(column: str, word: str) -> str:
    quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in word)
    return f"regexp_matches({column}, '(^|[^a-z0-9]){quoted}($|[^a-z0-9])')"


_SQL_SCORE = " + ".join(f"CASE WHEN {_sql_has('title', w)} THEN {3 * n} WHEN {_sql_has('body', w)} THEN {n} ELSE 0 END" for words, n in ((_STRONG, 2), (_WEAK, 1)) for w in words) + " - CASE WHEN " + " OR ".join(_sql_has("title", w) for w in _DEMOTE) + " THEN 8 ELSE 0 END"
_SQL_SCORED = f"""scored AS (SELECT doc_id, lang, source, n_chars, CAST({_SQL_SCORE} AS INTEGER) AS score FROM (SELECT *, lower(split_part(coalesce(text, ''), chr(10), 1)) AS title,
    lower(substring(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 1)) AS body FROM documents))"""


def _scored(spark, sf):
    text = F.coalesce("text", F.lit(""))
    title = F.substring_index(text, "\n", 1)
    body = F.substring(text, F.char_length(title) + 1, F.char_length(text))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", qs.keyword_score(title, body, _STRONG, _WEAK, _DEMOTE).cast("int").alias("score"))


@query(f"WITH {_SQL_SCORED} SELECT doc_id, score FROM scored")
def keyword_scores(spark, sf):
    """Whole words of a category in the first line and the rest of every document."""
    return _scored(spark, sf).select("doc_id", "score")


@query(f"WITH {_SQL_SCORED} SELECT lang, source, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, n_chars DESC NULLS LAST, doc_id) AS k FROM scored) WHERE k = 1")
def headline_documents(spark, sf):
    """The document to show first in each language and source: the best score, then the longest, then the least id, by partial aggregation."""
    rank = F.struct((-F.col("score")).alias("a"), F.col("n_chars").isNull().alias("b"), (-F.col("n_chars")).alias("c"), F.col("doc_id").alias("d"))
    return _scored(spark, sf).groupBy("lang", "source").agg(F.min_by(F.struct("doc_id", "score"), rank).alias("x")).select("lang", "source", "x.doc_id", "x.score")


@query("""WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'error') AS u, count(*) FILTER (WHERE event_type = 'click') AS p FROM events GROUP BY user_id)
SELECT user_id, coalesce(nullif(concat_ws(', ', CASE WHEN a > 0 THEN a || ' apply' END, CASE WHEN u > 0 THEN u || ' not known' END, CASE WHEN p > 0 THEN p || ' proposed' END), ''), 'nothing found') AS said FROM n""")
def counts_in_words(spark, sf):
    """Counts of each user's events as an answer puts them."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    n = table(spark, sf, "events").groupBy("user_id").agg(of("purchase").alias("a"), of("error").alias("u"), of("click").alias("p"))
    return n.select("user_id", qs.counts_said(F.col("a"), F.col("u"), F.col("p")).alias("said"))


_TITLES = ("rents and deposits", "que la mente", "nicht die osos", "of the invention and them")


def looked_up(spark, sf):
    """``(address_id, place, rows)``: each customer's lookup as one array, in order of rule."""
    p, r = parcels(spark, sf), rules(spark, sf)
    rows = lk.with_precedence(lk.base_results(lk.jurisdiction_pairs(p, r), F.lit(AS_OF).cast("date")), ["address_id"])
    title = F.concat(category_name(F.col("category")), F.lit(" "), F.element_at(F.array(*map(F.lit, _TITLES)), F.col("rule_id") % 4 + 1))
    row = F.struct("rule_id", category_name(F.col("category")).alias("category"), "level", "result", "conflict", "missing", F.col("effective").cast("string").alias("effective"), title.alias("title"))
    return rows.groupBy("address_id").agg(F.any_value(F.coalesce("city", "state")).alias("place"), F.array_sort(F.collect_list(row)).cast(an.ROW).alias("rows"))


@query()
def question_answers(spark, sf):
    """Every turn of every conversation answered for an address: intent, lead, citations, open facts and what to ask next; tests hold it to a plain loop."""
    n = table(spark, sf, "customer").count()
    asked = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % n + 1).alias("address_id"), qs.unmarked(qs.tokens(F.col("text"))).alias("words"))
    kept = asked.withColumn("kept", qs.greedy(qs.phrase_hits(F.col("words"), LEXICON)))
    about = kept.withColumn("intent", qs.intent(F.col("kept"), CATEGORIES, KINDS)).join(looked_up(spark, sf), "address_id", "left")
    x = an.answer(F.col("intent.kind"), F.col("intent.category"), F.col("rows"), F.col("words"), F.coalesce("place", F.lit("here")), ALL_CATEGORIES)
    return about.select("conv_id", "turn", "address_id", x.alias("x")).select("conv_id", "turn", "address_id", "x.kind", "x.lead", *[F.array_join(f"x.{c}", ",").alias(c) for c in ("cited", "missing", "next")])


_DETAIL = {
    "doc": "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN -doc_id - 1 ELSE doc_id END", "s": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 7919) % greatest(length(text), 1) END",
    "e": "CASE WHEN doc_id % 17 = 0 THEN 10000000 ELSE least((doc_id * 7919) % greatest(length(text), 1) + 40, length(text)) END", "q": "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'other words' ELSE substr(text, CAST((doc_id * 7919) % greatest(length(text), 1) + 1 AS INT), 40) END",
}
_u16 = lambda x: f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@query(f"""WITH r AS (SELECT doc_id AS rule_id, {_DETAIL['doc']} AS doc, {_DETAIL['s']} AS s, {_DETAIL['e']} AS e, {_DETAIL['q']} AS q FROM documents), j AS (SELECT r.*, d.text, coalesce(s >= 0 AND s < e AND e <= length(d.text), false) AS good FROM r LEFT JOIN documents d ON d.doc_id = r.doc),
w AS (SELECT *, greatest(0, s - 1200) AS l0, least(length(text), e + 1200) AS h0 FROM j),
b AS (SELECT *, strpos(reverse(substr(text, greatest(0, l0 - 300) + 1, l0 - greatest(0, l0 - 300))), chr(10)) AS la, strpos(substr(text, h0 + 1, 300), chr(10)) AS ha FROM w),
c AS (SELECT *, CASE WHEN l0 > 0 AND la > 0 THEN l0 - la + 1 ELSE l0 END AS lo, CASE WHEN h0 < length(text) AND ha > 0 THEN h0 + ha - 1 ELSE h0 END AS hi FROM b),
v AS (SELECT *, substr(text, lo + 1, hi - lo) AS win FROM c)
SELECT rule_id, CASE WHEN good THEN md5(win) END AS window_md5, CASE WHEN good THEN s END AS start, CASE WHEN good THEN lo END AS window_start, CASE WHEN good THEN hi END AS window_end, CASE WHEN good THEN {_u16('substr(text, 1, s)')} END AS start16, CASE WHEN good THEN {_u16('substr(text, 1, lo)')} + {_u16('win')} END AS window_end16,
CASE WHEN good THEN substr(text, s + 1, e - s) = q END AS quote_matches, CASE WHEN good THEN 'offsets' WHEN coalesce(q, '') <> '' THEN 'substring' ELSE 'none' END AS highlight,
CASE WHEN doc IS NULL THEN 'rule names no document' WHEN coalesce(length(text), 0) = 0 THEN 'document has no text' WHEN NOT good THEN 'span is missing or out of range' END AS note, CASE WHEN rule_id % 3 = 0 THEN 'You may.' END AS tenant, CASE WHEN rule_id % 2 = 0 THEN 'You must.' END AS owner FROM v""")
def rule_details(spark, sf):
    """A rule a document: the passage about its span anywhere in the whole text, offsets in both units, how to mark it, and its answers."""
    docs = table(spark, sf, "documents")
    found = docs.selectExpr("doc_id AS rule_id", f"{_DETAIL['doc']} AS doc_id", f"CAST({_DETAIL['s']} AS INT) AS span_start", f"CAST({_DETAIL['e']} AS INT) AS span_end", f"{_DETAIL['q']} AS quoted_span")
    ids = docs.select(F.col("doc_id").alias("rule_id"))
    answers = ids.where("rule_id % 3 = 0").select("rule_id", F.lit("tenant").alias("role"), F.lit("You may.").alias("answer")).union(ids.where("rule_id % 2 = 0").select("rule_id", F.lit("owner"), F.lit("You must.")))
    rows = dt.rule_details(found, docs.select("doc_id", "text", F.lit(0).alias("body_offset"), F.lit("FR").alias("jurisdiction")), answers)
    return rows.select("rule_id", F.md5(F.col("window").cast("binary")).alias("window_md5"), F.col("start").cast("long").alias("start"), *[F.col(c).cast("long").alias(c) for c in ("window_start", "window_end", "start16", "window_end16")], "quote_matches", "highlight", "note", "tenant", "owner")
