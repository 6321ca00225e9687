"""A rule's page: the passage about its quote with offsets in characters and in UTF-16 units, its answers, and how to mark the quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import with_documents

#: Characters about a quote; characters within which the passage is widened to a whole line.
WINDOW, SNAP = 1200, 300


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 units: a character beyond the first plane takes two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _passage(text: Column, body: Column, start: Column, end: Column) -> Column:
    """``(low, high)``: WINDOW characters each way, widened to a line's start and end if one is within SNAP."""
    low = F.greatest(body, start - WINDOW)
    before = F.substring(text, F.greatest(body, low - SNAP) + 1, low - F.greatest(body, low - SNAP))
    at = F.locate("\n", F.reverse(before))
    low = F.when((low > body) & (at > 0), low - at + 1).otherwise(low)
    size = F.char_length(text)
    high = F.least(size, end + WINDOW)
    line = F.locate("\n", F.substring(text, high + 1, F.lit(SNAP)))
    high = F.when((high < size) & (line > 0), high + line - 1).otherwise(high)
    return F.struct(F.least(low, start).alias("low"), high.alias("high"))


def rule_details(rules: DataFrame, docs: DataFrame, answers: DataFrame) -> DataFrame:
    """``(rule_id, window, start, end, window_start, window_end, start16, end16, window_start16, window_end16, quote_matches, highlight, note, tenant, owner)`` of every rule.

    ``rules(rule_id, doc_id, span_start, span_end, quoted_span)``, ``docs(doc_id, text, body_offset, jurisdiction)``,
    ``answers(rule_id, role, answer)``.  Texts are cut where they lie, and only the
    passage goes on.  Highlight is by offsets; by substring where the span is
    missing or out of range or there is no text; none without a quote.
    """
    rows = with_documents(rules, docs).withColumn("body", F.coalesce("body_offset", F.lit(0)))
    size = F.char_length("text")
    good = F.coalesce((F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= size), F.lit(False))
    rows = rows.withColumn("w", F.when(good, _passage(F.col("text"), F.col("body"), F.col("span_start"), F.col("span_end"))))
    cut = lambda a, b: F.substring("text", a + 1, b - a)
    upto = lambda a: utf16_units(F.substring(F.col("text"), F.lit(1), a))
    low, high, s, e = F.col("w.low"), F.col("w.high"), F.col("span_start"), F.col("span_end")
    note = F.when(F.col("doc_id").isNull(), "rule names no document").when(F.coalesce(size, F.lit(0)) == 0, "document has no text").when(~good, "span is missing or out of range")
    on = lambda x: F.when(good, x)
    rows = rows.select(
        "rule_id", on(cut(low, high)).alias("window"), on(s).alias("start"), on(e).alias("end"), low.alias("window_start"), high.alias("window_end"), on(upto(s)).alias("start16"), on(upto(e)).alias("end16"), on(upto(low)).alias("window_start16"),
        on(upto(low) + utf16_units(cut(low, high))).alias("window_end16"), on(cut(s, e) == F.col("quoted_span")).alias("quote_matches"), F.when(good, "offsets").when(F.coalesce("quoted_span", F.lit("")) != "", "substring").otherwise("none").alias("highlight"), note.alias("note"),
    )
    said = answers.groupBy("rule_id").agg(*[F.max(F.when(F.col("role") == role, F.col("answer"))).alias(role) for role in ("tenant", "owner")])
    return rows.join(said, "rule_id", "left")


def guarded_answers(rules: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(rule_id, role, answer, state)`` of every summary: shown only while it is of the very quote that the rule has now.

    ``rules(rule_id, quoted_span)``, ``summaries(rule_id, role, answer, quote_sha)``. An answer whose digest is of another quote
    is stale and hidden, one of a rule that is gone is an orphan; one without words is empty.
    """
    now = rules.select("rule_id", F.sha2(F.coalesce("quoted_span", F.lit("")), 256).alias("_now"))
    rows = summaries.join(now, "rule_id", "left")
    state = F.when(F.col("_now").isNull(), "orphan").when(~F.col("quote_sha").eqNullSafe(F.col("_now")), "stale").when(F.trim(F.coalesce("answer", F.lit(""))) == "", "empty").otherwise("shown")
    return rows.select("rule_id", "role", F.when(state == "shown", F.col("answer")).alias("answer"), state.alias("state"))


def audit_of(rules: DataFrame, lines: DataFrame) -> DataFrame:
    """``(rule_id, line_id, stage)``: the audit lines that are about a rule as it stands.

    ``rules(rule_id, candidates, chunks, docs)`` with arrays of ids; ``lines(line_id, stage, rule_id, candidates, chunk_id,
    doc_id)``. A verify line counts for its rule, unless it names candidates of which the
    rule has none; an extract line for the rules of its chunk; an ingest line for those of its document; other stages for none.
    Each stage is an equi-join on its own key.
    """
    verify = lines.where("stage = 'verify'").select("line_id", "stage", "rule_id", F.col("candidates").alias("_named"))
    own = rules.select("rule_id", F.coalesce("candidates", F.array().cast("array<string>")).alias("_own"))
    some = (F.coalesce(F.size("_named"), F.lit(0)) <= 0) | (F.size("_own") == 0) | F.arrays_overlap("_own", "_named")
    by_rule = verify.join(own, "rule_id").where(some).select("rule_id", "line_id", "stage")
    by_chunk = rules.select("rule_id", F.explode(F.array_distinct("chunks")).alias("chunk_id")).join(lines.where("stage = 'extract'").select("line_id", "stage", "chunk_id"), "chunk_id").select("rule_id", "line_id", "stage")
    by_doc = rules.select("rule_id", F.explode(F.array_distinct("docs")).alias("doc_id")).join(lines.where("stage = 'ingest'").select("line_id", "stage", "doc_id"), "doc_id").select("rule_id", "line_id", "stage")
    return by_rule.union(by_chunk).union(by_doc)
