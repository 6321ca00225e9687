"""Candidate rules checked against the documents they quote: gates that reject, and soft checks near the quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import effective as ef
from ..functions import text as tx
from ..functions.spans import find_span
from .documents import chaptering_record

# Characters about a quote in which its date and its numbers stand, and of a document that is one chunk.
DATE_WINDOW, NUMBER_WINDOW, ONE_CHUNK = 1000, 1500, 24_000
#: Bytes of candidates that are sent to where the documents are; beyond that documents move to them.
SENT_BYTES = 64 << 20

NEEDED = ("title", "requirement", "citation", "quoted_span")
NEAR, ANYWHERE = ("requirement", "key_value"), ("coverage_text", "exemptions", "penalty")


def with_documents(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Each candidate beside its document's ``text``, ``body_offset`` and ``of_jurisdiction``, null where there is no such document.

    While all candidates take at most SENT_BYTES they go to the documents, which stay
    in place; what was not met is then added by the candidates alone.  Above that the
    join is left to Spark, and each document moves once.
    """
    own = docs.select(F.col("doc_id").alias("_doc"), "text", "body_offset", F.col("jurisdiction").alias("of_jurisdiction"))
    weight = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in candidates.columns), F.lit(0))
    if (candidates.agg(F.sum(weight)).first()[0] or 0) > SENT_BYTES:
        return candidates.join(own, candidates["doc_id"] == own["_doc"], "left").drop("_doc")
    return own.join(F.broadcast(candidates), candidates["doc_id"] == own["_doc"], "right").drop("_doc")


def gates(valid: Column) -> Column:
    """The first reason against a candidate that needs no look at its document; ``valid`` says whether its jurisdiction is known."""
    level = F.when(F.col("jurisdiction").contains(", "), "city").otherwise("state")
    out = F.when(F.col("text").isNull(), "document without text").when(~valid, "unknown jurisdiction").when(~F.col("level").eqNullSafe(level), "level is not the jurisdiction's")
    for name in NEEDED:
        out = out.when(F.trim(F.coalesce(name, F.lit(""))) == "", f"missing {name}")
    return out


def _window(start: Column, end: Column, width: int) -> Column:
    low = F.greatest(F.col("body_offset"), start - width)
    return F.substring("text", low + 1, end + width - low)


def checked(candidates: DataFrame, docs: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """``(candidate_id, reject, start, end, match, reasons, notes, penalty, doc_anchor, day, method)`` of every candidate.

    ``candidates(candidate_id, doc_id, jurisdiction, level, title, citation, status_hint, quoted_span,
    effective_date_phrase, effective_date_anchor, requirement, key_value, coverage_text,
    exemptions, penalty_text as penalty, predicate_numbers array)``; ``docs(doc_id, text,
    body_offset, jurisdiction)``; ``jurisdictions(jurisdiction)`` is a dimension.

    Reasons ask for review, notes don't; both in a fixed order, hundredths as penalty.
    A date phrase belongs within DATE_WINDOW of the quote; far from it, it is a note in
    a document of one chunk and a reason in a longer one. Numbers of the requirement
    and the key value belong within NUMBER_WINDOW, all others anywhere in the body. A date
    that the candidate's own anchor doesn't give is tried from the document's one
    chaptering line.  Every text is read where it lies and dropped there.
    """
    known = candidates.join(jurisdictions.select("jurisdiction").distinct().withColumn("_valid", F.lit(True)), "jurisdiction", "left")
    rows = with_documents(known, docs).withColumn("body_offset", F.coalesce("body_offset", F.lit(0)))
    body = F.substring("text", F.col("body_offset") + 1, F.char_length("text"))
    within = lambda quote: find_span(F.col("body"), quote)
    rows = rows.withColumn("body", body).withColumn("gate", gates(F.coalesce("_valid", F.lit(False))))
    rows = rows.withColumn("x", F.when(F.col("gate").isNull(), within(F.col("quoted_span"))))
    rows = rows.withColumn("reject", F.coalesce("gate", F.when(F.col("x").isNull(), "quote not in its document")))
    start, end = F.col("x.start"), F.col("x.end")
    phrase, anchor = F.trim("effective_date_phrase"), F.trim("effective_date_anchor")
    ok = F.col("reject").isNull()
    rows = rows.withColumn("p", F.when(ok & phrase.isNotNull(), within(phrase))).withColumn("bare", F.when(ok & phrase.isNotNull() & F.col("p").isNull(), F.nullif(F.call_function("instr", F.col("body"), phrase), F.lit(0)) - 1))
    near = F.when(F.col("p").isNotNull(), (F.col("p.start") < end + DATE_WINDOW) & (F.col("p.end") > start - DATE_WINDOW)).when(F.col("bare").isNotNull(), F.abs(F.col("bare") - start) < DATE_WINDOW + end - start)
    far = phrase.isNotNull() & near.isNotNull() & ~near
    one_chunk = F.char_length("body") <= ONE_CHUNK
    lost_anchor = anchor.isNotNull() & ~F.contains(F.col("body"), anchor) & within(anchor).isNull()
    window = F.substring("body", F.greatest(F.lit(0), start - NUMBER_WINDOW) + 1, end + NUMBER_WINDOW - F.greatest(F.lit(0), start - NUMBER_WINDOW))
    rows = rows.withColumns({"around": F.when(ok, tx.numbers_in(window)), "all_numbers": F.when(ok, tx.numbers_in(F.col("body")))})

    def numbers(claimed: Column, source: str, said: str) -> Column:
        bad = F.array_except(claimed, F.col(source))
        return F.when(F.size(bad) > 0, F.concat(F.lit(said), F.array_join(bad, ", ")))

    reasons = [F.when(phrase.isNotNull() & near.isNull(), "date phrase not in the document"), F.when(far & ~one_chunk, "date phrase far from the quote"), F.when(lost_anchor, "date anchor not in the document")]
    reasons += [numbers(tx.numbers_in(F.coalesce(name, F.lit(""))), "around", f"{name}: numbers not near the quote: ") for name in NEAR]
    reasons += [numbers(tx.numbers_in(F.coalesce(name, F.lit(""))), "all_numbers", f"{name}: numbers not in the document: ") for name in ANYWHERE]
    reasons.append(numbers(F.coalesce("predicate_numbers", F.array().cast("array<string>")), "all_numbers", "conditions: numbers not in the document: "))
    same, state = F.col("jurisdiction") == F.col("of_jurisdiction"), F.substring_index("of_jurisdiction", ", ", -1)
    reasons.append(F.when(~same & (F.col("jurisdiction") != state), "jurisdiction is not the document's"))
    notes = [F.when(far & one_chunk, "date phrase far from the quote"), F.when(~same & (F.col("jurisdiction") == state), "state rule from a city's document")]
    found = rows.withColumns({
        "reasons": F.when(ok, F.array_compact(F.array(*reasons))), "notes": F.when(ok, F.array_compact(F.array(*notes))), "lost": F.when(ok & (F.col("x.match") == "tolerant"), 5).when(ok, 0),
        "doc_anchor": F.when(ok & phrase.isNull() & anchor.isNull() & (F.col("status_hint") == "enacted"), chaptering_record(F.col("body"))),
    })
    kept = found.select("candidate_id", "reject", start.alias("start"), end.alias("end"), F.col("x.match").alias("match"), "reasons", "notes", F.col("lost").alias("penalty"), "doc_anchor", "effective_date_phrase", "effective_date_anchor", "status_hint", "level")
    return dated(kept).drop("effective_date_phrase", "effective_date_anchor", "status_hint", "level")


def dated(rows: DataFrame) -> DataFrame:
    """Adds ``day`` and ``method``: by the candidate's own anchor, else by the document's where only that one gives a day."""
    enacted, default = F.col("status_hint") == "enacted", F.col("level") == "state"
    of = lambda anchor: ef.resolve(F.col("effective_date_phrase"), anchor, enacted, default)
    rows = rows.withColumn("_own", F.when(F.col("reject").isNull(), of(F.col("effective_date_anchor"))))
    rows = rows.withColumn("_doc", F.when(F.col("_own.day").isNull() & F.col("doc_anchor").isNotNull(), of(F.col("doc_anchor"))))
    x = F.when(F.col("_doc.day").isNotNull(), F.col("_doc")).otherwise(F.col("_own"))
    return rows.withColumns({"day": x["day"], "method": x["method"]}).drop("_own", "_doc")
