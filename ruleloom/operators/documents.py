"""Documents as they come: bytes checked, headers read, batches of answers parsed, change tests told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.effective import anchor_day

# The corpus format and its limits.
MOST_BYTES, LEAST_BODY = 5_000_000, 20
HEADER = r"(?s)\ASOURCE: ([^\n]*)\nRETRIEVED: ([^\n]*)\n\n"


def header(text: Column) -> Column:
    """``(url, retrieved, body_offset)`` of a text that begins with the two lines and a blank one; nulls where it doesn't."""
    part = lambda k: F.regexp_extract(text, HEADER, k)
    return F.when(text.rlike(HEADER), F.struct(part(1).alias("url"), part(2).alias("retrieved"), F.char_length(part(0)).alias("body_offset")))


def document_problem(content: Column) -> Column:
    """The first reason for which bytes are no document of the corpus; null if there is none."""
    text = content.cast("string")
    utf8 = F.is_valid_utf8(text)
    head = header(F.when(utf8, text))
    minute = F.to_timestamp(F.when(F.try_to_timestamp(F.substring(head["retrieved"], 1, 16), F.lit("yyyy-MM-dd HH:mm")).isNotNull(), F.substring(head["retrieved"], 1, 16)), "yyyy-MM-dd HH:mm")
    body = F.regexp_replace(F.substring(text, head["body_offset"] + 1, F.char_length(text)), r"(?U)^\s+|\s+\z", "")
    return (
        F.when(content.isNull(), "file not found").when(F.octet_length(content) == 0, "empty file").when(F.octet_length(content) > MOST_BYTES, "file too large").when(F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF")), "byte order mark")
        .when(~utf8, "not UTF-8").when(F.contains(text, F.lit("\r")), "CR line endings").when(head.isNull(), "no header").when(~head["url"].rlike(r"^https?://\S+$"), "source is no address")
        .when(~head["retrieved"].rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2} UTC$"), "retrieval time not as agreed").when(minute.isNull(), "no such retrieval time").when(F.char_length(body) < LEAST_BODY, "no text after the header")
    )


def parsed_batch(rows: DataFrame, text_col: str, schema: str) -> DataFrame:
    """The CSV lines in a column, a row each: short ones padded with nulls, long ones cut, blank ones dropped; other columns stay."""
    lines = rows.withColumn("_line", F.explode(F.split(text_col, r"\r?\n"))).where(F.trim("_line") != "")
    return lines.withColumn("_x", F.from_csv("_line", F.lit(schema), {"mode": "PERMISSIVE"})).select(*[c for c in rows.columns if c != text_col], "_x.*")


def chaptering_record(text: Column) -> Column:
    """The line that records chaptering, if the text has exactly one such line with a date; equal lines are one."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?i)^[ \t]*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}[ \t]*-[ \t]*chaptered\b")), lambda x: F.trim(x)))
    dated = F.filter(lines, lambda x: anchor_day(x).isNotNull())
    return F.when(F.size(dated) == 1, F.element_at(dated, 1))


def change_kind(kind: Column, after: Column, default_day: Column) -> Column:
    """What a change test is about: a law that failed, is pending, comes into force after the default day, or was enacted."""
    later = F.coalesce((kind == "as_of") & (after > default_day), F.lit(False))
    return F.when(kind == "negative", "failed").when(kind == "pending", "pending").when(later, "not_yet_effective").otherwise("enacted")


def in_scope(states: Column, state: Column) -> Column:
    """Whether a state is among a test's; a test without any is about all."""
    return states.isNull() | F.array_contains(states, state)
