"""Dates and quotes as texts put them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_months = "|".join(MONTHS)
LONG = rf"(?i)\b(?:{_months})\s+[0-9]{{1,2}},\s+[0-9]{{4}}\b"
ISO = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
NUMERIC = r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b"


def _month(word: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(word))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def dates_in(text: Column) -> Column:
    """Distinct full dates of a text, in order of day; a form takes what it matches away from the forms after it."""
    part = lambda x, p, g=1: F.regexp_extract(x, p, g)
    long = F.transform(F.regexp_extract_all(text, F.lit(LONG), 0), lambda x: _iso(part(x, "([0-9]{4})$"), _month(part(x, "^([A-Za-z]+)")), part(x, r"\s([0-9]{1,2}),")))
    rest = F.regexp_replace(text, LONG, " ")
    iso = F.transform(F.regexp_extract_all(rest, F.lit(ISO), 0), lambda x: F.try_to_date(x))
    rest = F.regexp_replace(rest, ISO, " ")
    numeric = F.transform(F.regexp_extract_all(rest, F.lit(NUMERIC), 0), lambda x: _iso(part(x, "([0-9]{4})$"), part(x, "^([0-9]+)/"), part(x, "/([0-9]+)/")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(long, iso, numeric))))


def single_date(text: Column) -> Column:
    """The date of a text that states one only."""
    found = dates_in(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def resolve(phrase: Column, anchor: Column) -> Column:
    """``(day, method)`` of an effective-date phrase: counted months, counted days, at once, stated, or not stated."""
    lower = F.lower(phrase)
    months = F.nullif(F.regexp_extract(lower, r"first day of the ([0-9]+)(?:st|nd|rd|th) month", 1), F.lit("")).cast("int")
    days = F.nullif(F.regexp_extract(lower, r"([0-9]+)(?:st|nd|rd|th)? days? after", 1), F.lit("")).cast("int")
    stated = single_date(phrase)
    as_ = lambda day, method: F.struct(day.cast("date").alias("day"), F.lit(method).alias("method"))
    return (
        F.when(months.isNotNull() & anchor.isNotNull(), as_(F.trunc(F.add_months(anchor, months), "month"), "nth_month"))
        .when(days.isNotNull() & anchor.isNotNull(), as_(F.date_add(anchor, days), "days_after"))
        .when(lower.contains("immediately") & anchor.isNotNull(), as_(anchor, "immediately"))
        .when(stated.isNotNull(), as_(stated, "explicit"))
        .otherwise(as_(F.lit(None), "not_stated"))
    )


def folded(text: Column) -> Column:
    """Typographic quotes, dashes and spaces as plain ones, character for character, so places stay."""
    return F.translate(text, "‘’“”–— ", "''\"\"-- ")


def find_normalised(text: Column, quote: Column) -> Column:
    """First place (from 0) of a quote whose white space may differ; null where it doesn't occur.

    The pattern runs over the text itself, so the place needs no mapping back.
    """
    words = F.filter(F.split(F.trim(folded(quote)), r"\s+"), lambda w: w != "")
    pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    at = F.regexp_instr(folded(text), pattern)
    return F.when((F.size(words) > 0) & (at > 0), at - 1)
