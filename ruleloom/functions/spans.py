"""Where a quote stands in a text: exactly, with other white space, or with other signs; and every place of a needle."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that read as another, signs that are not seen, and the shortest quote.
_typeset, _typed = "‘’‚′`“”„″‐‑‒–—−   　", "'''''\"\"\"\"------    "
_unseen = r"[­​﻿]*"
LEAST = 20
#: Letters that Unicode writes as another single one; their places stay.
_twins = {chr(c): n for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000 and len(n := unicodedata.normalize("NFC", chr(c))) == 1 and n != chr(c) and n < "￿"}
_broken = r"(?:(?<=\p{L})-\n\s*(?=\p{Ll}))?"


def _quoted(x: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.regexp_replace(x, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))


def _stripped(quote: Column) -> Column:
    return F.regexp_replace(quote, r"(?U)^\s+|\s+\z", "")


def _words(quote: Column) -> Column:
    return F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")


def find_span(text: Column, quote: Column) -> Column:
    """``(start, end, match)`` from 0, end exclusive, by the first level that finds the quote; null where none does or the quote has fewer than LEAST characters.

    exact: as it stands. normalized: runs of white space are alike, and so are the two
    ways of writing one letter. tolerant: also typographic signs, unseen signs, blanks
    after a section sign, and words broken by a hyphen at a line's end.
    The pattern of each level is made from the quote and runs over the text itself,
    whose signs are changed one for one, so places need no way back.
    """
    same = lambda c: F.translate(c, "".join(_twins), "".join(_twins.values()))
    fold = lambda c: F.translate(same(c), _typeset, _typed)
    spaced = F.concat(F.lit("(?U)"), F.array_join(F.transform(_words(same(quote)), _quoted), r"\s+"))
    plain = F.regexp_replace(F.regexp_replace(fold(quote), _unseen[:-1], ""), r"(?U)(?<=\p{L})-\n\s*(?=\p{Ll})", "")
    plain = F.regexp_replace(plain, r"(?U)§\s+", "§")
    letters = lambda w: F.filter(F.split(w, ""), lambda c: c != "")
    sign = lambda c: F.when(c == "§", r"§\s*").otherwise(_quoted(c))
    loose = F.concat(F.lit("(?U)"), F.array_join(F.transform(_words(plain), lambda w: F.array_join(F.transform(letters(w), sign), _unseen + _broken + _unseen)), _unseen + r"\s+" + _unseen))
    long = lambda q: F.char_length(F.array_join(_words(q), " ")) >= LEAST

    def at(place: Column, found: Column, match: str) -> Column:
        return F.struct((place - 1).cast("int").alias("start"), (place - 1 + F.char_length(found)).cast("int").alias("end"), F.lit(match).alias("match"))

    by_pattern = lambda t, p, match: at(F.regexp_instr(t, p), F.call_function("regexp_extract", t, p, F.lit(0)), match)
    exact = F.call_function("instr", text, _stripped(quote))
    return F.when((F.char_length(_stripped(quote)) >= LEAST) & text.isNotNull(), (
        F.when(exact > 0, at(exact, _stripped(quote), "exact")).when(long(quote) & (F.regexp_instr(same(text), spaced) > 0), by_pattern(same(text), spaced, "normalized"))
        .when(long(plain) & (F.regexp_instr(fold(text), loose) > 0), by_pattern(fold(text), loose, "tolerant"))
    ))


def occurrences(text: Column, needle: Column) -> Column:
    """Places, from 0 and in order, of a needle that don't overlap; none for an empty needle or text."""
    parts = F.split(F.coalesce(text, F.lit("")), _quoted(needle), F.lit(-1))
    size = F.char_length(needle)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, part: F.struct((s["at"] + F.char_length(part) + size).cast("int").alias("at"), F.concat(s["found"], F.array((s["at"] + F.char_length(part)).cast("int"))).alias("found"))
    return F.when(needle == "", F.array().cast("array<int>")).otherwise(F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["found"]))
