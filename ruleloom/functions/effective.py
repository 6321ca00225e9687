"""Effective dates as laws state them: every date of a text with its place, and the day a phrase means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phrases import MONTHS

# Spelled ordinals and numbers, and the words around a date.
ORDINALS = {w: i for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split(), 1)} | {"eighteenth": 18, "twenty-fourth": 24}
DAY_ORDINALS = {"tenth": 10, "fifteenth": 15, "twentieth": 20, "thirtieth": 30, "forty-fifth": 45, "sixtieth": 60, "ninetieth": 90}
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"fifteen": 15, "twenty": 20, "thirty": 30, "forty-five": 45, "sixty": 60, "ninety": 90, "one hundred eighty": 180}
START = r"(?i)\b(?:effect|effective|operative|enforce\w*|takes?|went|begin\w*|commenc\w*)\b"
END = r"(?i)\b(?:until|repealed|expires?|sunset|inoperative|through)\b"
#: Months by their first three letters; the way each may be written.
_short = [m[:3] for m in MONTHS]
_month = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + r"|sept)\.?"
DATE = rf"(?i)\b{_month}\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}|\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b|\b[0-9]{{1,2}}([/-])[0-9]{{1,2}}\1(?:[0-9]{{4}}|[0-9]{{2}})\b|\b{_month},?\s+[0-9]{{4}}\b"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once in the row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _one(found: Column) -> Column:
    """A date as it is written, as ``yyyy-mm-dd`` or ``yyyy-mm``; null where there is no such day."""
    numbers = F.regexp_extract_all(found, F.lit("[0-9]+"), 0)
    month = F.lpad(F.array_position(F.array(*map(F.lit, _short)), F.lower(F.substring(found, 1, 3))).cast("string"), 2, "0")
    full = lambda y, m, d: F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), "yyyy-MM-dd")
    at = lambda k: F.get(numbers, F.lit(k))
    year = F.when(F.char_length(at(2)) == 2, F.concat(F.lit("20"), at(2))).otherwise(at(2))
    return F.when(found.rlike("^[0-9]{4}-"), full(at(0), at(1), at(2))).when(found.rlike("^[0-9]"), full(year, at(0), at(1))).when(F.size(numbers) == 2, full(at(1), month, at(0))).otherwise(F.concat_ws("-", at(0), month))


def dates_with_places(text: Column) -> Column:
    """``(start, end, day)`` of every date of a text in order; a month without its day is ``yyyy-mm``; days that don't exist are none."""
    none = F.array().cast("array<struct<start:int,end:int,day:string>>")

    def read(text: Column) -> Column:
        found, between = F.regexp_extract_all(text, F.lit(DATE), 0), F.split(text, DATE, -1)
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), none.alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + F.char_length(F.element_at(between, s["k"] + 1))
            return F.struct((at + F.char_length(x)).alias("at"), (s["k"] + 1).alias("k"), F.concat(s["out"], F.array(F.struct(at.alias("start"), (at + F.char_length(x)).alias("end"), _one(x).alias("day")))).alias("out"))

        return F.filter(F.aggregate(found, start, step, lambda s: s["out"]), lambda d: d["day"].isNotNull())

    # one cheap look first: most phrases hold no date
    return F.when(text.rlike("[0-9]{4}|[0-9][/-][0-9]"), _let(text, read)).otherwise(none)


def anchor_day(text: Column) -> Column:
    """The full date of a text that states one only."""
    return _let(dates_with_places(text), _only_day)


def _only_day(found: Column) -> Column:
    days = F.array_distinct(F.filter(F.transform(found, lambda d: d["day"]), lambda x: F.char_length(x) == 10))
    return F.when(F.size(days) == 1, F.get(days, F.lit(0)).cast("date"))


def _numbered(word: Column, words: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.nullif(F.regexp_extract(word, r"^([0-9]{1,3})", 1), F.lit("")).cast("int"), known[word])


def _choice(words: dict[str, int]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def resolve(phrase: Column, anchor: Column, enacted: Column, default_to_january: Column) -> Column:
    """``(day, method, penalty)``: what an effective-date phrase and the text it counts from come to.

    In this order: the first day of a counted month, a counted day, at once; one date;
    two dates as a range, whose first counts; the one of several that a start word
    introduces; else unresolved. Without a phrase January 1 after the anchor where
    that is the default, else not stated. What counts from an anchor without a day
    is unresolved. Penalties are in hundredths.

    The phrase's and the anchor's dates are read once a row each and handed on by name.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(phrase, F.lit("")), r"\s+", " "))
    seen = F.struct(flat.alias("phrase"), dates_with_places(flat).alias("found"), anchor_day(F.coalesce(anchor, F.lit(""))).alias("base"))
    return _let(seen, lambda x: _resolved(x, anchor, enacted, default_to_january))


def _resolved(x: Column, anchor: Column, enacted: Column, default_to_january: Column) -> Column:
    phrase, found, base = x["phrase"], x["found"], x["base"]
    lower = F.lower(phrase)
    out = lambda day, method, penalty=0: F.struct(day.cast("string").alias("day"), F.lit(method).alias("method"), F.lit(penalty).alias("penalty"))
    unresolved = out(F.lit(None), "unresolved")
    counted_month = rf"first day of the ([0-9]{{1,2}}(?:st|nd|rd|th)|{_choice(ORDINALS)}) (?:calendar )?month"
    counted_day = rf"\b([0-9]{{1,3}}(?:st|nd|rd|th)|{_choice(DAY_ORDINALS)}) day (?:from and after|after|following)"
    counted_days = rf"\b([0-9]{{1,3}}|{_choice(NUMBERS)}) ?(?:\([0-9]+\) ?)?(?:calendar )?days? (?:after|following|from)"
    counted = lambda pattern, words: _numbered(F.regexp_extract(lower, pattern, 1), words)
    n_days = F.coalesce(F.when(lower.rlike(counted_day), counted(counted_day, DAY_ORDINALS)), F.when(lower.rlike(counted_days), counted(counted_days, NUMBERS)))
    from_base = lambda n, day, method: F.when(base.isNotNull() & n.isNotNull(), out(day, method)).otherwise(unresolved)
    none = F.size(found) == 0
    first, last = F.get(found, F.lit(0)), F.element_at(found, -1)

    def dated() -> Column:
        days = F.array_distinct(F.transform(found, lambda d: d["day"]))
        between = F.substring(phrase, first["end"] + 1, last["start"] - first["end"])
        is_range = (F.size(found) == 2) & between.rlike(r"(?i)^\s*(?:,?\s*(?:to|through|thru|until)|[-–—])\s*$") & (first["day"] < last["day"])
        before = lambda d, n: F.substring(phrase, F.greatest(d["start"] - n, F.lit(0)) + 1, F.least(d["start"], F.lit(n)))
        starts = F.array_distinct(F.transform(F.filter(found, lambda d: before(d, 80).rlike(START) & ~before(d, 30).rlike(END)), lambda d: d["day"]))
        several = _let(starts, lambda s: F.when(F.size(s) == 1, out(F.get(s, F.lit(0)), "explicit", 5)).otherwise(unresolved))
        return F.when(F.size(days) == 1, out(F.get(days, F.lit(0)), "explicit")).when(is_range, out(first["day"], "range_start")).otherwise(several)

    said = (
        F.when(lower.contains("first day of the") & lower.rlike(counted_month), _let(counted(counted_month, ORDINALS), lambda n: from_base(n, F.trunc(F.add_months(base, n), "month"), "nth_month")))
        .when(none & lower.contains("day") & (lower.rlike(counted_day) | lower.rlike(counted_days)), _let(n_days, lambda n: from_base(n, F.date_add(base, n), "days_after")))
        .when(none & lower.rlike(r"\b(?:takes?|shall take|to take) effect immediately|\beffective immediately"), from_base(F.lit(0), base, "immediately")).when(none, unresolved).otherwise(dated())
    )
    january = F.coalesce(enacted & default_to_january & F.lower(anchor).rlike(r"\bchaptered\b") & base.isNotNull(), F.lit(False))
    unsaid = F.when(january, out(F.make_date(F.year(base) + 1, F.lit(1), F.lit(1)), "january_default", 20)).otherwise(F.when(F.coalesce(enacted, F.lit(False)), out(F.lit(None), "not_stated", 10)).otherwise(out(F.lit(None), "not_stated")))
    return F.when(phrase != "", said).otherwise(unsaid)
