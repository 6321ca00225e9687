"""Three-valued logic over interval facts: 0 false, 1 unknown, 2 true, as an int column that is never null.

With this coding ``all`` is the least of the values, ``any`` the greatest and ``not``
is ``2 - v``, so predicate trees fold with grouped minima and maxima and null
never stands for a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE, UNKNOWN, TRUE = 0, 1, 2


def decided(yes: Column, no: Column) -> Column:
    """True where ``yes``, false where ``no``, else unknown; a null condition doesn't hold."""
    return F.when(yes, TRUE).when(no, FALSE).otherwise(UNKNOWN)


def compare(op: str, low: Column, high: Column, value: Column) -> Column:
    """``op`` holds for all, none or some of the interval; a null bound is open."""
    point = F.coalesce(low == high, F.lit(False))
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    table = {
        ">=": (low >= value, high < value),
        ">": (low > value, high <= value),
        "<=": (high <= value, low > value),
        "<": (high < value, low >= value),
        "==": (point & (low == value), outside),
        "!=": (outside, point & (low == value)),
    }
    if op not in table:
        raise ValueError(f"unknown comparison {op!r}")
    return decided(*table[op])


def compare_year_to_date(op: str, year: Column, cutoff: Column) -> Column:
    """A date of which only the year is known against a day: the same year leaves it open."""
    if op not in ("<", "<=", ">", ">="):
        return F.lit(UNKNOWN)
    before, after = year < F.year(cutoff), year > F.year(cutoff)
    return decided(before, after) if op[0] == "<" else decided(after, before)


def both(*values: Column) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def either(*values: Column) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def negated(value: Column) -> Column:
    return F.lit(2) - value


def named(value: Column) -> Column:
    return F.element_at(F.array(F.lit("false"), F.lit("unknown"), F.lit("true")), value + 1)
