"""Dates as legal texts give them: partial, counted from an event, or relative to the day of the question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of_nth_month_after(day: Column, n: Column | int) -> Column:
    """The first day of the ``n``-th month after the day's own."""
    return F.trunc(F.add_months(day, n), "month").cast("date")


def days_after(day: Column, n: Column | int) -> Column:
    return F.date_add(day, n)


def january_after(day: Column) -> Column:
    return F.make_date(F.year(day) + 1, F.lit(1), F.lit(1))


def years_before(day: Column, n: Column | int) -> Column:
    """The same day ``n`` years before; 29 February becomes the 28th."""
    return F.add_months(day, (F.lit(-12) * n).cast("int"))


def last_day_of_partial(text: Column) -> Column:
    """The last day that ``2026``, ``2026-01`` or ``2026-01-15`` can mean; null for anything else."""
    year = F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-12-31"))))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.last_day(F.try_to_date(F.concat(text, F.lit("-01")))))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text))
    return F.coalesce(year, month, day)


def status_on(hint: Column, effective: Column, as_of: Column) -> Column:
    """What a rule is on a day: pending, failed, in_force or not_yet_effective; without a date it is in force."""
    return F.when(hint == "bill", "pending").when(hint == "failed", "failed").when(effective.isNull(), "in_force").when(effective > as_of, "not_yet_effective").otherwise("in_force")
