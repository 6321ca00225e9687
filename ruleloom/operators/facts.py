"""What is known of a building, from text columns of any quality; what is missing; and what a user adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("high", "medium", "low")
#: Facts a user may state, with the least and greatest value taken.
STATED = {"year_built": (1600, 2100), "units": (0, 100_000), "units_min": (0, 100_000), "units_max": (0, 100_000)}


def whole(text: Column) -> Column:
    """A whole number written in any usual way (``7``, ``7.0``, ``1e2``, blanks about it); else null."""
    text = F.trim(text.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(number == F.floor(number), number.try_cast("int"))


def said(text: Column) -> Column:
    """Text without blanks at its ends; a blank one is null."""
    return F.nullif(F.trim(text), F.lit(""))


def normalised(raw: DataFrame) -> DataFrame:
    """``raw`` with typed facts in place of its text columns, and ``missing``, ``city_confirmed`` and ``units_exact``.

    Columns: ``city, confidence, year_built, units, units_min, units_max, units_source, use_description``.
    A units column is held by the range, which it widens. A range upside down
    is unknown, and so is its source. A confidence that isn't known is low; a city counts as
    confirmed at high or medium.  Nothing is guessed, no row is dropped.
    """
    units, low, high = (whole(F.col(c)) for c in ("units", "units_min", "units_max"))
    rows = raw.withColumns({"_u": units, "_l": F.when(units.isNotNull(), F.least(units, low)).otherwise(low), "_h": F.when(units.isNotNull(), F.greatest(units, high)).otherwise(high)})
    bad = F.coalesce(F.col("_l") > F.col("_h"), F.lit(False))
    low, high = F.when(~bad, F.col("_l")), F.when(~bad, F.col("_h"))
    none = low.isNull() & high.isNull()
    source = F.when(~none, F.coalesce(said(F.col("units_source")), F.when(F.col("_u").isNotNull(), "units")))
    level = F.when(said(F.col("confidence")).isin(*LEVELS), said(F.col("confidence"))).otherwise("low")
    out = rows.withColumns({"units_min": low, "units_max": high, "units_source": source, "year_built": whole(F.col("year_built")), "use_description": said(F.col("use_description")), "city": said(F.col("city")), "confidence": level})
    return with_missing(out.drop("units", "_u", "_l", "_h"))


def with_missing(facts: DataFrame) -> DataFrame:
    """Adds ``missing``, ``city_confirmed`` and ``units_exact`` to typed facts."""
    gone = F.array_compact(F.array(F.when(F.col("year_built").isNull(), "year_built"), F.when(F.col("units_min").isNull() & F.col("units_max").isNull(), "units"), F.when(F.col("use_description").isNull(), "use_description")))
    exact = F.when(F.col("units_min") == F.col("units_max"), F.col("units_min"))
    return facts.withColumns({"missing": gone, "city_confirmed": F.col("city").isNotNull() & F.col("confidence").isin("high", "medium"), "units_exact": exact})


def with_stated(facts: DataFrame, stated: DataFrame, key: str) -> DataFrame:
    """Facts with what users state in place of the record's, ``used`` (what was taken) and ``problem`` (why nothing was).

    ``stated(key, year_built, units, units_min, units_max)`` of whole numbers, a row a key at most. A number of units is
    both ends; ends given apart replace both.  A value out of bounds, a range
    upside down, or units beside a range is a problem, and the record stays as it is.
    """
    given = stated.select(key, *[F.col(c).alias(f"_{c}") for c in STATED])
    rows = facts.join(given, key, "left")
    out_of = [F.when(~F.col(f"_{c}").between(a, b), f"{c} out of bounds") for c, (a, b) in STATED.items()]
    ends = F.col("_units_min").isNotNull() | F.col("_units_max").isNotNull()
    problem = F.coalesce(*out_of, F.when(F.col("_units_min") > F.col("_units_max"), "units_min above units_max"), F.when(F.col("_units").isNotNull() & ends, "units and a range"))
    rows = rows.withColumn("problem", problem)
    fine = F.col("problem").isNull()
    some = fine & (F.col("_units").isNotNull() | ends)
    used = F.array_compact(F.array(*[F.when(fine & F.col(f"_{c}").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"_{c}").cast("string"))) for c in STATED]))
    changed = {"units_min": F.when(some, F.coalesce("_units", "_units_min")).otherwise(F.col("units_min")), "units_max": F.when(some, F.coalesce("_units", "_units_max")).otherwise(F.col("units_max")), "units_source": F.when(some, "user_input").otherwise(F.col("units_source")), "year_built": F.when(fine, F.coalesce("_year_built", "year_built")).otherwise(F.col("year_built"))}
    return with_missing(rows.withColumn("used", used).withColumns(changed).drop(*[f"_{c}" for c in STATED]))
