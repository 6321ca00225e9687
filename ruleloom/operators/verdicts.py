"""A lookup's rows with why: what decided them, what nobody checked, how sure they are, and a sentence that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wordings as wd
from ..functions.guards import EVASION
from .relations import label, listed

# Hundredths that a doubt takes off a row's confidence, the least and the most in a conflict.
PENALTIES = {"derived": 10, "presumed": 5, "described": 5, "partly_exempt": 5, "exempt": 10, "city_open": 20, "city_near": 5, "not_compared": 5, "governor_open": 5}
LEAST, IN_CONFLICT, OWN = 10, 60, 90


def decided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``reason``, ``other``, ``by_stricter`` and ``against`` to base results, and puts precedence into ``result``.

    ``rows`` as :func:`.lookup.base_results` gives them, with ``stricter`` for rules that give way only to a
    stricter one.  One window over ``keys`` and category: within it are one parcel's
    rules of a category, however many parcels there are.  A state rule that gives way
    and applies is superseded by the first city rule that surely covers, else unknown
    if one may; where it is itself unknown such a rule is only named.  Rules that
    contradict one another while both may hold are in each other's ``against``.
    """
    group = Window.partitionBy(*keys, "category")
    city, live = F.col("level") == "city", F.col("result").isin("applies", "unknown")
    sure = city & (F.col("result") == "applies") & (F.col("form") > 0)
    rows = rows.withColumn("_sure", F.min(F.when(sure, F.col("rule_id"))).over(group)).withColumn("_maybe", F.min(F.when(city & live & ~sure, F.col("rule_id"))).over(group))
    ids = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("rule_id"))).over(group))
    rows = rows.withColumn("_cities", ids(city & live)).withColumn("_sayers", ids(F.col("conflicts") & live))
    none = F.array().cast("array<int>")
    against = F.when(F.col("conflicts") & live, F.col("_cities")).when(city & live, F.col("_sayers")).otherwise(none)
    gives = F.col("defers") & live
    applies = gives & (F.col("result") == "applies")
    reason = (
        F.when(F.col("result").isin("pending", "not_yet_effective"), "status").when(applies & F.col("_sure").isNotNull(), "superseded").when(applies & F.col("_maybe").isNotNull(), "may_be_superseded")
        .when(city & (F.col("result") == "unknown") & (F.col("confidence") == "low"), "jurisdiction").otherwise("coverage")
    )
    other = F.when(gives, F.coalesce("_sure", "_maybe"))
    rows = rows.withColumns({"reason": reason, "other": other, "against": against})
    result = F.when(F.col("reason") == "superseded", "superseded").when(F.col("reason") == "may_be_superseded", "unknown").otherwise(F.col("result"))
    return rows.withColumn("result", result).withColumn("by_stricter", (F.col("reason") == "superseded") & F.col("stricter")).drop("_sure", "_maybe", "_cities", "_sayers")


def notes() -> Column:
    """What was left unchecked between a row and other rules, in words."""
    id_ = F.col("other").cast("string")
    return F.array_compact(F.array(
        F.when((F.col("reason") == "coverage") & F.col("other").isNotNull(), F.concat(F.lit("whether "), id_, F.lit(" governs instead"))),
        F.when(F.size("against") > 0, F.concat(F.lit("what holds between this rule and "), F.array_join(F.transform("against", lambda x: x.cast("string")), ", "))),
        F.when(F.col("reason") == "may_be_superseded", F.concat(F.lit("whether "), id_, F.lit(" covers the unit"))),
        F.when(F.col("by_stricter"), F.lit("whether the local limit is stricter")),
    ))


def doubts() -> dict[str, Column]:
    """By name, whether a doubt lowers a row's confidence."""
    city = F.col("level") == "city"
    return {
        "derived": F.col("derived"), "presumed": F.col("presumed"), "described": F.col("described"), "partly_exempt": F.col("exempts") & (F.col("form") > 0), "exempt": F.col("exempts") & (F.col("form") == 0),
        "city_open": city & (F.col("confidence") == "low"), "city_near": city & (F.col("confidence") == "medium"), "not_compared": F.col("by_stricter"), "governor_open": F.col("reason") == "may_be_superseded",
    }


def confidence() -> tuple[Column, Column]:
    """Hundredths, and the reasons: the rule's own, each doubt with what it costs, and the cap of a conflict."""
    own, holds = F.coalesce("own_cents", F.lit(OWN)), doubts()
    left = F.greatest(own - sum((F.when(holds[d], cost).otherwise(0) for d, cost in PENALTIES.items()), F.lit(0)), F.lit(LEAST))
    capped = (F.size("against") > 0) & (left > IN_CONFLICT)
    why = [F.concat(F.lit("own "), own.cast("string")), *[F.when(holds[d], f"-{cost} {d}") for d, cost in PENALTIES.items()], F.when(capped, f"at most {IN_CONFLICT} in a conflict")]
    return F.when(capped, IN_CONFLICT).otherwise(left).cast("int"), F.array_compact(F.array(*why))


def unchecked() -> Column:
    """What the row's facts leave open, in a fixed order."""
    facts = F.when(F.size("presumed_facts") > 0, F.concat(F.lit("exemptions that turn on "), listed(F.transform("presumed_facts", label))))
    return F.array_compact(F.array(
        facts,
        F.when(F.col("exempts") & F.col("result").isin("applies", "superseded", "unknown"), F.when(facts.isNotNull(), "its other exemptions").otherwise("its exemptions")),
        F.when(F.col("by_stricter"), "which limit is stricter"),
        F.when((F.col("confidence") == "low") & F.col("city").isNotNull() & (F.col("reason") != "jurisdiction"), "the city the law counts"),
        F.when(F.col("city").isNull(), "rules of a city"),
    ))


def explained(citation: Column, other: Column, first_against: Column) -> Column:
    """A sentence on what was decided, one on what was not checked, one on what is under review.

    ``citation``, ``other`` and ``first_against`` are how the row's rule, the rule it may give way to and
    the first it contradicts are cited.  A number that none of them or the place has, or wording that helps
    to evade, lets only the bare result stand.
    """
    head = F.concat(citation, F.lit(", "), F.col("jurisdiction"))
    names = lambda facts: listed(F.transform(facts, label))
    open_ = F.when((F.size("missing") > 0) & F.col("uncovered"), F.concat(F.lit("; its reach here turns on "), names(F.col("missing")))).otherwise("")
    waits = F.when(F.size("missing") > 0, names(F.col("missing"))).otherwise("facts of its coverage")
    used = F.when(F.col("derived"), F.transform("used", lambda x: F.when(x == "year_built", "year built, taken for the day of the certificate").otherwise(label(x)))).otherwise(F.transform("used", label))
    main = (
        F.when(F.col("result") == "pending", F.concat(F.lit(" is proposed and not law on that day"), open_)).when(F.col("result") == "not_yet_effective", F.concat(F.lit(" is enacted and not in effect on that day"), open_))
        .when(F.col("reason") == "superseded", F.concat(F.lit(" reaches this building and gives way to "), F.when(F.col("by_stricter"), "the stricter ").otherwise(""), other)).when(F.col("reason") == "jurisdiction", " may apply once the city that counts in law is known")
        .when(F.col("reason") == "may_be_superseded", F.concat(F.lit(" reaches this building unless "), other, F.lit(" does, which is open"))).when(F.col("result") == "unknown", F.concat(F.lit(" may apply; not known: "), waits))
        .when(F.col("form") == 0, " applies, with no condition to test").when(F.size("used") == 0, " applies, its conditions being met").otherwise(F.concat(F.lit(" applies by "), listed(used)))
    )
    left = F.when(F.size("unchecked") > 0, F.concat(F.lit(" Not checked: "), F.array_join("unchecked", ", "), F.lit("."))).otherwise("")
    review = F.when(F.size("against") > 0, F.concat(F.lit(" Under review: it may contradict "), first_against, F.when(F.size("against") > 1, " and others").otherwise(""), F.lit("."))).when(F.col("disputed"), " Under review: its sources differ.").otherwise("")
    text, known = F.concat(head, main, F.lit("."), left, review), F.concat_ws(" ", citation, "jurisdiction", other, first_against)
    sound = F.forall(F.regexp_extract_all(text, F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0)), lambda n: F.contains(known, n)) & ~wd.says(wd.spelled(text), EVASION["en"])
    return F.when(sound, text).otherwise(F.concat(head, F.lit(": "), F.translate("result", "_", " "), F.lit(".")))
