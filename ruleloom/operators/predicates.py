"""Predicate trees over parcel facts, with presumption of what can't be known.

Five forms of tree occur in the rules: none; all(units, year); any(units, not year);
all(units, not owner-occupied), where nobody records the owner, so a second, lenient
pass presumes the negation; and a building's age in years before the day asked about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import tristate as tri


def _units() -> Column:
    return tri.compare(">=", F.col("units_min"), F.col("units_max"), F.col("min_units"))


def _year(op: str) -> Column:
    return tri.compare(op, F.col("year_built"), F.col("year_built"), F.col("year"))


def _age(as_of: Column) -> Column:
    return tri.compare_year_to_date("<", F.col("year_built"), dates.years_before(as_of, F.col("years")))


def coverage(as_of: Column) -> tuple[Column, Column]:
    """Strict and lenient value of a rule's tree for a parcel, compiled to one expression each."""
    unknown = F.lit(tri.UNKNOWN)
    shared = F.when(F.col("form") == 0, tri.TRUE).when(F.col("form") == 1, tri.both(_units(), _year("<"))).when(F.col("form") == 2, tri.either(_units(), tri.negated(_year(">=")))).when(F.col("form") == 4, _age(as_of))
    return F.coalesce(shared, tri.both(_units(), unknown)), F.coalesce(shared, _units())


def outcome(strict: Column, lenient: Column) -> tuple[Column, Column]:
    """The value, and whether it rests on a presumption: a lenient truth lifts an unknown, a lenient falsehood drops nothing."""
    presumed = (strict == tri.UNKNOWN) & (lenient == tri.TRUE)
    return F.when(presumed, tri.TRUE).otherwise(strict), presumed


def missing_facts(strict: Column) -> Column:
    """The facts that an unknown value waits for, in order of the tree."""
    units = F.when((F.col("form").isin(1, 2, 3)) & (_units() == tri.UNKNOWN), "units")
    year = F.when((F.col("form").isin(1, 2, 4)) & F.col("year_built").isNull(), "year_built")
    owner = F.when(F.col("form") == 3, "owner_occupied")
    return F.when(strict == tri.UNKNOWN, F.array_compact(F.array(units, year, owner))).otherwise(F.array().cast("array<string>"))


def fold(leaves: DataFrame, nodes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """``(*keys, value)``: trees held as data, folded from the leaves up by grouped minima and maxima.

    ``leaves(*keys, tree, node, value)`` are evaluated leaves; ``nodes(tree, node, parent,
    depth, kind)`` the inner nodes, ``kind`` one of all, any, not, and a root's parent
    null.  ``nodes`` is a dimension of the rules' size.  The plan has one level for each
    of ``depth``, known to the caller.
    """
    inner = nodes.where("kind <> 'leaf'").select("tree", F.col("node").alias("up"), F.col("parent").alias("up_parent"), "kind", F.col("depth").alias("up_depth"))
    parent = nodes.select("tree", "node", "parent")
    values = leaves.join(parent, ["tree", "node"]).select(*keys, "tree", "node", "parent", "value")
    done = values.where("parent IS NULL")
    for level in range(depth, -1, -1):
        here = values.where("parent IS NOT NULL").join(inner.where(F.col("up_depth") == level), (values["tree"] == inner["tree"]) & (values["parent"] == inner["up"])).select(*keys, values["tree"], "up", "up_parent", "kind", "value")
        folded = here.groupBy(*keys, "tree", "up", "up_parent", "kind").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        folded = folded.select(*keys, "tree", F.col("up").alias("node"), F.col("up_parent").alias("parent"), F.when(F.col("kind") == "all", F.col("low")).when(F.col("kind") == "any", F.col("high")).otherwise(2 - F.col("low")).alias("value"))
        rest = values.join(inner.where(F.col("up_depth") == level).select(F.col("tree").alias("t"), F.col("up").alias("n")), (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left_anti")
        values = rest.unionByName(folded)
        done = values.where("parent IS NULL")
    return done.select(*keys, "value")
