"""An address's page: who governs it, a block a category with the rule to show first, and what failed there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import keyword_score

#: Tiers of the rule to show first; results not named come after, proposals never.
TIER = {"applies": 0, "unknown": 1, "not_yet_effective": 2, "superseded": 9}


def category_score(category: Column, title: Column, body: Column, words: dict[int, tuple[list[str], list[str], list[str]]]) -> Column:
    """How well a rule's own wording answers its category's question; ``words`` are a category's strong, weak and demoting ones."""
    score = F.lit(0)
    for k, (strong, weak, demote) in words.items():
        score = F.when(category == k, keyword_score(title, body, strong, weak, demote)).otherwise(score)
    return score.cast("int")


def headlines(rows: DataFrame, words: dict[int, tuple[list[str], list[str], list[str]]]) -> DataFrame:
    """``(address_id, category, rule_id, result, score, others)``: of each address and category the rule to show first, and how many more there are.

    ``rows(address_id, category, rule_id, level, result, title, body, fields)``, ``fields`` how many of a rule's key value and answer there are. By result, score,
    fields, city before state, then id; partial minima, so no group is sorted.
    """
    shown = rows.where("result <> 'pending'").withColumn("score", category_score(F.col("category"), F.col("title"), F.col("body"), words))
    tier = F.create_map(*[F.lit(x) for pair in TIER.items() for x in pair])[F.col("result")]
    rank = F.struct(tier.alias("a"), (-F.col("score")).alias("b"), (-F.col("fields")).alias("c"), F.when(F.col("level") == "city", 0).otherwise(1).alias("d"), F.col("rule_id").alias("e"))
    best = shown.groupBy("address_id", "category").agg(F.min_by(F.struct("rule_id", "result", "score"), rank).alias("x"), (F.count("*") - 1).alias("others"))
    return best.select("address_id", "category", "x.rule_id", "x.result", "x.score", "others")


def pages(parcels: DataFrame, rows: DataFrame, rules: DataFrame, categories: int, order: tuple[str, ...]) -> DataFrame:
    """``(address_id, stack, blocks, notes)`` of every address.

    ``stack``: its state, then its city and whether that is confirmed. ``blocks``: an array with the rule ids of each category, by result, city before
    state, then id; a category without a rule is empty. ``notes``: rules of its state or city that failed.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("result"))
    sort = F.struct(place.alias("a"), F.when(F.col("level") == "city", 0).otherwise(1).alias("b"), F.col("rule_id").alias("c"))
    held = rows.groupBy("address_id").agg(F.collect_list(F.struct("category", sort.alias("s"))).alias("all"))
    failed = rules.where("hint = 'failed'").groupBy("jurisdiction").agg(F.array_sort(F.collect_list("rule_id")).alias("failed"))
    out = parcels.join(held, "address_id", "left").join(failed.withColumnsRenamed({"jurisdiction": "state", "failed": "of_state"}), "state", "left").join(failed.withColumnsRenamed({"jurisdiction": "city", "failed": "of_city"}), "city", "left")
    none = F.array().cast("array<int>")
    block = lambda k: F.transform(F.array_sort(F.transform(F.filter("all", lambda r: r["category"] == k), lambda r: r["s"])), lambda s: s["c"])
    confirmed = F.when(F.col("confidence") == "low", "city unconfirmed: ").otherwise("city: ")
    return out.select(
        "address_id", F.array_compact(F.array(F.concat(F.lit("state: "), "state"), F.concat(confirmed, "city"))).alias("stack"), F.array(*[F.coalesce(block(k), none) for k in range(categories)]).alias("blocks"),
        F.concat(F.coalesce("of_state", none), F.coalesce("of_city", none)).alias("notes"),
    )
