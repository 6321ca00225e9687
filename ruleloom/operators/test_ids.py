"""Ids of an organiser's rules matched with ours: place, kind and number of the id, then an equi-join; a reviewed map goes before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import place_of_prefix

ID = r"^([A-Za-z ]+[A-Za-z0-9]*)-([A-Z]+)-(P?[0-9]+)$"


def matched(ids: DataFrame, kinds: DataFrame, states: DataFrame, places: DataFrame, rules: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``(org_id, jurisdiction, level, category, status_class, rule_ids, problem, how, differs)`` of every distinct id.

    ``ids(org_id)``; ``kinds(kind, category)``, ``states(state)``, ``places(city)`` are dimensions; ``rules(rule_id,
    jurisdiction, level, category, status)``; ``reviewed(org_id, rule_ids)`` what somebody
    has looked at. A number with a P is about bills and failed measures, any other
    about enacted rules.  A place is a state by its whole name, else the one city
    that its letters begin or abbreviate.  A reviewed id keeps its rules, and ``differs`` says
    whether the match would give others.
    """
    part = lambda k: F.nullif(F.regexp_extract("org_id", ID, k), F.lit(""))
    rows = ids.select("org_id").distinct().withColumns({"place": part(1), "kind": part(2), "num": part(3)})
    rows = rows.join(kinds.select("kind", "category"), "kind", "left").join(states.select(F.col("state").alias("_state")).distinct(), F.col("place") == F.col("_state"), "left")
    city = place_of_prefix(rows.where("_state IS NULL AND place IS NOT NULL").select(F.col("place").alias("test_id"), F.col("place").alias("prefix")).distinct(), places)
    rows = rows.join(city.withColumnsRenamed({"test_id": "place", "city": "_city"}), "place", "left")
    status = F.when(F.col("num").startswith("P"), "pending_or_failed").when(F.col("num").isNotNull(), "enacted")
    rows = rows.select("org_id", F.coalesce("_state", "_city").alias("jurisdiction"), F.when(F.col("_state").isNotNull(), "state").when(F.col("_city").isNotNull(), "city").alias("level"), "category", status.alias("status_class"), "num", "kind")
    of = rules.select("rule_id", "jurisdiction", "level", "category", F.when(F.col("status").isin("pending", "failed"), "pending_or_failed").otherwise("enacted").alias("status_class"))
    pools = of.groupBy("jurisdiction", "level", "category", "status_class").agg(F.array_sort(F.collect_list("rule_id")).alias("found"))
    rows = rows.join(pools, ["jurisdiction", "level", "category", "status_class"], "left").join(reviewed.select("org_id", F.array_sort("rule_ids").alias("_kept")), "org_id", "left")
    none = F.array().cast("array<int>")
    found = F.coalesce("found", none)
    problem = F.when(F.col("num").isNull(), "no such form of id").when(F.col("category").isNull(), "kind not known").when(F.col("jurisdiction").isNull(), "no place or several").when(F.size(found) == 0, "no such rule")
    kept = F.col("_kept").isNotNull()
    return rows.select("org_id", "jurisdiction", "level", "category", "status_class", F.coalesce("_kept", found).alias("rule_ids"), F.when(~kept, problem).alias("problem"), F.when(kept, "reviewed").otherwise("matched").alias("how"), (kept & (F.col("_kept") != found)).alias("differs"))
