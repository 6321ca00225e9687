"""Matching records to sources, places, checklists, cached answers and tests; joins by key, with problems as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_street, house_numbers, initials, squashed


def source_problems(rules: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(rule_id, problem)`` of rules whose document is not in the manifest, or stands there under another address.

    ``rules(rule_id, doc_id, url)``, ``manifest(doc_id, url)`` with distinct ids.
    """
    known = manifest.select("doc_id", F.col("url").alias("known"), F.lit(True).alias("there"))
    found = rules.join(known, "doc_id", "left")
    problem = F.when(F.col("there").isNull(), "document not in the manifest").when(~F.col("url").eqNullSafe(F.col("known")), "address differs from the manifest")
    return found.select("rule_id", problem.alias("problem")).where("problem IS NOT NULL")


def in_jurisdiction(jurisdictions: Column, state: Column, city: Column) -> Column:
    """Whether a manifest's list, ``ST; City, ST``, names the state or the city of it."""
    parts = F.transform(F.split(F.coalesce(jurisdictions, F.lit("")), ";"), lambda x: F.trim(x))
    return F.exists(parts, lambda p: (p == state) | (p == F.concat(city, F.lit(", "), state)))


def located(points: DataFrame, places: DataFrame, states: DataFrame) -> DataFrame:
    """Adds ``city``, ``state`` and ``problems`` to ``points(place_geoid, state_geoid, postal_state, ...)`` by two left joins on geographic ids."""
    found = points.join(places.select("place_geoid", "city", F.col("state_geoid").alias("_of")), "place_geoid", "left").join(states.select("state_geoid", "state"), "state_geoid", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("place_geoid").isNotNull() & F.col("city").isNull(), "place not known"), F.when(F.col("state").isNull(), "state not known"),
        F.when(F.col("_of") != F.col("state_geoid"), "place lies in another state"), F.when(F.col("state") != F.col("postal_state"), "postal state differs"),
    ))
    return found.withColumn("problems", problems).drop("_of")


def checklist_found(checklist: DataFrame, rules: DataFrame) -> DataFrame:
    """``(item_id, found)``: whether a rule of the item's jurisdiction and category is from its document or cites what it names.

    ``checklist(item_id, jurisdiction, category, doc_id, citation)``. Documents meet by key; of citations each wording of a
    group is looked for once in each that its rules have, so items that ask the same aren't multiplied by rules.
    """
    group = ["jurisdiction", "category"]
    by_doc = checklist.join(rules.select(*group, "doc_id"), [*group, "doc_id"], "left_semi").select("item_id")
    named = checklist.where("citation IS NOT NULL").withColumn("_asked", F.lower("citation"))
    said = rules.where("citation IS NOT NULL").select(*group, F.lower("citation").alias("_said")).distinct()
    met = named.select(*group, "_asked").distinct().join(said, group).where(F.contains("_said", "_asked")).select(*group, "_asked")
    by_name = named.join(met, [*group, "_asked"], "left_semi").select("item_id")
    found = by_doc.union(by_name).distinct().withColumn("_found", F.lit(True))
    return checklist.select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("_found", F.lit(False)).alias("found"))


def retry_queries(street: Column, unit: Column) -> Column:
    """What to ask in turn, each once: the address, without its unit, cleaned, and with the first house number alone."""
    bare = F.trim(F.regexp_replace(street, r"(?i)\s+(?:#|apt\.?|unit|suite)\s*\S+$", ""))
    first = F.regexp_replace(bare, r"^([0-9]+)\s*(?:-|/|&)\s*[0-9]+", "$1")
    return F.array_distinct(F.array(F.trim(F.concat_ws(" ", street, unit)), bare, clean_street(bare), clean_street(first)))


def number_agrees(asked: Column, matched: Column) -> Column:
    """Whether the house number of a match lies in the range of the one asked for; no number agrees with none."""
    own, other = house_numbers(asked), house_numbers(matched)
    return F.coalesce((other["low"] >= own["low"]) & (other["low"] <= own["high"]), F.lit(False))


def geocoded(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``(address_id, matched, source)``: the batch's match if its house number agrees, else that of the first query with an agreeing cached one.

    ``rows(address_id, street, unit, batch_match)``, ``cache(query, matched)``; an
    address without a number isn't asked about again. Nothing is fetched: what the
    cache doesn't hold is no match.
    """
    sure = number_agrees(F.col("street"), F.col("batch_match"))
    rows = rows.withColumn("sure", F.col("batch_match").isNotNull() & sure)
    open_ = rows.where(~F.col("sure") & house_numbers(F.col("street"))["low"].isNotNull())
    asked = open_.select("address_id", "street", F.posexplode(retry_queries(F.col("street"), F.col("unit"))).alias("nth", "query"))
    hits = asked.join(cache, "query").where(number_agrees(F.col("street"), F.col("matched")))
    best = hits.groupBy("address_id").agg(F.min(F.struct("nth", "matched")).alias("x"))
    found = rows.join(best, "address_id", "left")
    return found.select("address_id", F.when(F.col("sure"), F.col("batch_match")).otherwise(F.col("x.matched")).alias("matched"), F.when(F.col("sure"), "batch").when(F.col("x").isNotNull(), F.concat(F.lit("retry "), F.col("x.nth"))).otherwise("none").alias("source"))


def place_of_prefix(tests: DataFrame, places: DataFrame) -> DataFrame:
    """``(test_id, city)``: the only place whose initials are the test's prefix, or whose name begins with it; null where none or several do.

    ``places(city)`` is a dimension; prefixes are joined to all beginnings of its names, so the join is one by key.
    """
    name = squashed(F.col("city"))
    keys = places.select("city", F.explode(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.char_length(name)), lambda n: F.substring(name, F.lit(1), n)), F.array(initials(F.col("city")))))).alias("prefix"))
    found = tests.select("test_id", F.lower("prefix").alias("prefix")).join(keys, "prefix", "left")
    one = found.groupBy("test_id").agg(F.count_distinct("city").alias("n"), F.min("city").alias("city"))
    return one.select("test_id", F.when(F.col("n") == 1, F.col("city")).alias("city"))


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int, value: str) -> DataFrame:
    """``(*keys, said)``: the first ``n`` values of each group, comma-joined, and how many more there are; a group's rest is only counted."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.select(*keys, value, rank.alias("_k")).where(F.col("_k") <= n).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.col(value).cast("string").alias("v")))), lambda x: x["v"]).alias("_first"))
    many = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    more = F.when(F.col("_n") > n, F.concat(F.lit(" +"), F.col("_n") - n, F.lit(" more"))).otherwise("")
    return many.join(first, keys).select(*keys, F.concat(F.array_join("_first", ", "), more).alias("said"))


def differing(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, before, after)`` of keys whose fingerprints differ or that only one side has."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def inherited_dates(candidates: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Adds ``date`` and ``how``: a candidate's own day, or the only one that its section states elsewhere; with several it stays without, and all are marked as conflicting."""
    known = candidates.where(F.col(day).isNotNull()).groupBy(*keys).agg(F.count_distinct(day).alias("_n"), F.min(day).alias("_day"))
    found = candidates.join(known, keys, "left")
    how = F.when(F.col(day).isNotNull() & (F.col("_n") > 1), "conflicting").when(F.col(day).isNotNull(), "own").when(F.col("_n") == 1, "inherited").otherwise("none")
    return found.withColumn("date", F.when(F.col(day).isNotNull(), F.col(day)).when(F.col("_n") == 1, F.col("_day"))).withColumn("how", how).drop("_n", "_day")


def built_confidence(penalty: Column, reasons: Column, conflict: Column) -> Column:
    """Hundredths: ninety less the date's penalty and five a reason, thirty at least, sixty at most in a conflict."""
    score = F.greatest(F.lit(30), 90 - penalty - 5 * reasons)
    return F.when(conflict, F.least(score, F.lit(60))).otherwise(score).cast("int")


def address_line(street: Column, unit: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """``street unit, city, ST zip``; what is null or blank leaves no sign behind."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = lambda sep, *xs: F.nullif(F.concat_ws(sep, *map(some, xs)), F.lit(""))
    return F.concat_ws(", ", joined(" ", street, unit), some(city), joined(" ", state, zip_code))
