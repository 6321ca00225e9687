"""A geocoder's answers for an address folded to one decision: its point, city and how sure they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_points(candidates: DataFrame) -> DataFrame:
    """``(lon, lat)`` that a geography has to be asked for, each once, as written."""
    return candidates.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct()


def decided(addresses: DataFrame, candidates: DataFrame, geographies: DataFrame, cities: DataFrame) -> DataFrame:
    """``(address_id, city, lon, lat, confidence, source, reasons)`` of every address.

    ``addresses(address_id, postal_city, state, zip)``; ``candidates(address_id, nth, source, exact, matched, lon,
    lat)``, a geocoder's short list; ``geographies(lon, lat, city, state, problems array)`` a row a point;
    ``cities(city)`` those with rules, as ``City, ST``.

    No candidate: the postal city, if it has rules, at low confidence. Several in
    different cities: low, and no point. Else the first candidate in the address's ZIP, or the first: high
    where the batch found it exactly, medium otherwise. A state that isn't the
    address's takes the city away and leaves low; problems of the geography, or a postal
    city with rules that is another one, leave medium at most.  A candidate whose
    point has no geography is in no city.
    """
    known = cities.select(F.col("city").alias("_known")).distinct()
    rows = addresses.withColumn("_postal", F.concat(F.trim("postal_city"), F.lit(", "), F.trim("state")))
    rows = rows.join(known, F.col("_postal") == F.col("_known"), "left")
    place = geographies.select("lon", "lat", "city", F.col("state").alias("found_state"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))
    each = candidates.join(place, ["lon", "lat"], "left")
    list_ = each.groupBy("address_id").agg(F.array_sort(F.collect_list(F.struct("nth", "source", "exact", "matched", "lon", "lat", "city", "found_state", "problems"))).alias("all"))
    rows = rows.join(list_, "address_id", "left")
    n = F.coalesce(F.size("all"), F.lit(0))
    several = F.size(F.array_distinct(F.transform("all", lambda c: F.coalesce(c["city"], F.lit(""))))) > 1
    in_zip = F.filter("all", lambda c: (F.trim("zip") != "") & (F.regexp_extract(c["matched"], r"([0-9]{5})\s*$", 1) == F.trim("zip")))
    rows = rows.withColumn("x", F.when((n > 0) & ~several, F.coalesce(F.get(in_zip, F.lit(0)), F.get("all", F.lit(0)))))
    chosen, first = F.col("x").isNotNull(), F.get("all", F.lit(0))
    other_state = chosen & ~F.col("x.found_state").eqNullSafe(F.trim("state"))
    odd = F.coalesce(F.size("x.problems"), F.lit(0)) > 0
    other_city = chosen & ~other_state & F.col("x.city").isNotNull() & F.col("_known").isNotNull() & (F.col("_postal") != F.col("x.city"))
    exact = (first["source"] == "batch") & F.coalesce(F.col("x.exact"), F.lit(False))
    confidence = F.when((n <= 0) | several | other_state, "low").when(odd | other_city, "medium").when(exact, "high").otherwise("medium")
    city = F.when(n <= 0, F.col("_known")).when(~other_state, F.col("x.city"))
    reasons = F.array_compact(F.concat(
        F.array(F.when(n <= 0, F.when(F.col("_known").isNotNull(), "no match: postal city, unverified").otherwise("no match: postal city has no rules")), F.when((n > 0) & several, "matches in different cities"), F.when(other_state, "another state")),
        F.coalesce("x.problems", F.array().cast("array<string>")), F.array(F.when(other_city, "postal city is another one")),
    ))
    return rows.select("address_id", city.alias("city"), F.col("x.lon").alias("lon"), F.col("x.lat").alias("lat"), confidence.alias("confidence"), F.when(n <= 0, "postal").otherwise(first["source"]).alias("source"), reasons.alias("reasons"))
