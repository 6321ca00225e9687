"""The domain's entities as views over the supplied tables: parcels are customers, rules come from regions and nations.

All values are integer arithmetic on keys, so any engine computes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

AS_OF = "2026-10-01"
CATEGORIES = ("rent", "eviction", "deposit", "fees", "notice", "registry")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(nationkey, city, state)``: as many rows as there are nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("city"), F.col("r_name").alias("state"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    units = (1 + key % 6).cast("int")
    return table(spark, sf_dir, "customer").join(places(spark, sf_dir), F.col("c_nationkey") == F.col("nationkey")).select(
        key.alias("address_id"),
        "state",
        F.when(key % 11 != 0, F.col("city")).alias("city"),
        F.when(key % 3 == 0, "low").when(key % 3 == 1, "medium").otherwise("high").alias("confidence"),
        F.when(key % 5 != 0, (1950 + (key * 7) % 75).cast("int")).alias("year_built"),
        F.when(key % 7 != 0, units).alias("units_min"),
        F.when(key % 7 != 1, units + F.when(key % 4 == 0, 3).otherwise(0)).alias("units_max"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rules a state and three a city; their number grows with places alone."""
    region = table(spark, sf_dir, "region")
    state = region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("state"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    state = state.select((F.col("key") * 6 + F.col("k")).cast("int").alias("rule_id"), F.lit("state").alias("level"), F.col("state").alias("jurisdiction"), "state", F.col("k").cast("int").alias("category"))
    city = places(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    city = city.select((1000 + F.col("nationkey") * 3 + F.col("k")).cast("int"), F.lit("city"), "city", "state", ((F.col("nationkey") + F.col("k")) % 6).cast("int"))
    r = F.col("rule_id")
    return state.union(city).select(
        "*",
        (r % 5).alias("form"),
        (2 + r % 4).alias("min_units"),
        (1950 + (r * 13) % 60).alias("year"),
        (5 + r % 20).alias("years"),
        F.when(r % 9 == 7, "bill").when(r % 9 == 8, "failed").otherwise("enacted").alias("hint"),
        F.when(r % 4 != 3, F.date_add(F.lit("2023-01-01").cast("date"), (r * 61) % 1800)).alias("effective"),
        ((F.col("level") == "state") & (r % 3 == 0)).alias("defers"),
        ((F.col("level") == "state") & (r % 5 == 2)).alias("conflicts"),
    )


def category_name(category: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), category + 1)


#: The same views for an SQL engine that has the tables; begins a WITH clause.
SQL_VIEWS = """WITH places AS (SELECT n_nationkey AS nationkey, n_name AS city, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
parcels AS (SELECT c_custkey AS address_id, state, CASE WHEN c_custkey % 11 <> 0 THEN city END AS city,
    CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN c_custkey % 5 <> 0 THEN CAST(1950 + (c_custkey * 7) % 75 AS INTEGER) END AS year_built,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST(1 + c_custkey % 6 AS INTEGER) END AS units_min,
    CASE WHEN c_custkey % 7 <> 1 THEN CAST(1 + c_custkey % 6 + CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS INTEGER) END AS units_max
    FROM customer JOIN places ON c_nationkey = nationkey),
rule_keys AS (SELECT CAST(r_regionkey * 6 + k AS INTEGER) AS rule_id, 'state' AS level, r_name AS jurisdiction, r_name AS state, CAST(k AS INTEGER) AS category FROM region, range(6) t(k)
    UNION ALL SELECT CAST(1000 + nationkey * 3 + k AS INTEGER), 'city', city, state, CAST((nationkey + k) % 6 AS INTEGER) FROM places, range(3) t(k)),
rules AS (SELECT *, rule_id % 5 AS form, 2 + rule_id % 4 AS min_units, 1950 + (rule_id * 13) % 60 AS year, 5 + rule_id % 20 AS years,
    CASE WHEN rule_id % 9 = 7 THEN 'bill' WHEN rule_id % 9 = 8 THEN 'failed' ELSE 'enacted' END AS hint,
    CASE WHEN rule_id % 4 <> 3 THEN DATE '2023-01-01' + CAST((rule_id * 61) % 1800 AS INTEGER) END AS effective,
    level = 'state' AND rule_id % 3 = 0 AS defers, level = 'state' AND rule_id % 5 = 2 AS conflicts FROM rule_keys),
pairs AS (SELECT p.*, r.* EXCLUDE (state) FROM parcels p JOIN rules r ON r.level = 'state' AND r.jurisdiction = p.state
    UNION ALL SELECT p.*, r.* EXCLUDE (state) FROM parcels p JOIN rules r ON r.level = 'city' AND r.jurisdiction = p.city)
"""
