"""What repeats in a table is worked out once, and gives the rows that working it out each time gives."""

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import guards as gd
from ruleloom.plans.catalogue import QUERIES
from ruleloom.sources import readers


def test_a_sentence_of_many_rows_is_read_once(spark):
    said = [("You owe 7 dollars", "5", "tenant", "in_force", "en"), ("You owe 7 dollars", "7", "tenant", "in_force", "en"), (None, None, None, None, None), ("Usted debe 5% en mayo", "5 percent in May", "owner", "pending", "es")]
    rows = spark.createDataFrame([(i, *said[i % 4]) for i in range(12)], "k int, sentence string, quote string, role string, status string, lang string")
    one = gd.check(*map(F.col, ("sentence", "quote", "role", "status", "lang")))
    want = {r.k: r.reasons for r in rows.select("k", one.alias("reasons")).collect()}
    got = gd.checked(rows).collect()
    assert len(got) == 12 and {r.k: r.reasons for r in got} == want and want[2] == ["no_answer"] and want[0] != want[1]
    assert repr(one).count("{N};^]+") == 1


def test_a_text_is_read_once_and_what_is_heard_twice_counts_once(spark):
    from ruleloom.operators import relations as rel

    over, yields = "No city may enact a limit.", "A local ordinance shall govern the amount."
    rows = [(1, "state", 7, None, over, yields, [("No town may enact it.", "2")]), (2, "city", 7, 2, "", None, None), (3, "city", 7, 3, None, None, None), (4, "city", None, 3, None, None, None), (5, "state", None, None, over, None, None)]
    rules = spark.createDataFrame(rows, "rule_id long, level string, state long, city long, interaction string, exemptions string, provenance array<struct<text:string,scope:string>>")
    rules = rules.selectExpr("*", "0 AS category", "false AS failed", "CAST(NULL AS STRING) AS scope")
    found = rel.spoken(rules)
    pairs = sorted((r.source, r.nth, r.kind, r.target) for r in rel.relations(rules).collect())
    assert pairs == [(1, 0, "conflict", 2), (1, 0, "conflict", 3), (1, 1, "conflict", 2)]
    got = {r.rule_id: (r.overrides, r.interaction) for r in rel.linked(rules, found).collect()}
    assert got == {1: ([2, 3], f'unresolved against 2, 3: "{over}"; unresolved against 2: "No town may enact it."'), 2: ([1], "unresolved against 1"), 3: ([1], "unresolved against 1"), 4: ([], None), 5: ([], None)}
    plan = rel.linked(rules, found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("preempt") <= 3 * "".join(rel.wd.any_of(rel.OVERRIDES)).count("preempt")


@pytest.mark.parametrize(("name", "dealt"), [("merge_overlapping_spans", 1), ("contract_checks", 3)])
def test_a_task_has_no_more_rows_in_a_larger_table(spark, sf_dir, monkeypatch, name, dealt):
    want = sorted(QUERIES[name](spark, sf_dir).collect())
    monkeypatch.setattr(readers, "ROWS_A_PART", 250)
    got = QUERIES[name](spark, sf_dir)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == dealt
    assert sorted(got.collect()) == want


def test_addresses_alike_are_looked_up_once(spark, sf_dir):
    from ruleloom.operators import changes as ch
    from ruleloom.sources.views import parcels

    own = parcels(spark, sf_dir)
    twice = own.union(own.withColumn("address_id", F.col("address_id") + 1_000_000))
    one, two = ({(r.state, r.city, r.confidence, r.year_built, r.units_min, r.units_max): (r.address_id, r.n) for r in ch.alike(p).collect()} for p in (own, twice))
    assert two == {k: (at, 2 * n) for k, (at, n) in one.items()} and sum(n for _, n in two.values()) == twice.count()
    tests = spark.createDataFrame([(1, ["CALIFORNIA"]), (2, None)], "test_id int, states array<string>").union(own.groupBy().agg(F.lit(3), F.collect_set("state")))
    assert sorted(ch.scopes(tests, ch.alike(twice)).collect()) == sorted(ch.scopes(tests, twice).collect())
