"""Operators over records: odd values, empty tables, and cases one by one."""

import math

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import units as un
from ruleloom.operators import candidates as cd
from ruleloom.operators import changes as ch
from ruleloom.operators import contracts as ct
from ruleloom.operators import facts as fc
from ruleloom.operators import gold as gd
from ruleloom.operators import sphere as sp
from ruleloom.operators import stable_ids as si


def test_every_kind_of_unit_parser(spark):
    cases = {
        ("CA", "Flats 5 to 14 units"): (5, 14), ("CA", "Five or more apartments"): (5, None), ("CA", "Alameda use code (5+ units)"): (5, None), ("CA", "TIC Bldg 4 units or less"): (None, 4), ("MA", "MXD >8-UNIT-APT"): (9, None),
        ("NJ", "3B-7U/4B-24U-G"): (31, 31), ("NJ", "4 1/2B-10U-BA"): (10, 10), ("NJ", "3SB2UG"): (None, None), ("NJ", "5B-1OU"): (None, None), ("MA", "LUXURY APARTMENT"): (None, None), ("MA", "Flats 5 to 14 units"): (None, None),
        ("CA", None): (None, None), (None, "APT 7-30 UNITS"): (None, None), ("MA", "APT 30-7 UNITS"): (None, None), ("CA", "Apartment 99999999999 units or more"): (None, None),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, state string, text string")
    got = {r.i: (r.x.low, r.x.high) for r in df.select("i", un.described(F.col("text"), F.col("state"), un.parsers()).alias("x")).collect()}
    assert got == dict(enumerate(cases.values()))
    with pytest.raises(ValueError, match="there already"):
        un.parsers('[{"id": "a", "kind": "none", "pattern": "x"}, {"id": "a", "kind": "none", "pattern": "y"}]')
    with pytest.raises(ValueError, match="unknown kind"):
        un.parsers('[{"id": "a", "kind": "odd", "pattern": "x"}]')


def test_the_hull_keeps_an_open_end(spark):
    df = spark.createDataFrame([("3", "(5+ units)"), ("x", "(5+ units)"), ("", "(5+ units)"), ("7", "(5+ units)"), ("-1", ""), (None, None)], "units string, text string")
    rows = df.select(un.resolved(F.col("units"), un.described(F.col("text"), F.lit("CA"), un.parsers())).alias("x")).collect()
    assert [(r.x.units, r.x.low, r.x.high, r.x.source, r.x.review is not None) for r in rows] == [
        (3, 3, None, "units", True), (None, 5, None, "use_description", True), (None, 5, None, "use_description", False), (7, 7, 7, "units", False), (None, None, None, None, True), (None, None, None, None, False)]


def test_yaml_rows(spark, tmp_path):
    from ruleloom.sources import readers

    (tmp_path / "a.yaml").write_text("rows:\n- {id: 1, name: x}\n- {id: 2}\n")
    assert [tuple(r) for r in readers.yaml_rows(spark, str(tmp_path / "a.yaml"), "id int, name string", under="rows").collect()] == [(1, "x"), (2, None)]


def test_ids_by_equality_then_by_unique_containment(spark):
    sets = lambda rows: spark.createDataFrame(rows, "id long, members array<string>")
    prior = sets([(1, ["a"]), (2, ["b", "c"]), (3, ["d"]), (4, ["e"]), (5, ["e", "e"]), (6, []), (7, None), (8, ["m"]), (9, ["n"])])
    current = sets([(10, ["a", None, "a"]), (11, ["b", "c", "z"]), (12, ["d", "x"]), (13, ["d", "y"]), (14, ["e"]), (15, ["q"]), (16, []), (17, ["m", "n"])])
    got = {r.id: (r.stable, r.how) for r in si.stable_ids(prior, current, F.floor(F.col("id") / 4)).collect()}
    assert got == {10: (1, "equal"), 11: (2, "contains"), 14: (5, "equal"), 12: (10, "new"), 13: (11, "new"), 15: (12, "new"), 16: (13, "new"), 17: (14, "new")}
    assert {r.id: r.stable for r in si.stable_ids(prior.limit(0), current.limit(2), F.lit(0)).collect()} == {10: 1, 11: 2}
    refs = spark.createDataFrame([(1, [14, 99, 14]), (2, None), (3, [])], "k int, ids array<long>")
    back = {r.k: r.ids for r in si.rewritten(refs, "k", "ids", si.stable_ids(prior, current, F.lit(0))).collect()}
    assert back == {1: [5, 99, 5], 2: None, 3: []}


def test_ids_against_all_pairs(spark):
    """Sets that repeat on both sides, some with more members than have all their parts made, against plain Python."""
    import random
    from collections import Counter

    rnd, names = random.Random(3), [f"m{i:02}" for i in range(30)]
    draw = lambda most: rnd.sample(names, rnd.randint(1, most))
    current = [(i, draw(9)) for i in range(1_500)] + [(i, rnd.sample(names, rnd.randint(10, 22))) for i in range(1_500, 1_540)]
    current += [(2_000 + k, rnd.choice(current)[1]) for k in range(300)]
    prior = [(2 * i, m if i % 3 else m[1:]) for i, m in current if i % 2] + [(9_000 + i, draw(7)) for i in range(200)]
    prior += [(20_000 + k, rnd.sample(rnd.choice(current[1_500:1_540])[1], 9)) for k in range(30)] + [(30_000, names[:20]), (30_001, [])]
    rare = [f"z{i:02}" for i in range(18)]
    current, prior = current + [(6_000, rare)], prior + [(40_000, rare[3:7])]
    df = lambda rows: spark.createDataFrame(rows, "id long, members array<string>")
    got = {r.id: (r.stable, r.how) for r in si.stable_ids(df(prior), df(current), F.floor(F.col("id") / 100)).collect()}
    old, new = ({frozenset(m): sorted(i for i, x in rows if set(x) == set(m)) for _, m in rows if m} for rows in (prior, current))
    want = {new[s][0]: (old[s][-1], "equal") for s in old if s in new}
    left = {i: s for s, ids in new.items() for i in ids if i not in want}
    pairs = [(old[s][-1], i) for s in old if s not in new for i, l in left.items() if s <= l]
    small, large = Counter(p for p, _ in pairs), Counter(i for _, i in pairs)
    want |= {i: (p, "contains") for p, i in pairs if small[p] == large[i] == 1}
    last = max(i for i, _ in prior)
    want |= {i: (last + k, "new") for k, i in enumerate(sorted(i for i, _ in current if i not in want), 1)}
    assert got == want and {how for _, how in want.values()} == {"equal", "contains", "new"}
    assert any(how == "contains" and len(dict(current)[i]) > si.PARTS_OF for i, (_, how) in want.items())


def test_lines_of_two_runs_are_grouped_once(spark, sf_dir):
    from ruleloom.plans import links

    found = links.ids_rewritten(spark, sf_dir)
    assert len(found.collect()) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("partial_collect_list(") - final.count("partial_collect_list(struct(_at") == 1


def test_containment_of_sets_of_twelve(spark):
    """Sets of a dozen of a few common members, where meeting at the rarest brings half of all together."""
    import random
    import time

    rnd, names = random.Random(5), [f"m{i:02}" for i in range(24)]
    large = [(i, sorted(rnd.sample(names, 12))) for i in range(40_000)]
    small = [(i, sorted(rnd.sample(large[i * 7 % 40_000][1] if i % 9 == 0 else names, 11))) for i in range(40_000)]
    schema, begin = "id long, members array<string>", time.time()
    pairs = si.contained(spark.createDataFrame(small, schema), spark.createDataFrame(large, schema))
    found = pairs.groupBy("small").agg(F.sort_array(F.collect_list("large")).alias("l")).collect()
    assert time.time() - begin < 60
    sets, found = [set(m) for _, m in large], {r.small: r.l for r in found}
    for k in range(0, 40_000, 3_000):
        assert found.get(k, []) == [i for i, s in enumerate(sets) if s.issuperset(small[k][1])]


@pytest.mark.parametrize("radius", [20.0, 5_000.0, 900_000.0])
def test_nearest_against_all_pairs_at_poles_and_antimeridian(spark, radius):
    points = [(i, lat, lng) for i, (lat, lng) in enumerate([(90, 0), (-90, 10), (89.99, 179.99), (0, 180), (0, -180), (10, 179.9999), (45, -179.9999), (-89.999, -90), (12.3, 45.6), (None, 1), (60, 0)])]
    sites = [(100 + i, lat, lng) for i, (lat, lng) in enumerate([(89.9999, -120), (-89.9999, 170), (0, -179.9999), (10, -179.99), (45.0001, 179.9999), (12.3001, 45.6001), (12.3001, 45.6001), (60, 3), (None, None), (60.00001, 0.00001)])]
    df = lambda rows, name: spark.createDataFrame([(i, float(a) if a is not None else None, float(b) if b is not None else None) for i, a, b in rows], f"{name} long, lat double, lng double")

    def metres(a, b):
        p, q, d, e = map(math.radians, (a[1], b[1], b[1] - a[1], b[2] - a[2]))
        return 2 * sp.EARTH_M * math.asin(min(1.0, math.sqrt(math.sin(d / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(e / 2) ** 2)))

    want = {p[0]: min((metres(p, s), s[0]) for s in sites if s[1] is not None) for p in points if p[1] is not None}
    within = {r.id: r.site for r in sp.nearest_within(df(points, "id"), df(sites, "site"), radius).collect()}
    assert within == {p: s for p, (m, s) in want.items() if m <= radius}
    assert {r.id: r.site for r in sp.nearest(df(points, "id"), df(sites, "site"), radius).collect()} == {p: s for p, (_, s) in want.items()}
    assert sp.nearest(df(points, "id"), df(sites, "site").limit(0), radius).count() == 0


def test_gold_ties_gaps_and_bins(spark):
    make = lambda rows, id_: spark.createDataFrame(rows, f"{id_} long, doc_id long, start int, end int, category string")
    gold = make([(1, 1, 0, 100, "a"), (2, 1, 5000, 5100, "a"), (3, 1, 9000, 9010, "b"), (4, 2, 0, 10, "a"), (5, 1, 1020, 3000, "c")], "gold_id")
    ours = make([(10, 1, 50, 90, "b"), (11, 1, 50, 90, "a"), (12, 1, 300, 310, "a"), (13, 1, 5300, 5310, "x"), (14, 1, 9211, 9300, "b"), (15, 1, 1000, 1030, "c"), (16, 1, 2000, 4000, "z")], "rule_id")
    got = {r.gold_id: (r.rule_id, r.overlap, r.gap) for r in gd.matched(gold, ours).collect()}
    assert got == {1: (11, 40, 0), 2: (13, 0, 200), 3: (None, None, None), 4: (None, None, None), 5: (16, 1000, 0)}


def test_candidates_both_ways_to_their_documents(spark, monkeypatch):
    body = "The owner shall give thirty days notice in writing to every tenant of the building.\n" + "x" * 30_000 + "\nThis section takes effect on January 1, 2027 for all.\n7/20/26 - Chaptered by the Secretary of State\n"
    docs = spark.createDataFrame([("D1", body, 0, "Town, CA"), ("D2", None, 0, "CA")], "doc_id string, text string, body_offset int, jurisdiction string")
    row = lambda i, **x: {"candidate_id": i, "doc_id": "D1", "jurisdiction": "CA", "level": "state", "title": "t", "citation": "c", "status_hint": "enacted", "quoted_span": "shall give thirty days notice", "effective_date_phrase": None, "effective_date_anchor": None, "requirement": "30 days", "key_value": None, "coverage_text": None, "exemptions": None, "penalty": None, "predicate_numbers": ["2027"]} | x
    rows = [row(1), row(2, effective_date_phrase="takes effect on January 1, 2027 for all"), row(3, requirement="45 days"), row(4, doc_id="D2"), row(5, doc_id="none"), row(6, level="city"), row(7, jurisdiction="NY"), row(8, quoted_span="shall give forty days notice"), row(9, title=" ")]
    kinds = "candidate_id int, doc_id string, jurisdiction string, level string, title string, citation string, status_hint string, quoted_span string, effective_date_phrase string, effective_date_anchor string, requirement string, key_value string, coverage_text string, exemptions string, penalty string, predicate_numbers array<string>"
    cands = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    places = spark.createDataFrame([("CA",), ("Town, CA",)], "jurisdiction string")
    runs = []
    for most in (cd.SENT_BYTES, 0):
        monkeypatch.setattr(cd, "SENT_BYTES", most)
        runs.append({r.candidate_id: r for r in cd.checked(cands, docs, places).collect()})
    assert runs[0] == runs[1]
    got = runs[0]
    assert {k: r.reject for k, r in got.items() if r.reject} == {4: "document without text", 5: "document without text", 6: "level is not the jurisdiction's", 7: "unknown jurisdiction", 8: "quote not in its document", 9: "missing title"}
    assert (got[1].start, got[1].end, got[1].reasons, got[1].day, got[1].method) == (10, 39, [], "2027-01-01", "january_default")
    assert got[2].reasons == ["date phrase far from the quote"] and (got[2].day, got[2].method) == ("2027-01-01", "explicit")
    assert got[3].reasons == ["requirement: numbers not near the quote: 45"] and got[1].notes == ["state rule from a city's document"]


def test_outcomes_of_checks(spark):
    df = spark.createDataFrame([(1, [("a", True, ""), ("b", None, "")]), (2, [("a", True, ""), ("b", False, "")]), (3, [("a", None, "")]), (4, [])], f"i int, checks {ch.CHECK}")
    assert [r.o for r in df.select("i", ch.outcome(F.col("checks")).alias("o")).orderBy("i").collect()] == ["pass", "fail", "not checkable", "not checkable"]


def test_facts_and_contracts_of_empty_tables(spark):
    raw = spark.createDataFrame([], "address_id long, city string, confidence string, year_built string, units string, units_min string, units_max string, units_source string, use_description string")
    assert fc.normalised(raw).count() == 0
    rules = spark.createDataFrame([(None,) * 12], "rule_id string, title string, category string, jurisdiction string, level string, status string, effective_date string, citation string, quoted_span string, confidence double, doc_id string, superseded_by string")
    found = {r.problem for r in ct.rule_problems(rules, spark.createDataFrame([], "doc_id string"), ("a",)).collect()}
    assert {"id has another form", "title is missing", "status not known", "confidence out of bounds", "document not there"} <= found


def test_containment_of_sets_that_share_all_members(spark):
    """Sets of a few common members, where meeting at one of them brings nearly all together, and sets too large for their parts."""
    import random
    import time

    rnd, names = random.Random(7), [f"m{i:02}" for i in range(24)]
    large = [(i, sorted(rnd.sample(names, 6))) for i in range(100_000)] + [(200_000, names[:11]), (200_001, ["0", "1:1"])]
    small = [(i, sorted(rnd.sample(names, 5))) for i in range(100_000)] + [(200_000, ["m03", "m07"]), (200_001, ["0", "1:1"]), (200_002, ["1:1"]), (200_003, ["01:1"]), (200_004, ["0", "m03"])]
    schema, begin = "id long, members array<string>", time.time()
    pairs = si.contained(spark.createDataFrame(small, schema), spark.createDataFrame(large, schema))
    sizes = {r.small: r.n for r in pairs.groupBy("small").agg(F.count("*").alias("n")).collect()}
    assert time.time() - begin < 60
    sets, asked = [set(m) for _, m in large], dict(small)
    for k in (*range(0, 100_000, 9_000), *range(200_000, 200_005)):
        assert sizes.get(k, 0) == sum(set(asked[k]) <= s for s in sets)


def test_sites_that_lie_close(spark):
    """All points and sites in a cell or two of the radius, where each point would meet each site."""
    import time

    at = lambda k, m: (10 + (k * 7919 % m) / 1e5, 20 + (k * 104729 % (m - 1)) / 1e5)
    sites = [(k, *at(k, 20_011)) for k in range(20_000)]
    points = [(k, *at(k * 3 + 1, 20_011)) for k in range(30_000)] + [(70_000, -80.0, 0.0)]
    df, begin = spark.createDataFrame, time.time()
    p, s = df(points, "id long, lat double, lng double"), df(sites, "site long, lat double, lng double")
    got = {r.id: (r.site, r.metres) for r in sp.nearest(p, s, 400_000.0).collect()}
    assert time.time() - begin < 60
    assert len(got) == len(points) and sp.nearest_within(p, s, 400_000.0).where("id = 70000").count() == 0

    def far(a, b):
        half = lambda x, y: math.sin(math.radians(x - y) / 2) ** 2
        return 2 * sp.EARTH_M * math.asin(min(1.0, math.sqrt(half(b[1], a[1]) + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * half(b[2], a[2]))))

    for a in points[::4000] + points[-1:]:
        assert got[a[0]][1] == pytest.approx(min(far(a, b) for b in sites), abs=1e-3)


@pytest.mark.parametrize("name", ["nearest_of_all", "nearest_on_sphere"])
def test_cells_of_sites_stay_out_of_the_driver(spark, sf_dir, name):
    """Small files, whose rows are many in all grids; all that is broadcast is one site."""
    from ruleloom.plans import links

    found = getattr(links, name)(spark, sf_dir)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_places_at_one_point_are_one(spark, tmp_path):
    import time

    from ruleloom.plans.serving import nearest_within

    spark.range(60_000).selectExpr("id * 1000 AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(60_000).selectExpr("id * 1000 AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    begin = time.time()
    assert [tuple(r) for r in nearest_within(spark, str(tmp_path)).groupBy("id", "d2").count().collect()] == [(0, 0, 60_000)]
    assert time.time() - begin < 60


def test_items_that_ask_the_same(spark):
    """A group of many items and many rules; each wording is looked for once."""
    import time

    from ruleloom.operators import matching as mt

    items = spark.range(40_000).selectExpr("id AS item_id", "1 AS jurisdiction", "1 AS category", "id * 2 AS doc_id", "CASE WHEN id % 4 = 0 THEN 'Ring' WHEN id % 4 = 1 THEN 'none such' END AS citation")
    rules = spark.range(40_000).selectExpr("1 AS jurisdiction", "1 AS category", "id AS doc_id", "concat('a ring ', id) AS citation")
    begin = time.time()
    got = {tuple(r) for r in mt.checklist_found(items, rules).selectExpr("item_id % 4", "item_id < 20000", "found").distinct().collect()}
    assert time.time() - begin < 60
    assert got == {(k, few, few or k == 0) for k in range(4) for few in (True, False)}
