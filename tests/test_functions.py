"""Functions on small tables of values, the null and edge cases among them."""

import datetime

import pytest
from pyspark.sql import functions as F

from ruleloom.functions import dates, text
from ruleloom.functions import tristate as tri
from ruleloom.operators import corpus, temporal
from ruleloom.sources import readers

D = datetime.date


@pytest.mark.parametrize(
    ("low", "high", "want"),
    [(7, 7, 2), (2, 2, 0), (None, None, 1), (5, 9, 2), (1, 2, 0), (2, 9, 1), (5, None, 2), (None, 2, 0), (None, 9, 1)],
)
def test_at_least_three(spark, low, high, want):
    row = spark.createDataFrame([(low, high)], "low int, high int").select(tri.compare(">=", F.col("low"), F.col("high"), F.lit(3)).alias("v")).first()
    assert row.v == want


def test_year_against_a_day(spark):
    df = spark.createDataFrame([(1950,), (1990,), (1970,), (None,)], "y int")
    got = [r.v for r in df.select(tri.compare_year_to_date("<", F.col("y"), F.lit("1970-03-04").cast("date")).alias("v")).collect()]
    assert got == [2, 0, 1, 1]


def test_partial_dates_and_counting(spark):
    df = spark.createDataFrame([("2026",), ("2024-02",), ("2026-01-15",), ("2026-02-30",), ("soon",), (None,)], "t string")
    assert [r.d for r in df.select(dates.last_day_of_partial(F.col("t")).alias("d")).collect()] == [D(2026, 12, 31), D(2024, 2, 29), D(2026, 1, 15), None, None, None]
    row = spark.range(1).select(
        dates.first_of_nth_month_after(F.lit("2026-07-20").cast("date"), 12).alias("a"), dates.days_after(F.lit("2025-03-03").cast("date"), 90).alias("b"), dates.years_before(F.lit("2032-02-29").cast("date"), 3).alias("c"), dates.january_after(F.lit("2026-05-05").cast("date")).alias("d")
    ).first()
    assert tuple(row) == (D(2027, 7, 1), D(2025, 6, 1), D(2029, 2, 28), D(2027, 1, 1))


def test_texts(spark):
    pick = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert pick(text.citation_key(F.lit("Cal. Civ. Code § 1947.12"))) == "1947.12"
    assert pick(text.citation_key(F.lit("Senate, No. 2983"))) == "s2983"
    assert pick(text.citation_key(F.lit("House Bill No. 5222"))) == "h5222"
    assert pick(text.unsupported_numbers(F.lit("a $75 fee"), F.lit("a reasonable fee"))) == ["75"]
    assert pick(text.unsupported_numbers(F.lit("$1,000 and two"), F.lit("1000 or 2"))) == []
    assert pick(text.clean_street(F.lit("322-322.5 05TH AV."))) == "322 5TH AVE"
    for said, want in (("238 & 242 X ST", (238, 242)), ("12A MAIN ST", (12, 12)), ("MAIN ST", (None, None))):
        assert tuple(pick(text.house_numbers(F.lit(said)))) == want
    for said, want in (("TIC Bldg 4 units or less", (None, 4)), ("Apartment 5 to 14 Units", (5, 14)), ("Duplex", (2, 2)), ("vacant", (None, None))):
        assert tuple(pick(text.units_described(F.lit(said)))) == want


def test_overlapping_spans_are_one_island(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 40, 90), (2, 0, 50), (2, 100, 150), (3, 0, 100), (3, 10, 20), (3, 90, 120)], "d int, s int, e int")
    got = temporal.islands(df, ["d"], "s", "e").groupBy("d").agg(F.max("island").alias("n")).orderBy("d").collect()
    assert [r.n for r in got] == [1, 2, 1]


def test_window_is_widened_to_whole_lines(spark):
    df = spark.createDataFrame([("first\nsecond quote here\nthird",)], "t string")
    assert df.select(corpus.window_around(F.col("t"), F.lit(13), F.lit(18), 10).alias("w")).first().w == "second quote here"
    assert df.select(corpus.first_span(F.col("t"), F.lit("quote")).alias("w")).first().w == (13, 18)
    assert df.select(corpus.first_span(F.col("t"), F.lit("no")).alias("w")).first().w is None


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('doc_id,jurisdictions,url\nD1,"CA; ""x""",u\nD2,NJ\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "m.csv"), "doc_id string, jurisdictions string, url string").collect()] == [("D1", 'CA; "x"', "u"), ("D2", "NJ", None)]
    (tmp_path / "p.json").write_text('{"parcels": [{"a": 1}, {"a": null}]}')
    assert [r.a for r in readers.json_document(spark, str(tmp_path / "p.json"), "a:int", "parcels").collect()] == [1, None]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a").write_bytes("é".encode())
    (tmp_path / "texts" / "b").write_bytes(b"\xff\xfe")
    (tmp_path / "texts" / "c").write_bytes(b"")
    assert sorted((r.text or "", r.problem or "") for r in readers.whole_texts(spark, str(tmp_path / "texts")).collect()) == [("", "not UTF-8"), ("é", "")]
    a = spark.createDataFrame([("1", "a"), ("2", "a")], "doc_id string, v string")
    b = spark.createDataFrame([("2", "b"), ("3", "b")], "doc_id string, v string")
    assert sorted(tuple(r) for r in readers.manifest_union(a, b).collect()) == [("1", "a"), ("2", "a"), ("3", "b")]
    with pytest.raises(ValueError, match="not written"):
        readers.write_checked(a, a.select("v"), str(tmp_path / "out"))


def test_chunks_cover_the_text_and_overlap():
    from ruleloom.operators.chunks import cuts

    text = "\n\n".join("word " * (k % 40) for k in range(300)) + "x" * 500
    found = [c[:2] for c in cuts(text, 200, 30)]
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(a < b <= a + 200 for a, b in found)
    assert all(begin < nxt <= end for (begin, end), (nxt, _) in zip(found, found[1:], strict=False))
    assert cuts("", 10, 2) == []


def test_phrases(spark):
    from ruleloom.functions import phrases

    pick = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert pick(phrases.dates_in(F.lit("from July 20, 2026 to 2026-08-01, or 8/2/2026 and 2026-02-30"))) == [D(2026, 7, 20), D(2026, 8, 1), D(2026, 8, 2)]
    assert tuple(pick(phrases.resolve(F.lit("the first day of the 12th month after"), F.lit("2026-07-20").cast("date")))) == (D(2027, 7, 1), "nth_month")
    assert tuple(pick(phrases.resolve(F.lit("effective January 5, 2027"), F.lit(None).cast("date")))) == (D(2027, 1, 5), "explicit")
    assert pick(phrases.find_normalised(F.lit("say “no  rent”\nat all"), F.lit('"no rent" at'))) == 4
    assert pick(phrases.find_normalised(F.lit("abc"), F.lit("  "))) is None


def test_streets_jurisdictions_and_matches(spark):
    from ruleloom.operators import matching as mt

    pick = lambda c: spark.range(1).select(c.alias("v")).first().v

    for said, want in (("600 JACKSON/601 HARRISON", "600 JACKSON"), ("322 - 326.5 0012TH AV", "322 12TH AVE"), ("5 2ND ST.", "5 2ND ST"), ("MAIN-SIDE ST", "MAIN-SIDE ST")):
        assert pick(text.clean_street(F.lit(said))) == want
    for said, want in (("1031-1035 X", (1031, 1035)), ("322.5-324 X", (322, 324)), ("5 2ND ST", (5, 5)), ("12 A-B ST", (12, 12))):
        assert tuple(pick(text.house_numbers(F.lit(said)))) == want
    assert pick(mt.in_jurisdiction(F.lit("NJ; Hoboken, NJ"), F.lit("NJ"), F.lit("Newark"))) is True
    assert pick(mt.in_jurisdiction(F.lit("Hoboken, NJ"), F.lit("NJ"), F.lit("Hoboken"))) is True
    assert pick(mt.in_jurisdiction(F.lit(None).cast("string"), F.lit("NJ"), F.lit("Hoboken"))) is False
    assert pick(text.unsupported_numbers(F.lit("1.5 months, 20 days"), F.lit("One and one-half months, twenty days"))) == []


def test_trees_quirks(spark):
    import json

    from ruleloom.operators import trees as tr

    facts = tr.Facts(F.lit(2), F.lit(9), F.lit(1990), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    day = F.lit("2024-02-29").cast("date")

    def value(tree, as_of=day):
        ((_, nodes),) = tr.node_rows({1: json.dumps(tree) if tree else None})
        df = spark.createDataFrame([(nodes,)], f"nodes array<{tr.NODE}>")
        return df.select(tr.coverage(F.col("nodes"), facts, as_of).alias("c")).first().c

    leaf = lambda fact, op, v: {"fact": fact, "op": op, "value": v}
    assert value(None).value == 2
    same_year = value(leaf("year_built", "==", "1990-10-01"))
    assert (same_year.value, list(same_year.missing)) == (1, [])  # unknown, though nothing is missing
    dropped = value({"all": [leaf("units", ">=", 5), leaf("owner_type", "==", "REIT")]})
    assert (dropped.value, list(dropped.missing)) == (1, ["owner_type"])  # a lenient falsehood drops nothing, and says what blocks
    lifted = value({"all": [leaf("units", "<", 10), {"not": leaf("owner_occupied", "==", True)}]})
    assert (lifted.value, list(lifted.presumed), list(lifted.missing)) == (2, ["owner_occupied"], [])
    assert value(leaf("year_built", "<", {tr.RELATIVE: 30}), F.lit(None).cast("date")).value == 1
    assert value(leaf("units", "in", [10, 11])).value == 0 and value(leaf("units", "not_in", [10, 11])).value == 2
    assert value({"any": []}).value == 1
