"""Units of a building from what a data set says of it: parsers as data, folded in the row, and the hull of two statements."""

from __future__ import annotations

import json
from importlib.resources import files

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.readers import dimension

KINDS = ("range", "none", "sum_tokens")
PARSER = "id:string,kind:string,states:array<string>,pattern:string,low:struct<value:int,group:int,add:int>,high:struct<value:int,group:int,add:int>,split:string,token:string,ambiguous:string"


def parsers(text: str | None = None) -> Column:
    """The table of parsers, in the file's order, as a constant; one with a known id again or an unknown kind is refused.

    ``text`` is the file's, the package's own by default. Its size is that of a table kept by hand.
    """
    rows = dimension(text if text is not None else (files("ruleloom.sources") / "unit_parsers.yaml").read_text("utf-8"))
    seen: set[str] = set()
    for p in rows:
        if p["id"] in seen or p["kind"] not in KINDS:
            raise ValueError(f"parser {p['id']}: {'there already' if p['id'] in seen else 'unknown kind ' + p['kind']}")
        seen.add(p["id"])
    bound = lambda x: {"value": x} if isinstance(x, int) else x and {"add": 0} | x
    made = [{"states": [], "split": "/"} | p | {end: bound(p.get(end)) for end in ("low", "high")} for p in rows]
    return F.from_json(F.lit(json.dumps(made)), f"array<struct<{PARSER}>>")


def described(text: Column, state: Column, table: Column) -> Column:
    """``(low, high, parser, said)``: what the first parser of the state makes of a description; ``said`` is ok or why there is no range.

    A null or blank description, one that no parser fits, one reviewed as without a
    count, an ambiguous one and a range upside down have none. An open end is null.
    """
    text = F.trim(F.coalesce(text, F.lit("")))
    mine = F.filter(table, lambda p: ((F.size(p["states"]) == 0) | F.array_contains(p["states"], state)) & F.rlike(text, p["pattern"]))

    def bound(b: Column, pattern: Column) -> Column:
        group = F.call_function("regexp_extract", text, pattern, b["group"]).try_cast("int") + b["add"]
        return F.when(b["value"].isNotNull(), b["value"]).when(b["group"].isNotNull(), group)

    def use(p: Column) -> Column:
        out = lambda low, high, said: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), p["id"].alias("parser"), said.alias("said"))
        none, ok = F.lit(None), F.lit("ok")
        tokens = F.transform(F.call_function("split", text, p["split"], F.lit(-1)), lambda part: F.call_function("regexp_extract_all", part, p["token"], F.lit(1)))
        clear = F.forall(tokens, lambda t: F.size(t) == 1)
        total = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.coalesce(F.get(t, F.lit(0)).try_cast("int"), F.lit(0)))
        summed = F.when(p["ambiguous"].isNotNull() & F.rlike(text, p["ambiguous"]), out(none, none, F.lit("ambiguous token"))).when(~clear, out(none, none, F.lit("a part without one clear token"))).otherwise(out(total, total, ok))
        low, high = bound(p["low"], p["pattern"]), bound(p["high"], p["pattern"])
        ranged = F.when(low > high, out(none, none, F.lit("upside down"))).otherwise(out(low, high, ok))
        return F.when(p["kind"] == "none", out(none, none, F.lit("no count stated"))).when(p["kind"] == "sum_tokens", summed).otherwise(ranged)

    nothing = F.struct(F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(None).cast("string").alias("parser"), F.when(text == "", "no description").otherwise("no parser fits").alias("said"))
    return F.coalesce(F.get(F.transform(F.slice(mine, 1, 1), use), F.lit(0)), nothing)


def resolved(column: Column, parsed: Column) -> Column:
    """``(units, low, high, source, review)`` of a units column as text and a parsed description.

    The column wins where it is a whole number. Where the description contradicts it
    the range is their hull, an open end staying open, and the row is for review.
    """
    raw = F.trim(F.coalesce(column, F.lit("")))
    n = F.when(raw.rlike("^[+]?[0-9]+$"), raw.try_cast("int"))
    low, high = parsed["low"], parsed["high"]
    ranged = low.isNotNull() | high.isNotNull()
    outside = F.coalesce(n < low, F.lit(False)) | F.coalesce(n > high, F.lit(False))
    out = lambda units, a, b, source, review: F.struct(units.cast("int").alias("units"), a.cast("int").alias("low"), b.cast("int").alias("high"), F.lit(source).alias("source"), F.lit(review).alias("review"))
    none = F.lit(None)
    hull = out(n, F.when(low.isNotNull(), F.least(n, low)), F.when(high.isNotNull(), F.greatest(n, high)), "units", "units contradict the description")
    bad = F.when((raw != "") & n.isNull(), "units are no whole number")
    from_text = F.struct(none.cast("int").alias("units"), low.alias("low"), high.alias("high"), F.when(ranged, "use_description").alias("source"), bad.alias("review"))
    return F.when(n.isNotNull(), F.when(ranged & outside, hull).otherwise(out(n, n, n, "units", None))).otherwise(from_text)
