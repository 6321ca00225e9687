"""Answers to questions about one address, put together in the row from its lookup: seven kinds, with citations, open facts and what to ask next.

A lookup is an array of ``(rule_id, category, level, result, conflict, missing, effective, title)``, an address's
few rules; nothing is joined or shuffled for an answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import questions as qs

#: Results as answers put them, best first.
ORDER = ("applies", "superseded", "unknown", "not_yet_effective", "pending")
SAID = {"applies": "apply", "superseded": "give way", "unknown": "unknown", "not_yet_effective": "not yet in effect", "pending": "proposed"}
ROW = "array<struct<rule_id:int,category:string,level:string,result:string,conflict:boolean,missing:array<string>,effective:string,title:string>>"
MOST_CITED, MOST_NEXT, MOST_SUGGESTED = 3, 3, 6


def ranked(rows: Column, words: Column) -> Column:
    """By result, then by the telling words shared with the question, city before state, then by id."""
    key = lambda r: F.struct(
        F.array_position(F.array(*map(F.lit, ORDER)), r["result"]).alias("a"), (-qs.overlap(words, qs.unmarked(qs.tokens(r["title"])))).alias("b"), F.when(r["level"] == "city", 0).otherwise(1).alias("c"), r["rule_id"].alias("d"), r.alias("row"))
    return F.transform(F.array_sort(F.transform(rows, key)), lambda x: x["row"])


def counts(rows: Column) -> Column:
    """``2 apply, 1 unknown``: results in order, those that occur."""
    of = lambda result: F.size(F.filter(rows, lambda r: r["result"] == result))
    parts = [of(x) for x in ORDER]
    return F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {SAID[x]}"))) for x, n in zip(ORDER, parts, strict=True)])), ", ")


def open_facts(rows: Column) -> Column:
    """Facts that unknown rows wait for, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda r: r["result"] == "unknown"), lambda r: F.coalesce(r["missing"], F.array().cast("array<string>")))))


def suggestions(rows: Column, categories: tuple[str, ...]) -> Column:
    """What may be asked of a lookup, six at most: an overview, two categories, what is special in it, further categories, who governs.

    Categories with a rule that applies come first, then the others with a rule that is more than proposed.
    """
    any_ = lambda f: F.exists(rows, f)
    of = lambda c: F.filter(rows, lambda r: (r["category"] == c) & (r["result"] != "pending"))
    named = [(c, of(c)) for c in categories]
    first = F.array_compact(F.array(*[F.when(F.exists(x, lambda r: r["result"] == "applies"), f"category:{c}") for c, x in named]))
    rest = F.array_compact(F.array(*[F.when((F.size(x) > 0) & ~F.exists(x, lambda r: r["result"] == "applies"), f"category:{c}") for c, x in named]))
    cats = F.concat(first, rest)
    special = F.array_compact(F.array(F.when(any_(lambda r: r["result"] == "unknown"), "why_unknown"), F.when(any_(lambda r: r["result"].isin("not_yet_effective", "pending")), "upcoming"), F.when(any_(lambda r: r["conflict"]), "conflict")))
    every = F.concat(F.array_compact(F.array(F.when(F.size(rows) > 0, "overview"))), F.slice(cats, 1, 2), special, F.slice(cats, F.lit(3), F.greatest(F.size(cats), F.lit(1))), F.array(F.lit("jurisdiction")))
    return F.slice(every, 1, MOST_SUGGESTED)


def answer(kind: Column, category: Column, rows: Column, words: Column, place: Column, categories: tuple[str, ...]) -> Column:
    """``(kind, lead, cited, missing, next)`` of one question; rows null or empty are a lookup without a rule."""
    rows = F.coalesce(rows, F.array().cast(ROW))
    text = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    number = lambda x: F.size(x).cast("string")
    asked = F.coalesce(F.when(kind == "category", F.concat(F.lit("category:"), category)).otherwise(kind), F.lit("no_match"))
    offered = suggestions(rows, categories)
    after = F.slice(F.filter(offered, lambda s: s != asked), 1, MOST_NEXT)

    def out(lead: Column, cited: Column, missing: Column | None = None, most: int = MOST_CITED) -> Column:
        some = F.slice(cited, 1, most)
        return F.struct(kind.alias("kind"), lead.alias("lead"), F.transform(some, lambda r: r["rule_id"]).alias("cited"), (missing if missing is not None else F.array().cast("array<string>")).alias("missing"), after.alias("next"))

    none = F.slice(rows, 1, 0)
    mine = F.filter(rows, lambda r: category.isNull() | (r["category"] == category))
    let: Callable = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def by_category() -> Column:
        held = F.filter(mine, lambda r: r["result"] != "pending")
        top = lambda x: F.get(x, F.lit(0))
        lead = lambda x: text(place, ": ", number(held), " on ", category, " (", counts(held), "); first Sec. ", top(x)["rule_id"].cast("string"), F.when(top(x)["conflict"], ", under review").otherwise(""))
        return F.when(F.size(held) == 0, out(text(place, ": nothing on ", category), none)).otherwise(let(ranked(held, words), lambda x: out(lead(x), x, open_facts(F.slice(x, 1, MOST_CITED)))))

    def why_unknown() -> Column:
        unknown = F.filter(mine, lambda r: r["result"] == "unknown")
        return F.when(F.size(unknown) == 0, out(F.lit("nothing is unknown"), none)).otherwise(out(text(number(unknown), " unknown"), ranked(unknown, words), open_facts(unknown)))

    def upcoming() -> Column:
        later, proposed = F.filter(mine, lambda r: r["result"] == "not_yet_effective"), F.filter(mine, lambda r: r["result"] == "pending")
        full = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
        is_full = lambda r: F.coalesce(r["effective"].rlike(full), F.lit(False))
        by_day = F.transform(F.array_sort(F.transform(F.filter(later, is_full), lambda r: F.struct(r["effective"].alias("a"), r["rule_id"].alias("b"), r.alias("row")))), lambda x: x["row"])
        ordered = F.concat(by_day, F.filter(later, lambda r: ~is_full(r)), ranked(proposed, words))
        first = F.get(by_day, F.lit(0))
        lead = text(number(later), " not yet in effect, ", number(proposed), " proposed", F.when(F.size(by_day) > 0, text("; next ", first["effective"], ", Sec. ", first["rule_id"].cast("string"))).otherwise(""))
        return F.when(F.size(later) + F.size(proposed) == 0, out(F.lit("nothing is to come"), none)).otherwise(out(lead, ordered))

    def conflict() -> Column:
        flagged = F.filter(mine, lambda r: r["conflict"] & (r["result"] != "pending"))
        return F.when(F.size(flagged) == 0, out(F.lit("nothing is in conflict"), none)).otherwise(out(text(number(flagged), " in conflict"), ranked(flagged, words)))

    def jurisdiction() -> Column:
        of = lambda level: F.filter(rows, lambda r: (r["level"] == level) & (r["result"] != "pending"))
        picks = F.concat(F.slice(ranked(of("city"), words), 1, 1), F.slice(ranked(of("state"), words), 1, 1))
        return out(text(place, ": ", number(of("state")), " of the state, ", number(of("city")), " of the city"), picks)

    def overview() -> Column:
        held = F.filter(rows, lambda r: r["result"] != "pending")
        best = lambda c: F.slice(ranked(F.filter(held, lambda r: r["category"] == c), words), 1, 1)
        picks = F.concat(*map(best, categories))
        return F.when(F.size(held) == 0, out(text(place, ": no rule"), none)).otherwise(let(picks, lambda p: out(text(place, ": rules in ", number(p), f" of {len(categories)} categories (", counts(held), ")"), p, most=len(categories))))

    no_match = F.struct(F.lit("no_match").alias("kind"), F.lit("no rule of this building answers that").alias("lead"), F.array().cast("array<int>").alias("cited"), F.array().cast("array<string>").alias("missing"), offered.alias("next"))
    made = {"category": by_category, "why_unknown": why_unknown, "upcoming": upcoming, "conflict": conflict, "jurisdiction": jurisdiction, "overview": overview}
    found = F.lit(None)
    for name, make in made.items():
        found = F.when(kind == name, make()).otherwise(found) if name != "category" else F.when(kind == name, make())
    return F.coalesce(found, no_match)
