"""Personal data in texts, by DataFrame operations only: fixed forms, and what their contexts lead to.

Base spans are the leftmost matches of four forms that pass a check of their
digits.  They seed a bootstrap: each mention of an identifier, a run of characters
without white space that holds a digit or ``@``, stands in lexical patterns (the
two words before it, the words on either side, a label before it).  Patterns and
instances make a bipartite graph, scored in rounds: a pattern's confidence in a
kind is the sum of its instances' scores over their number, those of another kind
or of a shape that the kind can't have, smoothed; an instance's score is the chance
that at least one of its trusted patterns is right.  Instances found with a high
score support further patterns, and rounds go on until none is added.  Mentions
that no form covers, but a trusted pattern does, become further spans of its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

KINDS = ("email", "ip", "card", "phone")
#: Least confidence and distinct sure instances of a trusted pattern; unseen instances that it must outweigh.
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 5
SMOOTHING = 1.0
#: Characters on either side in which context words are sought.
CONTEXT = 80

# The four forms, in an order of matching that never goes back over a character twice: runs are
# possessive and begin where a run or the match before it ends.  They match what the plain forms match.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"
_mark, _other = "\u0001", "\u0002"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = r"0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    luhn = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.when((F.length(digits) - i) % 2 == 1, 2 * F.substring(digits, i, F.lit(1)).cast("int") - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(False))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(True)
    )


def _mentions(texts: DataFrame) -> DataFrame:
    """``(key, kind, s, e, value, left, right)`` of every match in ``texts(key, text)``; kind "token" for identifiers.

    Each match is marked in the text and the text cut at the marks; positions are
    running sums of the pieces' lengths.  Only lengths, matches and their contexts
    leave the scan, not the texts.
    """
    text = F.translate(F.col("text"), _mark, _other)
    cut = F.array(*[F.struct(F.lit(k).alias("kind"), F.split(F.when(text.rlike("@") if k == "email" else text.rlike("[0-9]") if k != "token" else F.lit(True), F.regexp_replace(text, p, f"{_mark}$0{_mark}")).otherwise(text), _mark).alias("parts")) for k, p in [*FORMS.items(), ("token", TOKEN)]])
    rows = texts.select("key", F.explode(cut).alias("c")).select("key", "c.kind", "c.parts").where(F.size("parts") > 1)
    part = F.col("parts")
    pieces = F.transform(
        part,
        lambda x, i: F.struct(
            F.char_length(x).alias("n"),
            F.when(i % 2 == 1, x).alias("value"),
            F.when(i % 2 == 1, F.right(F.get(part, i - 1), F.lit(CONTEXT))).alias("left"),
            F.when(i % 2 == 1, F.left(F.get(part, i + 1), F.lit(CONTEXT))).alias("right"),
        ),
    )
    rows = rows.select("key", "kind", F.posexplode(pieces).alias("at", "p")).select("key", "kind", "at", "p.*")
    e = F.sum("n").over(Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("e", e).where("at % 2 = 1").withColumn("s", F.col("e") - F.col("n"))
    lead = F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}+@]*+", 0))
    trimmed = F.regexp_extract("value", r"^[^\p{L}\p{N}+@]*+(.*?)[^\p{L}\p{N}]*$", 1)
    token = F.col("kind") == "token"
    rows = rows.withColumn("s", F.when(token, F.col("s") + lead).otherwise(F.col("s"))).withColumn("value", F.when(token, trimmed).otherwise(F.col("value")))
    rows = rows.withColumn("e", F.col("s") + F.char_length("value"))
    return rows.where(token | _valid(F.col("kind"), F.col("value"))).where("value <> ''").select("key", "kind", "s", "e", "value", "left", "right")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns that a mention stands in."""
    word = r"[\p{L}\p{M}'’-]+"
    two = F.lower(F.regexp_extract(left, rf"({word}\W{{1,3}}{word})\W{{0,3}}$", 1))
    one = F.lower(F.regexp_extract(left, rf"({word})\W{{0,3}}$", 1))
    after = F.lower(F.regexp_extract(right, rf"^\W{{0,3}}({word})", 1))
    label = F.lower(F.regexp_extract(left, rf"({word}) ?[:=#] ?$", 1))
    some = F.array(
        F.when(two != "", F.concat(F.lit("before "), two)),
        F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("around"), one, after)),
        F.when(label != "", F.concat(F.lit("label "), label)),
    )
    return F.filter(some, lambda x: x.isNotNull())


def _shape(kind: Column, value: Column) -> Column:
    """Whether an unseen identifier can be of the kind at all."""
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    return F.when(kind == "email", value.contains("@")).when(kind == "ip", value.rlike(r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){3,}$")).when(kind == "card", digits >= 8).otherwise((digits >= 7) & value.rlike(r"^[+0-9().-]+$"))


def _discovered(mentions: DataFrame) -> DataFrame:
    """``(key, kind, s, e)`` of the identifiers that only trusted patterns find."""
    order = Window.partitionBy("key").orderBy("s", "e")
    base = F.col("kind") != "token"
    before = F.max(F.when(base, F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("s"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = mentions.withColumn("covered", ~base & ((F.coalesce(before, F.lit(-1)) > F.col("s")) | F.coalesce(after < F.col("e"), F.lit(False))))
    marked = marked.where(~F.col("covered")).select("key", F.when(base, F.col("kind")).alias("kind"), "s", "e", "value", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    marked = written(marked, "pii-marked")
    edges = written(marked.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pii-edges")

    shaped = lambda k: F.col("kind").isNull() & F.coalesce(_shape(F.lit(k), F.col("value")), F.lit(False))
    n = edges.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if((F.col("kind") == k) | shaped(k)).alias(k) for k in KINDS])
    against = n.select("pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("of"), (F.col("n") - F.col(k)).alias("against")) for k in KINDS])).alias("x")).select("pattern", "x.of", "x.against")
    against = written(against, "pii-against")
    seeds = edges.where("kind IS NOT NULL").select("pattern", F.col("kind").alias("of"), F.lit(1.0).alias("score"))
    open_ = edges.where("kind IS NULL").select("pattern", "value")
    scored, known = seeds, -1
    while True:
        by_kind = scored.groupBy("pattern", "of").agg(F.sum("score").alias("score"), F.count("*").alias("scored"), F.count_if(F.col("score") >= MIN_CONFIDENCE).alias("sure")).where(F.col("sure") >= MIN_SEEDS)
        confidence = F.col("score") / (F.col("scored") + F.col("against") + SMOOTHING)
        trusted = by_kind.join(against, ["pattern", "of"]).withColumn("confidence", confidence).where(F.col("confidence") >= MIN_CONFIDENCE)
        trusted = written(trusted.select("pattern", "of", "confidence"), "pii-patterns")
        if (now := trusted.count()) <= known:
            break
        known = now
        reached = open_.join(trusted, "pattern").where(_shape(F.col("of"), F.col("value")))
        unseen = written(reached.groupBy("value", "of").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")), "pii-instances")
        scored = seeds.union(open_.join(unseen, "value").select("pattern", "of", "score"))

    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("of"))
    hits = marked.where("kind IS NULL").join(trusted, "pattern").where(_shape(F.col("of"), F.col("value")))
    return hits.groupBy("key", "s", "e").agg(F.max_by("of", F.struct("confidence", -rank)).alias("kind")).select("key", "kind", "s", "e")


def text_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, spans)`` of each distinct text that has any: ``key`` its MD5, ``spans`` in order of start, then kind.

    A span is a struct ``(s, k, e, after, base)``: code points, end exclusive; ``k`` the
    number of its kind; ``after`` the end of all spans before it; ``base`` false for
    those that only patterns find.
    """
    text = F.col(text_col).cast("string")
    texts = docs.where(text.rlike("[0-9@]")).select(F.md5(text.cast("binary")).alias("key"), text.alias("text")).distinct()
    mentions = written(_mentions(texts), "pii-mentions")
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    spans = mentions.where("kind <> 'token'").select("key", "kind", "s", "e", F.lit(True).alias("base"))
    spans = spans.union(_discovered(mentions).select("key", "kind", "s", "e", F.lit(False))).withColumn("k", rank)
    before = F.max("e").over(Window.partitionBy("key").orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("after", F.coalesce(before, F.lit(0)))
    return written(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", "after", "base"))).alias("spans")), "pii-spans")


def _joined(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``spans``, null where the text has none; no column of ``docs`` may be named ``own``, ``key`` or ``spans``."""
    own = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return docs.withColumn("own", own).join(text_spans(docs, text_col), F.col("own") == F.col("key"), "left").drop("own", "key")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: ``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered)``.

    Counts and digest are of the base spans; ``spans`` lists all.  A null text
    counts as empty and has none; equal texts are searched once, very long ones
    whole; repeated rows give repeated rows; null ids are kept; an empty table gives
    none; other columns are not read.
    """
    kind = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"], x["e"])), ",")
    rows = _joined(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    spans = F.coalesce(F.col("spans"), F.filter(F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("after"), F.lit(True).alias("base"))), lambda x: F.lit(False)))
    rows = rows.select("id", spans.alias("x")).withColumn("b", F.filter("x", lambda s: s["base"]))
    return rows.select(
        F.col("id").alias(id_col),
        *[F.size(F.array_remove(F.transform("b", lambda s: F.when(s["k"] == i, 1).otherwise(0)), 0)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],  # noqa: B023
        F.sha2(F.encode(shown(F.col("b")), "UTF-8"), 256).alias("base_sha256"),
        shown(F.col("x")).alias("spans"),
        (F.size("x") - F.size("b")).cast("long").alias("n_discovered"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in brackets; overlapping spans keep the part not yet replaced out.

    A null text stays null; repeated rows stay repeated; an empty table stays empty;
    all columns keep their names, whatever these are, for they are set aside
    meanwhile; a very long text is cut and joined in its row.
    """
    aside = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    name = f"c{docs.columns.index(text_col)}"
    text = F.col(name).cast("string")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda x: F.when(x["s"] >= x["after"], F.concat(F.substring(text, (x["after"] + 1).cast("int"), (x["s"] - x["after"]).cast("int")), F.get(kinds, x["k"]))).otherwise(F.lit(""))
    end = F.array_max(F.transform("spans", lambda x: x["e"])).cast("int")
    changed = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(text, end + 1, F.char_length(text)))).otherwise(text)
    return _joined(aside, name).withColumn(name, changed).select(*aside.columns).toDF(*docs.columns)
