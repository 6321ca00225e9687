"""How far sources of one language differ in their words: distances of all pairs, and the words that tell a source apart.

Copies are collapsed first: texts equal within a language are one row with the number of
times each source has them, tokenized once, and their words count as often as the copies
do.  Words are integers from then on: a word's share of a group is a whole number of
parts in ``SCALE``, and sums are exact.

A group lacks most words, and all that it lacks have one share.  So the distance of two
groups starts from those two shares over the whole vocabulary; then come, for each group
alone, its own words against the other's share of a missing word, by running sums over
the group's shares; then, for words that both have, what those two parts said wrongly.
Only the last looks at pairs, a slice of the vocabulary a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written
from .worker import begin

#: Parts that a group's words share among them.
SCALE = 1_000_000_000
#: Added to each count.
SMOOTH = 5
#: Documents of a language that a kept term stands in, at least.
LEAST_DOCS = 30
#: Terms of a group that are told.
TOP = 50
#: Counted words that a task holds before it hands them on.
HELD = 400_000
#: Slices of a language's vocabulary, at least, and rows in one on average, at most.
LEAST_SLICES, SLICE_ROWS = 64, 100_000

#: ASCII letters become lower case, other ASCII bytes a space; bytes of other characters stay.
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, lower-cased, and of any characters beyond ASCII, as they are."""
    return raw.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over distinct texts, each weighted by the copies a source has of it."""
    begin()
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            n, own = len(found), docs[lang, source]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * n, "source": [source] * n, "term": list(found), "n": list(found.values()), "docs": [own[t] for t in found]}, schema=schema)
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            terms = words(text)
            if len(copies) == 1 and copies[0]["times"] == 1:
                key = lang, copies[0]["source"]
                counts[key].update(terms)
                docs[key].update(set(terms))
                held += len(terms) // 8
            else:
                once = Counter(terms)
                for copy in copies:
                    key, times = (lang, copy["source"]), copy["times"]
                    of, seen = counts[key], docs[key]
                    for term, n in once.items():
                        of[term] += n * times
                        seen[term] += times
                held += len(once) * len(copies)
            if held >= HELD:
                held = sum(map(len, counts.values()))
                if held >= HELD:
                    yield from told()
                    held = 0
    yield from told()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(lang, source, term, n, docs)`` of all words, and ``(lang, source)`` of all groups, also those without a word.

    A text's copies meet as one row a map task and source; the text itself moves once a
    map task that has it.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(some(lang_col).alias("lang"), some(source_col).alias("source"), some(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = written(rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("times")), "copies-by-source")
    of_text = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "times")).alias("copies"))
    texts = rows.select("lang", "digest", F.col("text").cast("binary").alias("text")).dropDuplicates(["lang", "digest"])
    found = texts.join(of_text, ["lang", "digest"]).select("lang", "text", "copies").mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts, copies.select("lang", "source").distinct()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms))`` in whole numbers; 0 where there is no term."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    parts = F.call_function("div", wide, (total + SMOOTH * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + parts).otherwise(F.lit(0)).cast("long")


def _meetings(part: pd.DataFrame) -> pd.DataFrame:
    """For each two groups of a slice, sums over the terms that both have of what the one-sided sums said wrongly."""
    term, _ = pd.factorize(part["term"])
    source, names = pd.factorize(part["source"], sort=True)
    p, missing = part["p"].to_numpy(np.int64), part["missing"].to_numpy(np.int64)
    by = np.argsort(source, kind="stable")
    term, source, p, missing = term[by], source[by], p[by], missing[by]
    ends = np.append(np.flatnonzero(np.diff(source, prepend=-1)), len(source))
    at = np.full(term.max() + 1, -1, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(len(names) - 1):
        own = slice(ends[a], ends[a + 1])
        at[term[own]] = p[own]
        rest = slice(ends[a + 1], len(term))
        pa_ = at[term[rest]]
        both = np.flatnonzero(pa_ >= 0)
        pa_, pb, ma, mb = pa_[both], p[rest][both], missing[own][0], missing[rest][both]
        wrong = abs(pa_ - pb) - abs(pa_ - mb) - abs(ma - pb) + abs(ma - mb)
        # whole numbers far below 2**53, so sums of doubles are exact
        sums = np.bincount(source[rest][both], wrong.astype(float), minlength=len(names)).astype(np.int64)
        met = np.flatnonzero(sums)
        out.append((np.full(len(met), a), met, sums[met]))
        at[term[own]] = -1
    a, b, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
    names = np.asarray(names, object)
    return pd.DataFrame({"lang": part["lang"].iloc[0], "a": names[a], "b": names[b], "both": value})


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group its distance to every other source, and its most telling terms.

    Part ``pair``: all other sources of the language, farthest first; part ``term``: up to
    ``TOP`` terms whose share exceeds the language's.  Ties go by the item's UTF-8.
    Null texts, languages and sources are empty strings; a group without words has the
    smoothed shares, and in a language where no term is kept all distances are 0.
    Repeated rows are documents like others.  An empty table gives no rows; a text of any length is one row; other
    columns aren't read.
    """
    counts, groups = term_counts(docs, text_col, lang_col, source_col)
    counts = written(counts, "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "lang_n")
    entries = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = written(groups.withColumn("missing", _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    shares = entries.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))

    pairs = groups.select("lang", F.col("source").alias("a"), "terms", F.col("missing").alias("ma")).join(groups.select("lang", F.col("source").alias("b"), F.col("missing").alias("mb")), "lang").where("a <> b")
    known = shares.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("x")).agg(F.count("*").alias("m"))
    asked = pairs.select("lang", "a", "b", F.col("mb").alias("x"), "ma", F.lit(0).cast("long").alias("m"))
    line = known.select("lang", "a", F.lit(None).cast("string").alias("b"), "x", F.lit(None).cast("long").alias("ma"), "m").unionByName(asked)
    upto = Window.partitionBy("lang", "a").orderBy("x")
    whole = Window.partitionBy("lang", "a")
    line = line.withColumns({"m_low": F.sum("m").over(upto), "s_low": F.sum(F.col("m") * F.col("x")).over(upto), "m_all": F.sum("m").over(whole), "s_all": F.sum(F.col("m") * F.col("x")).over(whole)}).where("b IS NOT NULL")
    alone = line.select("lang", "a", "b", F.expr("2 * (x * m_low - s_low) + s_all - x * m_all - m_all * abs(ma - x)").alias("alone"))

    slices = max(LEAST_SLICES, -(-entries.count() // SLICE_ROWS))
    sliced = shares.select("lang", "source", "term", "p", "missing", F.pmod(F.xxhash64("term"), F.lit(slices)).alias("slice"))
    both = sliced.groupBy("lang", "slice").applyInPandas(_meetings, "lang string, a string, b string, both long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("both").alias("more"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), *[c for c in df.columns if c not in ("lang", "a", "b")])
    added = alone.union(turned(alone)).union(both).union(turned(both)).groupBy("lang", "a", "b").agg(F.sum("alone").alias("added"))
    far = pairs.join(added, ["lang", "a", "b"]).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), (F.col("terms") * F.abs(F.col("ma") - F.col("mb")) + F.col("added")).alias("value"))

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    telling = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = telling.withColumn("rank", rank).where(F.col("rank") <= TOP).unionByName(far.withColumn("rank", rank))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
