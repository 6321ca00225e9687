"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is its distinct five-word shingles, weighted by how often each occurs.
Every shingle sends arrivals of a Poisson process whose rate is its weight, each to
one of SLOTS slots; a slot's value is the shingle that arrives there first.  Two
documents agree in a slot with the probability Jaccard similarity of their weights.
Time stops as soon as every slot has surely been reached, so nearly all shingles of
a long document are left after their first arrival.

Slots are joined in bands.  In each bucket of a band the members are compared with
the bucket's least node.  Where a bucket then still holds several components, its
members are ranked by how little of their weight is theirs alone, so that the texts
in the middle of a group of near copies lead, and are compared with more leaders
each round.  A pair is compared in the first bucket that it shares, unless one of
two bounds or their sketches rule it out or a chain of links has joined it before;
rounds end when no bucket holds two components that have not been compared.  Pairs
count as links where the exact probability Jaccard similarity is SIMILARITY or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .shingles import mix, shingles, slices
from .storage import discard, written
from .worker import begin

WIDTH = 5
SIMILARITY = 0.8
#: Long bands keep apart documents that only share a passage, or their buckets would grow with the corpus; so many of
#: them that a pair at SIMILARITY itself shares none once in 7,000, at 0.85 once in 4,000,000.
BANDS, ROWS = 48, 8
SLOTS = BANDS * ROWS
#: Bits a slot in a node's sketch. Two sketches may differ in as many slots as those of a pair at SIMILARITY do on
#: average, and DEVIATIONS standard deviations more.
PLANES = 8
DEVIATIONS = 4.9
_apart = (1 - SIMILARITY) * (1 - 0.5**PLANES)
MOST_DIFFERENT = int(SLOTS * _apart + DEVIATIONS * (SLOTS * _apart * (1 - _apart)) ** 0.5)
#: Members of a bucket that lead comparisons in the first round after its least node; each round takes so many times more.
LEADERS = 32

_step = np.uint64(0x9E3779B97F4A7C15)
_bands = np.random.default_rng(7).integers(1, 2**63, (1, BANDS), dtype=np.uint64)


def weighted(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct shingles: (text, shingle, times)."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The shingle that is first in each slot of each text; texts without shingles keep zeros."""
    first = np.zeros((texts, SLOTS), np.uint64)
    total = np.bincount(text, weights=weight, minlength=texts)
    todo, patience = total > 0, np.log(SLOTS) + 3
    arrivals = {many: np.arange(1, many + 1, dtype=np.uint64) * _step for many in (1, 32)}
    while todo.any():
        mine = np.flatnonzero(todo[text])
        limit = np.divide(SLOTS * patience, total, out=np.zeros(texts), where=total > 0)
        h_, w_, t_ = h[mine], weight[mine].astype(float), text[mine]
        stop, time, seed = limit[t_], np.zeros(len(mine)), h_.copy()
        times, cells, names = [], [], []
        rounds = 0
        while len(h_):
            many = 1 if rounds < 8 else 32  # few shingles are left after some rounds: take more arrivals of each at once
            r = mix(seed[:, None] + arrivals[many][None, :])
            seed = seed + arrivals[many][-1]
            gaps = -np.log(((r >> np.uint64(12)).astype(float) + 0.5) / 2.0**52) / w_[:, None]
            at = time[:, None] + np.cumsum(gaps, axis=1)
            time = at[:, -1]
            row, col = np.nonzero(at <= stop[:, None])
            times.append(at[row, col])
            cells.append(t_[row] * SLOTS + (mix(r[row, col] ^ _step) % np.uint64(SLOTS)).astype(np.int64))
            names.append(h_[row])
            on = np.flatnonzero(time <= stop)
            h_, w_, t_, stop, time, seed = h_[on], w_[on], t_[on], stop[on], time[on], seed[on]
            rounds += 1
        when, cell, name = np.concatenate(times), np.concatenate(cells), np.concatenate(names)
        least = np.full(texts * SLOTS, np.inf)
        np.minimum.at(least, cell, when)
        whole = np.isfinite(least).reshape(texts, SLOTS).all(axis=1) & todo
        out = np.zeros(texts * SLOTS, np.uint64)
        won = when == least[cell]
        out[cell[won]] = name[won]
        first[whole] = out.reshape(texts, SLOTS)[whole]
        todo &= ~whole
        patience *= 2
    return first


def band_keys(first: np.ndarray) -> np.ndarray:
    parts = first.reshape(len(first), BANDS, ROWS)
    key = np.broadcast_to(_bands, (len(first), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * _step + parts[:, :, k])
    return key.view(np.int64)


def sketch(first: np.ndarray) -> np.ndarray:
    """PLANES bits of every slot, a plane of SLOTS bits after the other, in 64-bit integers."""
    x = mix(first ^ _step)
    planes = [np.packbits((x >> np.uint64(p)).astype(np.uint8) & 1, axis=1) for p in range(PLANES)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


_words = SLOTS // 64


def _differ(a: Column, b: Column, word: int) -> Column:
    """Of one word of two sketches the slots whose bits differ in some plane."""
    planes = [F.get(a, F.lit(word + p * _words)).bitwiseXOR(F.get(b, F.lit(word + p * _words))) for p in range(PLANES)]
    out = planes[0]
    for x in planes[1:]:
        out = out.bitwiseOR(x)
    return out


def may_be_alike(a: Column, b: Column) -> Column:
    """Whether two sketches agree as often as those of a pair that is alike; unlike by chance once in two million."""
    return sum((F.bit_count(_differ(a, b, i)) for i in range(1, _words)), F.bit_count(_differ(a, b, 0))) <= MOST_DIFFERENT


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each (elements in order, weights): the sum over common d of 1 / sum over e of max(a_e/a_d, b_e/b_d)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    low = np.searchsorted(ratio, ratio, side="left")
    xs, ys = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    both = np.flatnonzero((x > 0) & (y > 0))
    return float(np.sum(1 / ((xs[-1] - xs[low[both]]) / x[both] + ys[low[both]] / y[both])))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        for s in slices(batch.column(2)):
            h, begins = shingles(s, WIDTH)
            text, h, weight = weighted(h, begins)
            first = signatures(text, h, weight, len(s))
            keys, bits = band_keys(first), sketch(first)
            has = np.diff(begins) > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].reshape(-1)))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), batch.column(1).slice(s.first, len(s)), lists, sketches], names=["id", "node", "bands", "bits"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    def sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in slices(column):
            text, h, weight = weighted(*shingles(s, WIDTH))
            cuts = np.searchsorted(text, np.arange(len(s) + 1))
            for k in range(len(s)):
                yield h[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]

    for batch in batches:
        linked = [probability_jaccard(x, y) >= SIMILARITY - 1e-9 for x, y in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those that are alike, from the whole texts."""
    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return written(both.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), "links")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin()
    for batch in batches:
        node = batch.column(0).to_numpy()
        for s in slices(batch.column(1)):
            text, h, weight = weighted(*shingles(s, WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array(node[s.first + text]), pa.array(h.view(np.int64)), pa.array(weight.astype(np.int64))], names=["node", "gram", "times"])


def _company(texts: DataFrame) -> DataFrame:
    """``(node, n, w, k, kept)``: a text's distinct shingles and their weight, how many another of these texts has too, and their share of the weight."""
    grams = texts.mapInArrow(_grams, "node long, gram long, times long")
    one = grams.groupBy("gram").agg(F.count("*").alias("texts"), F.min("node").alias("node"), F.sum("times").alias("times")).where("texts = 1")
    alone = one.groupBy("node").agg(F.count("*").alias("n1"), F.sum("times").alias("w1"))
    whole = grams.groupBy("node").agg(F.count("*").alias("n"), F.sum("times").alias("w"))
    k, kept = F.col("n") - F.coalesce("n1", F.lit(0)), 1 - F.coalesce(F.col("w1") / F.col("w"), F.lit(0.0))
    return whole.join(alone, "node", "left").select("node", "n", "w", k.alias("k"), kept.alias("kept"))


def _within_bounds(a: str, b: str) -> Column:
    """Whether two texts can be alike, by what each shares with any other text.

    Let ``kept`` be the share of a text's weight on such shingles: similarity is at most ``1 / (1 / x + 1 / y - 1)``.
    Let ``c`` be at most the lesser ``k``: of the ``n + m`` distinct shingles ``n + m - 2 c`` at least stand in one text
    alone, and the greater weights of all sum to ``w + v - c`` at most, so similarity is at most one less their quotient.
    """
    c = F.least(f"k{a}", f"k{b}")
    by_share = 1 / (1 / F.col(f"kept{a}") + 1 / F.col(f"kept{b}") - 1)
    by_number = 1 - (F.col(f"n{a}") + F.col(f"n{b}") - 2 * c) / (F.col(f"w{a}") + F.col(f"w{b}") - c)
    return (by_share >= SIMILARITY - 1e-9) & (by_number >= SIMILARITY - 1e-9)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, node, class_id, class_node)`` of every row: its class of near-duplicates, named by the least id in it.

    ``node`` is the digest of the row's text: equal texts are one node, whatever
    their number and ids.  ``class_node`` is the node of the class's first document.
    A null text counts as empty; texts without a word are alike only if equal; a
    text of one to four words is one shingle; a very long text is taken whole, in a
    slice of its own.  Null ids come last and stay null; of documents with one id
    the lower digest names the class.  Repeated rows give repeated rows, an empty
    table none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    id_type = docs.schema[id_col].dataType
    signed = T.StructType([T.StructField("id", id_type), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
    signed = written(rows.mapInArrow(_sign, signed), "signed")
    # from here on a node is a number; written at once, so that it stays the same
    copies = written(signed.groupBy("node").agg(F.min("id").alias("rep")).withColumn("num", F.monotonically_increasing_id()), "copies")

    first = signed.join(copies, "node").where(F.col("id").eqNullSafe(F.col("rep")))
    one = first.select("num", F.posexplode("bands").alias("band", "key"))
    buckets = one.groupBy("key").agg(F.min("num").alias("lead"), F.max("num").alias("last")).where("lead <> last").select("key", "lead")
    shared = written(one.join(buckets, "key").distinct(), "shared")
    pairs = shared.where("num <> lead").select(F.col("lead").alias("a"), F.col("num").alias("b")).distinct()
    members = written(shared.groupBy("num").agg(F.collect_list(F.struct("band", "key")).alias("bands")), "members")  # BANDS at most a node

    # one text a node that has company, by a sort-merge join at every size: the texts are as much as the input
    needed = copies.join(members.select("num"), "num").select(F.col("node").alias("n"), F.col("rep").alias("r"), "num")
    texts = rows.join(needed.hint("merge"), (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("r"))).select("num", "text").dropDuplicates(["num"])
    texts = written(texts, "texts")
    links = _links(pairs, texts)
    roots = components(links.toDF("u", "v"))
    discard(shared, links)

    def undecided(led: int) -> DataFrame:
        """Rows ``(key, earlier, num, root, ...)``, with the node's buckets in earlier bands, of the buckets that hold several components after so many leaders."""
        mine = members.join(roots.withColumnRenamed("node", "num"), "num", "left").withColumn("root", F.coalesce("root", "num")).withColumn("at", F.explode("bands"))
        earlier = F.transform(F.filter("bands", lambda x: x["band"] < F.col("at.band")), lambda x: x["key"])
        mine = mine.select("at.key", earlier.alias("earlier"), *[c for c in mine.columns if c not in ("at", "bands")])
        open_ = mine.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where((F.col("size") > led + 1) & (F.col("r0") != F.col("r1"))).select("key")
        return mine.join(open_, "key", "left_semi")

    # from here on only nodes that can be like another; all of them may lead anew
    left = written(undecided(1).select("num").distinct(), "left")
    company = _company(texts.join(left, "num", "left_semi")).where(F.col("kept") >= SIMILARITY - 1e-9).withColumnRenamed("node", "num")
    facts = first.select("num", "bits").join(company, "num").dropDuplicates(["num"])
    every = members
    members = written(members.join(facts, "num"), "possible")
    discard(every, left)
    led, more = 0, LEADERS
    while True:
        mine = written(undecided(led), "undecided")
        if mine.count() == 0:
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("kept"), "num"))
        leaders = mine.withColumn("rank", rank).where(F.col("rank") <= led + more).where(F.col("rank") > led)
        sides = [side.select("key", *[F.col(c).alias(c + x) for c in ("earlier", "num", "root", "n", "w", "k", "kept", "bits")]) for side, x in ((leaders, "a"), (mine, "b"))]
        wanted = (F.col("roota") != F.col("rootb")) & _within_bounds("a", "b") & may_be_alike(F.col("bitsa"), F.col("bitsb")) & ~F.arrays_overlap("earliera", "earlierb")
        pairs = sides[0].join(sides[1], "key").where(wanted).select(F.least("numa", "numb").alias("a"), F.greatest("numa", "numb").alias("b")).distinct()
        links = _links(pairs, texts)
        roots = components(roots.where("node <> root").toDF("u", "v").union(links.toDF("u", "v")))
        discard(mine, links)
        led, more = led + more, more * LEADERS

    discard(mine, texts, members)
    named = copies.join(roots.withColumnRenamed("node", "num"), "num", "left").withColumn("root", F.coalesce("root", "num"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("no"), F.col("rep").alias("id"), "node")).alias("least"))
    classes = written(named.select("node", "root").join(least, "root").select("node", F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node")), "classes")
    return signed.select("id", "node").join(classes, "node").select(F.col("id").alias(id_col), "node", "class_id", "class_node")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stand for their class: the one with the least id.

    Of rows equal in id and text the one whose other columns hash lowest stays; of
    rows equal in everything, one.  Column names don't matter: they are set aside
    while the rows are chosen.  Else as :func:`near_duplicates`.
    """
    aside = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    key, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    found = near_duplicates(aside, key, text)
    stays = written(found.where(F.col(key).eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).select(F.col(key).alias("id"), F.col("node").alias("kept")).distinct(), "kept")
    node = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    rows = aside.withColumn("node", node).join(stays, F.col(key).eqNullSafe(F.col("id")) & (F.col("node") == F.col("kept")), "left_semi")
    low = F.row_number().over(Window.partitionBy(key, "node").orderBy(F.xxhash64(*aside.columns)))
    return rows.withColumn("low", low).where("low = 1").select(*aside.columns).toDF(*docs.columns)
