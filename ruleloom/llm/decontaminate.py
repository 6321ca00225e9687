"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves.

Test items are short and documents long, so the Jaccard similarity of the two is
near nothing even where the item is copied whole.  Items are therefore partitioned
by their number of shingles, and for each partition, with at most ``u`` shingles an
item, documents are seen as overlapping windows of ``2u`` shingles, one beginning
every ``u``: a passage of ``u`` shingles lies whole in one of them, and there a
contained item has a similarity of about a quarter at least.  A window that agrees
with an item in any of HASHES minima makes the document a candidate for the item;
at a similarity of a quarter all 64 differ once in 10^8.  Candidates are then
verified by exact containment of the item's distinct shingles in the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import Slice, shingles, slices
from .worker import begin

WIDTH = 5
CONTAINMENT = 0.8
HASHES = 64
#: Items are searched for in blocks of at most so many, and of so many characters unless one alone is longer; a block is what a task holds of the items.
ITEMS_PER_BLOCK = 2000
CHARS_PER_BLOCK = 4_000_000

_none = np.iinfo(np.uint64).max
_random = np.random.default_rng(20240501)
_factor = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_shift = _random.integers(0, 2**63, HASHES, dtype=np.uint64)


def grams(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; fewer words than ``width``, but some, make one."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


class ItemIndex:
    """The minima of a block of items, by shingle width and size partition."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.grams: list[set[tuple[bytes, ...]]] = [set()] * len(items)
        self.width = [WIDTH] * len(items)
        minima: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for s in slices(pa.array([t for _, t in items], pa.string())):
            for k in range(len(s)):
                n = int(s.begins[k + 1] - s.begins[k])
                if n == 0:
                    continue
                item, width = s.first + k, min(n, WIDTH)
                self.width[item] = width
                self.grams[item] = grams(s.words(k), width)
                h, begins = shingles(s, width)
                h = np.unique(h[begins[k] : begins[k + 1]])
                size = 1 << max(0, (len(h) - 1).bit_length())
                minima.setdefault((width, size), []).append((item, (h[None, :] * _factor[:, None] + _shift[:, None]).min(axis=1)))
        #: For each (width, most shingles of an item): the items, and for each hash function the minima in order with the items they are of.
        self.parts = {}
        for key, found in sorted(minima.items()):
            table = np.stack([m for _, m in found])
            order = np.argsort(table, axis=0, kind="stable")
            self.parts[key] = (np.array([i for i, _ in found]), np.ascontiguousarray(np.take_along_axis(table, order, 0).T), np.ascontiguousarray(order.T))

    def candidates(self, s: Slice) -> set[tuple[int, int]]:
        """Pairs (text of the slice, item) of which a window and the item share a minimum."""
        found: set[tuple[int, int]] = set()
        for width in sorted({w for w, _ in self.parts}):
            h, begins = shingles(s, width)
            if len(h) == 0:
                continue
            counts = np.diff(begins)
            if width < WIDTH:  # a shorter text's one shingle is of another width
                counts = np.where(np.diff(s.begins) >= width, counts, 0)
            for size in sorted(z for w, z in self.parts if w == width):
                items, table, order = self.parts[width, size]
                blocks = -(-counts // size)
                text = np.repeat(np.arange(len(counts)), blocks)
                if len(text) == 0:
                    continue
                inner = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                cuts = begins[text] + inner * size
                followed = np.flatnonzero(text[1:] == text[:-1])
                for j in range(HASHES):
                    low = np.minimum.reduceat(h * _factor[j] + _shift[j], cuts)
                    low[followed] = np.minimum(low[followed], low[followed + 1])
                    at = np.searchsorted(table[j], low)
                    at[at == len(items)] = 0
                    for k in np.flatnonzero(table[j][at] == low):
                        p = at[k]
                        while p < len(items) and table[j][p] == low[k]:
                            found.add((int(text[k]), int(items[order[j][p]])))
                            p += 1
        return found

    def contained(self, s: Slice) -> Iterator[tuple[int, int, int, int]]:
        """(text of the slice, item, the item's shingles, those of them in the text) where that is CONTAINMENT or more."""
        held: dict[tuple[int, int], set[tuple[bytes, ...]]] = {}
        for text, item in sorted(self.candidates(s)):
            width = self.width[item]
            if (text, width) not in held:
                held = {k: v for k, v in held.items() if k[0] == text}
                held[text, width] = grams(s.words(text), width)
            own = self.grams[item]
            shared = len(own & held[text, width])
            if shared >= CONTAINMENT * len(own):
                yield text, item, len(own), shared


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    held: list[tuple[object, str | None]] = []
    chars = 0
    for row in items.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        if held and (len(held) >= ITEMS_PER_BLOCK or chars + len(row[1] or "") > CHARS_PER_BLOCK):
            yield held
            held, chars = [], 0
        held.append((row[0], row[1]))
        chars += len(row[1] or "")
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc id, item id, n_shingles, n_shared)`` of every document and item it contains.

    Items are read in blocks of bounded size and each block goes over all documents
    once, so a benchmark of any size works and no task holds more than a block.
    Documents are not shuffled; a very long one is a slice of its own, read whole.
    Texts without a word (null, empty) contain nothing
    and are contained in nothing; an item of fewer than five words is one shingle,
    its words; repeated rows give repeated rows; null ids are kept; other columns
    are not read.
    """
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    out = T.StructType([T.StructField("doc", id_type), T.StructField("item", item_type), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())])
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id), F.col(doc_text).cast("string"))
    result = spark.createDataFrame([], out)
    for block in _blocks(items, item_id, item_text):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            begin()
            index = ItemIndex(shipped.value)
            item_arrow = pa.array(index.ids).type
            for batch in batches:
                rows, names = [], []
                for s in slices(batch.column(1)):
                    for text, item, n, shared in index.contained(s):
                        rows.append(s.first + text)
                        names.append((index.ids[item], n, shared))
                ids, n, shared = zip(*names, strict=True) if names else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, item_arrow), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], names=["doc", "item", "n_shingles", "n_shared"]
                )

        result = result.unionByName(texts.mapInArrow(run, out))
    return result.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_shingles", "n_shared")


def without_contaminated(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no item; see :func:`contaminated` for what counts."""
    spark = docs.sparkSession
    names = docs.columns
    for block in _blocks(items, item_id, item_text):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            begin()
            index = ItemIndex(shipped.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for s in slices(batch.column(batch.num_columns - 1)):
                    keep[[s.first + text for text, *_ in index.contained(s)]] = False
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

        wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
        schema = wide.schema
        wide = wide.withColumn("text", F.col(f"c{names.index(doc_text)}").cast("string"))
        docs = wide.mapInArrow(run, schema).toDF(*names)
    return docs
