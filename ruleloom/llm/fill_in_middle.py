"""Texts cut at two places of a set of boundaries and put together with the middle last.

The places where a text may be cut, 0 and the end of each line, are a compressed set:
places that share their upper bits are one container, kept as an array, a bitmap or
runs, whichever is smallest, beside the number of places before it.  The place of a
rank is found by a search over those numbers and a selection inside one container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .word_bpe import in_small_batches
from .worker import begin

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of a place that stand inside a container.
LOW_BITS = 16


@dataclass
class ArrayContainer:
    low: np.ndarray

    def select(self, rank: int) -> int:
        return int(self.low[rank])


@dataclass
class RunContainer:
    first: np.ndarray
    before: np.ndarray  # places in the runs before each

    def select(self, rank: int) -> int:
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.first[k]) + rank - int(self.before[k])


@dataclass
class BitmapContainer:
    bits: np.ndarray  # a byte holds eight places, the lowest bit first
    before: np.ndarray  # places in the words of 64 before each

    def select(self, rank: int) -> int:
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[8 * k : 8 * k + 8], bitorder="little"))
        return 64 * k + int(inside[rank - int(self.before[k])])


def _container(low: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    begins = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    bitmap = (1 << LOW_BITS) // 8
    if 4 * len(begins) < min(2 * len(low), bitmap):
        return RunContainer(low[begins].astype(np.uint16), begins.astype(np.int32))
    if 2 * len(low) <= bitmap:
        return ArrayContainer(low.astype(np.uint16))
    flags = np.zeros(1 << LOW_BITS, bool)
    flags[low] = True
    counts = np.cumsum(flags.reshape(-1, 64).sum(1))
    return BitmapContainer(np.packbits(flags, bitorder="little"), np.concatenate([[0], counts[:-1]]))


class BoundarySet:
    """A set of places, from an ascending array without repeats."""

    def __init__(self, places: np.ndarray):
        high = places >> LOW_BITS
        self.before = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[self.before].tolist()
        low = places & ((1 << LOW_BITS) - 1)
        self.containers = [_container(x) for x in np.split(low, self.before[1:])] if len(places) else []
        self.size = len(places)

    def select(self, rank: int) -> int:
        """The place of that rank, from 0."""
        if not 0 <= rank < self.size:
            raise IndexError(rank)
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return (self.high[k] << LOW_BITS) + self.containers[k].select(rank - int(self.before[k]))


def boundaries(text: str) -> np.ndarray:
    """0 and the code points after which a line ends; the last line need not end in a line feed."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    if text and not text.endswith("\n"):
        ends = np.append(ends, len(text))
    return np.concatenate([[0], ends]).astype(np.int64)


def transformed(key: object, text: str, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """``(lines, form, prefix_chars, middle_chars, output)`` of one text; the digest of seed and key decides cuts and form."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    places = BoundarySet(boundaries(text))
    n = places.size - 1
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places.select(low), places.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row; ``n``: its lines.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of those have the suffix first.  A text
    that is null or empty, or holds a sign of the format, stays plain.  A null id
    counts as an empty one; rows that repeat an id are each cut by it.  A long text is
    held once with its output.  An empty table gives no rows; other columns aren't read.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            own = pa.schema([pa.field("id", batch.schema.field(0).type), *schema])
            rows = ((key.as_py(), *transformed(shown.as_py(), text.as_py() or "", seed, rate, spm)) for key, shown, text in zip(*batch.columns, strict=True))
            yield from in_small_batches(rows, own, lambda r: 4 * len(r[-1]) + 64)

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("shown"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from; no text of a form with signs holds one, so each sign is the first of its kind."""
    of = lambda a, b, to: F.regexp_replace(output, f"(?s)^{a}(.*?){b}(.*?){MIDDLE}(.*)$", to)
    return F.when(form == "psm", of(PREFIX, SUFFIX, "$1$3$2")).when(form == "spm", of(SUFFIX, PREFIX, "$2$3$1")).otherwise(output)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of :func:`fill_in_middle`'s rows."""
    return df.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
