"""Words and word shingles of whole Arrow columns as 64-bit hashes, without a Python object per word.

A word is a maximal run, in the lower-cased text, of characters that are neither
ASCII other than letters and digits nor Unicode punctuation, symbols or
separators.  Hashes are fixed functions of the text, the same on every machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time.
SLICE_BYTES = 1 << 19

_word_byte = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_base = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, SLICE_BYTES * 2)
        for name, base in (("_powers", _base), ("_inverse", pow(_base, -1, 1 << 64))):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            globals()[name] = np.multiply.accumulate(grown)
    return _powers, _inverse


@dataclass
class Slice:
    """Some texts of a column: ``first`` is the number of the first; words of text k are ``begins[k]:begins[k+1]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, k: int) -> list[bytes]:
        """The words of text ``k`` themselves."""
        return _word.findall(self.data[self.offsets[k] : self.offsets[k + 1]].tobytes())


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-cased texts (null: empty), separators blanked, and where each begins."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    raw = column.buffers()[2]
    if raw is not None and np.isin(np.frombuffer(raw, np.uint8), (0xC2, 0xC3, *range(0xE0, 0xF5))).any():
        column = pc.replace_substring_regex(column, pattern=r"[^\x00-\x7F\pL\pM\pN\pC]", replacement=" ")
    raw = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array) -> Iterator[Slice]:
    """A column's texts in runs of about SLICE_BYTES; a longer text is a run of its own."""
    at, n = 0, len(column)
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    while at < n:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), SLICE_BYTES, side="right")))
        end = min(end, n)
        yield _slice(column.slice(at, end - at), at)
        at = end


def _slice(column: pa.Array, first: int) -> Slice:
    data, offsets = lowered(column)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Slice(first, data, offsets, none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64))
    inside = _word_byte[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    powers, inverse = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
    return Slice(first, data, offsets, starts, ends, mix((total[ends] - total[starts]) * inverse[starts]), np.searchsorted(starts, offsets).astype(np.int64))


def shingles(s: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and where each text's begin.

    A text of fewer words, but some, has one shingle: all its words.
    """
    h, begins = s.hashes, s.begins
    counts = np.diff(begins)
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = (rolled ^ h[k : n - width + 1 + k]) * np.uint64(_base)
        rolled ^= rolled >> np.uint64(29)
    made = np.maximum(counts - width + 1, 0)
    made[(counts > 0) & (counts < width)] = 1
    out_begins = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    out = np.empty(out_begins[-1], np.uint64)
    whole = counts >= width
    text_of = np.repeat(np.arange(len(counts)), np.where(whole, made, 0))
    where = np.arange(len(text_of)) - np.repeat(np.concatenate([[0], np.cumsum(np.where(whole, made, 0))[:-1]]), np.where(whole, made, 0))
    out[out_begins[text_of] + where] = rolled[begins[text_of] + where]
    for k in np.flatnonzero((counts > 0) & (counts < width)):
        acc = np.zeros(1, np.uint64)
        for x in h[begins[k] : begins[k + 1]]:
            acc = (acc ^ x) * np.uint64(_base)
            acc ^= acc >> np.uint64(29)
        out[out_begins[k]] = acc[0] ^ np.uint64(counts[k])
    return mix(out), out_begins
