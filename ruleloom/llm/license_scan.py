"""Licence texts in documents: winnowed fingerprints pick candidates, banded alignment measures them.

Each template is cut into runs of GRAM words and winnowed: of every WINDOW
successive hashes the least is kept.  The kept fingerprints make an inverted index
of (template, place).  All runs of a document are looked up; hits that put a
template's beginning at about the same word make one candidate.  The template's
words are then aligned with the document's around there, within a band, and the
share of them that match is the coverage.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import worker
from .license_templates import TEMPLATES
from .shingles import Slice, shingles, slices

GRAM, WINDOW = 3, 4
MIN_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1


def winnowed(h: np.ndarray) -> list[int]:
    """Places of the least hash of every WINDOW successive ones, the last of equal ones; all places where there are fewer."""
    if len(h) <= WINDOW:
        return list(range(len(h)))
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return sorted({i + WINDOW - 1 - int(w[::-1].argmin()) for i, w in enumerate(windows)})


def band_of(length: int) -> int:
    """Words by which a match may drift from the diagonal: a fifth of the template, four at least."""
    return max(4, length // 5)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Pairs of equal words in the best alignment of the whole template with any part of ``text``, near the diagonal."""
    m, n, width = len(template), len(text), 2 * band + 1
    score = np.full((m + 1, width + 2), -(10**6), np.int32)  # column c: text word i + diagonal - band + c - 1 is the next
    back = np.zeros((m + 1, width + 2), np.int8)
    columns = np.arange(width) + 1
    at = diagonal - band + columns - 1
    score[0, 1:-1] = np.where((at >= 0) & (at <= n), 0, -(10**6))
    for i in range(1, m + 1):
        at = i + diagonal - band + columns - 1  # words of the text used
        equal = np.zeros(width, bool)
        inside = (at >= 1) & (at <= n)
        equal[inside] = text[at[inside] - 1] == template[i - 1]
        step = score[i - 1, 1:-1] + np.where(equal, MATCH, MISMATCH)
        skip = score[i - 1, 2:] + GAP  # a template word left out
        best, way = np.where(step >= skip, step, skip), np.where(step >= skip, 1, 2).astype(np.int8)
        best[(at < 0) | (at > n)] = -(10**6)
        best[(way == 1) & ~inside] = -(10**6)
        row, ways = best.tolist(), way.tolist()
        for c in range(1, width):  # a text word left out
            if row[c - 1] + GAP > row[c]:
                if at[c] <= n:
                    row[c], ways[c] = row[c - 1] + GAP, 3
        score[i, 1:-1], back[i, 1:-1] = row, ways
    i, c = m, int(score[m, 1:-1].argmax()) + 1
    pairs = []
    while i > 0 and score[i, c] > -(10**5):
        way = back[i, c]
        j = i + diagonal - band + c - 1
        if way == 1:
            if text[j - 1] == template[i - 1]:
                pairs.append((i - 1, j - 1))
            i -= 1
        elif way == 2:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return pairs[::-1]


class TemplateIndex:
    """The inverted index of the templates' fingerprints; its size is that of the templates, a list that the caller gives."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words: list[np.ndarray] = []
        found: dict[int, list[tuple[int, int]]] = {}
        for s in slices(pa.array([t for _, t in templates], pa.string())):
            h, begins = shingles(s, GRAM)
            for k in range(len(s)):
                self.words.append(s.hashes[s.begins[k] : s.begins[k + 1]].copy())
                own = h[begins[k] : begins[k + 1]]
                for place in winnowed(own):
                    found.setdefault(int(own[place]), []).append((s.first + k, place))
        self.keys = np.array(sorted(found), np.uint64)
        self.postings = [found[int(k)] for k in self.keys]

    def matches(self, s: Slice) -> Iterator[tuple[int, int, int, int, int]]:
        """(text of the slice, template, matched words, first and last matched word), the best of those that overlap."""
        h, begins = shingles(s, GRAM)
        if len(h) == 0 or len(self.keys) == 0:
            return
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hits = np.flatnonzero(self.keys[at] == h)
        texts = np.searchsorted(begins, hits, side="right") - 1
        candidates: dict[tuple[int, int], list[int]] = {}
        for p, k in zip(hits.tolist(), texts.tolist(), strict=True):
            for template, place in self.postings[at[p]]:
                candidates.setdefault((k, template), []).append(p - int(begins[k]) - place)
        found: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for (k, template), starts in candidates.items():
            words, text = self.words[template], s.hashes[s.begins[k] : s.begins[k + 1]]
            band = band_of(len(words))
            merged = min(band, len(words) - 1)  # starts a template's length apart are notices of their own
            starts.sort()
            while starts:
                first = starts[0]
                cut = next((i for i, x in enumerate(starts) if x > first + merged), len(starts))
                middle, starts = starts[cut // 2], starts[cut:]
                for reach in {merged, band}:  # the wider may settle on the neighbour of a short template's notice
                    low = max(0, middle - reach)
                    pairs = align(words, text[low : middle + len(words) + reach], middle - low, reach)
                    if len(pairs) >= MIN_COVERAGE * len(words):
                        spare = len(words) + (pairs[-1][1] - pairs[0][1] + 1) - 2 * len(pairs)
                        found.setdefault(k, []).append((len(pairs) - spare, len(pairs), low + pairs[0][1], low + pairs[-1][1], template))
        for k in sorted(found):
            taken: list[tuple[int, int]] = []
            for _, n, first, last, template in sorted(found[k], key=lambda x: (-x[0], -x[1], x[2], x[4])):
                i = bisect_left(taken, (first, last))
                if (i == len(taken) or taken[i][0] > last) and (i == 0 or taken[i - 1][1] < first):
                    insort(taken, (first, last))
                    yield k, template, n, first, last


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, n_matched, n_words, coverage, start, end)``: one row a match, in code points, end exclusive.

    A match covers MIN_COVERAGE of the template's words at least; of overlapping
    ones the one stays that has most matched words beyond those, of template and text,
    that don't match (ties: more matched words, then the earlier, then the template
    first in the list).  Texts without a word (null,
    empty) match nothing; a template of one or two words is found where it is the
    whole text; repeated rows give repeated rows; null ids are kept; other columns
    are not read; an empty table gives no row; a very long text is read whole.
    Documents are not shuffled; a task holds the templates' index.
    """
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("license", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_matched", "n_words", "start", "end")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.begin()
        index = TemplateIndex(templates)
        for batch in batches:
            where, rows = [], []
            for s in slices(batch.column(1)):
                for k, template, n, first, last in index.matches(s):
                    begin, a, b = s.offsets[k], s.starts[s.begins[k] + first], s.ends[s.begins[k] + last]
                    points = [int(np.count_nonzero((s.data[begin:x] & 0xC0) != 0x80)) for x in (a, b)]
                    where.append(s.first + k)
                    rows.append((index.names[template], n, len(index.words[template]), *points))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=out.names)

    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)
    return found.select(F.col("id").alias(id_col), "license", "n_matched", "n_words", F.round(F.col("n_matched") / F.col("n_words"), 6).alias("coverage"), "start", "end")
