"""Documents as overlapping chunks, cut where the text itself breaks, each under the heading in force and without its menus."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lines that begin a section or an item, and what a menu's line is.
HEADING_FORMS = (
    r"§+\s*\d", r"(?:SECTION|Section|SEC\.|Sec\.)\s+\d+[\w.-]*[.:]?\s+[A-Z]", r"(?:ARTICLE|Article|CHAPTER|Chapter|DIVISION|Division|PART|Part)\s+[\dIVXLC]+[.:]",
    r"\d+(?:\.\d+)+[A-Z]?\.?\s+[A-Z][a-z]",
)
ITEM_FORM = r"(?:\d{1,3}|[a-z]|\([a-z0-9]{1,4}\))\.?[ \t]+\S"
MENU_LONGEST, MENU_TIMES, MENU_RUN = 30, 3, 4
#: Kinds of break, strongest first.
KINDS = ("heading", "paragraph", "item", "line")

_heading, _item = re.compile(r"[ \t]*(?:" + "|".join(HEADING_FORMS) + ")"), re.compile(r"[ \t]*" + ITEM_FORM)


@dataclass
class Outline:
    """Where a text's lines begin, those of each kind of break, and its menus' ranges; worked out once a text."""

    lines: list[int]
    breaks: dict[str, list[int]]
    menus: list[tuple[int, int]]

    @classmethod
    def of(cls, text: str, begin: int) -> Outline:
        rows = text[begin:].split("\n")
        if rows[-1] == "":
            rows.pop()
        starts, at = [], begin
        for row in rows:
            starts.append(at)
            at += len(row) + 1
        bare = [r.strip() for r in rows]
        kind = ["heading" if _heading.match(r) else "item" if _item.match(r) else "" for r in rows]
        breaks = {k: [s for s, own in zip(starts, kind, strict=True) if own == k] for k in ("heading", "item")}
        breaks |= {"line": starts, "paragraph": [starts[i] for i in range(1, len(rows)) if not bare[i - 1]]}
        return cls(starts, breaks, list(_menus(rows, bare, starts, len(text))))


def _menus(rows: list[str], bare: list[str], starts: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges, with their line feeds, of short lines that the text repeats, in runs of short lines that only blank ones interrupt."""
    short = [0 < len(s) <= MENU_LONGEST and not any(map(str.isdigit, s)) and s[-1] not in ".:;,)\"”" for s in bare]
    times = Counter(bare)
    for together, group in groupby(range(len(rows)), key=lambda i: short[i] or not bare[i]):
        run = list(group)
        if together and sum(short[i] for i in run) >= MENU_RUN:
            yield from ((starts[i], min(starts[i] + len(rows[i]) + 1, size)) for i in run if short[i] and times[bare[i]] >= MENU_TIMES)


def cuts(text: str, longest: int, overlap: int, begin: int = 0) -> list[tuple[int, int, str, int, str | None, list[tuple[int, int]]]]:
    """``(start, end, split, overlap, heading, dropped)`` of chunks that cover a text from ``begin``.

    A chunk ends at the last break of the strongest kind in its back half, else where
    it is full (hard).  The next begins ``overlap`` before, at a line's start, but right at the
    cut where that is a heading. Heading: the last one at or before the chunk's start.
    """
    outline, out, start, shared = Outline.of(text, begin), [], begin, 0
    heads = outline.breaks["heading"]
    while start < len(text):
        end, kind = len(text), "end"
        if end - start > longest:
            end, kind = start + longest, "hard"
            for k in KINDS:
                marks = outline.breaks[k]
                last = bisect_left(marks, start + longest) - 1
                if last >= 0 and marks[last] >= max(start + longest // 2, start + 1):
                    end, kind = marks[last], k
                    break
        above = bisect_right(heads, start) - 1
        heading = text[heads[above] :].split("\n", 1)[0].strip()[:200] if above >= 0 else None
        out.append((start, end, kind, shared, heading, [m for m in outline.menus if start <= m[0] and m[1] <= end]))
        if end == len(text):
            break
        start, shared = end, 0
        if kind != "heading":
            wanted = max(end - overlap, out[-1][0] + 1)
            at = bisect_left(outline.lines, wanted)
            start = min(outline.lines[at], end) if at < len(outline.lines) else end
            shared = end - start
    return out


def prompt(text: str, start: int, end: int, dropped: list[tuple[int, int]]) -> str:
    """A chunk's text without its dropped ranges."""
    edges = [start, *[x for pair in dropped for x in pair], end]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def chunk(docs: DataFrame, longest: int = 24_000, overlap: int = 2_000, id_col: str = "doc_id", text_col: str = "text", begin_col: str | None = None) -> DataFrame:
    """``(id, chunk_no, char_start, char_end, split, overlap, heading, dropped, prompt)``; a null or empty text has no chunk.

    ``begin_col`` says where a text's body begins. A cut depends on the one before it, hence Python, a batch at a
    time; no text is shuffled.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [("chunk_no", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("split", pa.string()), ("overlap", pa.int64()), ("heading", pa.string()), ("dropped", span), ("prompt", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (text, begin) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                text = text.as_py() or ""
                rows = [(n, a, b, kind, shared, head, [{"start": x, "end": y} for x, y in gone], prompt(text, a, b, gone)) for n, (a, b, kind, shared, head, gone) in enumerate(cuts(text, longest, overlap, begin.as_py() or 0))]
                if rows:
                    own = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["id", *[n for n, _ in kinds]])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    of = {"split": T.StringType(), "heading": T.StringType(), "dropped": spans, "prompt": T.StringType()}
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, of.get(c, T.LongType())) for c, _ in kinds]])
    begin = F.col(begin_col).cast("long") if begin_col else F.lit(0).cast("long")
    return docs.select(F.col(id_col), F.col(text_col), begin.alias("_begin")).mapInArrow(run, out).withColumnRenamed("id", id_col)
