"""Queries over the whole of every text, against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from ruleloom.functions.phrases import folded
from ruleloom.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", folded(F.col("text")).alias("folded")).collect()
    return {r.doc_id: (r.text, r.folded) for r in rows}


def _got(spark, sf_dir, name, texts):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert any(r.begin > 400 for r in rows)
    return rows


def test_quotes_from_anywhere_are_found(spark, sf_dir, texts):
    for r in _got(spark, sf_dir, "span_grounding", texts):
        text = texts[r.doc_id][0]
        quote = text[r.begin : r.begin + 12]
        assert r.start == (text.find(quote) if quote else None)


def test_quotes_with_other_white_space_are_found(spark, sf_dir, texts):
    space = "[ \\t\\n\\x0b\\f\\r]+"
    for r in _got(spark, sf_dir, "span_normalised", texts):
        text = texts[r.doc_id][1]
        words = [w for w in re.split(space, text[r.begin : r.begin + 40]) if w]
        found = re.search(space.join(map(re.escape, words)), text) if words else None
        assert r.start == (found.start() if found else None)


def test_windows_end_at_lines(spark, sf_dir, texts):
    for r in _got(spark, sf_dir, "text_window", texts):
        text = texts[r.doc_id][0]
        low, end = max(0, r.begin - 40), min(r.begin + 20, len(text))
        lead, tail = text[low : r.begin], text[end : end + 40].split("\n")[0]
        assert r.around == (lead.rsplit("\n", 1)[-1] if low else lead) + text[r.begin : end] + tail


HEAD = re.compile(r"^[ \t]*(?:§+\s*\d|(?:SECTION|Section|SEC\.|Sec\.)\s+\d+[\w.-]*[.:]?\s+[A-Z]|(?:ARTICLE|Article|CHAPTER|Chapter|DIVISION|Division|PART|Part)\s+[\dIVXLC]+[.:]|\d+(?:\.\d+)+[A-Z]?\.?\s+[A-Z][a-z])", re.M)
ITEM = re.compile(r"^[ \t]*(?:\d{1,3}|[a-z]|\([a-z0-9]{1,4}\))\.?[ \t]+\S", re.M)


def _plain_chunks(text, longest, overlap):
    """One chunk after the other, all breaks looked for anew each time."""
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
    line = {s: text[s : text.find("\n", s) if "\n" in text[s:] else len(text)] for s in starts}
    out, start, shared = [], 0, 0
    while start < len(text):
        cut, kind = len(text), "end"
        if cut - start > longest:
            cut, kind = start + longest, "hard"
            inside = [s for s in starts if start < s < start + longest and s - start >= longest // 2]
            blank = lambda s: not line[starts[starts.index(s) - 1]].strip()
            for name, fits in (("heading", lambda s: HEAD.match(line[s])), ("paragraph", blank), ("item", lambda s: not HEAD.match(line[s]) and ITEM.match(line[s])), ("line", lambda s: True)):
                if some := [s for s in inside if fits(s)]:
                    cut, kind = some[-1], name
                    break
        above = [s for s in starts if s <= start and HEAD.match(line[s])]
        out.append((start, cut, kind, shared, line[above[-1]].strip()[:200] if above else None))
        if cut == len(text):
            break
        before, start, shared = start, cut, 0
        if kind != "heading":
            start = min([s for s in starts if s >= max(cut - overlap, before + 1)] + [cut])
            start = min(start, cut)
            shared = cut - start
    return out


def test_chunks_by_heading(spark, sf_dir):
    from ruleloom.plans.phrases import headed

    got = {}
    for r in QUERIES["chunk_docs"](spark, sf_dir).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.split, r.overlap, r.heading))
    kinds = set()
    for r in headed(spark, sf_dir).collect():
        want = _plain_chunks(r.text or "", 2000, 200)
        assert got.get(r.doc_id, []) == want, r.doc_id
        kinds |= {x[2] for x in want}
    assert {"end", "heading", "line"} <= kinds


def test_menus_are_dropped_from_what_is_sent_on():
    from ruleloom.operators.chunks import cuts, prompt

    menu = "Home\nRents\n\nContact\nHelp\n"
    text = "§ 1 Scope\n" + menu + "The rule is this: one.\n" + menu + "It ends.\nHome\nNews\n" + menu + "Rents\nlast line with 5"
    (only,) = cuts(text, 10_000, 100)
    assert prompt(text, only[0], only[1], only[5]) == "§ 1 Scope\n\nThe rule is this: one.\n\nIt ends.\nNews\n\nlast line with 5"
    assert cuts("", 10, 2) == [] and [c[:3] for c in cuts("x" * 25, 10, 2)] == [(0, 10, "hard"), (10, 20, "hard"), (20, 25, "end")]
    assert cuts("head\n\nbody text", 100, 5, begin=6)[0][:2] == (6, 15)
