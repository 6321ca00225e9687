import random
import re

import numpy as np
from pyspark.sql import functions as F

from ruleloom.llm.license_scan import align, scan, winnowed
from ruleloom.llm.license_templates import TEMPLATES
from ruleloom.llm.registry import QUERIES

TEXT = dict(TEMPLATES)


def _words(text):
    return [m for m in re.finditer(r"[0-9a-z]+|[^\W_]+", (text or "").lower())]


def _best(template, text):
    """Most matched words of the best alignment of the whole template with any part of the text, without a band."""
    n = len(text)
    score = [(0, 0)] * (n + 1)
    for t in template:
        new = [(score[0][0] - 1, score[0][1])]
        for j in range(1, n + 1):
            equal = text[j - 1] == t
            new.append(max((score[j - 1][0] + (2 if equal else -1), score[j - 1][1] + equal), (score[j][0] - 1, score[j][1]), (new[j - 1][0] - 1, new[j - 1][1])))
        score = new
    return max(score)[1]


def test_winnowing_keeps_one_of_every_window():
    h = np.random.default_rng(1).integers(0, 50, 200, dtype=np.uint64)
    kept = winnowed(h)
    assert all(any(i <= p < i + 4 for p in kept) for i in range(len(h) - 3))
    assert winnowed(h[:3]) == [0, 1, 2]


def test_banded_alignment_against_the_whole_table():
    r = np.random.default_rng(3)
    for _ in range(200):
        template = r.integers(0, 30, r.integers(1, 40))
        text = np.delete(template, r.integers(0, len(template), r.integers(0, 3))) if len(template) > 4 else template
        text = np.insert(text, r.integers(0, len(text) + 1, r.integers(0, 3)), 99)
        lead = int(r.integers(0, 5))
        whole = np.concatenate([r.integers(100, 200, lead), text, r.integers(100, 200, 5)])
        pairs = align(template, whole, lead, 8)
        assert all(template[i] == whole[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len(pairs) == _best(template.tolist(), whole.tolist())


def _docs():
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 7))) for _ in range(400)]
    docs = []
    for i, (name, text) in enumerate(TEMPLATES * 2):
        words = text.split()
        if i >= len(TEMPLATES) and len(words) > 15:  # a near copy
            for _ in range(max(1, len(words) // 12)):
                words[r.randrange(1, len(words) - 1)] = r.choice(vocab)
        before, after = (" ".join(r.choice(vocab) for _ in range(r.randrange(0, 60))) for _ in range(2))
        docs.append((i, f"{before} Ünïcode 😀\n{' '.join(words)}\n{after}", name))
    docs += [(200 + k, " ".join(r.choice(vocab) for _ in range(300)), None) for k in range(20)]
    return docs


def test_planted_licences_are_found_whole_and_nothing_else(spark):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, license string").withColumn("start", F.lit("x")).withColumn("id", F.lit(0))
    got = {}
    for row in scan(df).collect():
        got.setdefault(row.doc_id, []).append(row)
    for i, text, name in docs:
        found = got.get(i, [])
        if name is None:
            assert found == []
            continue
        assert len(found) == 1, (name, found)
        row = found[0]
        words = [m.group() for m in _words(TEXT[row.license])]
        assert row.n_words == len(words) and row.n_matched == _best(words, [m.group() for m in _words(text)])
        if i < len(TEMPLATES):
            assert (row.license, row.coverage) == (name, 1.0)
            assert [m.group() for m in _words(text[row.start : row.end])] == words


def test_rows_of_every_kind(spark):
    line = TEXT["MIT-line"]
    rows = [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, "..."), (5, (line + " x ") * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.start, r.end) for r in scan(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 0, 30), (1, 0, 30), (None, 0, 30), *[(5, 34 * k, 34 * k + 30) for k in range(500)]]))
    assert scan(df.limit(0)).count() == 0


def test_query_against_a_search_for_the_lines(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.license, r.start, r.end) for r in QUERIES["op3_license_scan"](spark, sf_dir).collect() if r.coverage == 1}
    want = set()
    for i, text in texts.items():
        for name, line in TEMPLATES:
            for m in re.finditer(re.escape(line.rstrip(".")).replace(r"\ ", r"\s+"), text or ""):
                want.add((i, name, m.start(), m.end()))
    assert want and got >= want


def test_adjacent_notices_are_all_found(spark):
    one = "All rights reserved."
    df = spark.createDataFrame([(n, " ".join([one] * n)) for n in range(1, 8)], "doc_id int, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in scan(df).where("license = 'All-rights-reserved'").collect())
    assert got == [(n, k * 21, k * 21 + 19) for n in range(1, 8) for k in range(n)]
