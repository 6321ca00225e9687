import random
from collections import Counter

from ruleloom.operators import corpus


def _junk(text):
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    counts = Counter(bare)
    short = [0 < len(s) <= 30 and not any(c.isdigit() for c in s) and s[-1] not in ".:;,)\"”" for s in bare]
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and (short[j] or (j > i and not bare[j])):
            j += 1
        if sum(short[i:j]) >= 4:
            out += [(k, lines[k]) for k in range(i, j) if short[k] and counts[bare[k]] >= 3]
        i = max(j, i + 1)
    return out


def test_only_repeats_inside_runs_are_junk(spark):
    r = random.Random(1)
    pick = ["Home", " Home ", "About us", "", "", "A sentence.", "Call 555", "x" * 31, "Menu", "end,"]
    texts = ["Home\nA sentence.\nHome\nA sentence.\nHome", "\n".join(["Home", "", "Menu"] * 3), "", *["\n".join(r.choice(pick) for _ in range(r.randrange(1, 40))) for _ in range(150)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((x.doc_id, x.line_no, x.line) for x in corpus.junk_runs(corpus.lines(docs)).collect())
    want = sorted((d, k, line) for d, text in enumerate(texts) for k, line in _junk(text))
    assert got == want and {d for d, *_ in want} and not [1 for d, *_ in want if d == 0]
