import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ruleloom.llm.components import components
from ruleloom.llm.near_dedup import near_duplicates, one_of_each, probability_jaccard, signatures, weighted
from ruleloom.llm.registry import QUERIES
from ruleloom.llm.shingles import shingles, slices


def _bag(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _alike(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in {*a, *b}) for d in a if d in b)


def _classes(rows):
    """Brute force: all pairs that share a shingle, then union."""
    texts = sorted({t or "" for _, t in rows})
    bags = [_bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for k, bag in enumerate(bags):
        for g in bag:
            where.setdefault(g, []).append(k)
    for a, b in {(a, b) for ks in where.values() for a in ks for b in ks if a < b}:
        small, big = sorted((len(bags[a]), len(bags[b])))
        if small >= 0.5 * big and find(a) != find(b) and _alike(bags[a], bags[b]) >= 0.8:
            root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(texts.index(t or ""))
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, least[find(texts.index(t or ""))]) for i, t in rows), key=str)


def _corpus(r, n=40):
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 6))) for _ in range(500)]
    say = lambda k: [r.choice(vocab) for _ in range(k)]
    rows = [(None, None), (900, ""), (901, None), (902, "one two"), (903, "One, two!"), (904, "one three"), (905, "...")]
    for g in range(n):
        base = say(r.choice([3, 20, 120, 400]))
        for c in range(r.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows += [(g * 100 + c, " ".join(words))] * r.choice([1, 1, 1, 2])
    chain = say(200)
    for k in range(12):  # each like the next, the ends unlike
        rows.append((5000 + k, " ".join(chain)))
        chain = chain[8:] + say(8)
    return rows


def test_classes_against_brute_force(spark):
    rows = _corpus(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x")).withColumn("node", F.lit(1))
    got = sorted(((x.doc_id, x.class_id) for x in near_duplicates(df).collect()), key=str)
    assert got == _classes(rows)


def test_bucket_with_many_unlike_members_is_compared_whole(spark, monkeypatch):
    """All texts meet in one bucket, none is like the least node, and the links lie among the others."""
    import ruleloom.llm.near_dedup as m

    monkeypatch.setattr(m, "LEADERS", 2)
    r = random.Random(9)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for g in range(8):
        own = [f"o{g}x{k}" for k in range(30)]
        rows += [(10 * g + c, " ".join(shared + own + [f"e{g}c{c}"])) for c in range(3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((x.doc_id, x.class_id) for x in m.near_duplicates(df).collect()), key=str) == _classes(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_slots_estimate_the_probability_jaccard():
    r = random.Random(1)
    say = [f"w{r.randrange(40)}" for _ in range(3000)]
    other = [w if r.random() > 0.03 else "z" for w in say]
    (s,) = slices(pa.array([" ".join(say), " ".join(other)]))
    text, h, weight = weighted(*shingles(s, 5))
    sets = [(h[text == k], weight[text == k]) for k in (0, 1)]
    exact = _alike(_bag(" ".join(say)), _bag(" ".join(other)))
    assert abs(probability_jaccard(*sets) - exact) < 1e-9
    seen = [np.mean(np.equal(*signatures(text, h ^ np.uint64(salt), weight, 2))) for salt in range(200)]
    assert abs(np.mean(seen) - exact) < 0.02


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1100), 1000)}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((x.doc_id, x.class_id) for x in QUERIES["op6_near_duplicates"](spark, sf_dir).collect()), key=str)
    assert got == _classes(rows)


def test_one_of_each_keeps_clashing_columns_and_takes_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(2, long, "a", 1), (1, long + " end", "b", 2), (3, "other", "c", 3), (3, "other", "c", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string, `a.b` int").withColumn("_id", F.lit("i")).withColumn("c0", F.lit(7)).withColumn("node", F.lit(0))
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r._node, r["a.b"], r._id, r.c0) for r in kept.collect()), key=str) == [(1, "b", 2, "i", 7), (3, "c", 3, "i", 7), (None, None, None, "i", 7)]
