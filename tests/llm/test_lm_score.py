import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import gru, lm_score
from ruleloom.llm.registry import QUERIES


def _tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def _base(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in _tokens(text))
    n, v = c.total(), len(c)
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        ts = _tokens(text)
        out.append((i, h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)))
    return out


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    w = {k: x.astype(np.float64) for k, x in gru.fresh(r.integers(0, 9, 2 * gru.WIDTH)).items()}
    x, y, mask, h = r.integers(0, 128, (5, 3)), r.integers(0, 128, (5, 3)), r.random((5, 3)) < 0.8, r.normal(size=(3, gru.HIDDEN))
    loss = lambda: gru.Trainer(w).gradients(x, y, mask, h)[2]
    found, _, _ = gru.Trainer(w).gradients(x, y, mask, h)
    for name, (gradient, rows) in found.items():
        full = np.zeros_like(w[name])
        full[rows] = gradient
        for _ in range(12):
            at = tuple(r.integers(0, n) for n in w[name].shape) if name not in ("embedding", "out") else (int(r.choice(rows)), int(r.integers(0, w[name].shape[1])))
            keep, step = w[name][at], 1e-3
            w[name][at] = keep + step
            up = loss()
            w[name][at] = keep - step
            down = loss()
            w[name][at] = keep
            assert full[at] * gru.WINDOW * gru.LANES == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-3), (name, at)


def test_a_step_is_a_distribution_and_state_is_carried_over_windows():
    r = np.random.default_rng(2)
    w = gru.fresh(r.integers(1, 50, 192))
    h = r.normal(size=(1, gru.HIDDEN)).astype(np.float32)
    assert np.exp(gru.log_probabilities(w, np.repeat(h, 192, 0), np.arange(192))).sum() == pytest.approx(1, abs=1e-5)
    runs = [r.integers(0, 192, n) for n in (1, 5, 47, 48, 49, 200)]
    for got, run in zip(gru.score(w, runs, 3), runs, strict=True):
        h, want, before = np.zeros((1, gru.HIDDEN), np.float32), 0.0, 3
        for s in run:
            states, _ = gru._steps(w, w["embedding"] @ w["input"] + w["bias"], np.array([[before]]), h)
            h, before = states[0], s
            want += gru.log_probabilities(w, h, np.array([s]))[0]
        assert got == pytest.approx(want, rel=1e-5)


def test_training_learns_what_follows_what():
    r = np.random.default_rng(3)
    runs = [np.cumsum(r.integers(1, 2, 40)) % 64 for _ in range(900)]
    w = gru.fresh(np.ones(64))
    before = gru.score(w, runs[:50], 0).sum()
    assert gru.train(w, iter(runs), 0) == 900 * 40
    assert gru.score(w, runs[:50], 0).sum() > 0.5 * before


@pytest.mark.parametrize("frequent", [65_536, 120])
def test_base_scores_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    monkeypatch.setattr(lm_score, "SHORTLIST", 60)
    r = random.Random(4)
    vocab = ["".join(r.choice("abÉéZY.x\x85") for _ in range(r.randrange(1, 5))) for _ in range(400)]
    rows = [(k, r.choice([" ", "\n", "\x0b "]).join(r.choice(vocab[: r.choice([20, 400])]) for _ in range(r.randrange(0, 90)))) for k in range(150)]
    rows += [(None, "a b"), (None, None), (1000, None), (1001, ""), (1002, " \t "), *[(7, rows[7][1])] * 5, (1003, "a " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    _same([tuple(x) for x in lm_score.score_documents(df).collect()], _base(rows))


def test_empty_table_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "only held out")], "doc_id long, text string")
    (row,) = lm_score.score_documents(df).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 4, 0, 0)
    assert lm_score.score_documents(df.limit(0)).count() == 0


def test_query_on_whole_table_beats_the_base_on_held_out_documents(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(x) for x in QUERIES["op1_lm_score"](spark, sf_dir).collect()]
    _same(got, _base(rows))
    assert sum(x[6] for x in got if x[1]) > sum(x[5] for x in got if x[1])


def test_every_token_of_every_training_document_is_learned_from(spark):
    rows = [(k, " ".join("abcdefgh"[(k + i) % 8] for i in range(n))) for k, n in enumerate([0, 1, 5, 63, 64, 65, 130, 1023, 1024, 5000, *[7] * 40])]
    rows += [(100, "one text of many copies")] * 30 + [(101, "x " * 60_000), (None, "a"), (102, None)]
    train = spark.createDataFrame(rows, "id long, text string").repartition(5)
    v = lm_score.vocabulary(lm_score.count_tokens(train, F.col("text")))
    _, seen = lm_score.fit(train, v)
    assert seen == v.total == sum(len(_tokens(text)) for _, text in rows)


def _plain_score(v, w, text):
    """The model's definition, a number at a time."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda row, m, j: sum(float(a) * float(m[i][j]) for i, a in enumerate(row))
    n, counted = gru.HIDDEN, {t: 10**c - 0.1 for t, c in ((t, v.log_count[i]) for t, i in v.place.items())}
    h, before, total = [0.0] * n, v.end, 0.0
    for token in [t.encode() for t in _tokens(text)]:
        if token in v.place:
            symbol, share = int(v.symbol[v.place[token]]), float(v.log_share[v.place[token]])
        else:
            k = lm_score.rest_of(token)
            symbol, share = int(v.rest_symbol[k]), math.log10(counted.get(token, 0) + 0.1) - float(v.rest_log_total[k])
        a = [dot(w["embedding"][before], w["input"], j) + float(w["bias"][j]) for j in range(3 * n)]
        g = [dot(h, w["recurrent"], j) for j in range(3 * n)]
        z, r = [sig(a[j] + g[j]) for j in range(n)], [sig(a[n + j] + g[n + j]) for j in range(n)]
        new = [math.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
        h = [new[j] + z[j] * (h[j] - new[j]) for j in range(n)]
        scores = [dot(h, w["class_out"], c) + float(w["class_bias"][c]) for c in range(len(w["class_bias"]))]
        inner = range(symbol // gru.WIDTH * gru.WIDTH, symbol // gru.WIDTH * gru.WIDTH + gru.WIDTH)
        within = [sum(h[i] * float(w["out"][s][i]) for i in range(n)) + float(w["out_bias"][s]) for s in inner]
        log_all = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
        total += (scores[symbol // gru.WIDTH] - log_all(scores) + within[symbol % gru.WIDTH] - log_all(within)) / math.log(10) + share
        before = symbol
    return total


def test_scores_against_a_plain_forward_pass_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHORTLIST", 60)
    monkeypatch.setattr(lm_score, "SHARE_TOKENS", 500)
    monkeypatch.setattr(lm_score, "FAN", 3)
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 5))) for _ in range(300)]
    rows = [(k, " ".join(r.choice(vocab[: r.choice([20, 300])]) for _ in range(r.randrange(0, 80)))) for k in range(200)] + [(None, "New words only"), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where(~lm_score.held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "id")
    v = lm_score.vocabulary(lm_score.count_tokens(train, F.col("text")))
    w, seen = lm_score.fit(train.repartition(3), v)
    assert seen == v.total > 3 * 500
    got = {x.doc_id: x.score for x in lm_score.score_documents(df.repartition(7)).collect()}
    for i, text in [*r.sample(rows, 25), rows[-1], rows[-2]]:
        assert got[i] == pytest.approx(_plain_score(v, w, text), rel=1e-4), text


def test_held_out_documents_at_a_larger_scale(spark, sf_dir):
    larger = Path(sf_dir).parent / "sf0.1"
    if not larger.exists():
        pytest.skip("no tables of sf0.1")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    train = docs.where(~lm_score.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text")
    v = lm_score.vocabulary(lm_score.count_tokens(train, F.col("text")))
    assert lm_score.fit(train, v)[1] == v.total
    held = [x for x in QUERIES["op1_lm_score"](spark, str(larger)).collect() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_lanes_read_texts_one_after_the_other_from_an_empty_state():
    r = np.random.default_rng(5)
    lengths = np.array([1000, *r.integers(0, 30, 400)])
    lanes = gru._lanes(lengths, 256)
    assert sorted(i for some in lanes for i in some) == list(range(401))
    assert max(lengths[some].sum() for some in lanes) * len(lanes) < 2 * lengths.sum()
    w = gru.fresh(r.integers(1, 50, 192))
    runs = [r.integers(0, 192, n) for n in (0, 1, 47, 48, 49, 100, 3, 3, 200)]
    alone = [gru.score(w, [run], 3)[0] for run in runs]
    for n in (1, 2, 5):
        assert gru.score(w, runs, 3, n) == pytest.approx(alone, rel=1e-5)
    assert len(gru.score(w, [], 3)) == 0


def test_texts_are_encoded_once_with_what_their_scores_need(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 20)
    monkeypatch.setattr(lm_score, "SHORTLIST", 10)
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abcdefghijklmnopqrstuvwxyzé") * 2 for _ in range(r.randrange(0, 60)))) for k in range(60)] + [(60, None), (61, "Unseen words UNSEEN")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("held_out", F.col("id") > 50)
    want = Counter(t for _, text in rows[:51] for t in _tokens(text))
    counts = lm_score.count_tokens(df.where("not held_out"), F.col("text"))
    assert {x.token: x.c for x in counts.collect()} == want
    v = lm_score.vocabulary(counts)
    for x in lm_score.encode(df.repartition(3), v).collect():
        ts = _tokens(rows[x.id][1])
        others = Counter(t for t in ts if t.encode() not in v.place)
        assert (x.n_tokens, len(x.symbols), dict(zip(x.tokens, x.times, strict=True))) == (len(ts), 2 * len(ts), others)
        symbols = [v.symbol[v.place[t.encode()]] if t.encode() in v.place else v.rest_symbol[lm_score.rest_of(t.encode())] for t in ts]
        assert np.frombuffer(x.symbols, lm_score.SYMBOL).tolist() == symbols
        assert x.known == sum(want[t] > 0 for t in ts if t not in others)
