"""Log-likelihood of whole documents under a gated recurrent language model trained on the corpus.

Tokens are words between ASCII white space, A to Z lower-cased, and one end a
document.  Every training document is counted.  The SHORTLIST commonest tokens are
symbols of the network; any other token is one of REST symbols, picked by a hash of
its last three bytes, times its share of that symbol's smoothed count, so the model
is a distribution over all counted tokens and one unseen token a symbol.

Training is truncated backpropagation.  A bounded sample sets the weights it starts
from.  All training documents are dealt to shares by their hash; each share goes on
from those weights through every token of its documents, in order of their hash and
in runs of RUN tokens, and the shares' weights are averaged by the tokens they saw.
How many shares there are depends on the tokens alone, so the same table gives the
same model on any cluster.  Scoring reads every token of every document and carries the
state from its first to its last.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru, worker
from .storage import written

END = "\n"
SMOOTHING = 0.1
#: Symbols of the network; tokens whose counts a task holds at most, the rest being joined.
SHORTLIST, REST = 4032, 64
FREQUENT = 65_536
#: Tokens of the sample that sets the weights training starts from, at most; documents in it, about.
START_TOKENS = 300_000
START_DOCUMENTS = 3000
#: Tokens of a share of the training documents: the least, held until there are SHARES of them, and the most that one task learns from in a row.
SHARE_TOKENS, SHARES, MOST_TOKENS = 1 << 20, 4096, 1 << 24
#: Models averaged at a time; runs side by side while a share is learned from.
FAN = 16
SHARE_LANES = 256
#: Tokens of a run.
RUN = 64
#: Characters of text that a task takes at a time; symbols that it scores at a time; distinct tokens that it counts at a time, and sends at a time.
TAKEN = 4_000_000
SCORED = 1 << 21
HELD, COUNTS_SENT = 1 << 19, 1 << 16
#: Symbols as they are written: there are fewer than 65,536.
SYMBOL = np.dtype("<u2")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text, modulo 10, is 0 (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 10 == 0


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text; ``bytes`` know only ASCII white space and letters."""
    return text.encode("utf-8").lower().split() if text else []


def rest_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % REST


@dataclass
class Vocabulary:
    """What a task needs to know of the tokens; its size is bounded by FREQUENT."""

    total: int
    types: int
    documents: int
    place: dict[bytes, int]
    symbol: np.ndarray
    log_count: np.ndarray
    log_share: np.ndarray
    rest_symbol: np.ndarray
    rest_log_total: np.ndarray
    symbol_counts: np.ndarray

    @property
    def end(self) -> int:
        """Symbol of the end, which is also what stands before a document."""
        return int(self.symbol[self.place[END.encode()]])

    @property
    def log_all(self) -> float:
        return math.log10(self.total + SMOOTHING * (self.types + 1))


def count_tokens(docs: DataFrame, text: Column) -> DataFrame:
    """``(token, c)`` over all rows; a task hands its counts on whenever it holds HELD tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.hold()
        counts: Counter[bytes] = Counter()
        for texts in (batch.column(0) for batch in batches):
            for part in _parts(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), TAKEN):
                counts.update(tokens_of(" ".join(filter(None, texts.slice(part.start, part.stop - part.start).to_pylist()))))
                counts[END.encode()] += part.stop - part.start
                if len(counts) >= HELD:
                    yield from _count_batches(counts)
                    counts.clear()
        yield from _count_batches(counts)

    found = docs.select(text.cast("string").alias("text")).mapInArrow(counted, "token string, c long")
    return found.groupBy("token").agg(F.sum("c").alias("c"))


def _count_batches(counts: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    tokens, times = list(counts), list(counts.values())
    for at in range(0, len(tokens), COUNTS_SENT):
        some = slice(at, at + COUNTS_SENT)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[some], pa.binary()).cast(pa.string()), pa.array(times[some], pa.int64())], names=["token", "c"])


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Rows in a row, cut whenever their sizes have reached ``most``; every row is in one part."""
    at = 0
    while at < len(sizes):
        end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at:]), most))
        yield slice(at, min(end, len(sizes)))
        at = end


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``counts(token, c)``; at most FREQUENT rows, and one a distinct count, reach the driver."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    left, least = FREQUENT - 1, 0
    for c, n in sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).toLocalIterator()), reverse=True):
        least, left = c, left - n
        if left < 0:
            least = c + 1
            break
    found = {r.token.encode("utf-8"): r.c for r in counts.where((F.col("c") >= least) | (F.col("token") == END)).toLocalIterator()}
    found.setdefault(END.encode(), 0)
    ranked = sorted(found, key=lambda w: (-found[w], w))
    short = ranked[:SHORTLIST]
    if END.encode() not in short:
        short[-1] = END.encode()
    rest = F.crc32(F.substring(F.encode("token", "UTF-8"), -3, 3)) % REST
    totals, sums = np.full(REST, SMOOTHING), np.zeros(REST)
    for k, c, n in counts.groupBy(rest.alias("k")).agg(F.sum("c"), F.count("*")).collect():
        totals[k] += c + SMOOTHING * n
        sums[k] += c
    for w in short:
        if found[w]:
            totals[rest_of(w)] -= found[w] + SMOOTHING
            sums[rest_of(w)] -= found[w]
    totals = np.maximum(totals, SMOOTHING)
    amounts = np.array([found[w] for w in short] + sums.tolist())
    amounts = np.concatenate([amounts, np.zeros(-len(amounts) % gru.WIDTH)])
    order = np.argsort(-amounts, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    place = {w: i for i, w in enumerate(short)}
    for w in ranked:
        place.setdefault(w, len(place))
    words = list(place)
    log_count = np.log10(np.array([found[w] for w in words]) + SMOOTHING)
    classes = np.array([rest_of(w) for w in words])
    symbol = np.where(np.arange(len(words)) < len(short), number[np.minimum(np.arange(len(words)), len(short) - 1)], number[len(short) + classes])
    log_share = np.where(np.arange(len(words)) < len(short), 0.0, log_count - np.log10(totals[classes]))
    return Vocabulary(int(total), int(types), found[END.encode()], place, symbol, log_count, log_share, number[len(short) : len(short) + REST], np.log10(totals), amounts[order])


def encode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """A row each of ``rows(id, text, held_out)``, for training and for scoring: its symbols, each two bytes, and what is known of it without the network.

    ``order`` is a hash of the row, ``own`` the logarithm of its tokens' shares of their symbols, ``tokens`` those
    that are not among the frequent ones and ``times`` how often each of them stands in the text.
    """
    known = rows.sparkSession.sparkContext.broadcast(v)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("order", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()), T.StructField("own", T.DoubleType()), T.StructField("symbols", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.hold()
        v = known.value
        number = v.symbol.astype(SYMBOL)
        unknown, end = np.log10(SMOOTHING) + 1e-9, v.place[END.encode()]
        log_count, log_share = np.append(v.log_count, 0.0), np.append(v.log_share, 0.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _parts(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), TAKEN):
                n = part.stop - part.start
                found = [tokens_of(text) for text in batch.column(1).slice(part.start, n).to_pylist()]
                lengths = np.fromiter(map(len, found), np.int64, n) + 1
                ends = np.cumsum(lengths)
                begins = ends - lengths
                place = np.empty(int(ends[-1]), np.int64)
                place[ends - 1] = end
                inner = np.ones(len(place), bool)
                inner[ends - 1] = False
                place[inner] = np.fromiter(map(v.place.get, chain.from_iterable(found), repeat(-1)), np.int64, len(place) - n)
                symbol = number[place]
                counts = log_count[place]
                own = np.add.reduceat(log_share[place], begins)
                known_tokens = np.add.reduceat((counts > unknown) & (place >= 0), begins, dtype=np.int64)
                tokens, times = [[] for _ in range(n)], [[] for _ in range(n)]
                others = np.flatnonzero(place < 0)
                of = np.searchsorted(ends, others, side="right")
                rare = [found[i][j] for i, j in zip(of.tolist(), (others - begins[of]).tolist(), strict=True)]
                if rare:
                    rest = np.fromiter(map(rest_of, rare), np.int64, len(rare))
                    symbol[others] = v.rest_symbol[rest]
                    own -= np.bincount(of, weights=v.rest_log_total[rest], minlength=n)
                    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        some = Counter(rare[a:b])
                        tokens[of[a]], times[of[a]] = list(some), list(some.values())
                data = pa.py_buffer(symbol.tobytes())
                offsets = pa.py_buffer((np.concatenate([[0], ends]) * symbol.itemsize).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column(0).slice(part.start, n), batch.column(2).slice(part.start, n), batch.column(3).slice(part.start, n), pa.array(lengths), pa.array(known_tokens),
                    pa.array(np.add.reduceat(counts, begins)), pa.array(own), pa.Array.from_buffers(pa.binary(), n, [None, offsets, data]), pa.array(tokens, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64())),
                ], names=schema.names)
                row += n

    return rows.select("id", "text", "held_out", F.xxhash64("id", "text").alias("order")).mapInArrow(run, schema)


def _runs(texts: Iterator[bytes]) -> Iterator[np.ndarray]:
    """The runs that are learned from: each text's symbols from its first token to its end."""
    for text in texts:
        symbol = np.frombuffer(text, SYMBOL)
        for begin in range(0, len(symbol), RUN):
            yield symbol[begin : begin + RUN]


def fit(train: DataFrame, v: Vocabulary) -> tuple[dict[str, np.ndarray], int]:
    """Weights learned from ``train(id, text)``, see the module's text; the tokens learned from after the start, which are all there are."""
    return learn(written(encode(train.select("id", F.col("text").cast("string").alias("text"), F.lit(False).alias("held_out")), v), "encoded"), v)


def learn(coded: DataFrame, v: Vocabulary) -> tuple[dict[str, np.ndarray], int]:
    """As :func:`fit`, from ``coded(order, symbols)``."""
    spark = coded.sparkSession
    size, counts, end = len(v.symbol_counts), v.symbol_counts, v.end
    schema = "share long, weights binary, seen double"
    arrow = pa.schema([("share", pa.int64()), ("weights", pa.binary()), ("seen", pa.float64())])

    def row(share: int, weights: np.ndarray, seen: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"share": [share], "weights": [weights.astype(np.float32).tobytes()], "seen": [float(seen)]}, schema=arrow)

    def bounded(texts: Iterator[bytes]) -> Iterator[np.ndarray]:
        left = START_TOKENS
        for run in _runs(texts):
            if left <= 0:
                return
            left -= len(run)
            yield run

    def by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
        rows = (r for batch in batches for r in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        return groupby(rows, key=lambda r: r[0])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.hold()
        for share, rows in by_share(batches):
            weights = gru.fresh(counts)
            seen = gru.train(weights, bounded(r[1] for r in rows), end)
            yield row(share, gru.packed(weights), seen)

    # a part of the rows by their hash, about START_DOCUMENTS whatever the corpus; copies are as rare in it as there
    hashed = coded.select("order", "symbols")
    part = min(1.0, START_DOCUMENTS / max(1, v.documents))
    picked = hashed.where(F.pmod("order", F.lit(1 << 30)) < int(part * (1 << 30))).repartition(1).sortWithinPartitions("order", "symbols")
    first = picked.select(F.lit(0).cast("long").alias("share"), "symbols").mapInArrow(start, schema).collect()
    weights = np.frombuffer(first[0].weights, np.float32) if first else gru.packed(gru.fresh(v.symbol_counts))
    begun = spark.sparkContext.broadcast(weights)

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.hold()
        for share, rows in by_share(batches):
            mine = gru.unpacked(begun.value, size)
            seen = gru.train(mine, _runs(r[1] for r in rows), end, SHARE_LANES)
            yield row(share, gru.packed(mine), seen)

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, rows in by_share(batches):
            total, seen = np.zeros(len(begun.value)), 0.0
            for _, _, w, n in rows:
                total += np.frombuffer(w, np.float32) * n
                seen += n
            if seen:
                yield row(share, total / seen, seen)

    shares = max(1, min(SHARES, -(-v.total // SHARE_TOKENS)), -(-v.total // MOST_TOKENS))
    dealt = hashed.withColumn("share", F.pmod("order", F.lit(shares))).repartition("share").sortWithinPartitions("share", "order", "symbols")
    learned = dealt.select("share", "symbols").mapInArrow(go_on, schema)
    while shares > 1:  # a level a job; no task and no driver sees more than FAN models at once
        learned = written(learned, "models").withColumn("up", F.floor(F.col("share") / FAN)).repartition("up").sortWithinPartitions("up", "share")
        learned = learned.select("up", "share", "weights", "seen").mapInArrow(averaged, schema)
        shares = -(-shares // FAN)
    last = learned.collect()
    return (gru.unpacked(np.frombuffer(last[0].weights, np.float32), size), int(last[0].seen)) if last else (gru.unpacked(weights, size), 0)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, from its whole text.

    A null text counts as empty and has one token, its end; a null id counts as the
    empty text in the choice of held-out rows; repeated rows count as often as they
    occur and give repeated rows; other columns are not read.  Without any training
    row every token is unseen.  Scores are base-10 logarithms.

    Counts of frequent tokens go to the tasks; the others of each document are
    joined with the table of counts, and their sums brought back to the document.
    The symbols of all texts are written once, for training and for scoring.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = written(count_tokens(train, F.col("text")), "token-counts")
    v = vocabulary(counts)
    coded = written(encode(rows, v), "encoded")
    learned = spark.sparkContext.broadcast(gru.packed(learn(coded.where(~F.col("held_out")), v)[0]))
    n_symbols, end = len(v.symbol_counts), v.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.hold()
        weights = gru.unpacked(learned.value, n_symbols)
        for batch in batches:
            symbols = [np.frombuffer(x, SYMBOL) for x in batch.column("symbols").to_pylist()]
            score = np.empty(len(symbols))
            for part in _parts(np.fromiter(map(len, symbols), np.int64, len(symbols)), SCORED):
                score[part] = gru.score(weights, symbols[part], end)
            score = pa.array(score / math.log(10) + batch.column("own").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), score], names=[*kept, "score"])

    kept = ["row", "id", "held_out", "n_tokens", "known", "base"]
    out = T.StructType([coded.schema[n] for n in kept]).add("score", T.DoubleType())
    scored = coded.select(*kept, "own", "symbols").mapInArrow(run, out)
    rare = coded.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", F.col("x.tokens").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + SMOOTHING)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return scored.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + more_known).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * v.log_all).alias("base_score"), (F.col("score") + more).alias("score"),
    )
