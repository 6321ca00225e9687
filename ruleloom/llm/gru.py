"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are numbered by falling frequency and class ``k`` holds the symbols from
``k * WIDTH`` on, so a symbol's probability is that of its class times that of the
symbol within it, and no sum goes over all symbols.
"""

from __future__ import annotations

from heapq import heapreplace
from itertools import islice

import numpy as np

WIDTH = 64
EMBEDDING, HIDDEN = 24, 32
#: Steps of a window and texts side by side: in training, where the gradient is cut, and in scoring, which carries the state on.
WINDOW, LANES = 16, 128
SCORED_WINDOW, SCORED_LANES = 48, 256
LEARNING_RATE = 0.05
#: States whose symbols are looked up at a time.
PICKED = 4096
#: Rows of a step's column: after the symbol's vector the state, and last a one.
STATE, LAST = slice(EMBEDDING, EMBEDDING + HIDDEN), EMBEDDING + HIDDEN

NAMES = ("embedding", "input", "recurrent", "bias", "class_out", "class_bias", "out", "out_bias")


def fresh(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights before training; the biases already say how often each symbol occurs. ``len(counts)`` is a multiple of WIDTH."""
    r = np.random.default_rng(seed)
    m = len(counts)
    p = (counts + 0.5).reshape(-1, WIDTH)
    small = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[-1])).astype(np.float32)
    return {
        "embedding": small(m, EMBEDDING), "input": small(EMBEDDING, 3 * HIDDEN), "recurrent": small(HIDDEN, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32),
        "class_out": small(HIDDEN, m // WIDTH) * 0.1, "class_bias": np.log(p.sum(axis=1) / p.sum()).astype(np.float32),
        "out": small(m, HIDDEN) * 0.1, "out_bias": np.log(p / p.sum(axis=1, keepdims=True)).reshape(-1).astype(np.float32),
    }


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[n].reshape(-1) for n in NAMES]).astype(np.float32)


def unpacked(flat: np.ndarray, symbols: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, like in fresh(np.zeros(symbols)).items():
        out[name] = flat[at : at + like.size].reshape(like.shape).copy()
        at += like.size
    return out


def _steps(w: dict[str, np.ndarray], table: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
    """In plain form what :func:`_forward` does: states after each of the steps ``x`` (steps, lanes), as (steps, lanes, HIDDEN), and the gates."""
    states, gates = np.empty((len(x), *h.shape), table.dtype), []
    for t in range(len(x)):
        a, g = table[x[t]], h @ w["recurrent"]
        z, r = np.split(1 / (1 + np.exp(-a[:, : 2 * HIDDEN] - g[:, : 2 * HIDDEN])), 2, axis=1)
        new = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        states[t] = h = new + z * (h - new)
        gates.append((z, r, new))
    return states, gates


def _joined(w: dict[str, np.ndarray]) -> np.ndarray:
    """All weights of a step, to be multiplied with a column of symbol's vector, state and one.

    Rows: what the reset gate holds back of the new state, both gates with their sign turned, the rest of the new state.
    """
    m = np.zeros((4 * HIDDEN, LAST + 1), w["bias"].dtype)
    m[:HIDDEN, STATE] = w["recurrent"][:, 2 * HIDDEN :].T
    m[HIDDEN : 3 * HIDDEN, STATE] = -w["recurrent"][:, : 2 * HIDDEN].T
    m[HIDDEN:, :EMBEDDING], m[HIDDEN:, LAST] = w["input"].T, w["bias"]
    m[HIDDEN : 3 * HIDDEN, :EMBEDDING] *= -1
    m[HIDDEN : 3 * HIDDEN, LAST] *= -1
    return m


def _columns(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each step a column a lane: the symbol's vector, the state before it (of the first step ``h``, of the others to be filled in), and one; a last one for the state in the end."""
    steps, lanes = x.shape
    u = np.empty((steps + 1, LAST + 1, lanes), w["embedding"].dtype)
    u[:-1, :EMBEDDING] = w["embedding"].take(x, axis=0).transpose(0, 2, 1)
    u[0, STATE] = h.T
    u[:, LAST] = 1
    return u


def _forward(joined: np.ndarray, u: np.ndarray, parts, begin=()) -> None:
    """Fills in the states of ``u``; ``parts[t]`` gets the four blocks of step ``t``. ``begin``: steps and lanes where a text begins, by step."""
    steps = len(u) - 1
    at, next_at = 0, begin[0][0] if begin else steps
    for t in range(steps):
        column, p, after = u[t], parts[t], u[t + 1, STATE]
        if t == next_at:  # the state that was read up to here stays
            column = column.copy()
            while t == next_at:
                column[STATE, begin[at][1]] = 0
                at += 1
                next_at = begin[at][0] if at < len(begin) else steps
        np.matmul(joined, column, out=p)
        both, new = p[HIDDEN : 3 * HIDDEN], p[3 * HIDDEN :]
        np.exp(both, out=both)
        np.add(both, 1, out=both)
        np.reciprocal(both, out=both)
        np.multiply(both[HIDDEN:], p[:HIDDEN], out=after)
        np.add(new, after, out=new)
        np.tanh(new, out=new)
        np.subtract(column[STATE], new, out=after)
        np.multiply(after, both[:HIDDEN], out=after)
        np.add(after, new, out=after)


def _shifted(x: np.ndarray, axis: int) -> np.ndarray:
    """Logits that can be raised without overflow: less by their largest, where one is far from 0."""
    if x.size and (x.max() > 80 or x.min() < -80):
        x -= x.max(axis=axis, keepdims=True)
    return x


def _by_class(y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """``rows`` in the order of the classes of ``y[rows]``; each class that occurs, and where its rows begin and end there."""
    k = (y[rows] // WIDTH).astype(np.int16)
    order = np.argsort(k, kind="stable")
    k = k[order]
    cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
    return rows[order], [(int(k[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _with_biases(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights out of a state with a one behind it, to the classes (by column) and to the symbols (by row)."""
    return np.concatenate([w["class_out"], w["class_bias"][None]]), np.concatenate([w["out"], w["out_bias"][:, None]], axis=1)


def log_probabilities(w: dict[str, np.ndarray], states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probability of symbol ``y[i]`` after state ``states[i]``."""
    return _looked_up(*_with_biases(w), np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1), y)


def _looked_up(class_out: np.ndarray, out: np.ndarray, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same with a one behind each state, and weights of :func:`_with_biases`."""
    found = np.empty(len(y))
    for begin in range(0, len(y), PICKED):
        part = slice(begin, begin + PICKED)
        order, classes = _by_class(y[part], np.arange(len(y[part])))
        symbol, some = y[part][order], states[part].take(order, axis=0)
        within = np.empty((len(symbol), WIDTH), some.dtype)
        for k, a, b in classes:
            np.matmul(some[a:b], out[k * WIDTH : (k + 1) * WIDTH].T, out=within[a:b])
        total = np.zeros(len(symbol))
        for x, target in ((some @ class_out, symbol // WIDTH), (within, symbol % WIDTH)):
            own = _shifted(x, 1)[np.arange(len(symbol)), target].astype(float)
            np.exp(x, out=x)
            total += own - np.log(x @ np.ones(x.shape[1], x.dtype))
        found[begin + order] = total
    return found


class Trainer:
    """Truncated backpropagation with one learning rate a weight, falling with its gradients (Adagrad)."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.sums = {n: np.full(x.shape, 1e-6, np.float32) for n, x in weights.items()}
        self.symbols = np.arange(len(weights["out"]))

    def _move(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        sums = self.sums[name][rows]
        sums += gradient * gradient
        step = np.sqrt(sums)
        np.divide(gradient, step, out=step)
        step *= LEARNING_RATE
        if isinstance(rows, slice):  # sums are a view then
            self.w[name] -= step
        else:
            self.sums[name][rows] = sums
            self.w[name][rows] -= step

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[dict[str, tuple[np.ndarray, np.ndarray | slice]], np.ndarray, float]:
        """Gradients of the loss over one window (steps, lanes), by the symbols of a full one; the state after it; the summed loss."""
        w = self.w
        steps, lanes = x.shape
        kind = w["out"].dtype
        u = _columns(w, x, h)
        parts = np.empty((steps, 4 * HIDDEN, lanes), u.dtype)
        _forward(_joined(w), u, parts)
        before, after = u[:-1, STATE], u[1:, STATE.start :]
        class_out, out = _with_biases(w)
        weight = mask.astype(kind) / kind.type(WINDOW * LANES)
        every = slice(None)

        # classes: (steps, classes, lanes)
        d = np.matmul(class_out.T, after)
        at = (np.arange(steps)[:, None] * d.shape[1] + y // WIDTH) * lanes + np.arange(lanes)
        own = _shifted(d, 1).reshape(-1)[at]
        np.exp(d, out=d)
        total = d.sum(axis=1)
        loss = -float(((own - np.log(total)) * mask).sum())
        d *= (weight / total)[:, None]
        d.reshape(-1)[at] -= weight
        sums = np.matmul(after, d.transpose(0, 2, 1)).sum(axis=0)
        found = {"class_out": (sums[:-1], every), "class_bias": (sums[-1], every)}
        back = np.matmul(w["class_out"], d)

        # symbols of a class: a row a symbol that counts, class by class
        flat = y.reshape(-1)
        order, classes = _by_class(flat, np.flatnonzero(mask.reshape(-1)))
        some = after.transpose(0, 2, 1).reshape(-1, HIDDEN + 1).take(order, axis=0)
        target = flat[order] % WIDTH
        d = np.empty((len(order), WIDTH), kind)
        for k, a, b in classes:
            np.matmul(some[a:b], out[k * WIDTH : (k + 1) * WIDTH].T, out=d[a:b])
        own = _shifted(d, 1)[np.arange(len(order)), target]
        np.exp(d, out=d)
        total = d @ np.ones(WIDTH, kind)
        loss -= float((own - np.log(total)).sum())
        weight = kind.type(1 / (WINDOW * LANES))
        d *= (weight / total)[:, None]
        d[np.arange(len(order)), target] -= weight
        sums, sorted_back = np.zeros_like(out), np.empty((len(order) + 1, HIDDEN), kind)
        sorted_back[-1] = 0
        place = np.full(steps * lanes, len(order))
        place[order] = np.arange(len(order))
        for k, a, b in classes:
            np.matmul(d[a:b].T, some[a:b], out=sums[k * WIDTH : (k + 1) * WIDTH])
            np.matmul(d[a:b], w["out"][k * WIDTH : (k + 1) * WIDTH], out=sorted_back[a:b])
        back += sorted_back.take(place, axis=0).reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
        found |= {"out": (sums[:, :-1], self.symbols), "out_bias": (sums[:, -1], self.symbols)}

        # through the gates: what a change of a state does to them, for all steps at once, then step by step
        over, z, r, new = parts.reshape(steps, 4, HIDDEN, lanes).transpose(1, 0, 2, 3)
        by = np.empty((steps, 4, HIDDEN, lanes), kind)
        other = 1 - z
        np.subtract(before, new, out=by[:, 1])
        by[:, 1] *= z
        by[:, 1] *= other
        np.multiply(new, new, out=by[:, 3])
        np.subtract(1, by[:, 3], out=by[:, 3])
        by[:, 3] *= other
        np.multiply(by[:, 3], r, out=by[:, 0])
        np.subtract(1, r, out=other)
        other *= over
        np.multiply(by[:, 0], other, out=by[:, 2])
        recurrent = np.roll(w["recurrent"], HIDDEN, axis=1)
        da = by.reshape(steps, 4 * HIDDEN, lanes)
        dh, kept = np.zeros((2, HIDDEN, lanes), kind)
        for t in reversed(range(steps)):
            back[t] += dh
            by[t] *= back[t]
            np.matmul(recurrent, da[t, : 3 * HIDDEN], out=dh)
            np.multiply(back[t], z[t], out=kept)
            dh += kept
        da = da.transpose(0, 2, 1)
        sums = np.matmul(u[:-1], da).sum(axis=0)
        found |= {"recurrent": (np.roll(sums[STATE, : 3 * HIDDEN], -HIDDEN, axis=1), every), "bias": (sums[LAST, HIDDEN:], every), "input": (sums[:EMBEDDING, HIDDEN:], every)}
        symbols = x.reshape(-1).astype(np.int16 if len(out) < 1 << 15 else np.int64)
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(symbols)) + 1])
        rows = np.matmul(da[:, :, HIDDEN:], w["input"].T).reshape(-1, EMBEDDING)
        found["embedding"] = (np.add.reduceat(rows.take(order, axis=0), starts), symbols[starts].astype(np.int64))
        return found, u[-1, STATE].T, loss

    def learn(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        found, h, loss = self.gradients(x, y, mask, h)
        for name, (gradient, rows) in found.items():
            self._move(name, np.clip(gradient, -1, 1), slice(None) if rows is self.symbols else rows)
        return h, loss


def train(weights: dict[str, np.ndarray], texts, first: int, lanes: int = LANES) -> int:
    """Learns from runs of symbols, ``lanes`` at a time; returns how many symbols it saw.

    Each run begins with the symbol ``first`` as its context and an empty state; the
    state is carried from window to window of a run.  The runs of a batch stand side by
    side, longest first, so that a window holds those that reach it and no others.
    """
    trainer, seen = Trainer(weights), 0
    source = iter(texts)
    while runs := sorted((r for r in islice(source, lanes) if len(r)), key=len, reverse=True):
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(lengths)
        y = np.zeros((int(lengths[0]), len(runs)), np.int64)
        y[np.arange(ends[-1]) - np.repeat(ends - lengths, lengths), np.repeat(np.arange(len(runs)), lengths)] = np.concatenate(runs)
        x = np.vstack([np.full((1, len(runs)), first), y[:-1]])
        h = np.zeros((len(runs), HIDDEN), np.float32)
        for at in range(0, len(y), WINDOW):
            live = int(np.count_nonzero(lengths > at))
            part = slice(at, at + WINDOW), slice(0, live)
            mask = np.arange(at, at + len(y[part]))[:, None] < lengths[None, :live]
            h, _ = trainer.learn(x[part], y[part], mask, h[:live])
        seen += int(ends[-1])
    return seen


def _lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """The texts of each lane, one after the other; as many lanes as the longest text leaves work for, the fullest first."""
    n = max(1, min(most, -(-int(lengths.sum()) // max(1, int(lengths.max(initial=0))))))
    lanes: list[list[int]] = [[] for _ in range(n)]
    least = [(0, k) for k in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        full, k = least[0]
        lanes[k].append(i)
        heapreplace(least, (full + int(lengths[i]), k))
    return [lanes[k] for _, k in sorted(least, reverse=True)]


def score(weights: dict[str, np.ndarray], texts: list[np.ndarray], first: int, lanes: int = SCORED_LANES) -> np.ndarray:
    """Natural log-likelihood of each whole run of symbols, the state carried from its beginning to its end.

    A lane reads texts one after the other, each from an empty state, so that few lanes stand idle.
    """
    joined, looked = _joined(weights), _with_biases(weights)
    total = np.zeros(len(texts))
    dealt = _lanes(np.array([len(t) for t in texts], np.int64), lanes)
    lengths = np.array([sum(len(texts[i]) for i in some) for some in dealt])
    x, y, text = np.zeros((3, len(dealt), int(lengths.max(initial=0))), np.int32)
    begin = []
    for j, some in enumerate(dealt):
        at = 0
        for i in some:
            end = at + len(texts[i])
            if end > at:
                y[j, at:end] = texts[i]
                x[j, at + 1 : end] = texts[i][:-1]
                x[j, at], text[j, at:end] = first, i
                begin.append((at, j))
                at = end
    begin.sort(reverse=True)
    h = np.zeros((len(dealt), HIDDEN), np.float32)
    for at in range(0, x.shape[1], SCORED_WINDOW):
        live, end = int(np.count_nonzero(lengths > at)), min(at + SCORED_WINDOW, x.shape[1])
        new = []
        while begin and begin[-1][0] < end:
            t, j = begin.pop()
            new.append((t - at, j))
        u = _columns(weights, np.ascontiguousarray(x[:live, at:end].T), h[:live])
        _forward(joined, u, [np.empty((4 * HIDDEN, live), u.dtype)] * (end - at), new)
        rows = np.flatnonzero((np.arange(at, end)[:, None] < lengths[:live]).reshape(-1))
        states = u[1:, STATE.start :].transpose(0, 2, 1).reshape(-1, HIDDEN + 1)
        lp = _looked_up(*looked, states if len(rows) == len(states) else states.take(rows, axis=0), y[:live, at:end].T.reshape(-1)[rows])
        total += np.bincount(text[:live, at:end].T.reshape(-1)[rows], weights=lp, minlength=len(texts))
        h = u[-1, STATE].T
    return total
