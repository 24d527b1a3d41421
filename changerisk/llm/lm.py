"""Language-model scores: a gated recurrent network in numpy with a class-factored softmax.

Words of the training part are counted, all of them, by hash. The most frequent are symbols of the
network; every other word belongs, by its spelling, to one of a few tail classes, which are symbols
too. The network gives the probability of the next class, and of the word in a class of symbols; in
a tail class a word has its smoothed share of the counts. So any text has a probability, known words
or not. The network is trained by truncated backpropagation on every text of the training part:
a few texts give it a start on the driver, then the texts are dealt by hash into shards, of which
there are as many as the words need, and each round trains every shard in a task from the last
parameters and averages what comes back. Texts are scored whole, the state running on from window to
window.

What is sent to the tasks has a fixed size: the network, and the counts of the HEAD most frequent
words. Counts of rarer words, and their words in the texts, meet in a join on the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from changerisk.llm.blocks import SOLID, Words, cut, hashes, mix, words
from changerisk.llm.shared import hash_fraction, hashed_sample, remainder, stored

#: Symbols come in so many classes of so many words; words beyond them in so many tail classes.
CLASSES, MEMBERS, TAILS = 32, 32, 32
HIDDEN = 24
#: Words whose counts are sent to the tasks.
HEAD = 1 << 18
#: Leading bits of a hash by which it is looked up among them.
RANGES = 20
#: About so many documents give the network its start, in windows of STEPS words of STREAMS texts at a time.
SAMPLE = 1_500
STEPS, STREAMS, EPOCHS, RATE = 24, 64, 2, 0.01
#: Then all texts train it: shards of about SHARD symbols, side by side, each text in one of ROUNDS
#: rounds; after a round the parameters of the shards are averaged, in so many slices.
SHARD, ROUNDS, ROUND_STREAMS, ROUND_RATE, SLICES = 1 << 21, 4, 256, 0.008, 16
#: Words per call while scoring, and words that a task holds to run side by side (two bytes each).
_RUN, HELD = 256, 1 << 22
#: So many texts are stepped, and of about so many words the probabilities taken, at a time: they fit a cache.
BESIDE, GATHERED = 1024, 1 << 15
#: Exponentials of logits up to this are summed up without a shift.
SAFE = 60.0
#: So many words have their logits held at a time; words of one class are trained in blocks of so many.
NEAR, BLOCK = 1 << 10, 64

_U = np.uint64
#: Stands for the end of a text; also what comes before a text.
END = int(mix(np.array([0x656E64], _U), 77).view(np.int64)[0])


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def tail_class(w: Words) -> np.ndarray:
    """Class of each word by its first two bytes and its last one."""
    first, last = w.data[w.start].astype(_U), w.data[w.end - 1].astype(_U)
    second = w.data[np.minimum(w.start + 1, w.end - 1)].astype(_U)
    return (mix(first | second << _U(8) | last << _U(16), 61) % _U(TAILS)).astype(np.int64)


def _merge(h: np.ndarray, n: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return h[first], np.add.reduceat(n[order], first), tail[order[first]]


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _merge(*(np.concatenate(x) for x in zip(*held, strict=True)))

    frame = lambda x: pd.DataFrame({"h": x[0], "n": x[1], "tail": x[2]})
    for part in parts:
        texts = _texts(part["text"])
        rows += len(texts)
        for lo, hi in cut(texts):
            w = words(texts[lo:hi], SOLID)
            held.append(_merge(hashes(w).view(np.int64), np.ones(len(w.start), np.int64), tail_class(w)))
            if sum(len(x[0]) for x in held) > 1 << 20:
                held = [merged()]
                if len(held[0][0]) > 1 << 19:
                    yield frame(held.pop())
    held.append((np.array([END]), np.array([rows]), np.array([0])))
    yield frame(merged())


@dataclass
class Network:
    """Parameters; ``gates``: what each symbol adds to the reset, update and candidate gates; ``back``: what the state adds.

    The three gates are apart, so that each one's values of many texts lie side by side.
    """

    gates: np.ndarray
    back: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    members: np.ndarray
    member_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(HIDDEN)).astype(np.float32)
        n = CLASSES * MEMBERS + TAILS
        apart = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))
        return Network(apart(draw(n, 3 * HIDDEN)), apart(draw(HIDDEN, 3 * HIDDEN)), draw(HIDDEN, CLASSES + TAILS) * 0.1, np.zeros(CLASSES + TAILS, np.float32), draw(CLASSES, HIDDEN, MEMBERS) * 0.1, np.zeros((CLASSES, MEMBERS), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.gates, self.back, self.classes, self.class_bias, self.members, self.member_bias]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.advance(state, self.gates.take(symbol, axis=1))

    def advance(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state, and what the state gives the candidate; ``x``, what symbols add to the gates, becomes the gates."""
        a = state @ self.back
        # In place: 1 / (1 + exp(-x)), tanh, and n + z * (state - n).
        rz, n = x[:2], x[2]
        rz += a[:2]
        np.exp(np.negative(rz, out=rz), out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        n += rz[0] * a[2]
        np.tanh(n, out=n)
        new = state - n
        new *= rz[1]
        new += n
        return new, a[2]

    def log_probability(self, state: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm; of a tail symbol, that of its class."""
        kind = _kinds(target)
        out = _log_share(state, self.classes, self.class_bias, kind)
        order, ends = _by_class(kind)
        for c in np.flatnonzero(np.diff(ends)):
            at = order[ends[c] : ends[c + 1]]
            out[at] += _log_share(state.take(at, axis=0), self.members[c], self.member_bias[c], target[at] % MEMBERS)
        return out


def _kinds(target: np.ndarray) -> np.ndarray:
    """Class of each symbol; those of the tail come after the others."""
    return np.where(target < CLASSES * MEMBERS, target // MEMBERS, target - CLASSES * MEMBERS + CLASSES)


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by class, those of the tail last; and where each class of symbols begins and the last one ends."""
    order = np.argsort(kind, kind="stable")
    return order, np.searchsorted(kind[order], np.arange(CLASSES + 1))


def _unsafe(weight: np.ndarray, bias: np.ndarray) -> bool:
    """Whether logits must be shifted before their exponentials are summed up: no state is beyond 1."""
    return not float((np.abs(weight).sum(axis=-2) + np.abs(bias)).max()) < SAFE


def _logits(state: np.ndarray, weight: np.ndarray, bias: np.ndarray, shift: bool) -> np.ndarray:
    x = state @ weight
    x += bias
    if shift:
        x -= x.max(axis=-1, keepdims=True)
    return x


def _log_share(state: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of one column of each row."""
    out, shift, ones = np.empty(len(at), state.dtype), _unsafe(weight, bias), np.ones(len(bias), state.dtype)
    for lo in range(0, len(at), NEAR):
        here = at[lo : lo + NEAR]
        x = _logits(state[lo : lo + NEAR], weight, bias, shift)
        picked = x[np.arange(len(here)), here]
        out[lo : lo + NEAR] = picked - np.log(np.exp(x, out=x) @ ones)
    return out


def _softmax(state: np.ndarray, weight: np.ndarray, bias: np.ndarray, shift: bool | None = None) -> np.ndarray:
    x = _logits(state, weight, bias, _unsafe(weight, bias) if shift is None else shift)
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[-1], x.dtype)))[..., None]
    return x


def _class_gradients(net: Network, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of minus the sum of the classes' log probabilities, by weight, bias and state."""
    weight, bias, by_state, shift = np.zeros_like(net.classes), np.zeros_like(net.class_bias), np.empty_like(state), _unsafe(net.classes, net.class_bias)
    for lo in range(0, len(kind), NEAR):
        own, at = state[lo : lo + NEAR], kind[lo : lo + NEAR]
        p = _softmax(own, net.classes, net.class_bias, shift)
        p.reshape(-1)[np.arange(len(at)) * p.shape[1] + at] -= 1
        weight += (p.T @ own).T
        bias += np.ones(len(at), p.dtype) @ p
        np.matmul(p, net.classes.T, out=by_state[lo : lo + NEAR])
    return weight, bias, by_state


def _member_gradients(net: Network, state: np.ndarray, kind: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of minus the sum of the log probabilities within classes of symbols: by weight, bias and state, and which states."""
    weight, bias = np.zeros_like(net.members), np.zeros_like(net.member_bias)
    order, ends = _by_class(kind)
    known, sizes = order[: ends[-1]], np.diff(ends)
    # The rows of a class fill blocks of equal size, which are worked on together.
    blocks = -(-sizes // BLOCK)
    owner, first = np.repeat(np.arange(CLASSES), blocks), np.cumsum(blocks) - blocks
    place = np.arange(len(known)) + np.repeat(first * BLOCK - ends[:-1], sizes)
    own = np.zeros((len(owner) * BLOCK, HIDDEN), np.float32)
    own[place] = state.take(known, axis=0)
    own = own.reshape(-1, BLOCK, HIDDEN)
    p = _softmax(own, net.members[owner], net.member_bias[owner][:, None], _unsafe(net.members, net.member_bias))
    flat = p.reshape(-1, MEMBERS)
    flat[place, member[known]] -= 1
    # What stands for no row.
    rest = np.ones(len(flat), bool)
    rest[place] = False
    flat[rest] = 0
    used = np.flatnonzero(blocks)
    if len(used):
        weight[used] = np.add.reduceat(own.transpose(0, 2, 1) @ p, first[used], axis=0)
        bias[used] = np.add.reduceat(np.ones(BLOCK, p.dtype) @ p, first[used], axis=0)
    by_state = p @ net.members.transpose(0, 2, 1)[owner]
    return weight, bias, by_state.reshape(-1, HIDDEN)[place], known


def _sums(x: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols, and the sums of their rows in each of ``x``."""
    order = np.argsort(symbol, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(symbol[order]) > 0)))
    # Two numbers are added at a time, as one complex number.
    pairs = x.take(order, axis=1).view(np.complex64)
    return symbol[order[first]], np.add.reduceat(pairs, first, axis=1).view(np.float32)


def train(streams: np.ndarray, start: int, epochs: int = EPOCHS, rate: float = RATE, net: Network | None = None, before_rows: np.ndarray | None = None) -> Network:
    """``streams``: symbols, texts one after the other by row, each closed by ``start``; -1 is no symbol.

    ``net`` is trained in place if given; ``before_rows``: the symbol before each row, if not ``start``.
    """
    net = Network.fresh() if net is None else net
    moments = [[np.zeros_like(p) for p in net.parameters()] for _ in range(2)]
    k, rows, turn = HIDDEN, len(streams), 0
    steps = epochs * -(-streams.shape[1] // STEPS)
    for _ in range(epochs):
        state, last = np.zeros((rows, k), np.float32), np.full(rows, start, np.int16) if before_rows is None else before_rows
        for lo in range(0, streams.shape[1], STEPS):
            target = np.ascontiguousarray(streams[:, lo : lo + STEPS].T)
            follow = np.where(target >= 0, target, start)
            symbols, last = np.concatenate((last[None], follow[:-1])), follow[-1]
            # A text starts anew.
            fresh = [np.flatnonzero(s == start) for s in symbols]
            gates = net.gates.take(symbols, axis=1)
            before, inner, states = (np.empty((len(target), rows, k), np.float32) for _ in range(3))
            for t in range(len(target)):
                before[t] = state
                before[t, fresh[t]] = 0
                state, inner[t] = net.advance(before[t], gates[:, t])
                states[t] = state
            real = np.flatnonzero(target >= 0)
            if not len(real):
                continue
            whole = len(real) == target.size
            h, y = states.reshape(-1, k), target.reshape(-1)
            if not whole:
                h, y = h.take(real, axis=0), y[real]
            kind = _kinds(y)
            by_classes, by_class_bias, dh = _class_gradients(net, h, kind)
            by_members, by_member_bias, more, known = _member_gradients(net, h, kind, y % MEMBERS)
            dh[known] += more
            by_state = dh.reshape(states.shape) if whole else np.zeros_like(states)
            if not whole:
                by_state.reshape(-1, k)[real] = dh
            # What a change of the state changes before the gates' curves: as factors, for all steps at once.
            r, z, n = gates
            by_gates = np.empty_like(gates)
            curve = np.multiply(n, n)
            np.subtract(1, curve, out=curve)
            np.subtract(before, n, out=by_gates[1])
            by_gates[1] *= z
            rest = np.subtract(1, z)
            by_gates[1] *= rest
            curve *= rest
            np.multiply(curve, r, out=by_gates[2])
            np.subtract(1, r, out=rest)
            rest *= inner
            np.multiply(by_gates[2], rest, out=by_gates[0])
            carried, forth = np.zeros((rows, k), np.float32), np.ascontiguousarray(net.back.transpose(0, 2, 1))
            for t in range(len(target) - 1, -1, -1):
                d, x = by_state[t], by_gates[:, t]
                d += carried
                x *= d
                carried = d * z[t]
                for part in x @ forth:
                    carried += part
                carried[fresh[t]] = 0
            by_back = before.reshape(-1, k).T @ by_gates.reshape(3, -1, k)
            # The state before adds to the candidate through the reset gate, a symbol beside it.
            np.multiply(by_state, curve, out=by_gates[2])
            by_symbol = np.zeros_like(net.gates)
            found, sums = _sums(by_gates.reshape(3, -1, k), symbols.reshape(-1))
            by_symbol[:, found] = sums
            turn += 1
            grads = [by_symbol, by_back, by_classes, by_class_bias, by_members, by_member_bias]
            # Of the mean, at most of length 1.
            size = float(np.sqrt(sum(np.vdot(g, g) for g in grads))) / len(real)
            scale = min(1.0, 1.0 / max(1e-9, size)) / len(real)
            lr = rate * (1 - 0.9 * turn / steps) * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn)
            for q, g, m, v in zip(net.parameters(), grads, *moments, strict=True):
                g *= scale
                m *= 0.9
                m += 0.1 * g
                g *= g
                g *= 0.01
                v *= 0.99
                v += g
                np.sqrt(v, out=g)
                g += 1e-6
                np.divide(m, g, out=g)
                g *= float(lr)
                q -= g
    return net


def _range(h: np.ndarray) -> np.ndarray:
    return (h >> (64 - RANGES)) + (1 << (RANGES - 1))


@dataclass
class Model:
    #: hashes in ascending order
    head: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    #: log10 of what counts are divided by: in all, and by tail class
    base: float
    tails: np.ndarray
    network: Network = field(default_factory=Network.fresh)

    @property
    def start(self) -> int:
        at = np.searchsorted(self.head, END)
        return int(self.symbol[at]) if at < len(self.head) and self.head[at] == END else 0

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place in the head or -1, symbol, document, order) of each word and end, by document."""
        w = words(texts, SOLID)
        h = hashes(w).view(np.int64)
        at = self._places(h)
        sym = np.where(at >= 0, self.symbol[at], -1) if len(self.head) else at.copy()
        out = np.flatnonzero(sym < 0)
        sym[out] = CLASSES * MEMBERS + tail_class(Words(w.data, w.start[out], w.end[out], w.doc[out], w.docs, w.offset))
        # A text's end comes after its words.
        n = w.counts() + 1
        own, end = np.arange(len(h)) + w.doc, np.cumsum(n) - 1
        end_at = int(self._places(np.array([END]))[0])

        def joined(x: np.ndarray, last: int) -> np.ndarray:
            all_of = np.empty(len(x) + len(n), np.int64)
            all_of[own], all_of[end] = x, last
            return all_of

        end_sym = int(self.symbol[end_at]) if end_at >= 0 else -1
        return joined(h, END), joined(at, end_at), joined(sym, end_sym if end_sym >= 0 else CLASSES * MEMBERS), np.repeat(np.arange(len(n)), n), n

    @cached_property
    def _firsts(self) -> np.ndarray:
        """Place in the head of the first hash of each range of hashes; the ranges are those of the leading bits."""
        return np.concatenate(([0], np.cumsum(np.bincount(_range(self.head), minlength=1 << RANGES))))[:-1].astype(np.int32)

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the head, or -1: looked for from the first hash of its range on."""
        head = np.append(self.head, np.iinfo(np.int64).max)
        at = self._firsts[_range(h)].astype(np.int64)
        before = np.flatnonzero(head[at] < h)
        while len(before):
            at[before] += 1
            before = before[head[at[before]] < h[before]]
        return np.where((at < len(self.head)) & (head[at] == h), at, -1)

    def recurrent(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log probability of each text's symbols; texts of like length run side by side, longest first."""
        order = np.argsort(-size, kind="stable")
        begin, out = np.cumsum(size) - size, np.empty(len(size))
        for lo in range(0, len(order), BESIDE):
            at = order[lo : lo + BESIDE]
            out[at] = self._run(symbols, begin[at], size[at])
        return out

    def _run(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        total, longest = np.zeros(len(length)), int(length[0]) if len(length) else 0
        lives = np.searchsorted(-length, -np.arange(longest), "left").tolist()
        state, last = np.zeros((len(length), HIDDEN), np.float32), np.full(len(length), self.start)
        for lo in range(0, longest, _RUN):
            states, targets, whose, many = [], [], [], 0
            for t in range(lo, min(lo + _RUN, longest)):
                live = lives[t]
                state, _ = self.network.step(state[:live], last[:live])
                last = symbols[begin[:live] + t]
                states.append(state)
                targets.append(last)
                whose.append(np.arange(live))
                many += live
                if many > GATHERED:
                    total += self._gathered(states, targets, whose, len(total))
                    states, targets, whose, many = [], [], [], 0
            if states:
                total += self._gathered(states, targets, whose, len(total))
        return total

    def _gathered(self, states, targets, whose, n: int) -> np.ndarray:
        p = self.network.log_probability(np.concatenate(states), np.concatenate(targets))
        return np.bincount(np.concatenate(whose), p, minlength=n)


def _counts(training: DataFrame) -> DataFrame:
    """h, n, tail: all distinct words and the end, with their counts."""
    return stored(training.select("text").mapInPandas(_counted, "h long, n long, tail long").groupBy("h").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")))


def learn(training: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame, int]:
    """The model, the counts of all words (h, n, tail), and how many words they are.

    Counts and the network cover all rows; the network's start is of about ``sample`` texts.
    """
    counts = _counts(training)
    # By eighths of powers of two: the lowest count from which on at most HEAD words are left.
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("words")).collect()
    size, least = 0, None
    for s, many in sorted(((r.s, r.words) for r in steps), reverse=True):
        if size + many > HEAD:
            break
        size, least = size + many, s
    head = counts.where(step >= F.lit(least if least is not None else 1 << 20)).toPandas()
    end = counts.where(F.col("h") == END)
    head = pd.concat([head, end.toPandas()]).drop_duplicates("h").sort_values(["n", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
    # The end of a text is always a symbol.
    first = pd.concat([head[head.h == END], head[head.h != END].head(CLASSES * MEMBERS - 1)]).sort_values(["n", "h"], ascending=[False, True], kind="stable")
    symbol = {h: i for i, h in enumerate(first.h.tolist())}
    head = head.sort_values("h")
    top = F.broadcast(training.sparkSession.createDataFrame([(int(h),) for h in symbol], "h long"))
    rest = counts.join(top, "h", "left_anti").groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    all_words = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(all_words.n or 0), int(all_words.v)
    tails = np.full(TAILS, np.log10(0.5))
    for r in rest:
        tails[r.tail] = np.log10(r.n + 0.5 * (r.v + 1))
    model = Model(head.h.to_numpy(np.int64), head.n.to_numpy(np.int64), np.array([symbol.get(h, -1) for h in head.h.tolist()], np.int64), float(np.log10(total + 0.5 * (kinds + 1))), tails)
    model.network = _start(training, model, sample)
    _train_on_all(training, model, total)
    return model, counts, total


def _start(training: DataFrame, model: Model, sample: int) -> Network:
    sent = training.sparkSession.sparkContext.broadcast(model)

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = _texts(part["text"])
            yield pd.DataFrame({"o": part["o"], "s": [sent.value.coded([t])[2].astype(np.int16).tobytes() for t in texts]})

    key = hash_fraction(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    picked = hashed_sample(training.select("doc_id", "text"), [], sample, F.col("doc_id"), F.lit("lm"))
    rows = picked.select("text", key.alias("o")).mapInPandas(coded, "o double, s binary").toPandas().sort_values(["o", "s"])
    texts = [np.frombuffer(s, np.int16) for s in rows["s"]]
    streams: list[list[np.ndarray]] = [[] for _ in range(STREAMS)]
    sizes = np.zeros(STREAMS, int)
    for t in texts:
        at = int(sizes.argmin())
        streams[at].append(t)
        sizes[at] += len(t)
    out = np.full((STREAMS, int(sizes.max())), -1, np.int16)
    for i, parts in enumerate(streams):
        if parts:
            out[i, : sizes[i]] = np.concatenate(parts)
    return train(out, model.start)


def _train_on_all(training: DataFrame, model: Model, total: int) -> None:
    """Train the model's network on every text; ``total``: how many symbols they are."""
    context = training.sparkSession.sparkContext
    sent = context.broadcast(model)
    shards = max(1, -(-total // SHARD))

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = _texts(part["text"])
            for lo, hi in cut(texts):
                _, _, sym, _, size = sent.value.coded(texts[lo:hi])
                held = np.split(sym.astype(np.int16), np.cumsum(size)[:-1])
                yield part[["round", "shard", "at"]].iloc[lo:hi].assign(s=[x.tobytes() for x in held])

    # Shards and rounds come from the text's own hash, not from how rows are dealt out.
    same = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    deal = lambda many, name: F.floor(hash_fraction(F.col("doc_id"), same, F.lit(name)) * many).cast("long")
    placed = training.select("text", deal(ROUNDS, "round").alias("round"), deal(shards, "shard").alias("shard"), hash_fraction(F.col("doc_id"), same).alias("at"))
    texts = stored(placed.mapInPandas(coded, "round long, shard long, at double, s binary"))
    for turn in range(ROUNDS):
        model.network = _averaged(texts.where(F.col("round") == turn), shards, model.network, model.start, ROUND_RATE * (1 - turn / ROUNDS))


def _averaged(texts: DataFrame, shards: int, network: Network, start: int, rate: float) -> Network:
    """The mean of the networks that the shards of ``texts`` (shard, at, s) make of ``network``, by symbols."""
    sent = texts.sparkSession.sparkContext.broadcast(network)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate([np.frombuffer(s, np.int16) for s in part.sort_values(["at", "s"])["s"]])
        net = Network(*(p.copy() for p in sent.value.parameters()))
        streams, before = _rows_of(flat, start)
        train(streams, start, 1, rate, net, before)
        values = np.concatenate([p.ravel() for p in net.parameters()])
        return pd.DataFrame({"slice": np.arange(SLICES), "shard": part["shard"].iloc[0], "n": len(flat), "v": [x.tobytes() for x in np.array_split(values, SLICES)]})

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for part in parts:
            for k, n, v in zip(part["slice"], part["n"], part["v"], strict=True):
                x = held.setdefault(k, [0, 0.0])
                x[0] += n
                x[1] = x[1] + np.frombuffer(v, np.float32) * float(n)
        yield pd.DataFrame({"slice": list(held), "v": [(x / n).astype(np.float32).tobytes() for n, x in held.values()]})

    # So many partitions as shards: few bytes are much work, which Spark would put into few tasks.
    each = texts.repartition(shards, "shard").groupBy("shard").applyInPandas(local, "slice long, shard long, n long, v binary")
    ordered = each.repartition(SLICES, "slice").sortWithinPartitions("slice", "shard")
    found = sorted(ordered.mapInPandas(summed, "slice long, v binary").collect())
    if not found:
        return network
    values, out, at = np.concatenate([np.frombuffer(r.v, np.float32) for r in found]), [], 0
    for p in network.parameters():
        out.append(values[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return Network(*out)


def _rows_of(flat: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, cut into rows of equal length so that none is padded, and the symbol before each row."""
    # Few symbols stand in fewer rows, so that they still make steps enough.
    rows = max(1, min(ROUND_STREAMS, len(flat) // (STEPS * 32)))
    width = -(-len(flat) // rows)
    out = np.full(rows * width, -1, np.int16)  # small integers are sorted by their digits
    out[: len(flat)] = flat
    before = np.concatenate((np.array([start], np.int16), out[width - 1 : -1 : width]))
    return out.reshape(rows, width), np.where(before >= 0, before, start)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each whole text.

    A null text counts as empty: only its end is scored. Rows that repeat are scored each; extra
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    id_type = docs.select("doc_id").schema["doc_id"]
    fields = T.StructType([T.StructField("row", T.LongType()), id_type, *T.StructType.fromDDL("n_tokens long, known long, base double, score double, rare array<long>").fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place, row, held, waiting = TaskContext.get().partitionId(), 0, [], 0
        known = np.log10(m.count + 0.5)

        def run_all() -> Iterator[pa.RecordBatch]:
            """The network runs over all held texts side by side: the longest one is waited for once."""
            sizes = [x[1] for x in held]
            run = m.recurrent(np.concatenate([x[0] for x in held]), np.concatenate(sizes)) / np.log(10)
            for (_, size, ids, rows, seen, base, more, rare), own in zip(held, np.split(run, np.cumsum([len(s) for s in sizes])[:-1]), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids, pa.array(size), pa.array(seen), pa.array(base), pa.array(own + more), rare], fields.names)

        for batch in batches:
            texts = _texts(batch["text"].to_pylist())
            for lo, hi in cut(texts, 2 << 20):
                h, at, sym, doc, size = m.coded(texts[lo:hi])
                n = hi - lo
                inside = at >= 0
                value = np.where(inside, known[at] if len(known) else 0.0, 0.0)
                tail = sym >= CLASSES * MEMBERS
                base = np.bincount(doc, value, minlength=n) - size * m.base
                more = np.bincount(doc[tail], value[tail] - m.tails[sym[tail] - CLASSES * MEMBERS], minlength=n)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc[~inside], minlength=n)))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[~inside]))
                seen = np.bincount(doc[inside], minlength=n)
                held.append((sym.astype(np.int16), size, batch["doc_id"].slice(lo, n), (place << 40) + row + np.arange(n), seen, base, more, rare))
                row, waiting = row + n, waiting + len(sym)
                if waiting > HELD:
                    yield from run_all()
                    held, waiting = [], 0
        if held:
            yield from run_all()

    found = stored(docs.select("doc_id", "text").mapInArrow(step, fields))
    unsolved = found.select("row", F.explode("rare").alias("h"))
    n = F.coalesce("n", F.lit(0))
    rare = unsolved.join(counts.select("h", "n"), "h", "left").groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("more"), F.sum((n > 0).cast("long")).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return found.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def score_held_out(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learned where crc32 mod 5 is not 1.

    Each row has a row. Null, empty and blank texts have one token, the end. Rows that repeat count as often
    in training and are scored alike. An empty table gives an empty result. Extra columns are ignored.
    """
    held = remainder("doc_id", 5) == 1
    model, counts, total = learn(docs.where(~held), sample)
    scored = score(docs, model, counts)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
