"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  Its potential comes from features of the line and of both
neighbours, and neighbouring labels attract or repel each other.  Only documents are
labelled: lines start with their document's label, and half-way through training a bad
document's lines that the field takes for good become good, its worst line never.
Forward-backward gives each line's probability of being bad; their mean, weighted by length,
is calibrated, on documents that the field has not seen, to the probability that a document
is good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, logistic, reachable, shares, slices, turn
from .shingles import _byte, _power, mix

#: Learning documents of either label at most, training rounds.
SAMPLE, ROUNDS = 1500, 150
#: Bytes of text scored at once.
TEXT = 4 << 20


def _class(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return out


_kinds = [
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))),
    _class("0123456789"),
    _class("!?"),
    _class("|<>{}[]=_\\/^~`"),
    _class("#$%&*+@"),
    _class(".,;:'\"()-"),
    _class(bytes(range(0x80, 0x100))),
]
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
WIDTH = len(_kinds) + 6


@dataclass
class Lines:
    features: np.ndarray  # a row a line
    lengths: np.ndarray  # characters, as weights
    first: np.ndarray  # each text's first line, and the number of lines


def lines(texts: list[str]) -> Lines:
    """Features of the texts' lines; an empty text has one empty line."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    end = np.flatnonzero(data == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    first = np.concatenate(([0], np.cumsum([c.count(b"\n") + 1 for c in coded])))
    n = (end - start).astype(float)
    some = np.maximum(n, 1)
    f = np.zeros((len(end), WIDTH))
    for i, kind in enumerate(_kinds):
        c = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        f[:, i] = (c[end] - c[start]) / some
    blank = _blank[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    at = np.flatnonzero(begins)
    stops = ~blank
    stops[:-1] &= blank[1:]
    to = np.flatnonzero(stops) + 1
    line = np.searchsorted(end, at)
    words = np.bincount(line, minlength=len(end)).astype(float)
    if len(at):
        up, down = _power(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte[data] * up[: len(data)], out=total[1:])
        h = mix((total[to] - total[at]) * down[at])
        same = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        f[:, -6] = np.bincount(line[1:][same], minlength=len(end)) / np.maximum(words, 1)
        f[:, -5] = np.bincount(line, (to - at) == 1, minlength=len(end)) / np.maximum(words, 1)
    f[:, -4] = np.log1p(words) / 5
    f[:, -3] = np.minimum(n / np.maximum(words, 1) / 10, 3)
    f[:, -2] = n == 0
    last = data[np.maximum(end - 1, 0)]
    f[:, -1] = np.isin(last, [46, 33, 63]) & (n > 0)
    f[:, : len(_kinds)] = np.sqrt(f[:, : len(_kinds)])
    return Lines(f, some, first)


def in_parts(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def beside(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, the one before and the one after (zero at a text's ends), and a one."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.column_stack([f, before, after, np.ones(len(f))])


def marginals(u: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of bad for each line, expected transition counts, and the log partition sum.

    u: a line's potential for bad (good has 0).  All texts step together, the longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes.max() + 1), "left") if len(sizes) else np.zeros(1, int)
    pot = np.column_stack([np.zeros(len(u)), u])
    alpha, beta = np.zeros_like(pot), np.zeros_like(pot)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)

    steps = int(sizes.max()) if len(sizes) else 0
    for t in range(steps):
        at = starts[: active[t]] + t
        alpha[at] = pot[at] if t == 0 else pot[at] + lse(alpha[at - 1][:, :, None] + trans[None], 1)
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        beta[at] = lse(trans[None] + (pot[at + 1] + beta[at + 1])[:, None, :], 2)
    ends = first[1:] - 1
    z = lse(alpha[ends], 1)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.exp(alpha + beta - z[of][:, None])
    inner = np.ones(len(u), bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    joint = alpha[at][:, :, None] + trans[None] + (pot[at + 1] + beta[at + 1])[:, None, :] - z[of[at]][:, None, None]
    return p[:, 1], np.exp(joint).sum(axis=0), float(z.sum())


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def badness(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean probability of bad, as log odds."""
        x = lines(texts)
        p, _, _ = marginals(beside(x.features, x.first) @ self.weights, self.trans, x.first)
        total = np.add.reduceat(p * x.lengths, x.first[:-1]) / np.add.reduceat(x.lengths, x.first[:-1])
        total = np.clip(total, 1e-6, 1 - 1e-6)
        return np.log(total / (1 - total))

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        odds = self.badness(texts) if len(self.weights) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -30, 30)))


def inner(first: np.ndarray) -> np.ndarray:
    """Which lines have one after them in their text."""
    out = np.ones(first[-1], bool)
    out[first[1:] - 1] = False
    return out


def field(sample: list[tuple[str, int]]) -> Model:
    """The field from (text, label) rows of both labels, not calibrated."""
    y = np.array([b for _, b in sample], float)
    # the labels weigh the same in training; calibration brings the true shares back
    parts = []
    for label in (0, 1):
        weight = 0.5 * len(y) / (y == label).sum()
        for texts in in_parts([t for t, b in sample if b == label]):
            x = lines(texts)
            parts.append((beside(x.features, x.first).astype(np.float32), np.full(x.first[-1], 1.0 - label), x.first, weight))
    width = parts[0][0].shape[1]
    w, trans = np.zeros(width), np.zeros((2, 2))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
    for step in range(1, ROUNDS + 1):
        gw, gt = 1e-3 * len(y) * w, 1e-2 * len(y) * trans
        for ff, b, first, weight in parts:
            p, joint, _ = marginals(ff @ w, trans, first)
            if step == ROUNDS // 2 and b.any():
                worst = np.maximum.reduceat(p, first[:-1])
                b[:] = (p >= 0.5) | (p >= np.repeat(worst, np.diff(first)))
            at = np.flatnonzero(inner(first))
            seen = np.bincount((2 * b[at] + b[at + 1]).astype(int), minlength=4).reshape(2, 2)
            gw = gw + weight * (ff.T @ (p - b))
            gt = gt + weight * (joint - seen)
        for g, m, v, par in ((gw, mw, vw, w), (gt, mt, vt, trans)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            par -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(w, trans, 1.0, 0.0)


def train(sample: list[tuple[str, int]], stands_for: dict[int, float] | None = None) -> Model:
    """A calibrated field from (text, label) rows, label 1 for good.  Without both labels every
    score is the same.  A row of a label stands for so many learning rows.  Each half of the
    rows is judged by a field of the other half, if that has both labels, to calibrate."""
    y = np.array([b for _, b in sample], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0), np.zeros((2, 2)), 0.0, -6.0 if len(y) and y.max() == 0 else 6.0)
    whole = field(sample)
    # equal texts go to the same half
    half = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t, _ in sample])
    odds = np.zeros(len(y))
    for h in (0, 1):
        mine, others = np.flatnonzero(half == h), [sample[i] for i in np.flatnonzero(half != h)]
        if len(mine):
            other = field(others) if len({b for _, b in others}) == 2 else whole
            odds[mine] = np.concatenate([other.badness(part) for part in in_parts([sample[i][0] for i in mine])])
    slope, shift = logistic(odds[:, None], y, ridge=1.0, weight=shares(y, stands_for))
    return Model(whole.weights, whole.trans, float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Model:
    """Learn from at most ``each`` labelled documents of either kind outside the held-out fold.

    An id with both labels is good; ids without a label, null ids and labels other than 0 and 1
    teach nothing; repeated rows count once; null texts are empty.  Without rows of both labels
    the model gives every text the same score."""
    return train(*labelled_sample(docs, labels, "quality", each, parts="\n"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``score`` (0 to 1, the probability of good) of every row's whole text; null: empty.
    Rows map one to one: repeated rows stay, extra columns go, an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, TEXT):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores([t or "" for t in b.column(1).to_pylist()]), pa.float64())], [key, "score"])

    reachable(docs.sparkSession)
    return docs.select(key, text).mapInArrow(turn(run), f"`{key}` {dict(docs.dtypes)[key]}, score double")
