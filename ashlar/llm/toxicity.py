"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

A text is folded to kernel letters (case, accents, width, lookalikes and signs that stand for
letters; other letters of any script by a hash) and cut into sentences of tokens.  A token's
features are its subsequences of three letters (its start counts as one) inside a span of at
most SPAN, each weighing DECAY to the power of its span, so an insult with gaps or inserted
characters still shares most of them.  The kernel of a sentence and a landmark (a sentence of one token) is the largest
normalised kernel of the sentence's tokens with it, less a floor.  Landmarks come from learning
sentences of both labels: tokens that set toxic ones apart, and those of clean ones that look
most like them.  Nystroem's map of the kernel values feeds a linear machine, trained on
sentences.  A document is judged by its worst sentence and by how much of it leans to toxic,
each calibrated on documents that the machine behind it has not seen.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_sample, reachable, shares, turn

DECAY, SPAN = 0.8, 6
#: Landmarks of toxic and of clean sentences at most, and how alike two may be.
LANDMARKS, CLEAN, APART = 64, 16, 0.7
#: Groups of toxic landmarks that bound a token's values together.
GROUPS = 8
#: Normalised kernel values up to this are chance likeness of words and count as none.
FLOOR = 0.25
#: From this value (less the floor) on, a token of a toxic document stands for its landmark in learning.
WITNESS = 0.6
#: Learning documents of either label at most, characters of either label's at most (a sentence
#: counts as some more), tokens a worker remembers.
SAMPLE, CHARS, CACHE = 1500, 12 << 20, 100_000
#: Tokens longer than this are cut into pieces that overlap by half; tokens of a turn.
LONGEST, TURN = 24, 50_000
#: What a sentence's leaning must pass to add to a document's average, and tokens by which
#: short documents' averages are held back.
LEAN, SHORT = 0.4, 50

#: Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Letters that look like Latin ones or have no accent to take off.
LOOKS_LIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "α": "a", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d",
    "æ": "a", "œ": "o", "þ": "t", "ß": "s",
}
#: Kernel letters: the start of a token, 26 Latin ones, one for signs, and OTHER that letters of all other scripts share by a hash.
OTHER = 36
SIZE = 28 + OTHER
_SPACES = {0x20, *range(0x09, 0x0E), 0x85, 0xA0}


def folded(c: str) -> str:
    """What a character reads as: letters, a space, a stop, ``~`` for signs, or nothing for marks and format characters."""
    if c == "\n":
        return ". "
    if ord(c) in _SPACES or c.isspace():
        return " "
    out = ""
    for x in unicodedata.normalize("NFKD", c).casefold():
        kind = unicodedata.category(x)
        x = STANDS_FOR.get(x) or LOOKS_LIKE.get(x) or x
        if "a" <= x <= "z" or x == " ":
            out += x
        elif kind[0] == "M" or kind == "Cf":
            continue
        elif x in ".!?\u3002\u0964\u061f":
            out += "."
        elif kind[0] == "L":
            out += chr(0xC0 + (ord(x) * 0x9E3779B1 >> 7) % OTHER)
        else:
            out += "~"
    return out


class Folding(dict):
    """folded() by code point, as str.translate() asks for it; a worker meets few distinct ones."""

    def __missing__(self, point: int) -> str:
        got = self[point] = folded(chr(point))
        return got


_fold = Folding()
_table = bytes(ord((folded(chr(i)) or "~")[0]) if chr(i) != "\n" else 10 for i in range(256))
_letter = "a-z\xc0-\xe3".encode("latin-1")
_spaced = re.compile(rb"(?<![^ ])(?:[" + _letter + rb"] ){2,}[" + _letter + rb"](?![^ .])")
_around = re.compile(rb"~+(?![^ ])|(?<![^ ])~+")
_stop = re.compile(rb"[.~]*\.[.~]*(?![^ ])")
_code = np.zeros(256, np.int64)
_code[97:123] = np.arange(1, 27)
_code[[ord("~"), ord(".")]] = 27
_code[0xC0 : 0xC0 + OTHER] = np.arange(28, SIZE)
_GAPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def tokens(text: str) -> list[bytes]:
    """Folded tokens without signs around them, and a stop after each sentence that ends with
    one.  Letters set apart by spaces are one token."""
    try:
        data = text.encode("latin-1").translate(_table).replace(b"\n", b". ")
    except UnicodeEncodeError:
        data = text.translate(_fold).encode("latin-1")
    return _spaced.sub(lambda m: m[0].replace(b" ", b""), _stop.sub(b" .", _around.sub(b"", data))).split()


def pieces(token: bytes) -> list[bytes]:
    """What a token is compared as: itself, and without signs; or its pieces if it is long."""
    if len(token) <= LONGEST:
        return [token, token.translate(None, b".~")] if b"." in token or b"~" in token else [token]
    return [token[i : i + LONGEST] for i in range(0, len(token) - LONGEST // 2, LONGEST // 2)]


def least_norms(n: np.ndarray) -> np.ndarray:
    """Norm of a token of n letters (its start is one) if its subsequences are all different; repeats only add to it."""
    total = np.zeros(len(n))
    for _, k in _GAPS:
        total += np.maximum(n - k, 0) * DECAY ** (2 * (k + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def norms(words: list[bytes]) -> np.ndarray:
    """Norms of tokens."""
    parts = list(subsequences(words))
    out = np.full(len(words), 1e-12)
    if parts:
        key = np.concatenate([word * SIZE**3 + code for word, code, _ in parts])
        weight = np.concatenate([np.full(len(word), w) for word, _, w in parts])
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        if len(key):
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            out += np.bincount(key[cut] // SIZE**3, np.add.reduceat(weight, cut) ** 2, minlength=len(words))
    return np.sqrt(out)


def subsequences(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word index, subsequence code, weight) for every gap pattern, words' order kept; code 0 marks a word's start."""
    c = _code[np.frombuffer(b"".join(b"^" + w for w in words), np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    for j, k in _GAPS:
        if len(c) <= k:
            continue
        same = word[:-k] == word[k:]
        code = (c[:-k] * SIZE + c[j : len(c) - k + j]) * SIZE + c[k:]
        yield word[:-k][same], code[same], DECAY ** (k + 1)


class Kernel:
    """Normalised kernel values of tokens and sentences with landmark tokens."""

    def __init__(self, landmarks: list[bytes], toxic: int | None = None):
        """Of the landmarks, the first ``toxic`` are of toxic sentences (None: all)."""
        self.m = len(landmarks)
        toxic = self.m if toxic is None else toxic
        found: dict[int, np.ndarray] = {}
        for i, w in enumerate(landmarks):
            for _, code, weight in subsequences([w]):
                for c in code.tolist():
                    found.setdefault(c, np.zeros(self.m))[i] += weight
        # only the landmarks' own subsequences have a row; the others share the first, of zeros
        self.row = np.zeros(SIZE**3, np.int32)
        self.row[list(found)] = np.arange(1, len(found) + 1)
        table = np.array([np.zeros(self.m), *found.values()])
        self.table = (table / (np.sqrt((table**2).sum(axis=0)) + 1e-12)).astype(np.float32)
        # of each few toxic landmarks that are alike, the largest weight a subsequence has in any
        like = self.table[:, :toxic].T @ self.table[:, :toxic]
        seeds = [0] if toxic else []
        while len(seeds) < min(GROUPS, toxic):
            seeds.append(int(like[seeds].max(axis=0).argmin()))
        nearest = like[seeds].argmax(axis=0) if toxic else np.zeros(0, int)
        self.most = [self.table[:, :toxic][:, nearest == i].max(axis=1) for i in range(len(seeds)) if (nearest == i).any()]
        self.rows = np.zeros((CACHE + 1, self.m), np.float32)  # of tokens like a toxic landmark, from 1 on
        self.known: dict[bytes, int] = {b".": -1}  # token -> its row, or 0; a stop has none
        self.live = 0

    def near(self, words: list[bytes]) -> np.ndarray:
        """Which words can have a value with a toxic landmark at all, by a bound on it."""
        total = np.zeros((len(self.most), len(words)))
        for word, code, weight in subsequences(words) if words else ():
            row = self.row[code]
            use = row > 0
            word, row = word[use], row[use]
            for i, most in enumerate(self.most):
                total[i] += np.bincount(word, most[row], minlength=len(words)) * weight
        return total.max(axis=0, initial=0) > FLOOR * 0.9999 * least_norms(np.array([len(w) + 1 for w in words]))

    def values(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), self.m), np.float32)
        if not words:
            return out
        for word, code, weight in subsequences(words):
            row = self.row[code]
            use = row > 0
            word, row = word[use], row[use]
            if len(word):
                cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                out[word[cut]] += np.add.reduceat(self.table[row], cut) * np.float32(weight)
        norm = least_norms(np.array([len(w) + 1 for w in words]))
        near = np.flatnonzero(out.max(axis=1, initial=0) > 0.1 * norm)  # exact where it can matter
        norm[near] = norms([words[i] for i in near])
        return (np.maximum(np.minimum(out / norm[:, None], 1) - FLOOR, 0) / (1 - FLOOR)).astype(np.float32)

    def of(self, toks: list[bytes]) -> np.ndarray:
        """Values of tokens, the larger of the pieces' for a cut one; a token or piece that is
        like no toxic landmark has none."""
        out = np.zeros((len(toks), self.m), np.float32)
        words = [t[:LONGEST] for t in toks]
        more = [(i, p) for i, t in enumerate(toks) if b"~" in t or b"." in t or len(t) > LONGEST for p in pieces(t)[1:]]
        words += [p for _, p in more]
        of = np.concatenate([np.arange(len(toks)), np.array([i for i, _ in more], np.int64)])
        for at in range(0, len(words), 10_000):
            near = at + np.flatnonzero(self.near(words[at : at + 10_000]))
            np.maximum.at(out, of[near], self.values([words[i] for i in near]))
        return out

    def codes(self, toks: list[bytes]) -> np.ndarray:
        """What ``known`` has for the tokens; new ones are worked out first."""
        new = list(set(toks) - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known = {b".": -1}
            self.live, new = 0, list(set(toks) - self.known.keys())
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            got = self.of(part)
            on = np.flatnonzero(got.any(axis=1))
            place = np.zeros(len(part), np.int64)
            place[on] = np.arange(self.live + 1, self.live + 1 + len(on))
            self.rows[place[on]] = got[on]
            self.live += len(on)
            self.known.update(zip(part, place.tolist()))
        return np.fromiter(map(self.known.__getitem__, toks), np.int64, len(toks))

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kernel values of the sentences that any landmark is like, the text of each, and
        every text's number of tokens."""
        rows, docs, count = [np.zeros((0, self.m), np.float32)], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        now, last, open_ = 0, -1, False  # the last sentence so far, the last with a row, whether it goes on

        def add(toks: list[bytes], doc: np.ndarray) -> None:
            nonlocal now, last, open_
            row = self.codes(toks)
            ends = row < 0
            begins = np.concatenate(([not open_], ends[:-1] | (doc[1:] != doc[:-1])))
            nth = now + np.cumsum(begins)
            now, open_ = int(nth[-1]), not ends[-1]
            on = np.flatnonzero(row > 0)  # most tokens are like no landmark
            if not len(on):
                return
            cut = np.flatnonzero(np.concatenate(([True], np.diff(nth[on]) > 0)))
            got = np.maximum.reduceat(self.rows[row[on]], cut)
            of = doc[on][cut]
            if nth[on[0]] == last:  # a sentence that went on
                np.maximum(rows[-1][-1], got[0], out=rows[-1][-1])
                got, of = got[1:], of[1:]
            last = int(nth[on[-1]])
            if len(got):
                rows.append(got)
                docs.append(of)

        toks: list[bytes] = []
        of: list[int] = []
        for i, t in enumerate(texts):
            mine = tokens(t)
            count[i] = len(mine) - mine.count(b".")
            if toks and len(toks) + len(mine) > TURN:
                add(toks, np.array(of))
                toks, of, open_ = [], [], False
            for at in range(0, len(mine), TURN) if len(mine) > TURN else ():  # a very long text
                add(mine[at : at + TURN], np.full(min(TURN, len(mine) - at), i))
            if len(mine) > TURN:
                open_ = False
                continue
            toks += mine
            of += [i] * len(mine)
        if toks:
            add(toks, np.array(of))
        return np.concatenate(rows), np.concatenate(docs), count


@dataclass
class Machine:
    landmarks: list[bytes]
    toxic: int  # so many of them, from the first on, are of toxic sentences
    weights: np.ndarray  # of the kernel values: Nystroem's map and the machine in one

    def judged(self, kernel: Kernel, texts: list[str]) -> np.ndarray:
        """How far each text's worst sentence leans to toxic, and how far its tokens do on average."""
        k, doc, count = kernel.sentences(texts)
        lean = np.maximum(k @ self.weights, 0)
        worst = np.zeros(len(texts))
        np.maximum.at(worst, doc, lean)
        return np.column_stack([worst, np.bincount(doc, np.maximum(lean - LEAN, 0), minlength=len(texts)) / (count + SHORT)])


@dataclass
class Model:
    machine: Machine
    levels: list[np.ndarray]  # for worst and average: ascending, with the probability at each
    chances: list[np.ndarray]  # between them it is interpolated; the larger of both counts

    @property
    def landmarks(self) -> list[bytes]:
        return self.machine.landmarks

    def kernel(self) -> Kernel:
        return Kernel(self.landmarks, self.machine.toxic)

    def scores(self, kernel: Kernel, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.landmarks:
            return np.full(len(texts), self.chances[0][0])
        x = self.machine.judged(kernel, texts)
        return np.maximum(*(np.interp(x[:, i], self.levels[i], self.chances[i]) for i in (0, 1)))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss over weighted rows."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    s = np.where(y > 0, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        gap = 1 - s * (x @ w)
        on = np.flatnonzero(gap > 0)
        h, g = np.eye(len(w)) * 0.5, np.zeros(len(w))
        for at in range(0, len(on), 1 << 14):  # double precision for a part of the rows at a time
            part = on[at : at + (1 << 14)]
            xo = x[part].astype(float)
            xw = xo * weight[part, None]
            h += c * (xw.T @ xo)
            g += c * (xw.T @ s[part])
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = (w + new) / 2
    return w


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and the probabilities of label 1 there: isotonic regression of weighted rows, equal
    margins being one, each pooled block smoothed by one row of even odds."""
    level, of = np.unique(margin, return_inverse=True)
    blocks: list[list[float]] = []  # rows, ones, lowest and highest margin
    for m, n, ones in zip(level.tolist(), np.bincount(of, weight).tolist(), np.bincount(of, weight * y).tolist()):
        blocks.append([n, ones, m, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, ones, _, high = blocks.pop()
            blocks[-1][0] += n
            blocks[-1][1] += ones
            blocks[-1][3] = high
    chance = np.maximum.accumulate([(b[1] + 0.5) / (b[0] + 1) for b in blocks])
    return np.array([x for b in blocks for x in b[2:]]), np.repeat(chance, 2)


class Apart:
    """A list of tokens of which no two are alike."""

    def __init__(self):
        self.tokens: list[bytes] = []
        self.having: dict[int, list[tuple[int, float]]] = {}  # subsequence -> tokens with it, weights

    def add(self, token: bytes) -> bool:
        """Append the token unless one of the list is APART or more like it."""
        mine: dict[int, float] = {}
        for _, code, weight in subsequences([token]):
            for c in code.tolist():
                mine[c] = mine.get(c, 0.0) + weight
        norm = math.sqrt(sum(w * w for w in mine.values())) or 1.0
        like = [0.0] * len(self.tokens)
        for c, w in mine.items():
            for i, v in self.having.get(c, ()):
                like[i] += w / norm * v
        if (max(like, default=0.0) - FLOOR) / (1 - FLOOR) >= APART:
            return False
        for c, w in mine.items():
            self.having.setdefault(c, []).append((len(self.tokens), w / norm))
        self.tokens.append(token)
        return True


def chosen(sample: list[tuple[str, int]]) -> tuple[list[bytes], int]:
    """Landmarks, and how many of them are toxic sentences': tokens that come in toxic documents' sentences only or nearly so, by the
    evidence for that, and of clean documents' tokens those that are most like them."""
    bad, good, many, seen = Counter(), Counter(), Counter(), set()
    size = Counter(y for _, y in sample)
    for text, label in sample:
        # distinct sentences: those of copied documents count once, and so does a token in a document
        toks, mine = tokens(text), set()
        ends = [0, *(i for i, t in enumerate(toks, 1) if t == b"." or i == len(toks))]
        for a, b in zip(ends, ends[1:]):
            s = (label, hash(tuple(toks[a:b])))
            if s not in seen:
                seen.add(s)
                mine.update(toks[a:b])
        (bad if label else good).update({p for t in mine for p in (pieces(t) if len(t) > LONGEST or b"~" in t or b"." in t else (t,)) if len(p) >= (4 if t.isascii() else 3)})
    share = size[1] / len(sample)

    def evidence(t: bytes) -> float:
        a, b = bad[t], good[t]
        return a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)

    # of all tokens of three documents, about one would show that much by chance
    least = math.log(max(1, sum(bad[t] + good[t] >= 3 for t in bad.keys() | good.keys())))
    ranked = {t: e for t, n in bad.items() if n >= 3 and 20 * good[t] * share <= n * (1 - share) and (e := evidence(t)) >= least}
    out = Apart()
    for t in sorted(ranked, key=lambda t: (-ranked[t], t)):
        if out.add(t) and len(out.tokens) == LANDMARKS:
            break
    toxic = len(out.tokens)
    if not toxic:
        return [], 0
    kernel, names = Kernel(out.tokens), [t for t, n in good.items() if n >= 3 and not bad[t] > n * share / (1 - share)]
    for at in range(0, len(names), 10_000):
        part = names[at : at + 10_000]
        part = [part[i] for i in np.flatnonzero(kernel.near(part))]
        many.update({t: v * good[t] for t, v in zip(part, kernel.values(part).max(axis=1, initial=0).tolist()) if 0 < v < APART})
    for t in sorted(many, key=lambda t: (-many[t], t)):
        if out.add(t) and len(out.tokens) == toxic + CLEAN:
            break
    return out.tokens, toxic


def learned(sample: list[tuple[str, int]]) -> tuple[Machine, Kernel]:
    """The machine on sentences, and the kernel that has met them."""
    y = np.array([b for _, b in sample], float)
    marks, toxic = chosen(sample) if 0 < y.sum() < len(y) else ([], 0)
    kernel = Kernel(marks, toxic)
    if not marks:
        return Machine([], 0, np.zeros(0)), kernel
    parts, clean = [], 0
    for at in range(0, len(sample), 100):
        texts = [t for t, _ in sample[at : at + 100]]
        k, doc, _ = kernel.sentences(texts)
        parts.append((k, y[at + doc]))
        clean += sum(tokens(x).count(b".") or 1 for x, b in sample[at : at + 100] if not b)
    k, label = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    # toxic sentences: those of toxic documents that hold a token much like a landmark
    shown = np.flatnonzero((label == 1) & (k.max(axis=1, initial=0) >= WITNESS))
    if not len(shown):
        shown = np.flatnonzero(label == 1)
    use = np.concatenate([shown, np.flatnonzero(label == 0)])
    among = kernel.values(marks).astype(float)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    root = (vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T).astype(np.float32)
    # sentences like no landmark are all the same: one row stands for those of clean documents
    x = np.concatenate([k[use] @ root, np.zeros((1, len(marks)), np.float32)])
    w = machine(x, np.append(label[use], 0), np.append(np.ones(len(use)), max(1, clean - (label == 0).sum())))
    return Machine(marks, toxic, (root @ w[:-1]).astype(np.float32)), kernel


def judged(machine: Machine, kernel: Kernel, sample: list[tuple[str, int]]) -> np.ndarray:
    return np.concatenate([machine.judged(kernel, [t for t, _ in sample[i : i + 100]]) for i in range(0, len(sample), 100)])


def train(sample: list[tuple[str, int]], stands_for: dict[int, float] | None = None) -> Model:
    """A model from (text, label) rows; without both labels every score is the same.  A row of
    a label stands for so many learning rows.  Each half of the rows is judged by a machine
    that learned from the other half, and these judgements calibrate the machine of all rows."""
    y = np.array([b for _, b in sample], float)
    if not len(y) or y.min() == y.max():
        return Model(Machine([], 0, np.zeros(0)), [], [np.array([0.0025 if not len(y) or y.max() == 0 else 0.9975])])
    weight = shares(y, stands_for)
    whole, _ = learned(sample)
    if not whole.landmarks:
        return Model(whole, [], [np.array([weight @ y / weight.sum()])])
    # equal texts go to the same half
    half = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t, _ in sample])
    x = np.zeros((len(y), 2))
    for h in (0, 1):
        mine, others = np.flatnonzero(half == h), [sample[i] for i in np.flatnonzero(half != h)]
        if len(mine):
            other, kernel = learned(others) if others else (whole, None)
            if not other.landmarks or kernel is None:
                other, kernel = whole, Kernel(whole.landmarks, whole.toxic)
            x[mine] = judged(other, kernel, [sample[i] for i in mine])
    return Model(whole, *zip(*(calibrated(x[:, i], y, weight) for i in (0, 1))))


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Model:
    """Learn from at most ``each`` labelled documents of either kind outside the held-out fold.

    An id with both labels is toxic; ids without a label, null ids and labels other than 0 and 1
    teach nothing; repeated rows count once; null texts are empty.  Without rows of both labels
    the model gives every text the same score."""
    return train(*labelled_sample(docs, labels, "toxic", each, most=CHARS, parts=".!?\n"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``score`` (0 to 1) of every row's whole text; null and empty texts have no tokens.
    Rows map one to one: repeated rows stay, extra columns go, an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = model.kernel()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(kernel, [t or "" for t in part.column(1).to_pylist()]), pa.float64())], [key, "score"])

    reachable(docs.sparkSession)
    return docs.select(key, text).mapInArrow(turn(run), f"`{key}` {dict(docs.dtypes)[key]}, score double")


def clean(docs: DataFrame, model: Model, below: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below ``below``; repeated
    rows stay or go together, a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = model.kernel()
        for b in batches:
            at = b.schema.get_field_index(text)
            for x in range(0, b.num_rows, 200):
                part = b.slice(x, 200)
                yield part.filter(pa.array(model.scores(kernel, [t or "" for t in part.column(at).to_pylist()]) < below))

    reachable(docs.sparkSession)
    return docs.mapInArrow(turn(run), docs.schema)
