"""Word-shingle sets of texts, hashed to 64 bits, in NumPy over Arrow buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import cached

WIDTH = 5
#: Bytes of text hashed at once; a longer text is a piece by itself.
PIECE = 1 << 19

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32  # A-Z only
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95
_u = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


_byte = mix(np.arange(1, 257, dtype=np.uint64) * _u(0x9E3779B97F4A7C15))
_place = mix(np.arange(300, 300 + WIDTH + 1, dtype=np.uint64) * _u(0x9E3779B97F4A7C15)) | _u(1)
_powers: list[np.ndarray] = []
cached(__name__, _powers.clear)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, PIECE), base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def _piece(data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of the texts data[cuts[i]:cuts[i+1]]."""
    n, docs = len(data), len(cuts) - 1
    if n == 0:
        return [np.empty(0, np.uint64)] * docs
    data = _fold[data]
    blank = _space[data]
    start, end = ~blank, ~blank
    start[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    inner = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < n)]
    start[inner] = ~blank[inner]
    end[inner - 1] = ~blank[inner - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(first):
        return [np.empty(0, np.uint64)] * docs
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte[data] * up[:n], out=total[1:])
    word = mix((total[last] - total[first]) * down[first])
    many = max(0, len(word) - WIDTH + 1)
    gram = np.zeros(many, np.uint64)
    for k in range(WIDTH):
        gram += word[k : k + many] * _place[k]
    gram = mix(gram)
    at = np.searchsorted(first, cuts)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WIDTH:
            g = np.sort(gram[a : b - WIDTH + 1])
            if len(g) > 1:
                g = g[np.concatenate(([True], g[1:] != g[:-1]))]
            out.append(g)
        elif b > a:  # fewer words: the whole sequence is the one shingle
            out.append(mix((word[a:b] * _place[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _place[WIDTH]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of every text of a string array, in order; null: empty."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if texts.null_count:
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECE, "right")) - 1)
        got = _piece(bytes_[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at])
        for i, s in enumerate(got, at):
            yield s if not texts.null_count or valid[i] else s[:0]
        at = to


def set_key(s: np.ndarray) -> int:
    """A 64-bit key of a set: equal sets, equal keys."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
