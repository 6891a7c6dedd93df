"""Byte-level BPE by a token automaton.

Merging is compiled into a deterministic automaton over tokens.  It starts as one state
with a loop for every byte.  The gadget of merge ``(a, b) -> ab`` gives every state that
has an ``a`` arc an ``ab`` arc to where ``b`` led from ``a``'s state, and takes the ``b``
arc from (a copy of) ``a``'s state.  Since an arc's target depends on its label alone, a
state is named by the last token, and the automaton is kept as what each gadget did:
``ab``'s state is ``b``'s as it stood before the gadget, and merge ``(t, u)`` takes ``u``
from ``t``'s.  Looking an arc up walks those gadgets back and is then remembered in the
transition table.  Each byte string has exactly one accepted path, which is its BPE
encoding, so encoding a pre-split word follows a byte trie of the labels and the
transition table; decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cached, reachable, turn

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers in each of two generations, and the longest of them in characters: some 40 MB.
CACHE_WORDS, CACHE_CHARS = 80_000, 48
#: Looked-up arcs that a worker remembers: some 25 MB.
TABLE_ARCS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for
    itself, the other bytes in order from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The compiled automaton of one vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        letters = byte_letters()
        vocab: dict[str, int] = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.labels = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        # each token's gadget: its rank, left and right; rank -1: the token is not merged
        self.rank, self.left, self.right = (array("i", [-1]) * (max(self.labels) + 1) for _ in range(3))
        self.taken: dict[int, int] = {}  # state << 32 | arc -> rank of the gadget that takes it
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = vocab[a], vocab[b]
            self.taken.setdefault(left << 32 | right, rank)
            new = vocab[a + b]
            if self.rank[new] < 0:
                self.rank[new], self.left[new], self.right[new] = rank, left, right
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends: list[int] = [-1]
        for s, i in vocab.items():
            node = 0
            for byte in self.labels[i]:
                after = self.trie.get(node << 8 | byte)
                if after is None:
                    after = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = after
            self.ends[node] = i
        self.longest = max(map(len, self.labels.values()))
        self.table: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def arc(self, t: int, u: int, before: int) -> bool:
        """Whether state t has arc u after the gadgets of lower rank than ``before``."""
        if self.taken.get(t << 32 | u, before) < before:
            return False
        gt, gu = self.rank[t], self.rank[u]
        if gt < 0 and gu < 0:
            return True
        if gt > gu:
            return self.arc(self.right[t], u, gt)
        if gu > gt:
            return self.arc(t, self.left[u], gu + 1)  # a doubling merge (a, a) has already taken a from a's state
        return self.arc(self.right[t], self.left[t], gt)

    def arcs_at(self, word: bytes, i: int) -> list[int]:
        """The labels that spell word from i on, shortest first."""
        trie, ends, node, out = self.trie, self.ends, 0, []
        for byte in word[i : i + self.longest]:
            node = trie.get(node << 8 | byte)
            if node is None:
                break
            if ends[node] >= 0:
                out.append(ends[node])
        return out

    def path(self, word: bytes) -> list[int]:
        """The accepted path's labels.  It goes by the longest arc and steps back from a
        dead end; a place has one state whichever way it was reached, so dead places are
        not tried again and the work is linear in the word."""
        n, table, labels = len(word), self.table, self.labels
        out: list[int] = []
        places, open_arcs, dead, i = [0], [self.arcs_at(word, 0)], set(), 0
        while i < n:
            left = open_arcs[-1]
            while left:
                u = left.pop()
                j = i + len(labels[u])
                if j in dead:
                    continue
                if out:
                    key = out[-1] << 32 | u
                    ok = table.get(key)
                    if ok is None:
                        ok = table[key] = self.arc(out[-1], u, 1 << 60)
                    if not ok:
                        continue
                out.append(u)
                i = j
                places.append(i)
                if i < n:
                    open_arcs.append(self.arcs_at(word, i))
                break
            else:
                dead.add(i)
                places.pop()
                open_arcs.pop()
                out.pop()
                i = places[-1]
        return out

    def packed(self, word: str) -> bytes:
        """The ids of a pre-split word, little-endian unsigned 32-bit."""
        got = self.older.get(word)
        if got is None:
            got = b"".join(i.to_bytes(4, "little") for i in self.path(word.encode("utf-8", "surrogatepass")))
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:  # words not asked for since the last turn go
                self.older = self.known.copy()
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        known, parts = self.known, []
        for piece in self.cut(text) if self.cut else [text]:
            if piece in self.special:
                parts.append(self.special[piece].to_bytes(4, "little"))
            else:
                parts += [known.get(w) or self.packed(w) for w in self.split(piece)]
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_built: dict[str, Automaton] = {}
cached(__name__, _built.clear)


def automaton(spec: str) -> Automaton:
    """One automaton a worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(spec)
    return _built[key]


def _spec(df: DataFrame, path: str):
    # a vocabulary file is a fixed few MB whatever the corpus
    with open(path, encoding="utf-8") as f:
        return reachable(df.sparkSession).sparkContext.broadcast(f.read())


def _column(df: DataFrame, key: str, value: Column, name: str, kind: str, step) -> DataFrame:
    """key and value, as columns ``key`` and ``name``, through step(list) -> list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.binary() if kind == "binary" else pa.string()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(step(part.column(1).to_pylist()), to)], [key, name])

    return df.select(F.col(key), value.alias(name)).mapInArrow(turn(run), f"`{key}` {dict(df.dtypes)[key]}, `{name}` {kind}")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key and ``ids``, the little-endian unsigned 32-bit token ids.

    A null or empty text has no ids.  Special tokens' strings become their ids, as the
    tokenizers library does; no truncation or padding.  Rows map one to one: repeated
    rows stay, extra columns go, an empty table gives an empty one.
    """
    spec = _spec(docs, path)

    def step(texts: list) -> list:
        a = automaton(spec.value)
        return [a.encode(t or "") for t in texts]

    return _column(docs, key, F.col(text), "ids", "binary", step)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row a row: the key and ``decoded``, the labels' bytes as UTF-8 (null ids: empty)."""
    spec = _spec(encoded, path)

    def step(rows: list) -> list:
        a = automaton(spec.value)
        return [a.decode(x or b"") for x in rows]

    return _column(encoded, key, F.col(ids), "decoded", "string", step)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``ids`` and ``decoded`` of each document in one pass: the ids go through
    decode() as they stand, not through the text."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [a.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(list(map(a.decode, ids)), pa.string())], [key, "ids", "decoded"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(turn(run), f"`{key}` {dict(docs.dtypes)[key]}, ids binary, decoded string")
