import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest

from ashlar.llm import lm
from ashlar.llm.common import LOWER, words
from ashlar.llm.queries import op8_lm


def kt(n0, n1):
    return sum(math.log((i + 0.5)) for i in range(n0)) + sum(math.log(i + 0.5) for i in range(n1)) - sum(math.log(i + 1) for i in range(n0 + n1))


class Tree:
    """The context tree, written out: a node for each context and bit prefix."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for t in texts:
            for ctx, x in self.coded(t):
                for j in range(8):
                    for d in range(lm.DEPTH + 1):
                        self.n[ctx[:d], j, x >> (8 - j)][x >> (7 - j) & 1] += 1
                        if d:
                            self.kids[ctx[: d - 1], j, x >> (8 - j)].add(ctx[:d])
        self.known = {}

    @staticmethod
    def coded(t):
        b = bytes(lm.DEPTH) + t.translate(LOWER).encode() + b"\0"
        for i in range(lm.DEPTH, len(b)):
            yield tuple(b[i - lm.DEPTH : i][::-1]), b[i]

    def weighted(self, ctx, j, p):
        if (ctx, j, p) not in self.known:
            own = kt(*self.n[ctx, j, p])
            if len(ctx) < lm.DEPTH:
                kids = sum(self.weighted(c, j, p) for c in self.kids[ctx, j, p])
                self.known[ctx, j, p] = np.logaddexp(own, kids) - math.log(2), 1 / (1 + math.exp(min(700, kids - own)))
            else:
                self.known[ctx, j, p] = own, 1.0
        return self.known[ctx, j, p][0]

    def score(self, t):
        total = 0.0
        for ctx, x in self.coded(t):
            for j in range(8):
                prefix, bit, p = x >> (8 - j), x >> (7 - j) & 1, None
                for d in range(lm.DEPTH, -1, -1):
                    c = ctx[:d]
                    n = self.n[c, j, prefix] if (c, j, prefix) in self.n else [0, 0]
                    own = (n[bit] + 0.5) / (sum(n) + 1)
                    self.weighted(c, j, prefix)
                    stop = self.known[c, j, prefix][1]
                    p = own if p is None else stop * own + (1 - stop) * p
                total += math.log10(p)
        return total


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def test_equals_the_tree_written_out(spark):
    rows = [(i, f"Abra cadabra {'kadabra' if i % 3 else 'simsalabim'} {i % 5}" if i % 7 else "") for i in range(40)]
    tree = Tree([t for i, t in rows if not held(i)])
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert any(held(i) for i, _ in rows)
    for i, t in rows:
        assert got[i] == pytest.approx(tree.score(t), rel=1e-9)


def unigrams(rows):
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(words((t or "").translate(LOWER)))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        toks = [*words((t or "").translate(LOWER)), None]
        out.append((i, held(i), len(toks), sum(c[x] > 0 for x in toks), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in toks)))
    return out


def same(rows, got):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    for a, b in zip(got, sorted(unigrams(rows), key=lambda x: repr(x))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert len(got) == len(rows)


def test_query_over_its_table(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet")
    got = op8_lm(spark, sf).collect()
    same(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), got)
    size = {i: len((x or "").encode()) + 1 for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())}
    out = [r for r in got if r["held_out"]]
    assert -sum(r["score"] for r in out) / sum(size[r["doc_id"]] for r in out) * math.log2(10) < 2.5  # bits a byte, from 180 documents


def test_shards_sum_up(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    whole = {r["doc_id"]: r for r in lm.score(d).collect()}
    monkeypatch.setattr(lm, "SHARD", 20_000)
    for r in lm.score(d).collect():
        w = whole[r["doc_id"]]
        assert r["score"] == pytest.approx(w["score"], rel=1e-9) and r["n_known"] == w["n_known"] and r["base_score"] == pytest.approx(w["base_score"], rel=1e-9)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in odd.texts()]
    same(rows, lm.score(odd.docs(spark)).collect())
    assert lm.score(odd.none(spark)).count() == 0


def test_bytes_of_a_context_share_out_one():
    texts = ["the cat sat", "the dog ran"]
    k, _ = lm.strings(texts)
    keys, counts = lm.merged(k, np.ones(len(k), np.int64))
    ctx = np.uint64((ord("t") << 40))
    every = np.unique(np.concatenate([keys, ctx | np.arange(256, dtype=np.uint64)]))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, keys)] = counts
    top = lm.subtree(every, full)[0]
    rows = []
    for j in range(8):
        ids = (top.node[j] >> np.uint64(8 + j)).astype(int) << 8 | (1 << j) | (top.node[j] & np.uint64((1 << j) - 1)).astype(int)
        for i in np.unique(ids):
            at = ids == i
            rows.append((int(i), int(top.n0[j][at].sum()), int(top.n1[j][at].sum()), float(top.pw[j][at].sum())))
    p = lm.log10_probabilities(every, full, lm.Top(rows))
    assert (10 ** p[(every >> np.uint64(8)) == ctx >> np.uint64(8)]).sum() == pytest.approx(1)
