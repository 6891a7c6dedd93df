"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions, each in the context of the bits before it in its
byte and of up to DEPTH bytes before.  Every node of the context tree has a
Krichevsky-Trofimov estimate from the training documents, and the tree mixes, at each node,
its own estimate with its children's, by how well either would have coded the training
bytes.  A text's score is the log probability of its bytes and one end.

Counts of byte strings are gathered from all documents (strings that only held-out ones
have come with a count of zero, so that their probability is worked out too).  Subtrees
below two context bytes are each worked out in one task on distinct strings; what joins
them is bounded by the alphabet.  The resulting tables are read by scoring tasks in shards
of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cached, held_out, keep, new_path, reachable, slices, turn
from .jaccard import BLOB, dealt, grouped, pack, rows, unpack
from .shingles import _byte, _power, mix

#: Context bytes; bytes of text a worker takes at once; strings it holds before it passes them on.
DEPTH, TEXT, HELD = 5, 2 << 20, 2 << 20
#: Characters of text whose strings one task adds up.
PART = 16 << 20
#: Entries of a shard that a scoring worker holds.
SHARD = 8 << 20
END = np.uint64(0x9E3779B97F4A7C15)
_u = np.uint64
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


def strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(string, text) for every byte of the lower-cased texts and one end (a zero byte) each.

    A string is the byte with DEPTH bytes before it, the nearest first: b1 b2 b3 b4 b5 x.
    Before a text there are zeros."""
    pad = bytes(DEPTH)
    data = _fold[np.frombuffer(pad + pad[:DEPTH].join(t.encode("utf-8", "surrogatepass") + b"\0" for t in texts), np.uint8)]
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts]) + 1
    first = np.cumsum(sizes + DEPTH) - sizes
    real = np.ones(len(data), bool)
    for k in range(1, DEPTH + 1):
        real[first - k] = False
    wide = data.astype(np.uint64)
    key = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        key |= wide[DEPTH - k : len(wide) - k] << _u(8 * (DEPTH + 1 - k))
    return key[real[DEPTH:]], np.repeat(np.arange(len(texts)), sizes)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token: the lower-cased words and one end a text."""
    data = _fold[np.frombuffer(b"\0".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\0", np.uint8)]
    ends_at = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts]) - 1
    blank = _blank[data]
    blank[ends_at] = True
    begin, stop = ~blank, ~blank
    begin[1:] &= blank[:-1]
    stop[:-1] &= blank[1:]
    at, to = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte[data] * up[: len(data)], out=total[1:])
    h = mix((total[to] - total[at]) * down[at])
    return np.concatenate([h, np.full(len(texts), END)]), np.concatenate([np.searchsorted(ends_at, at), np.arange(len(texts))])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cut], np.add.reduceat(counts, cut)


def tally(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each comes with train set."""
    marked = np.sort(keys << _u(1) | train.astype(np.uint64)) if len(keys) and keys.max() < 1 << 63 else None
    if marked is None:
        return merged(keys, train.astype(np.int64))
    k = marked >> _u(1)
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[cut], np.add.reduceat((marked & _u(1)).astype(np.int64), cut)


def gather(parts: int):
    """Texts -> counts of strings (kind 0, by their two nearest context bytes) and of training tokens (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            k, c = merged(*(np.concatenate([x[i] for x in held[kind]]) for i in (0, 1)))
            held[kind] = []
            dest = (mix(k >> _u(32)) if kind == 0 else k) % _u(parts)
            out = dealt(dest.astype(np.int32), kind, k, c)
            for at in range(0, len(out), 64):
                yield rows(out[at : at + 64])

        for whole in batches:
            for b in slices(whole, 0, TEXT):
                texts = [t or "" for t in b.column(0).to_pylist()]
                train = b.column(1).to_numpy(zero_copy_only=False)
                k, of = strings(texts)
                held[0].append(tally(k, train[of]))
                h, of = word_hashes(texts)
                h = h[train[of]]
                held[1].append(merged(h, np.ones(len(h), np.int64)))
                for kind in (0, 1):
                    if sum(len(x[0]) for x in held[kind]) > HELD:
                        yield from flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from flush(kind)

    return run


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by destination -> one row a destination and kind, keys sorted."""
    for dest, got in grouped(batches):
        out = []
        for kind in (0, 1):
            parts = [unpack(body, "<u8", "<i8") for k, body in got if k == kind]
            if parts:
                k, c = merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                if len(k):
                    out.append((dest, kind, pack(k, c)))
        yield rows(out)


_half: list[np.ndarray] = []


def log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2 (less that of 1/2) or of n + 1, for whole n."""
    if not _half:
        i = np.arange(1, 1 << 16)
        _half.extend([np.concatenate(([0.0], np.cumsum(np.log(i)))), np.concatenate(([0.0], np.cumsum(np.log(i - 0.5))))])
    small = _half[1 if half else 0]
    x = n + (0.5 if half else 1.0)
    big = np.maximum(x, 2.0)
    series = (big - 0.5) * np.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3)
    if half:
        series = series - 0.5723649429247001
    return np.where(n < len(small), small[np.minimum(n, len(small) - 1)], series)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(n0, True) + log_gamma(n1, True) - log_gamma(n0 + n1, False)


def half_and_half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) - np.log(2)


class Level:
    """Nodes of one depth: for each bit place, their keys, counts, weighted log probability and stopping weight."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        k = (keys >> _u(8 * (DEPTH + 1 - depth))) << _u(8) | (keys & _u(255))
        self.k, self.c = merged(k, counts)
        self.node, self.n0, self.n1, self.pw, self.stop = [], [], [], [], []
        for j in range(8):
            node = self.k >> _u(8 - j)
            cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            one = ((self.k >> _u(7 - j)) & _u(1)).astype(np.int64) * self.c
            self.node.append(node[cut])
            all_, ones = np.add.reduceat(self.c, cut), np.add.reduceat(one, cut)
            self.n0.append(all_ - ones)
            self.n1.append(ones)

    def weigh(self, below: Level | None) -> None:
        for j in range(8):
            own = estimate(self.n0[j], self.n1[j])
            if below is None:
                self.pw.append(own)
                self.stop.append(np.ones(len(own)))
                continue
            child = below.node[j]
            parent = (child >> _u(8 + j)) << _u(j) | (child & _u((1 << j) - 1))
            kids = np.bincount(np.searchsorted(self.node[j], parent), below.pw[j], minlength=len(own))
            self.pw.append(half_and_half(own, kids))
            self.stop.append(1 / (1 + np.exp(np.clip(kids - own, -700, 700))))


def subtree(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels 2 to DEPTH, weighed."""
    levels: list[Level] = []
    for depth in range(DEPTH, 1, -1):
        level = Level(keys, counts, depth)
        level.weigh(levels[-1] if levels else None)
        levels.append(level)
    return levels[::-1]


def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the subtrees below two context bytes give the node above them: id (nearest byte
    and bit node), n0, n1 and the sum of weighted log probabilities."""
    for b in batches:
        for kind, body in zip(b.column(1).to_pylist(), b.column(2)):
            if kind:
                continue
            top = subtree(*unpack(body.as_py(), "<u8", "<i8"))[0]
            ids, n0, n1, pw = [], [], [], []
            for j in range(8):
                ids.append((top.node[j] >> _u(8 + j)).astype(np.int64) << 8 | (1 << j) | (top.node[j] & _u((1 << j) - 1)).astype(np.int64))
                n0.append(top.n0[j])
                n1.append(top.n1[j])
                pw.append(top.pw[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, n0, n1, pw)], ["id", "n0", "n1", "pw"])


class Top:
    """The nodes above: one a nearest byte and bit node (65,280 at most), and those without context."""

    def __init__(self, found: list):
        self.n0, self.n1, kids = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
        for i, a, b, p in found:
            self.n0[i >> 8, i & 255], self.n1[i >> 8, i & 255], kids[i >> 8, i & 255] = a, b, p
        own = estimate(self.n0, self.n1)
        self.stop = 1 / (1 + np.exp(np.clip(kids - own, -700, 700)))
        pw = half_and_half(own, kids)
        self.r0, self.r1 = self.n0.sum(axis=0), self.n1.sum(axis=0)
        own, kids = estimate(self.r0, self.r1), pw.sum(axis=0)
        self.root = 1 / (1 + np.exp(np.clip(kids - own, -700, 700)))


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 of each string's last byte's probability after its context."""
    levels = subtree(keys, counts)
    x = (keys & _u(255)).astype(np.int64)
    b1 = (keys >> _u(8 * DEPTH)).astype(np.int64)
    total = np.zeros(len(keys))
    for j in range(8):
        one = (x >> (7 - j)) & 1

        def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
            return (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1.0)

        p = None
        for depth in range(DEPTH, 1, -1):
            level = levels[depth - 2]
            node = (keys >> _u(8 * (DEPTH + 1 - depth))) << _u(j) | (x >> (8 - j)).astype(np.uint64)
            at = np.searchsorted(level.node[j], node)
            own = kt(level.n0[j][at], level.n1[j][at])
            p = own if p is None else level.stop[j][at] * own + (1 - level.stop[j][at]) * p
        bit = (1 << j) | (x >> (8 - j))
        p = top.stop[b1, bit] * kt(top.n0[b1, bit], top.n1[b1, bit]) + (1 - top.stop[b1, bit]) * p
        p = top.root[bit] * kt(top.r0[bit], top.r1[bit]) + (1 - top.root[bit]) * p
        total += np.log10(p)
    return total


def tables(top: Top, shards: int):
    """Counts -> tables for scoring: key and log10 probability (kind 0), token and count (kind 1), with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dest, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                k, c = unpack(body.as_py(), "<u8", "<i8")
                value = log10_probabilities(k, c, top) if kind == 0 else c.astype(float)
                shard = (mix(k) % _u(shards)).astype(np.int32)
                for s, _, packed in dealt(shard, kind, k, value):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), pa.array([packed], pa.binary())], ["shard", "kind", "body"])

    return run


_loaded: dict[str, list] = {}
cached(__name__, _loaded.clear)


def shard_tables(path: str) -> list:
    """One shard's two tables, sorted by key; a worker process holds one shard at a time."""
    if path not in _loaded:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _loaded.clear()
        store, base = fs.FileSystem.from_uri(path)
        got: dict[int, list] = {0: [], 1: []}
        for f in store.get_file_info(fs.FileSelector(base)):
            if f.path.endswith(".parquet"):
                with store.open_input_file(f.path) as file:
                    for b in pq.ParquetFile(file).iter_batches(batch_size=4, columns=["kind", "body"]):
                        for kind, body in zip(b.column(0).to_pylist(), b.column(1)):
                            got[kind].append([x.copy() for x in unpack(body.as_buffer().to_pybytes(), "<u8", "<f8")])
        out = []
        for kind in (0, 1):
            k = np.concatenate([x[0] for x in got[kind]] or [np.empty(0, np.uint64)])
            v = np.concatenate([x[1] for x in got[kind]] or [np.empty(0)])
            got[kind].clear()
            order = np.argsort(k)
            k, v = k[order], v[order]
            out.append((k, v))
        _loaded[path] = out
    return _loaded[path]


def looked_up(keys: np.ndarray, of: np.ndarray, docs: int, table: tuple[np.ndarray, np.ndarray], value) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of value(table entry) over its keys in the table, and how many those are."""
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    distinct = keys[cut]
    at = np.minimum(np.searchsorted(table[0], distinct), max(0, len(table[0]) - 1))
    found = table[0][at] == distinct if len(table[0]) else np.zeros(len(distinct), bool)
    v = np.where(found, value(table[1][at]) if len(table[0]) else 0.0, 0.0)
    each = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(keys))))
    return np.bincount(of, v[each], minlength=docs), np.bincount(of, found[each], minlength=docs)


def scorer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, TEXT):
                grams, tokens = shard_tables(path)
                texts = [t or "" for t in b.column(2).to_pylist()]
                k, of = strings(texts)
                logp, _ = looked_up(k, of, len(texts), grams, lambda v: v)
                h, of = word_hashes(texts)
                logc, known = looked_up(h, of, len(texts), tokens, lambda c: np.log10(c + 0.1))
                n = np.bincount(of, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logc), pa.array(logp)], ["row", "doc_id", "n_tokens", "n_known", "log_counts", "score"])

    return run


SCORED = "row bigint, doc_id {id}, n_tokens bigint, n_known bigint, log_counts double, score double"


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The models learn from the documents whose crc32(doc_id) leaves a remainder by ``folds``
    (a null id is held out).  base_score: smoothed unigram log10 probability of the tokens
    (lower-cased words and one end); score: the weighted context tree's of the lower-cased
    bytes and one end.  Null texts are empty and have the end alone.  Repeated rows are
    scored each.  If nothing trains, every byte has probability 1/256.
    """
    spark = reachable(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), folds).alias("held"))
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(32, 2 * spark.sparkContext.defaultParallelism, size // PART)
    counts = d.select("text", (~F.col("held")).alias("train")).mapInArrow(turn(gather(parts)), BLOB)
    counts = keep(counts.repartition(parts, "dest").sortWithinPartitions("dest").mapInArrow(turn(add_up), BLOB), "counts")
    found = counts.where("kind = 0").mapInArrow(turn(heads), "id bigint, n0 bigint, n1 bigint, pw double").groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("pw"))
    top = Top([tuple(r) for r in found.collect()])  # 65,280 rows at most, whatever the corpus
    # a packed row holds 8 bytes of length and 16 an entry
    size = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum((F.octet_length("body") - 8) / 16).cast("bigint").alias("n")).collect()}
    shards = max(1, -(-max(size.values(), default=0) // SHARD))
    path = new_path(spark, "model")
    counts.mapInArrow(turn(tables(top, shards)), "shard int, kind int, body binary").write.option("compression", "none").partitionBy("shard").parquet(path)
    total = counts.where("kind = 1").mapInArrow(turn(_sums), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rest = float(total + 0.1 * (size.get(1, 0) + 1))
    texts = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if shards > 1:  # all passes must number the rows alike
        texts = keep(texts, "texts")
    out = None
    for s in range(shards):  # each pass holds one shard; sums over shards make the score
        one = texts.mapInArrow(turn(scorer(f"{path}/shard={s}")), SCORED.format(id=kind))
        out = one if out is None else out.union(one)
    if shards > 1:
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("log_counts").alias("log_counts"), F.sum("score").alias("score"))
    base = F.col("log_counts") + (F.col("n_tokens") - F.col("n_known")) * F.lit(-1.0) - F.col("n_tokens") * F.log10(F.lit(rest))
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(unpack(x.as_py(), "<u8", "<i8")[1].sum()) for x in b.column(2)], pa.int64())], ["n"])
