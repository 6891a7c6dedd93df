"""Exact n-gram Jaccard self-join by set relations.

Equal sets are one set from the start.  The others' shingles go into index lists ordered
by one global order (shingles of few sets first, frequent ones last, by hash within), of
which each set only enters its prefix; sets that are similar enough share several of them.
Lists are kept by set size with the entry's position, and what a size and a position can
still reach lets entries beyond it be skipped.  Long lists are not expanded into pairs:
the sets that long lists connect form a group, which is cut into blocks by size, and a
tile of two blocks finds its links where the sets are.  There a set's intersections with
all others are not counted anew but derived from those of a similar set, by the few
shingles in which the two differ.  Pairs of short lists are compared on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, keep, reachable, slices, turn
from .components import components
from .shingles import set_key, sets

#: A shingle of more sets than this is frequent; a list longer than LONG is not expanded.
FREQUENT, LONG = 64, 96
#: Sets of a block, and sets whose answers a tile keeps to derive others' from.
BLOCK, PIVOTS = 2048, 8
#: The part of the hash range, from below, whose shingles can be counted and indexed.
ZONE = np.uint64(1 << 63)
#: Index entries a task is meant to hold, and filter rows up to which a filter is broadcast.
TASK, FILTER = 1 << 19, 2_000_000
#: Bytes of text that a worker turns into index entries at once.
TEXT = 3 << 20

BLOB = "dest int, kind int, body binary"


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The smallest intersection that links sets of n and m: 100 i >= 80 (n + m - i)."""
    return (4 * (n + m) + 8) // 9


def shared(alpha: np.ndarray) -> np.ndarray:
    """How many common shingles must show in the prefixes of linked sets."""
    return 1 + alpha // 24


def prefix(n: np.ndarray) -> np.ndarray:
    """Entries of a set of n that any linked set's prefix may have to meet."""
    alpha = (4 * n + 4) // 5
    return n - alpha + shared(alpha)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as bytes."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(body: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(body, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["dest", "kind", "body"])


def dealt(dest: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The arrays' rows as one packed row for each destination."""
    if not len(dest):
        return []
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    arrays = tuple(a[order] for a in arrays)
    cut = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True])))
    return [(int(dest[a]), kind, pack(*(x[a:b] for x in arrays))) for a, b in zip(cut[:-1], cut[1:])]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(dest, [(kind, body)]) of rows sorted by dest."""
    dest, got = None, []
    for b in batches:
        for d, k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if d != dest:
                if got:
                    yield dest, got
                dest, got = d, []
            got.append((k, body.as_py()))
    if got:
        yield dest, got


def joined(parts: list[list[np.ndarray]], *types: str) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate(types)]


def runs(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)


ENTRY = ("<u8", "<i8", "<i4", "<i4", "<i4")  # shingle, set, its size, its shingles in the zone, rank by hash


def spread(parts: int, frequent_over: int = FREQUENT):
    """Texts -> index entries, dealt by shingle.  A shingle of more than frequent_over sets of one
    batch is frequent for certain: its entries go past the count, by set, and the count only
    gets a note, so no shingle gathers more entries a batch than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 0, TEXT)):
            tok, key, size, zone, rank = [], [], [], [], []
            for s in sets(b.column(0)):
                n = len(s)
                if not n:
                    continue
                z = int(np.searchsorted(s, ZONE))
                m = max(z, min(n, int(prefix(np.int64(n)))))
                tok.append(s[:m])
                key.append(np.full(m, set_key(s)))
                size.append(np.full(m, n, np.int32))
                zone.append(np.full(m, z, np.int32))
                rank.append(np.arange(m, dtype=np.int32))
            if not tok:
                continue
            t, k, n, z, r = map(np.concatenate, (tok, key, size, zone, rank))
            order = np.argsort(t, kind="stable")
            cut = runs(t[order])
            hot = np.repeat(np.diff(cut) > frequent_over, np.diff(cut))
            frequent = np.zeros(len(t), bool)
            frequent[order[hot]] = True
            frequent &= r < z
            here = ~frequent
            dest = (t % np.uint64(parts)).astype(np.int32)
            out = dealt(dest[here], 0, t[here], k[here], n[here], z[here], r[here])
            note = np.unique(t[frequent])
            out += dealt((note % np.uint64(parts)).astype(np.int32), 1, note)
            out += dealt((k[frequent] % parts).astype(np.int32), 2, t[frequent], k[frequent], n[frequent], z[frequent], r[frequent], np.ones(frequent.sum(), np.int8))
            for at in range(0, len(out), 64):
                yield rows(out[at : at + 64])

    return run


def counted(parts: int, frequent_over: int = FREQUENT):
    """Entries by shingle -> entries of shingles that more than one set has, marked if frequent, dealt by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in grouped(batches):
            yield rows(_counted(got, parts, frequent_over))

    return run


def _counted(got: list[tuple[int, bytes]], parts: int, frequent_over: int) -> list[tuple[int, int, bytes]]:
    t, k, n, z, r = joined([unpack(body, *ENTRY) for kind, body in got if kind == 0], *ENTRY)
    notes = [unpack(body, "<u8")[0] for kind, body in got if kind == 1]
    note = np.unique(np.concatenate(notes)) if notes else np.empty(0, np.uint64)
    order = np.argsort(t, kind="stable")
    t, k, n, z, r = t[order], k[order], n[order], z[order], r[order]
    cut = runs(t)
    many = np.diff(cut)
    df = np.repeat(many, many)
    noted = np.isin(t, note)
    frequent = ((df > frequent_over) | noted) & (r < z)
    stay = (df > 1) | noted
    out = dealt((k[stay] % parts).astype(np.int32), 2, t[stay], k[stay], n[stay], z[stay], r[stay], frequent[stay].astype(np.int8))
    # what went past the count is by set already
    return out + [(int(unpack(body, "<u8", "<i8")[1][0] % parts), 2, body) for kind, body in got if kind == 2]


def placed(parts: int):
    """Entries by set -> the sets' prefixes with positions in the global order, dealt by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (*ENTRY, "<i1")
        for _, got in grouped(batches):
            t, k, n, z, r, f = joined([unpack(body, *types) for _, body in got], *types)
            order = np.lexsort((r, k))
            t, k, n, z, r, f = (x[order] for x in (t, k, n, z, r, f))
            cut = runs(k)
            many = np.diff(cut)
            total = np.concatenate(([0], np.cumsum(f)))
            before = total[:-1] - np.repeat(total[cut[:-1]], many)
            frequent = np.repeat(total[cut[1:]] - total[cut[:-1]], many)
            # few-set shingles of the zone, then its frequent ones, then the rest
            pos = np.where(r >= z, r, np.where(f == 1, z - frequent + before, r - before))
            keep_ = pos < prefix(n.astype(np.int64))
            t, k, n, pos = t[keep_], k[keep_], n[keep_], pos[keep_].astype(np.int32)
            out = dealt((t % np.uint64(parts)).astype(np.int32), 0, t, k, n, pos)
            if out:
                yield rows(out)

    return run


LIST = ("<u8", "<i8", "<i4", "<i4")  # shingle, set, its size, position


def reaches(n: np.ndarray, pos: np.ndarray, m: np.ndarray, mpos: np.ndarray) -> np.ndarray:
    """Whether a common shingle at these positions can be one of those that must show."""
    alpha = need(n, m)
    slack = shared(alpha) - 1 - alpha
    return (n - pos + slack >= 0) & (m - mpos + slack >= 0)


def farthest(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """No less than the largest size that an entry can reach from its position: with m, alpha
    less what shared() forgives must not pass n - pos."""
    return (9 * 24 * (n - pos + 1) // 23 + 9) // 4 - n


PAIR = "a bigint, b bigint, na int, nb int, hits bigint"


def pairs_batch(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs with their hits, the smaller set key first."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]))) if len(a) else np.zeros(1, np.int64)
    at = cut[:-1]
    return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(na[at].astype(np.int32)), pa.array(nb[at].astype(np.int32)), pa.array(np.diff(cut).astype(np.int64))], ["a", "b", "na", "nb", "hits"])


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, sets, sizes, positions) of each destination, sorted by shingle, size and set."""
    for _, got in grouped(batches):
        t, k, n, pos = joined([unpack(body, *LIST) for _, body in got], *LIST)
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        order = np.lexsort((k, n, t))
        yield t[order], k[order], n[order], pos[order]


def short_pairs(longest: int = LONG):
    """All pairs that meet in lists up to ``longest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, k, n, pos in lists(batches):
            many = np.diff(runs(t))
            use = np.repeat(many <= longest, many)
            t, k, n, pos = t[use], k[use], n[use], pos[use]
            found: list[tuple] = []
            size = 0
            # entry i meets the entries behind it, for all lists at once, and leaves its list at
            # the first size that it cannot reach from its position; the rest is skipped
            far = np.minimum(farthest(n, pos), 5 * n // 4)
            i = np.arange(len(t))
            for d in range(1, int(many[many <= longest].max(initial=0))):
                i = i[i + d < len(t)]
                i = i[(t[i + d] == t[i]) & (n[i + d] <= far[i])]
                if not len(i):
                    break
                j = i + d
                ok = (k[i] != k[j]) & reaches(n[i], pos[i], n[j], pos[j])
                x, y = i[ok], j[ok]
                found.append((k[x], k[y], n[x], n[y]))
                size += len(x)
                if size > 1 << 19:
                    yield pairs_batch(*map(np.concatenate, zip(*found)))
                    found, size = [], 0
            if size:
                yield pairs_batch(*map(np.concatenate, zip(*found)))

    return run


def long_members(longest: int = LONG):
    """(set, first set of the list, size) for the members of each longer list: what holds a group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, k, n, _ in lists(batches):
            cut = runs(t)
            many = np.diff(cut)
            use = np.repeat(many > longest, many)
            first = np.repeat(k[cut[:-1]], many)
            yield pa.RecordBatch.from_arrays([pa.array(k[use]), pa.array(first[use]), pa.array(n[use].astype(np.int32))], ["a", "b", "n"])

    return run


def tile_links(x: list[np.ndarray], y: list[np.ndarray], own: bool, copies: np.ndarray, total: np.ndarray, every: bool = False) -> Iterator[tuple[int, int]]:
    """Links of the sets of x (with each other and with those of y) as a forest of index
    pairs, or every link; y's sets are counted from len(x) on.  Pairs within y are another
    tile's, and so are those within x, but for the forest, unless this tile is x's own.
    Adds to total, for each set, the copies of the sets that it links with in this tile."""
    all_ = x + y
    sizes = np.array([len(s) for s in all_])
    token = np.concatenate(all_)
    owner = np.repeat(np.arange(len(all_)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    cut = runs(token)
    names, starts, many = token[cut[:-1]], cut[:-1], np.diff(cut)

    def tally(shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each set has, from their index lists."""
        at = np.searchsorted(names, shingles)
        n = many[at]
        where = np.arange(n.sum()) + np.repeat(starts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.bincount(owner[where], minlength=len(all_))

    label = np.arange(len(all_))  # the class that each set is known to be in
    pivots: list[tuple[np.ndarray, np.ndarray]] = []
    for i, s in enumerate(x):
        best = max(pivots, key=lambda p: p[1][i], default=None)
        if best is not None and 2 * best[1][i] > max(len(s), len(best[0])):
            p, known = best
            both = np.intersect1d(s, p, assume_unique=True)
            counts = known + tally(np.setdiff1d(s, both, assume_unique=True)) - tally(np.setdiff1d(p, both, assume_unique=True))
        else:
            counts = tally(s)
            pivots = [*pivots[-(PIVOTS - 1) :], (s, counts)]
        linked = np.flatnonzero(counts >= need(sizes, np.int64(len(s))))
        linked = linked[linked > i]
        mine = linked if own else linked[linked >= len(x)]
        total[i] += copies[mine].sum()
        total[mine] += copies[i]
        if every:
            yield from ((i, j) for j in mine.tolist())
            continue
        # one link to each class is enough
        classes, at = np.unique(label[linked], return_index=True)
        for c, j in zip(classes.tolist(), linked[at].tolist()):
            if c != label[i]:
                yield i, j
                label[label == c] = label[i]


def tiles(every: bool = False):
    """Rows (tile, side, key, copies, body) sorted by tile and side (2: the first side of a
    block's tile with itself) -> links (a, b) and link counts (a, n)."""

    def links(own: bool, key: list[list[int]], copies: list[list[int]], sets_: list[list[np.ndarray]]) -> pa.RecordBatch:
        names = np.array(key[0] + key[1], np.int64)
        total = np.zeros(len(names), np.int64)
        found = list(tile_links(*sets_, own, np.array(copies[0] + copies[1], np.int64), total, every)) if sets_[0] else []
        some = np.flatnonzero(total)
        a, b = (names[[p[i] for p in found]].tolist() if found else [] for i in (0, 1))
        columns = a + names[some].tolist(), b + [None] * len(some), [None] * len(a) + total[some].tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, key, copies, sets_ = None, False, [[], []], [[], []], [[], []]
        for b in batches:
            for tile, side, k, n, body in zip(*(c.to_pylist() for c in b.columns)):
                if tile != now:
                    if now is not None:
                        yield links(own, key, copies, sets_)
                    now, own, key, copies, sets_ = tile, side == 2, [[], []], [[], []], [[], []]
                key[side % 2].append(k)
                copies[side % 2].append(n)
                sets_[side % 2].append(np.frombuffer(body, np.uint64))
        if now is not None:
            yield links(own, key, copies, sets_)

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(len(s), set_key(s) if len(s) else None) for s in sets(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["doc_id", "n_shingles", "key"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 0, TEXT):
            got = list(sets(part.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["key", "body"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in slices(whole, 2, TEXT)):
        a, c = [], []
        for x, y, p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            s, t = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            if len(np.intersect1d(s, t, assume_unique=True)) >= int(need(np.int64(len(s)), np.int64(len(t)))):
                a.append(x)
                c.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose doc_id is (left_semi) or is not (left_anti) among ids, a kept table; the
    text is not shuffled where the ids are few enough to send out."""
    return docs.join(F.broadcast(ids) if bounded(ids, FILTER) else ids, "doc_id", how)


def _bodies(docs: DataFrame, keys: DataFrame, owner: DataFrame) -> DataFrame:
    """key, body (the whole set) of the wanted sets, from their owners' texts."""
    ids = keep(owner.join(keys, "key", "left_semi").select("doc_id").distinct(), "set-ids")
    texts = _only(docs, ids, "left_semi").select("text")
    if not ids.where("doc_id IS NULL").isEmpty():  # sets that only rows without an id have
        texts = texts.union(docs.where("doc_id IS NULL").select("text"))
    return texts.mapInArrow(turn(_whole), "key bigint, body binary").join(keys, "key", "left_semi").dropDuplicates(["key"])


def _verified(docs: DataFrame, pairs: DataFrame, owner: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, compared on their whole sets."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    body = keep(_bodies(docs, keys, owner), "pair-sets")
    got = pairs.select("a", "b").join(body.withColumnsRenamed({"key": "a", "body": "x"}), "a").join(body.withColumnsRenamed({"key": "b", "body": "y"}), "b")
    return got.select("a", "b", "x", "y").mapInArrow(turn(_linked), "a bigint, b bigint")


def _grouped_links(docs: DataFrame, members: DataFrame, owner: DataFrame, block: int = BLOCK, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and link counts (a, n) of the sets of each group that long lists connect
    (members: a, b, n), and the sets' groups (key, root).

    A group is cut by size (sets link only within a class of sizes or with the next one) and
    by hash into blocks of about ``block`` sets; every two blocks that can hold links make
    a tile, and a set goes to as many tiles as its class and the next have blocks."""
    n = members.groupBy("a").agg(F.first("n").alias("n"))
    group = keep(components(members.select("a", "b")).join(n, F.col("node") == F.col("a")).select(F.col("node").alias("key"), "root", F.floor(F.log(1.25, F.col("n") + 0.5)).cast("int").alias("class")), "groups")
    cells = group.groupBy("root", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    after = cells.select("root", (F.col("class") - 1).alias("class"), F.col("parts").alias("after"))
    before = cells.select("root", (F.col("class") + 1).alias("class"), F.col("parts").alias("before"))
    g = group.join(cells, ["root", "class"]).join(after, ["root", "class"], "left").join(before, ["root", "class"], "left").na.fill(0, ["after", "before"])
    g = g.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    row = lambda step, i, j, side: F.struct(step.alias("step"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    count = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    own, zero, one = F.col("part"), F.lit(0), F.lit(1)
    # within a class block i meets blocks j >= i; block i of a class meets all blocks of the next
    uses = F.concat(
        F.array(row(zero, own, own, 2)),
        F.transform(F.filter(count(F.col("parts")), lambda j: j > own), lambda j: row(zero, own, j, 0)),
        F.transform(F.filter(count(F.col("parts")), lambda i: i < own), lambda i: row(zero, i, own, 1)),
        F.transform(count(F.col("after")), lambda j: row(one, own, j, 0)),
        F.transform(count(F.col("before")), lambda i: row(one, i, own, 1)),
    )
    g = g.select("key", "root", "class", F.explode(uses).alias("u"))
    tile = F.struct("root", (F.col("class") - F.when((F.col("u.step") == 1) & (F.col("u.side") == 1), 1).otherwise(0)).alias("class"), "u.step", "u.i", "u.j")
    g = g.select("key", F.xxhash64(tile).alias("tile"), F.col("u.side").alias("side"))
    body = _bodies(docs, group.select("key"), owner)
    rows = body.join(g, "key").join(owner.select("key", "copies"), "key").select("tile", "side", "key", "copies", "body")
    return rows.repartition("tile").sortWithinPartitions("tile", "side", "key").mapInArrow(turn(tiles(every)), "a bigint, b bigint, n bigint"), group.select("key", "root")


def _link_counts(links: DataFrame, owner: DataFrame) -> DataFrame:
    """key, n: the copies of the sets that each set links with."""
    both = links.select("a", "b").union(links.select("b", "a"))
    return both.join(owner.select(F.col("key").alias("b"), "copies"), "b").select(F.col("a").alias("key"), F.col("copies").alias("n"))


def join(docs: DataFrame, frequent_over: int = FREQUENT, longest: int = LONG, block: int = BLOCK, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links among docs (doc_id, text) at Jaccard similarity 0.8 of five-word shingle sets.

    Returns ``(documents, links)``: documents has a row for each row of docs: doc_id,
    n_shingles, key (of its set; null if empty), n_links (the other rows that it links with,
    copies included) and component_id, the smallest doc_id reachable by links (for an empty
    set the row's own); links has linked pairs of different sets (a, b: set keys), copies
    being one set: with ``every_link`` each pair once, whose number is quadratic in a group's
    sets, else all that components need.  Words are cut
    at ASCII space and \\t..\\r after lower-casing A-Z; a text of fewer words is one
    shingle; null and empty texts link with nothing.  Shingles and sets are told apart by
    64-bit hashes.  Repeated rows and ids are fine; a null id counts as no id.
    """
    spark = reachable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = keep(docs.mapInArrow(turn(_summary), "doc_id bigint, n_shingles bigint, key bigint"), "sets")
    owner = keep(every.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")), "owners")
    entries = owner.agg(F.sum("n")).first()[0] or 0
    parts = max(8, spark.sparkContext.defaultParallelism, entries // 2 // TASK)
    # rows that only repeat another row's set stay out; an id that owns a set stays in
    copies = keep(every.where("key IS NOT NULL").select("doc_id").distinct().join(owner.select("doc_id").distinct(), "doc_id", "left_anti"), "copies")

    def stage(df: DataFrame, run, schema: str = BLOB) -> DataFrame:
        return df.repartition(parts, "dest").sortWithinPartitions("dest").mapInArrow(turn(run), schema)

    first = _only(docs, copies, "left_anti").select("text").mapInArrow(turn(spread(parts, frequent_over)), BLOB)
    index = keep(stage(stage(first, counted(parts, frequent_over)), placed(parts)), "index")
    by_shingle = index.repartition(parts, "dest").sortWithinPartitions("dest")
    alpha = F.expr("(4 * (na + nb) + 8) div 9")
    hits = by_shingle.mapInArrow(turn(short_pairs(longest)), PAIR).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("hits").alias("hits"))
    # a linked pair that meets in no long list shows all the shingles that must show in short ones
    tried = keep(hits.where(F.col("hits") >= 1 + F.floor(alpha / 24)).select("a", "b"), "pairs")
    links = keep(_verified(docs, tried, owner), "short-links")
    members = keep(by_shingle.mapInArrow(turn(long_members(longest)), "a bigint, b bigint, n int").distinct(), "members")
    if not members.isEmpty():
        tiled, group = _grouped_links(docs, members, owner, block, every_link)
        tiled = keep(tiled, "tiles")
        # the tiles count all links inside a group
        of = [group.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        counts = links.join(of[0], "a", "left").join(of[1], "b", "left").where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b")
        counts = _link_counts(counts, owner).union(tiled.where("n IS NOT NULL").select("a", "n"))
        links = links.union(tiled.where("n IS NULL").select("a", "b"))
        if every_link:
            links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        counts = _link_counts(links, owner)
    counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
    links = keep(links, "links")
    roots = components(links)
    least = owner.join(roots, owner["key"] == roots["node"], "left").select("key", "doc_id", "copies", F.coalesce("root", "key").alias("root"))
    least = keep(least, "roots")
    linked = least.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1").drop("rows")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    names = keep(least.join(linked, "root").join(counts, "key", "left").select("key", "component_id", n_links), "components")
    out = every.join(names, "key", "left").select("doc_id", "n_shingles", "key", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links
