"""Mixing sources to target weights.

Each source's words, in order of document id, form one stream that is packed into blocks
of a fixed number of words.  Output shards of a fixed number of block slots draw
multinomial source counts from the targets; a source's slots are numbered through all
shards and mapped by a pseudorandom permutation of its block indexes, a fresh one each
time the source has been gone through; slots and blocks are then joined by index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import RANGE, WORD, before, fresh, keep, reachable, slices, turn

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Words a block, block slots an output shard, and the seed of draws and permutations.
BLOCK, SHARD, SEED = 64, 4096, 20240101


def size(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target and nth (from 0) from one row a source (source, source_size).

    Sources take the weights in turn by code point, null last.  Targets share all words by
    weight; what passes ``most`` times the source's size is shared again among the others.
    The sharing, whose rounds are as many as sources that stop, runs on ratios in one pass:
    sources stop in order of size/weight, so running sums find where stopping ends.
    """
    name = F.encode(F.col("source").cast("string"), "utf-8")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    s = before(sizes.select("source", "source_size"), [F.col("source").isNull().asc(), name.asc()], {"nth": F.lit(1)})
    s = s.withColumn("weight", w).withColumn("ratio", F.col("source_size") / F.col("weight"))
    s = before(s, [F.col("ratio").asc(), F.col("nth").asc()], {"rank": F.lit(1), "taken": "weight", "gone": "source_size"})
    all_ = s.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    # a source goes on if, all smaller ratios having stopped, its part of the rest is within
    # its limit; from the first such source on, all go on and share the rest by that level
    part = (F.lit(all_["size"]) - F.col("gone") * float(most)) / (F.lit(all_["weight"]) - F.col("taken"))
    first = s.where(part * F.col("weight") <= most * F.col("source_size")).agg(F.min(F.struct(F.col("rank"), part.alias("part"))).alias("x")).first()["x"]
    stop = most * F.col("source_size").cast("double")
    target = stop if first is None else F.when(F.col("rank") >= first["rank"], F.lit(first["part"]) * F.col("weight")).otherwise(stop)
    return s.select("source", "source_size", "weight", target.alias("target"), "nth")


def offsets(docs: DataFrame) -> DataFrame:
    """docs (source, doc_id, size, tie, copy, ...) with ``start``: the words before it in its
    source's stream, by doc_id (a null id first)."""
    return before(docs, [F.col(c).asc_nulls_first() for c in ("doc_id", "tie", "copy")], {"start": "size"}, by="source")


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Positions i (0 <= i < n) through a keyed permutation of range(n): a Feistel network
    over the next power of four, walked until it falls inside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(4):
            h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return left << shift | right

    x = once(i.astype(np.uint64))
    while (far := x >= np.uint64(n)).any():
        x[far] = once(x[far])
    return x.astype(np.int64)


def quotas(s: DataFrame, block: int) -> DataFrame:
    """Of the sources with words: ``sid`` (their place among all), ``blocks`` and ``slots``: how
    many blocks a source has and how many slots come nearest to its target."""
    s = s.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    return s.withColumn("slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), MOST * F.col("blocks")).cast("bigint")).withColumnRenamed("nth", "sid")


#: Sources that one draw chooses among; draws of more go by groups of so many first.
GROUP = 1024
#: Groups whose lists of sources are broadcast to the draws (16 KB each); more are joined by group.
LISTS = 64


def drawn(s: DataFrame, shard: int, seed: int) -> DataFrame:
    """sid, shard, first, n: the slots that each shard gives each source, numbered through.

    Every shard draws its counts from a multinomial by the sources' slots: first for groups
    of sources, then within each group.  Running sums over shards hold a source to its slots,
    and the last shard takes what is left, so the whole mix meets its quotas whatever the draws."""
    reachable(s.sparkSession)
    whole = s.agg(F.sum("slots")).first()[0] or 0
    shards = -(-whole // shard)
    s = s.withColumn("g", F.expr(f"sid div {GROUP}"))
    groups = s.groupBy("g").agg(F.sum("slots").alias("share"), F.sort_array(F.collect_list(F.struct("sid", "slots"))).alias("s"))  # GROUP sources at most
    every = np.array([tuple(r) for r in groups.select("g", "share").orderBy("g").collect()], np.int64).reshape(-1, 2)  # a number for GROUP sources
    rows = s.sparkSession.range(0, shards, 1, max(1, min(shards, shards * s.count() // RANGE + 1)))

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, of, n = [], [], []
            g, share = every.T
            for k in b.column(0).to_pylist():
                got = np.random.default_rng([seed, k]).multinomial(min(shard, whole - k * shard), share / share.sum())
                use = np.flatnonzero((got > 0) | (k == shards - 1))  # every source is in the last shard
                at += [k] * len(use)
                of.append(g[use])
                n.append(got[use])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.concatenate([*of, np.empty(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*n, np.empty(0, np.int64)]).astype(np.int64))], ["shard", "g", "n"])

    def by_source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, of, n = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, g, count, all_ in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                sid, share = (x.to_numpy() for x in all_.values.flatten())
                got = np.random.default_rng([seed, k, g]).multinomial(count, share / share.sum())
                use = np.flatnonzero((got > 0) | (k == shards - 1))
                at += [k] * len(use)
                of.append(sid[use])
                n.append(got[use])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.concatenate(of).astype(np.int64)), pa.array(np.concatenate(n).astype(np.int64))], ["shard", "sid", "n"])

    lists = groups.select("g", "s")
    lists = F.broadcast(lists) if len(every) <= LISTS else lists.hint("merge")  # never the draws, whose size Spark does not see
    d = rows.mapInArrow(turn(by_group), "shard bigint, g bigint, n bigint").join(lists, "g").select("shard", "g", "n", "s")
    d = d.mapInArrow(turn(by_source), "shard bigint, sid bigint, n bigint")
    d = before(d, [F.col("shard").asc()], {"first": "n"}, by="sid").join(s.select(F.col("sid").alias("s_"), "slots"), F.col("sid") == F.col("s_"))
    end = F.when(F.col("shard") == shards - 1, F.col("slots")).otherwise(F.least("slots", F.col("first") + F.col("n")))
    return d.where("first < slots").select("sid", "shard", "first", (end - F.col("first")).alias("n")).where("n > 0")


def uses(s: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """sid, block, epoch, shard: one row for each slot, with the block it takes."""
    slots = s.agg(F.sum("slots")).first()[0] or 0
    d = drawn(s, shard, seed).join(s.select("sid", "blocks"), "sid").select("sid", "shard", "first", "n", "blocks")
    names = ["sid", "block", "epoch", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, at, first, n, blocks = (b.column(i).to_numpy() for i in range(5))
            out, size = [], 0
            for i in range(len(n)):
                for x in range(first[i], first[i] + n[i], 1 << 16):
                    j = np.arange(x, min(x + (1 << 16), first[i] + n[i]))
                    epoch = j // blocks[i]
                    block = np.empty_like(j)
                    for e in range(epoch[0], epoch[-1] + 1):
                        block[epoch == e] = permuted(j[epoch == e] % blocks[i], int(blocks[i]), seed * 1_000_003 + int(sid[i]) * 4099 + e)
                    out.append((np.full(len(j), sid[i]), block, epoch, np.full(len(j), at[i])))
                    size += len(j)
                    if size >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    # the slots that a task makes are its work: as many tasks as they need
    return d.repartition(max(1, -(-slots // RANGE)), "sid", "shard").mapInArrow(turn(run), "sid bigint, block bigint, epoch bigint, shard bigint")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, size_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, source, text).

    Returns ``(rows, taken)``: rows has row, doc_id, tie, copy, source, size, source_size,
    target and start; taken has row, epoch, lo, hi: the word ranges [lo, hi) of the document
    that the mix takes, one row for each block it takes from.  ``tie`` (a hash of the text)
    and ``copy`` tell rows with the same id apart; equal rows count each.  A null text has
    size 0, a null source is a source of its own and comes last.  An empty table gives
    empty results.
    """
    d = docs.select("doc_id", "source", (size(F.col("text")) if size_of is None else size_of).alias("size"), F.xxhash64("text").alias("tie"))
    d = d.withColumns({"copy": F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("source")), "row": F.monotonically_increasing_id()})
    d = keep(d, "mix-sizes")
    every = keep(targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    # one row a source: Spark joins the source tables by their measured size
    s = keep(quotas(every, block), "mix-sources")
    every = every.withColumnRenamed("source", "s_")
    rows = offsets(d).join(every, F.col("source").eqNullSafe(F.col("s_"))).drop("s_", "weight", "nth")
    rows = keep(rows, "mix-rows")
    where = s.select(F.col("source").alias("s_"), "sid")
    span = rows.where("size > 0").join(where, F.col("source").eqNullSafe(F.col("s_"))).withColumn("end", F.col("start") + F.col("size"))
    span = span.select("row", "sid", "start", "end", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}"))).alias("block"))
    used = uses(s, shard, seed)
    # Spark takes what Python or explode makes for as large as what it is made of, and would
    # broadcast a row for each slot, through the driver: both sides are sorted and merged
    taken = span.join(used.hint("merge"), ["sid", "block"]).select("row", "epoch", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).alias("lo"), (F.least((F.col("block") + 1) * block, F.col("end")) - F.col("start")).alias("hi"))
    return rows, taken


def texts(docs: DataFrame, rows: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix as documents: docs' rows with text cut to what the mix takes.

    A document gives one row for each time its source is gone through and it is taken from;
    word ranges that touch stay as they stand in the text, others are joined by a line
    break.  n_chars follows the text; other columns stay as they are, whatever their names.
    What the mix does not take, and so null and empty texts, is left out; repeated rows are
    taken from each.  An empty table gives an empty one.
    """
    key, copy, used, other = (fresh(docs.columns, c) for c in ("_key", "_copy", "_uses", "_other"))
    spans = taken.groupBy("row", "epoch").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))  # within one document
    per = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("epoch", "ranges"))).alias(used))  # three times its size at most
    per = per.join(rows.select("row", "doc_id", "tie", F.col("copy").alias(other)).hint("merge"), "row").select(F.xxhash64("doc_id", "tie").alias("k"), other, used)
    mark = F.xxhash64("doc_id", F.xxhash64("text"))
    d = docs.withColumn(key, mark)
    d = d.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy("source")))
    # by document: the text is shuffled once, and copies of a row find theirs in one place; a
    # table's files say too little of its size to broadcast texts or rows by, so both are merged
    d = d.join(per.hint("merge"), (F.col(key) == F.col("k")) & (F.col(copy) - F.col(other) == 0)).select(*docs.columns, used)
    names = docs.columns
    words = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, names.index("text"), 4 << 20)):
            index, text = [], []
            for i, (t, uses) in enumerate(zip(b.column(names.index("text")).to_pylist(), b.column(len(names)).to_pylist())):
                at = [m.span() for m in words.finditer(t)]
                for u in uses:
                    parts: list[list[int]] = []
                    for r in u["ranges"]:
                        if parts and parts[-1][1] == r["lo"]:
                            parts[-1][1] = r["hi"]
                        else:
                            parts.append([r["lo"], r["hi"]])
                    index.append(i)
                    text.append(t if parts == [[0, len(at)]] else "\n".join(t[at[lo][0] : at[hi - 1][1]] for lo, hi in parts))
            out = b.select(names).take(pa.array(index, pa.int64()))
            columns = dict(zip(names, out.columns))
            columns["text"] = pa.array(text, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in text], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    reachable(docs.sparkSession)
    return d.mapInArrow(turn(run), docs.schema)
