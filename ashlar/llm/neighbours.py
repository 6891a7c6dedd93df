"""Nearest neighbours by inner product, as a block matrix join.

Vectors are dealt into blocks; every query block meets every candidate block in a tile.
A tile multiplies int8 roundings of the vectors, which gives every product with a bound on
its quantisation error; pairs whose upper bound reaches a query's k-th best lower bound
survive, are recomputed in double precision, and the tile keeps k a query.  The tiles'
results are merged by heaps.  The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep, reachable, turn

#: Vectors a candidate block and a query block aim at.
CANDIDATES, QUERIES = 8192, 1024

BLOCK = "dim int, block bigint, ids binary, vectors binary"
FOUND = "query_id bigint, best array<struct<vec_id: bigint, score: double>>"


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def blocks(vectors: DataFrame, each: int) -> DataFrame:
    """(vec_id, v) as blocks of about ``each`` vectors of one dimension: ids and a matrix of doubles."""
    n = -(-max(1, vectors.count()) // each)
    v = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(rows).tobytes()])], ["dim", "block", "ids", "vectors"])

        for b in batches:
            dim, block, vec = (b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.concatenate(([True], (dim[1:] != dim[:-1]) | (block[1:] != block[:-1]), [True])))
            for x, y in zip(cut[:-1], cut[1:]):
                if (dim[x], block[x]) != key:
                    if key is not None:
                        yield done()
                    key, ids, rows = (dim[x], block[x]), [], []
                ids.append(vec[x:y].astype("<i8"))
                rows.append(b.column(3).slice(x, y - x).flatten().to_numpy().astype("<f8"))
        if key is not None:
            yield done()

    reachable(vectors.sparkSession)
    return v.repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(turn(run), BLOCK)


def rounded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the rounded rows and of what rounding took away."""
    scale = np.abs(m).max(axis=1) / 127
    scale[scale == 0] = 1  # a denormal row
    q = np.rint(m / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(m - back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 rows times int8 rows, exact: floats hold every sum of that many products."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list]:
    """The k best candidates of each query of a tile: query ids, and (candidate id, score) best first."""
    qi, qs, qn, qe = rounded(q)
    ci, cs, cn, ce = rounded(c)
    out: tuple[list, list] = ([], [])
    for at in range(0, len(q), 256):
        to = min(at + 256, len(q))
        near = products(qi[at:to], ci) * (qs[at:to, None] * cs[None, :])
        off = (qe[at:to, None] * cn[None, :] + qn[at:to, None] * ce[None, :] + qe[at:to, None] * ce[None, :]) * 1.000001
        off += 1e-9 * (qn[at:to, None] + qe[at:to, None]) * (cn + ce)[None, :]  # rounding of this arithmetic
        low = near - off
        low[q_ids[at:to, None] == c_ids[None, :]] = -np.inf
        kth = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(to - at, -np.inf)
        for i in range(at, to):
            j = np.flatnonzero((near[i - at] + off[i - at] >= kth[i - at]) & (c_ids != q_ids[i]))
            score = np.empty(len(j))
            for x in range(0, len(j), 4096):  # sums from the first component on
                score[x : x + 4096] = np.cumsum(c[j[x : x + 4096]] * q[i], axis=1)[:, -1]
            best = np.lexsort((c_ids[j], -score))[:k]
            out[0].append(int(q_ids[i]))
            out[1].append([{"vec_id": x, "score": y} for x, y in zip(c_ids[j[best]].tolist(), score[best].tolist())])
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product, ties to the smaller id.

    Queries are the rows that ``is_query`` selects, candidates all rows but those with the
    query's own id.  Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows without an id.  Vectors meet those of their own
    dimension.  Of rows that repeat an id, the smallest vector counts.
    """
    spark = reachable(vectors.sparkSession)
    v = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    v = v.groupBy("vec_id").agg(F.min(F.struct("v", "asks")).alias("x")).select("vec_id", "x.v", "x.asks")
    v = keep(v, "vectors")
    every = keep(blocks(v.drop("asks"), CANDIDATES), "blocks")
    asked = keep(blocks(v.where("asks").drop("asks"), QUERIES), "queries")
    where = every.groupBy("dim").agg(F.collect_list("block").alias("blocks"))  # numbers of blocks
    q = asked.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "block": "q_block"}).join(where, "dim").withColumn("block", F.explode("blocks")).drop("blocks")
    tiles = q.join(every, ["dim", "block"]).select("dim", "q_ids", "q_vectors", "ids", "vectors")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, *parts in zip(b.column(0).to_pylist(), *b.columns[1:]):
                qi, qv, ci, cv = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, ("<i8", "<f8", "<i8", "<f8")))
                got = tile(qi, qv.reshape(-1, dim), ci, cv.reshape(-1, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.list_(pa.struct({"vec_id": pa.int64(), "score": pa.float64()})))], ["query_id", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(query: int, heap: list) -> Iterator[tuple]:
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1):
                yield query, rank, -vec, score

        query, heap = None, []
        for b in batches:
            out: list[tuple] = []
            for x, best in zip(*(c.to_pylist() for c in b.columns)):
                if x != query:
                    out.extend(ranked(query, heap))
                    query, heap = x, []
                for y in best:
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (y["score"], -y["vec_id"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])
        if heap:  # the last query
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ranked(query, heap)), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    found = tiles.mapInArrow(turn(work), FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(turn(merge), "query_id bigint, rank int, vec_id bigint, score double")
