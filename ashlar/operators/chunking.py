"""Fixed and content-defined chunking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.addr import addr, data

WINDOW = 48
#: Bytes hashed at once.
STRIDE = 1 << 15
#: Bytes of chunks handed on at once.
PIECE = 1 << 20
#: The hash of each byte value: the first four bytes of SHA-256 of that byte.
TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "big") for i in range(256)], np.uint32)


def fixed(df: DataFrame, key: str, payload: str, size: int, buffer_bytes: int | None = None) -> DataFrame:
    """key, ord, offset, hash, size, chunk: cut every ``size`` bytes, the last one short.  With
    buffer_bytes, cuts start again at each buffer's edge.  An empty payload has no chunk."""
    p = data(F.col(payload))
    n = F.octet_length("p")
    span = buffer_bytes or 0
    d = df.select(F.col(key), p.alias("p"))
    if not span:
        at = F.sequence(F.lit(0), n - 1, F.lit(size))
    else:
        starts = F.transform(F.sequence(F.lit(0), n - 1, F.lit(span)), lambda b: F.sequence(b, F.least(b + span, n) - 1, F.lit(size)))
        at = F.flatten(starts)
    d = d.where(n > 0).select(key, "p", F.posexplode(at).alias("ord", "offset"))
    end = F.lit(1 << 30) if not span else (F.floor(F.col("offset") / span) + 1) * span
    take = F.least(F.lit(size), end - F.col("offset")).cast("int")
    d = d.select(key, "ord", "offset", F.substring("p", F.col("offset") + 1, take).alias("chunk"))
    return d.select(key, "ord", "offset", addr(F.col("chunk")).alias("hash"), F.octet_length("chunk").cast("bigint").alias("size"), "chunk")


def sizes(average: int, least: int | None = None, most: int | None = None) -> tuple[int, int, int]:
    """(least, most, threshold) for an average chunk size."""
    least = least or max(average // 4, WINDOW + 16)
    most = most or average * 4
    expected = min(max(average - least, least), most)
    return least, most, (1 << 32) // expected


def rolling(b: np.ndarray) -> np.ndarray:
    """Hash of the 48 bytes that end at each place (places before the 48th are of no use).

    The hash is the xor of the bytes' table entries, each rotated by its age; windows of 16
    and 32 are doubled up from single bytes, and 32 and 16 make 48."""

    def rot(x: np.ndarray, n: int) -> np.ndarray:
        n %= 32
        return x if n == 0 else (x << np.uint32(n)) | (x >> np.uint32(32 - n))

    h, n = TABLE[b], 1
    sixteen = h
    while n < 32:
        older = np.zeros_like(h)
        older[n:] = h[:-n]
        h = h ^ rot(older, n)
        n *= 2
        if n == 16:
            sixteen = h
    older = np.zeros_like(h)
    older[32:] = sixteen[:-32]
    return h ^ older


#: Tests of a window's hash, each true about as often as a random hash is at most the threshold
#: (the mask: once in a power of two bytes).
PREDICATES = {
    "threshold": lambda h, threshold: h <= threshold,
    "mask": lambda h, threshold: h & np.uint32((1 << (((1 << 32) // threshold).bit_length() - 1)) - 1) == 0,
    "modulo": lambda h, threshold: h % np.uint32((1 << 32) // threshold) == (1 << 32) // threshold - 1,
}


def cuts(payload: bytes, least: int, most: int, threshold: int, predicate: str = "threshold") -> list[int]:
    """Ends of the chunks: after the first byte beyond ``least`` whose window's hash passes the
    test, at ``most`` bytes otherwise, and at the end."""
    passes = PREDICATES[predicate]
    n = len(payload)
    if n <= least:
        return [n] if n else []
    data = np.frombuffer(payload, np.uint8)
    found = []
    for at in range(0, n, STRIDE):  # in strides that stay in the processor's cache
        before = min(at, WINDOW - 1)
        h = rolling(data[at - before : at + STRIDE])
        found.append(np.flatnonzero(passes(h[before:], threshold)) + (at + 1))
    candidates = np.concatenate(found)
    out, start = [], 0
    while n - start > least:
        i = np.searchsorted(candidates, start + least + 1)
        end = int(candidates[i]) if i < len(candidates) else n
        end = min(end, start + most, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def _runs(ends: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Chunks of one payload in runs of about PIECE bytes at most: the first one's number, and where the run starts and each chunk ends."""
    edges = np.array([0, *ends])
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + PIECE, "right")) - 1)
        yield i, edges[i : j + 1]
        i = j


def _chunks(keys: pa.Array, runs: list[tuple[int, int, np.ndarray, pa.Buffer]], key: str) -> pa.RecordBatch:
    """key, ord, offset, chunk of runs of chunks: their bytes stay one buffer, no chunk becomes an object of its own."""
    n = [len(ends) - 1 for _, _, ends, _ in runs]
    rows = np.repeat([row for row, *_ in runs], n)
    ords = np.concatenate([np.arange(first, first + k) for (_, first, _, _), k in zip(runs, n)])
    at = np.concatenate([ends[:-1] for _, _, ends, _ in runs])
    edges = np.cumsum(np.concatenate([[0], *(np.diff(ends) for _, _, ends, _ in runs)]))
    whole = pa.py_buffer(b"".join(p for *_, p in runs))
    parts = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges.astype(np.int32)), whole])
    return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(ords, pa.int32()), pa.array(at, pa.int32()), parts], [key, "ord", "offset", "chunk"])


def content_defined(df: DataFrame, key: str, payload: str, average: int = 1024, least: int | None = None, most: int | None = None, predicate: str = "threshold") -> DataFrame:
    """key, ord, offset, hash, size, chunk; boundaries depend on the 48 bytes before them only.
    predicate: which test of the window's hash ends a chunk (PREDICATES).  Null and empty
    payloads have no chunk; repeated rows are cut each."""
    low, high, threshold = sizes(average, least, most)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, held = [], 0
            for row, p in enumerate(b.column(1)):
                p = p.as_buffer()
                if not p:
                    continue
                for first, ends in _runs(cuts(p, low, high, threshold, predicate)):
                    runs.append((row, first, ends, p[int(ends[0]) : int(ends[-1])]))
                    held += len(runs[-1][3])
                    if held >= PIECE:
                        yield _chunks(b.column(0), runs, key)
                        runs, held = [], 0
            if runs:
                yield _chunks(b.column(0), runs, key)

    d = df.select(F.col(key), data(F.col(payload)).alias("p")).mapInArrow(run, f"`{key}` {kind}, ord int, `offset` int, chunk binary")
    return d.select(key, "ord", "offset", addr(F.col("chunk")).alias("hash"), F.octet_length("chunk").cast("bigint").alias("size"), "chunk")


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    """key, bytes and address of the chunks of one payload put together in order."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "chunk"))).alias("c"))  # one payload's chunks
    whole = F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["chunk"]))
    return g.select(key, whole.alias("p")).select(key, F.octet_length("p").cast("bigint").alias("total_bytes"), addr(F.col("p")).alias("hash"))
