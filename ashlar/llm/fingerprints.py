"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its distinct lower-cased words with their counts.  For every
term and sample, gamma- and uniform-distributed numbers drawn from the term's own hash
choose a consistent position below the weight and an arrival value; the term that arrives
first is the sample.  Two texts agree in a sample with a probability equal to their
generalised Jaccard similarity: sum of smaller counts over sum of larger counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, cached, keep, reachable, turn

SAMPLES = 128
#: Terms and weights a worker remembers; each holds SAMPLES values.
CACHE = 150_000
_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # and bytes.split() cuts at the contracts' white space
#: Code of the samples of a text without words.
EMPTY = 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Consistent weighted samples of texts.

    One 64-bit draw for a term and sample gives r and c, each gamma(2, 1) as the sum of two
    exponentials, from its four 16-bit parts, and by a further product the uniform shift."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.lane = _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.known: dict[tuple[bytes, int], int] = {}
        self.arrivals = np.empty((CACHE, samples), np.float32)
        self.codes = np.empty((CACHE, samples), np.uint16)
        self.lanes = np.arange(samples)

    def fill(self, terms: list[tuple[bytes, int]]) -> None:
        """Arrival values and codes of terms (word, count) that are not known yet."""
        h = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w, _ in terms]), np.uint64)
        x = _mix(h[:, None] ^ self.lane[None, :])
        u = (x.view(np.uint16).reshape(len(terms), self.samples, 4).astype(np.float32) + np.float32(0.5)) * np.float32(2**-16)
        r = -np.log(u[:, :, 0] * u[:, :, 1])
        a = np.log(-np.log(u[:, :, 2] * u[:, :, 3]))
        shift = ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        a -= r * (1 - shift)
        code = x * np.uint64(0x9E3779B97F4A7C15)
        more = np.flatnonzero(np.array([n for _, n in terms]) > 1)
        if len(more):  # a count of one leaves the position at the shift itself
            t = np.floor(np.log(np.array([terms[i][1] for i in more], np.float32))[:, None] / r[more] + shift[more])
            a[more] -= r[more] * t
            code[more] += t.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        at = len(self.known)
        self.arrivals[at : at + len(terms)] = a
        self.codes[at : at + len(terms)] = np.maximum(code >> np.uint64(48), np.uint64(1))
        self.known.update(zip(terms, range(at, at + len(terms))))

    def __call__(self, text: str) -> np.ndarray:
        """The text's samples, 16-bit codes."""
        terms = list(Counter(text.encode("utf-8", "surrogatepass").translate(_lower).split()).items())
        best = code = None
        for at in range(0, len(terms), CACHE // 2):  # more than one turn for a very long text only
            part = terms[at : at + CACHE // 2]
            new = [x for x in part if x not in self.known]
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = part
            for k in range(0, len(new), 256):
                self.fill(new[k : k + 256])
            rows = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            a = self.arrivals.take(rows, axis=0)
            first = a.argmin(axis=0)
            low, got = a[first, self.lanes], self.codes[rows[first], self.lanes]
            if best is None:
                best, code = low, got
            else:
                better = low < best
                best, code = np.where(better, low, best), np.where(better, got, code)
        return np.full(self.samples, EMPTY, np.uint16) if code is None else code


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples: the estimate of generalised Jaccard similarity."""
    return float((a == b).mean())


_samplers: dict[int, Sampler] = {}
cached(__name__, _samplers.clear)


def sampler(samples: int) -> Sampler:
    """One sampler a worker process."""
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key, ``fingerprint`` (hexadecimal, four digits a sample) of each row; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(samples)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s(t or "").astype(">u2").tobytes().hex() for t in b.column(1).to_pylist()], pa.string())], [key, "fingerprint"])

    reachable(docs.sparkSession)
    return docs.select(F.col(key), F.col(text)).mapInArrow(turn(run), f"`{key}` {dict(docs.dtypes)[key]}, fingerprint string")


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as many first code points of ``after``."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


CHAIN = "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Ids of a bucket, as a power of two.
BUCKET = 11


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, text: every row in a bucket of neighbouring ids, and in each
    bucket as a tail the rows of the next id after it, or after the last bucket of the first
    id, so that each row's successor is in its bucket."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bucket", F.coalesce(F.shiftright("doc_id", BUCKET), F.lit(-1 << 62)))
    edge = d.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one small row for 2048 ids
    edge = keep(edge.select(F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"), "first_id"), "edges")
    if bounded(edge, 1_000_000):  # 16 bytes a row
        edge = F.broadcast(edge)
    tails = d.join(edge, d["doc_id"].eqNullSafe(edge["first_id"])).select(F.col("to").alias("bucket"), F.lit(True).alias("tail"), "doc_id", "text")
    return d.select("bucket", F.lit(False).alias("tail"), "doc_id", "text").union(tails)


def chain(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document and of its text edited with the next document's.

    docs (doc_id, text).  Next: by ascending (doc_id, text), a null id first; after the last
    comes the first (a single document follows itself); repeated rows follow each other.
    Likeness of two texts without words is 1, of one such and another 0.  A null text is
    empty.  The text is shuffled once, by buckets of neighbouring ids.
    """
    rows = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(samples)
        before = None  # bucket, doc_id, text, fingerprint of a row that waits for the next
        for b in batches:
            out = []
            for bucket, tail, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if tail and before is None:
                    continue
                mine = s(text)
                if before is not None:
                    _, old_id, old, f = before
                    new = edited(old, text)
                    g = s(new)
                    out.append((old_id, len(old), new, f.astype(">u2").tobytes().hex(), g.astype(">u2").tobytes().hex(), likeness(f, g), likeness(f, mine)))
                before = None if tail else (bucket, doc_id, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    reachable(docs.sparkSession)
    return rows.mapInArrow(turn(run), CHAIN)
