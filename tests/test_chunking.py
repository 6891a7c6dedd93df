import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ashlar.operators import chunking as c


def rot(x, n):
    n %= 32
    return ((x << n) | (x >> (32 - n))) & 0xFFFFFFFF if n else x


def test_rolling_hash_is_that_of_the_last_48_bytes():
    data = random.Random(1).randbytes(400)
    h = c.rolling(np.frombuffer(data, np.uint8))
    for i in range(47, 400, 7):
        want = 0
        for age in range(48):
            want ^= rot(int(c.TABLE[data[i - age]]), age)
        assert int(h[i]) == want


def test_lengths_are_in_bounds_and_cover():
    data = random.Random(2).randbytes(1 << 20)
    for average in (2048, 8192, 65536):
        low, high, threshold = c.sizes(average)
        ends = c.cuts(data, low, high, threshold)
        lengths = np.diff([0, *ends])
        assert ends[-1] == len(data) and (lengths[:-1] > low).all() and (lengths <= high).all()
        assert average / 2 < lengths.mean() < average * 2


def test_an_edit_moves_few_boundaries():
    data = random.Random(3).randbytes(1 << 19)
    low, high, threshold = c.sizes(4096)

    def chunks(d):
        ends = c.cuts(d, low, high, threshold)
        return {d[x:y] for x, y in zip([0, *ends], ends)}

    a, b = chunks(data), chunks(data[:1000] + b"some new bytes" + data[1000:])
    assert len(a - b) <= 4


def test_empty_and_short():
    low, high, threshold = c.sizes(256)
    assert c.cuts(b"", low, high, threshold) == [] and c.cuts(b"abc", low, high, threshold) == [3]


def test_fixed_chunks_restart_at_buffers(spark):
    d = spark.createDataFrame([(1, "x" * 25), (2, ""), (3, None)], "k int, p string")
    rows = c.fixed(d, "k", "p", 4, buffer_bytes=10).orderBy("k", "ord").collect()
    assert [r["size"] for r in rows] == [4, 4, 2, 4, 4, 2, 4, 1] and {r["k"] for r in rows} == {1}
    assert [r["offset"] for r in rows] == [0, 4, 8, 10, 14, 18, 20, 24]


def test_content_defined_chunks_come_together_again(spark):
    d = spark.createDataFrame([(i, random.Random(i).randbytes(i * 700)) for i in range(6)], "k int, p binary")
    got = {r["k"]: r["total_bytes"] for r in c.reassembled(c.content_defined(d, "k", "p", 256), "k").collect()}
    assert got == {i: i * 700 for i in range(1, 6)}
    assert d.where(F.length("p") == 0).count() == 1


def test_chunks_of_a_batch_are_handed_on_in_pieces(spark, monkeypatch):
    d = spark.createDataFrame([("x", b"x")], "k string, p binary")
    taken, through = [], type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, run, *a: taken.append(run) or through(self, run, *a))
    c.content_defined(d, "k", "p", 256)
    r = random.Random(4)
    payloads = [None, r.randbytes(5 << 20), b"", *(r.randbytes(3000) for _ in range(2000)), b"abc", None]
    keys = [str(i) for i in range(len(payloads))]
    pieces = list(taken[0](iter([pa.record_batch([pa.array(keys), pa.array(payloads, pa.binary())], ["k", "p"])])))
    assert max(x.nbytes for x in pieces) < 4 << 20  # of 11 MB, five of them of one payload
    together, rows = {}, [x for piece in pieces for x in piece.to_pylist()]
    for x in rows:
        before = together.setdefault(x["k"], bytearray())
        assert len(before) == x["offset"]
        before += x["chunk"]
    assert together == {k: p for k, p in zip(keys, payloads) if p}
    low, high, threshold = c.sizes(256)
    assert [x["ord"] for x in rows if x["k"] == "1"] == list(range(len(c.cuts(payloads[1], low, high, threshold))))
