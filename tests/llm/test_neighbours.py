import random

import numpy as np
from pyspark.sql import functions as F

from ashlar.llm import neighbours
from ashlar.llm.queries import op6_neighbours, oracle_sql


def brute(rows, ask, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q in filter(ask, good):
        near = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                s = 0.0
                for x, y in zip(np.float32(v).tolist(), np.float32(good[q]).tolist()):
                    s += x * y
                near.append((-s, i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def test_query_equals_its_sql(spark, sf, same_rows):
    same_rows(op6_neighbours(spark, sf), oracle_sql()["op6_neighbours"])


def test_ties_bad_vectors_and_dimensions(spark, monkeypatch):
    r = random.Random(5)
    hot = [0.5, 0.25, -1.0, 2.0]
    rows = [(i, hot) for i in range(60)] + [(i, [r.choice([-1.0, 0.5, 2.0, 0.1]) for _ in range(4)]) for i in range(60, 160)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 1.0, 1.0, 1.0]), (None, hot), (206, [1.0, 2.0]), (207, [3.0, 1.0]), (208, [1e-30] * 4), (5, hot), (7, [9.0] * 4)]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, block string")
    monkeypatch.setattr(neighbours, "CANDIDATES", 30)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    got = sorted(map(tuple, neighbours.search(d, F.col("vec_id") % 3 == 0, k=7).collect()))
    assert got == brute(rows, lambda i: i % 3 == 0, 7)


def test_fewer_candidates_than_k_and_none(spark):
    d = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id bigint, embedding array<double>")
    assert neighbours.search(d, F.col("vec_id") == 0, k=20).count() == 2
    assert neighbours.search(d.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(d.limit(1), F.lit(True)).count() == 0


def test_bounds_hold():
    g = np.random.default_rng(1)
    a, b = g.normal(size=(50, 33)) * g.exponential(size=(50, 1)), g.normal(size=(70, 33)) ** 3
    q, s, n, e = neighbours.rounded(a)
    p, t, m, f = neighbours.rounded(b)
    off = e[:, None] * m + n[:, None] * f + e[:, None] * f
    assert (np.abs(neighbours.products(q, p) * (s[:, None] * t) - a @ b.T) <= off * 1.000001 + 1e-9).all()
