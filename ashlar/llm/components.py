"""Connected components of links, by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keep, reachable, turn


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as stars: never more links than nodes go into a shuffle."""
    for b in batches:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        pairs = [(x, top(x)) for x in list(up) if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of links (a bigint, b bigint) with the smallest node it reaches.

    Nodes of degree one hundred million are no problem: minima are combined before each
    shuffle, and joins bring one row a node to the links.
    """
    reachable(links.sparkSession)
    e = keep(links.where("a <> b").select("a", "b").mapInArrow(turn(_forest), "a bigint, b bigint").distinct(), "links")  # a > b
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = keep(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        seen = now
