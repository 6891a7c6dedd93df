"""References followed to the end, and rules for packages of attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def closure(roots: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """root, node, hops: what each root (root) reaches by edges (src, dst), itself included at 0.

    One join a hop on the frontier; nodes reached before are not followed again.  ``most``
    is only a guard; it raises if the frontier is not empty by then."""
    seen = frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct()
    for hop in range(1, most + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(hop))
        frontier = frontier.persist()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"references go on after {most} hops")


def package_rules(objects: DataFrame, attachments: DataFrame) -> DataFrame:
    """Per package (pkg): n_objects, n_attachments, duplicate and null attachments, and errors:
    1 not exactly one object, 2 duplicate attachments, 4 null attachments."""
    o = objects.groupBy("pkg").agg(F.count("*").alias("n_objects"))
    a = attachments.groupBy("pkg", "hash").agg(F.count("*").alias("n"))
    a = a.groupBy("pkg").agg(F.sum("n").alias("n_attachments"), F.sum(F.when(F.col("hash").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum(F.when(F.col("hash").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    p = o.join(a, "pkg", "full").na.fill(0)
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    return p.withColumn("errors", flag(F.col("n_objects") != 1, 1) + flag(F.col("duplicates") > 0, 2) + flag(F.col("nulls") > 0, 4))
