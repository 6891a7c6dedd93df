"""Duplicate files: by size first, then by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.addr import addr, data
from ..functions.numbers import next_pow2


def size_groups(df: DataFrame) -> DataFrame:
    """Files (path, size) by exact size."""
    return df.groupBy("size").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def histogram(df: DataFrame) -> DataFrame:
    """Files and bytes by power-of-two size bucket, largest first."""
    return df.groupBy(next_pow2(F.col("size")).alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.col("bucket").desc())


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """size, canonical, duplicate: each file (path, payload) that repeats the content of one with a smaller path, the smallest."""
    f = df.select("path", F.octet_length(data(F.col("payload"))).cast("bigint").alias("size"), addr(F.col("payload")).alias("hash"))
    g = f.groupBy("size", "hash").agg(F.min("path").alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("n")
    return f.join(g, ["size", "hash"]).where("path > canonical").select("size", "canonical", F.col("path").alias("duplicate"))


def by_size(df: DataFrame) -> DataFrame:
    """Files (path, size), smallest first, equal sizes by path: the order in which they are cut."""
    return df.orderBy("size", "path")


def by_path(df: DataFrame) -> DataFrame:
    """The last size of each path (path, ord, size), in order of the paths."""
    return df.groupBy("path").agg(F.max_by("size", "ord").alias("size")).orderBy("path")


def duplicates(df: DataFrame, threshold: int = 0) -> DataFrame:
    """Groups of equal content among files (path, payload) above a size.

    Only files whose size occurs again are hashed; sizes are counted on lengths alone."""
    f = df.withColumn("size", F.octet_length(data(F.col("payload"))).cast("bigint")).where(F.col("size") > threshold)
    again = f.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    hashed = f.join(again, "size", "left_semi").select("path", "size", addr(F.col("payload")).alias("hash"))
    g = hashed.groupBy("size", "hash").agg(F.count("*").alias("files"), F.min("path").alias("canonical")).where("files > 1")
    return g.withColumn("dupe_bytes", F.col("size") * (F.col("files") - 1))
