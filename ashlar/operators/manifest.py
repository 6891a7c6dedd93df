"""Trees of named nodes: totals, Merkle roll-up, listing and path lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.addr import addr


def totals(nodes: DataFrame) -> DataFrame:
    """Number and bytes of the leaves of nodes (kind, size)."""
    return nodes.where("kind = 'leaf'").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def merkle(nodes: DataFrame, depth: int) -> DataFrame:
    """path, hash of every node of nodes (path, parent, depth, kind, ord, name, hash).

    A node's hash is the address of its children's hashes and names, nodes before leaves, in
    order.  One grouping a level, deepest first; ``depth`` is the tree's, not the data's."""
    done = nodes.where("kind = 'leaf'").select("path", "parent", "kind", "ord", "name", "hash", "depth")
    for level in range(depth - 1, -1, -1):
        mine = nodes.where((F.col("kind") == "node") & (F.col("depth") == level)).drop("hash")
        below = done.where(F.col("depth") == level + 1)
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.when(F.col("kind") == "node", 0).otherwise(1).alias("k"), "ord", "name", "hash"))), lambda x: F.concat(x["hash"], x["name"])), "")
        kids = below.groupBy(F.col("parent").alias("path")).agg(joined.alias("body"))
        here = mine.join(kids, "path", "left").select("path", "parent", "kind", "ord", "name", addr(F.coalesce("body", F.lit(""))).alias("hash"), "depth")
        done = done.unionByName(here)
    return done.select("path", "hash")


def printed(nodes: DataFrame) -> DataFrame:
    """path, line: the name of each node (path, depth, name), two blanks a level before it."""
    return nodes.select("path", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("name")).alias("line"))


def like(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern with * and ?, in any case; an empty pattern fits all."""
    if not pattern:
        return F.lit(True)
    special = set(r"\.[]{}()+^$|")
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern)
    return name.rlike(f"(?is)^{body}$")


def listing(nodes: DataFrame, pattern: str = "", after: str | None = None) -> DataFrame:
    """Entries of nodes (parent, name, ...) that fit, each with its place in its folder by
    name in any case; ``after`` goes on behind a name."""
    from pyspark.sql import Window

    d = nodes.where(like(F.col("name"), pattern))
    if after is not None:
        d = d.where(F.lower("name") > after.lower())
    return d.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.lower("name"), "name")).cast("bigint"))


def lookup(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (wanted) with the node they lead to, in any case; null if none."""
    n = nodes.withColumn("_low", F.lower("path"))
    return paths.withColumn("_low", F.lower("wanted")).join(n, "_low", "left").drop("_low")
