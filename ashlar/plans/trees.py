"""Queries on trees and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.addr import addr
from ..operators import closure, manifest
from .tables import table


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """region / nation / supplier as a manifest three levels deep below a root."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    root = spark.range(1).select(F.lit("root").alias("path"), none.alias("parent"), F.lit(0).alias("depth"), F.lit("node").alias("kind"), zero.alias("ord"), F.lit("root").alias("name"), zero.alias("size"), none.alias("hash"))
    regions = r.select(F.concat(F.lit("root/"), "r_name"), F.lit("root"), F.lit(1), F.lit("node"), F.col("r_regionkey").cast("bigint"), "r_name", zero, none)
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    nations = named.select(F.concat(F.lit("root/"), "r_name", F.lit("/"), "n_name"), F.concat(F.lit("root/"), "r_name"), F.lit(2), F.lit("node"), F.col("n_nationkey").cast("bigint"), "n_name", zero, none)
    leaves = s.join(named, s["s_nationkey"] == named["n_nationkey"])
    leaves = leaves.select(F.concat(F.lit("root/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "s_name"), F.concat(F.lit("root/"), "r_name", F.lit("/"), "n_name"), F.lit(3), F.lit("leaf"), "s_suppkey", "s_name", F.octet_length("s_name").cast("bigint"), addr(F.col("s_suppkey").cast("string")))
    return root.union(regions).union(nations).union(leaves)


def manifest_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.totals(_tree(spark, sf))


def merkle_tree(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.merkle(_tree(spark, sf), 3)


def manifest_list(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.listing(_tree(spark, sf).where("parent IS NOT NULL"), "*a*").select("parent", "name", "place")


def manifest_lookup(spark: SparkSession, sf: str) -> DataFrame:
    t = _tree(spark, sf)
    wanted = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = wanted.select("c_custkey", F.upper(F.concat(F.lit("ROOT/"), "r_name", F.lit("/"), F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise(F.col("n_name")))).alias("wanted"))
    return manifest.lookup(t.select("path", "kind", "ord"), wanted).select("c_custkey", "path", "kind", "ord")


def attachment_closure(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")).union(s.select(name("s", "s_suppkey"), name("n", "s_nationkey"))).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    roots = c.select(name("c", "c_custkey").alias("root")).union(s.select(name("s", "s_suppkey")))
    return closure.closure(roots, edges)


def package_validate(spark: SparkSession, sf: str) -> DataFrame:
    objects = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pkg"))
    attachments = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pkg"), F.when(F.col("l_quantity") > 1, addr(F.col("l_suppkey").cast("string"))).alias("hash"))
    return closure.package_rules(objects, attachments)


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def lossless_floats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum((F.col("l_extendedprice").cast("float").cast("double") == F.col("l_extendedprice")).cast("bigint")).alias("lossless"))


QUERIES = {f.__name__: f for f in (manifest_rollup, merkle_tree, manifest_list, manifest_lookup, attachment_closure, package_validate, duplicate_names, lossless_floats)}

_leaf = "SELECT r_name, n_name, n_nationkey, s_name, s_suppkey, substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 40) AS hash FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_names = "SELECT 'root' AS parent, r_name AS name FROM region UNION ALL SELECT 'root/' || r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'root/' || r_name || '/' || n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_edges = "SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"
SQL = {
    "manifest_rollup": "SELECT count(*) AS files, CAST(sum(octet_length(encode(s_name))) AS BIGINT) AS bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "merkle_tree": f"""WITH l AS ({_leaf}),
n AS (SELECT r_regionkey, r_name, n_name, n_nationkey, substr(sha256(coalesce(string_agg(l.hash || l.s_name, '' ORDER BY l.s_suppkey), '')), 1, 40) AS hash
 FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN l USING (r_name, n_name, n_nationkey) GROUP BY ALL),
r AS (SELECT r.r_regionkey, r.r_name, substr(sha256(coalesce(string_agg(n.hash || n.n_name, '' ORDER BY n.n_nationkey), '')), 1, 40) AS hash FROM region r LEFT JOIN n ON r.r_regionkey = n.r_regionkey GROUP BY ALL)
SELECT 'root' AS path, substr(sha256(string_agg(hash || r_name, '' ORDER BY r_regionkey)), 1, 40) AS hash FROM r
UNION ALL SELECT 'root/' || r_name, hash FROM r UNION ALL SELECT 'root/' || r_name || '/' || n_name, hash FROM n UNION ALL SELECT 'root/' || r_name || '/' || n_name || '/' || s_name, hash FROM l""",
    "manifest_list": f"SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY lower(name), name) AS place FROM ({_names}) WHERE lower(name) LIKE '%a%'",
    "manifest_lookup": "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'root/' || r_name || '/' || n_name END AS path, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'node' END AS kind, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(n_nationkey AS BIGINT) END AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "attachment_closure": f"WITH RECURSIVE e AS ({_edges}), t(root, node, hops) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION ALL SELECT root, dst, hops + 1 FROM t JOIN e ON src = node) SELECT root, node, min(hops) AS hops FROM t GROUP BY root, node",
    "package_validate": """SELECT pkg, n_objects, n_attachments, duplicates, nulls, CAST((CASE WHEN n_objects <> 1 THEN 1 ELSE 0 END) + (CASE WHEN duplicates > 0 THEN 2 ELSE 0 END) + (CASE WHEN nulls > 0 THEN 4 ELSE 0 END) AS INTEGER) AS errors FROM (
 SELECT coalesce(o.pkg, a.pkg) AS pkg, coalesce(n_objects, 0) AS n_objects, coalesce(n_attachments, 0) AS n_attachments, coalesce(duplicates, 0) AS duplicates, coalesce(nulls, 0) AS nulls FROM
 (SELECT o_orderkey AS pkg, count(*) AS n_objects FROM orders GROUP BY 1) o FULL JOIN
 (SELECT l_orderkey AS pkg, count(*) AS n_attachments, count(CASE WHEN l_quantity > 1 THEN 1 END) - count(DISTINCT CASE WHEN l_quantity > 1 THEN l_suppkey END) AS duplicates, count(*) - count(CASE WHEN l_quantity > 1 THEN 1 END) AS nulls FROM lineitem GROUP BY 1) a ON o.pkg = a.pkg)""",
    "duplicate_names": "SELECT l_orderkey, l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "lossless_floats": "SELECT l_returnflag, count(*) AS n, count(CASE WHEN CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) = l_extendedprice THEN 1 END) AS lossless FROM lineitem GROUP BY 1",
}
