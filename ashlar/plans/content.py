"""Queries on content: addresses, duplicates, chunks and the content-addressed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.addr import addr
from ..operators import cas, chunking, dedup
from .tables import table

CHUNK = 64


def content_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(addr(F.col("text")).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))
    return cas.stats(d)


STATS = """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_chunks, CAST(coalesce(sum(n * size), 0) AS BIGINT) AS total_bytes,
 count(*) AS unique_chunks, CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes,
 CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS duplicate_bytes, CAST(sum(n * size) // sum(n) AS BIGINT) AS mean_bytes
FROM (SELECT hash, count(*) AS n, any_value(size) AS size FROM ({}) GROUP BY hash)"""
DOCS = "SELECT substr(sha256(text), 1, 40) AS hash, octet_length(encode(text)) AS size FROM documents"


def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicates(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("payload")))


def two_root_sizes(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").cast("bigint").alias("size"))
    b = table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.octet_length("html").cast("bigint").alias("size"))
    return dedup.size_groups(a.union(b).where("size > 1024"))


def size_histogram_pow2(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select(F.octet_length("text").cast("bigint").alias("size"))
    b = table(spark, sf, "pages").select(F.octet_length("html").cast("bigint").alias("size"))
    return dedup.histogram(a.union(b))


def tier_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select(F.octet_length("text").cast("bigint").alias("size"))
    b = table(spark, sf, "pages").select(F.octet_length("html").cast("bigint").alias("size"))
    return a.union(b).groupBy(cas.tier(F.col("size")).alias("tier")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fixed(table(spark, sf, "documents"), "doc_id", "text", CHUNK)


def fixed_chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cas.stats(_fixed(spark, sf).select("hash", "size"))


PIECES = f"""SELECT doc_id, o // {CHUNK} AS ord, b[o + 1 : least(o + {CHUNK}, octet_length(b))] AS chunk
 FROM (SELECT doc_id, b, unnest(range(0, octet_length(b), {CHUNK})) AS o FROM (SELECT doc_id, encode(text) AS b FROM documents))"""


def fixed_chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    return _fixed(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.expr("sum(size) div count(*)").alias("mean_bytes"))


def fixed_chunk_new(spark: SparkSession, sf: str) -> DataFrame:
    d = _fixed(spark, sf).select("doc_id", "ord", "hash", "size")
    return cas.first_seen(d, "doc_id", "ord").groupBy("doc_id").agg(F.sum(F.col("is_new").cast("bigint")).alias("new_chunks"), F.sum(F.when(F.col("is_new"), F.col("size")).otherwise(0)).alias("new_bytes"))


def fixed_chunk_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.reassembled(_fixed(spark, sf), "doc_id")


def cdc_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.reassembled(chunking.content_defined(table(spark, sf, "documents"), "doc_id", "text", 256), "doc_id")


WHOLE = "SELECT doc_id, octet_length(encode(text)) AS total_bytes, substr(sha256(text), 1, 40) AS hash FROM documents WHERE octet_length(encode(text)) > 0"


def cdc_chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cas.stats(chunking.content_defined(table(spark, sf, "documents"), "doc_id", "text", 256).select("hash", "size"))


def cas_insert_new(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return cas.insert_new(cas.chunks(d, "text").drop("payload"), cas.chunks(d.where("lang = 'en'"), "text").drop("payload")).select("hash", "size")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(addr(F.col("p_partkey").cast("string")).alias("hash"), F.octet_length("p_name").cast("bigint").alias("size"), "p_size")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", addr(F.col("l_partkey").cast("string")).alias("hash"))


def cas_batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return cas.lookup(_refs(spark, sf), _parts(spark, sf).where("p_size <= 25").select("hash", "size")).select("l_orderkey", "l_linenumber", "hash", "size")


def need_list(spark: SparkSession, sf: str) -> DataFrame:
    return cas.need(_refs(spark, sf), _parts(spark, sf).where("p_size <= 25")).select("l_orderkey", "l_linenumber", "hash")


def job_materialise(spark: SparkSession, sf: str) -> DataFrame:
    return cas.materialise(_refs(spark, sf).withColumnRenamed("l_orderkey", "job"), _parts(spark, sf).where("p_size <= 45"))


def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("lang") == "de", addr(F.col("source"))).otherwise(addr(F.col("text"))).alias("claimed"))
    return cas.verified(d, "text", "claimed").select("doc_id", "claimed")


def scrub(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("lang") == "de", addr(F.col("source"))).otherwise(addr(F.col("text"))).alias("claimed"))
    return cas.scrub(d, "text", "claimed").select("doc_id", "claimed")


def gc_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return cas.unreferenced(table(spark, sf, "part"), refs, "p_partkey").select("p_partkey", "p_name")


def hash_report(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat_ws(",", F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)).alias("line"))


def next_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return cas.cursor(table(spark, sf, "documents").select((F.col("doc_id") * 4096).alias("offset"), F.octet_length("text").cast("bigint").alias("size")), 4096)


_refs_sql = "SELECT l_orderkey, l_linenumber, substr(sha256(CAST(l_partkey AS VARCHAR)), 1, 40) AS hash FROM lineitem"
_parts_sql = "SELECT substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 40) AS hash, octet_length(encode(p_name)) AS size, p_size FROM part"
_claims_sql = "SELECT doc_id, text, CASE WHEN lang = 'de' THEN substr(sha256(source), 1, 40) ELSE substr(sha256(text), 1, 40) END AS claimed FROM documents"
_sizes_sql = "SELECT octet_length(encode(text)) AS size FROM documents UNION ALL SELECT octet_length(encode(html)) FROM pages"

QUERIES = {f.__name__: f for f in (content_dedup_stats, duplicate_groups, two_root_sizes, size_histogram_pow2, tier_breakdown, fixed_chunk_stats, fixed_chunk_files, fixed_chunk_new, fixed_chunk_reassembly, cdc_reassembly, cdc_chunk_stats, cas_insert_new, cas_batch_lookup, need_list, job_materialise, verify_claims, scrub, gc_unreferenced, hash_report, next_cursor)}
SQL = {
    "content_dedup_stats": STATS.format(DOCS),
    "duplicate_groups": "SELECT size, hash, count(*) AS files, min(doc_id) AS canonical, size * (count(*) - 1) AS dupe_bytes FROM (SELECT doc_id, substr(sha256(text), 1, 40) AS hash, octet_length(encode(text)) AS size FROM documents) WHERE size > 0 GROUP BY size, hash HAVING count(*) > 1",
    "two_root_sizes": "SELECT size, count(*) AS files, min(path) AS first_path FROM (SELECT doc_id AS path, octet_length(encode(text)) AS size FROM documents UNION ALL SELECT page_id, octet_length(encode(html)) FROM pages) WHERE size > 1024 GROUP BY size",
    "size_histogram_pow2": f"SELECT CASE WHEN size <= 1 THEN 1 ELSE CAST(pow(2, length(bin(size - 1))) AS BIGINT) END AS bucket, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ({_sizes_sql}) GROUP BY 1",
    "tier_breakdown": f"SELECT CASE WHEN size < 1024 THEN 'tiny' WHEN size >= 1048576 THEN 'huge' ELSE 'small' END AS tier, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({_sizes_sql}) GROUP BY 1",
    "fixed_chunk_stats": STATS.format(f"SELECT substr(sha256(chunk), 1, 40) AS hash, octet_length(chunk) AS size FROM ({PIECES})"),
    "fixed_chunk_files": f"SELECT doc_id, count(*) AS chunks, CAST(sum(octet_length(chunk)) // count(*) AS BIGINT) AS mean_bytes FROM ({PIECES}) GROUP BY doc_id",
    "fixed_chunk_new": f"SELECT doc_id, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new_chunks, CAST(sum(CASE WHEN n = 1 THEN octet_length(chunk) ELSE 0 END) AS BIGINT) AS new_bytes FROM (SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, ord) AS n FROM ({PIECES})) GROUP BY doc_id",
    "fixed_chunk_reassembly": WHOLE,
    "cdc_reassembly": WHOLE,
    "cas_insert_new": f"SELECT hash, any_value(size) AS size FROM ({DOCS}) WHERE hash NOT IN (SELECT substr(sha256(text), 1, 40) FROM documents WHERE lang = 'en') GROUP BY hash",
    "cas_batch_lookup": f"SELECT l_orderkey, l_linenumber, hash, size FROM ({_refs_sql}) JOIN ({_parts_sql}) USING (hash) WHERE p_size <= 25",
    "need_list": f"SELECT * FROM ({_refs_sql}) WHERE hash NOT IN (SELECT hash FROM ({_parts_sql}) WHERE p_size <= 25)",
    "job_materialise": f"SELECT l_orderkey AS job, count(*) AS chunks, count(*) - count(p.hash) AS missing, count(*) = count(p.hash) AS ready FROM ({_refs_sql}) r LEFT JOIN (SELECT * FROM ({_parts_sql}) WHERE p_size <= 45) p ON r.hash = p.hash GROUP BY 1",
    "verify_claims": f"SELECT doc_id, claimed FROM ({_claims_sql}) WHERE substr(sha256(text), 1, 40) = claimed",
    "scrub": f"SELECT doc_id, claimed FROM ({_claims_sql}) WHERE substr(sha256(text), 1, 40) <> claimed",
    "gc_unreferenced": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "hash_report": "SELECT concat(doc_id, ',', sha256(text)) AS line FROM documents",
    "next_cursor": "SELECT CAST(max((doc_id * 4096 + octet_length(encode(text)) + 4095) // 4096 * 4096) AS BIGINT) AS next_offset FROM documents",
}
