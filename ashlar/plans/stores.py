"""Queries on stores, caches and file lists: lookups in order, views, counters and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..documents import frames
from ..functions import crc
from ..functions.addr import addr
from ..operators import access, cas, chunking, dedup, logs, manifest
from .tables import table
from .trees import _tree


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size <= 25").select(addr(F.col("p_partkey").cast("string")).alias("hash"), F.octet_length("p_name").cast("bigint").alias("size"))


def cas_batch_ordered(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"), addr(F.col("l_partkey").cast("string")).alias("hash"))
    return cas.batch_lookup(li, _stored(spark, sf)).select("batch", "nth", "pos", "hash", "size", "hits")


def chunk_store_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The compressed size of the test is a stated one: a third of the bytes, rounded up."""
    d = chunking.fixed(table(spark, sf, "documents"), "doc_id", "text", 64).withColumn("compressed", F.expr("(size + 2) div 3"))
    return cas.store_stats(d, chunking.fixed(table(spark, sf, "documents").where("lang = 'en'"), "doc_id", "text", 64))


def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_pairs(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("payload")))


def files_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.by_size(table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("size")))


def files_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.by_path(table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("ord"), F.octet_length("html").cast("bigint").alias("size")))


def _ops(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as operations: client files are the lines, server files those of them that were not returned."""
    file = F.struct(F.col("l_linenumber").alias("id"), F.concat_ws("/", "l_linestatus", "l_partkey").alias("path"))
    kept = F.when(F.col("l_returnflag") != "R", F.struct(F.col("l_linenumber").alias("id"), F.concat_ws("/", "l_linestatus", "l_suppkey").alias("path")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("op")).agg(F.collect_list(file).alias("files"), F.collect_list(kept).alias("serverfiles"))  # the lines of one order


def oplog_files(spark: SparkSession, sf: str) -> DataFrame:
    return logs.file_view(_ops(spark, sf))


def oplog_count_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return logs.count_mismatch(_ops(spark, sf))


def oplog_attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments of operations that the store does not have, one a hash."""
    ops = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(addr(F.col("l_partkey").cast("string")).alias("hash"), F.octet_length(F.col("l_partkey").cast("string")).cast("bigint").alias("size"))).alias("attachments"))
    return cas.insert_new(ops.select(F.explode("attachments").alias("a")).select("a.*"), _stored(spark, sf))


def oplog_open(spark: SparkSession, sf: str) -> DataFrame:
    """project -> oplog -> number of entries, for oplogs that have any."""
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    entries = o.groupBy("o_custkey").agg(F.count("*").alias("entries"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(entries, F.col("c_custkey") == F.col("o_custkey")).select(F.col("n_name").alias("project"), F.col("c_custkey").alias("oplog"), "entries")


def need_paths(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", addr(F.col("l_partkey").cast("string")).alias("hash"))
    p = table(spark, sf, "part").where("p_size > 10").select(addr((F.col("p_partkey") % 150).cast("string")).alias("hash"), F.col("p_name").alias("path"), F.col("p_partkey").alias("ord"))
    return cas.need_paths(li, p)


def route_captures(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"scheme": "https?", "host": "[^/]+", "lang": "[a-z]{2}", "id": "[0-9]+"}
    path = lambda t: logs.route_pattern(t, kinds)
    routes = [("page", path("{scheme}://{host}/{lang}/{id}"), {"GET", "HEAD"}), ("put", path("{scheme}://{host}/{rest}"), {"PUT"}), ("any", path("{scheme}://{rest}"), {"GET"})]
    verb = F.element_at(F.array(*map(F.lit, ("GET", "PUT", "HEAD"))), (F.col("page_id") % 3 + 1).cast("int"))
    name, captures = logs.routed_with(F.col("url"), verb, routes)
    return table(spark, sf, "pages").select("page_id", name.alias("route"), F.array_join(captures, "|").alias("captures"))


def cache_admission(spark: SparkSession, sf: str) -> DataFrame:
    """The memory tier after reads of every page: those small enough are in it."""
    p = table(spark, sf, "pages").groupBy(F.col("page_id").alias("key")).agg(F.max("html").alias("v"))
    memory = p.where("key % 5 = 0").select("key", F.lit("old").alias("v"))
    return logs.promoted(memory, p, "key", "v").select("key", F.octet_length("v").cast("bigint").alias("size"))


def cache_log_records(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    plain = logs.whole_records(d, "n", 48).select("doc_id", "records", "torn")
    return plain.join(logs.whole_records(d, "n", 48, header=64).select("doc_id", F.col("records").alias("after_header"), F.col("torn").alias("torn_after_header")), "doc_id")


def cache_put_offsets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("size", F.octet_length("props").cast("bigint"))
    return logs.sequenced(e, "user_id", ["ts", "event_id"], "size", align=16).select("user_id", "event_id", "lsn", "offset")


def upstream_put(spark: SparkSession, sf: str) -> DataFrame:
    """What goes upstream: key, the content's hash as its header, size."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), addr(F.col("text")).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))


def store_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "put").otherwise("get").alias("op"), F.octet_length("props").cast("bigint").alias("size"))
    return access.counters(e, "op", "size")


def write_cursors(spark: SparkSession, sf: str) -> DataFrame:
    return cas.cursors(table(spark, sf, "documents").select((F.col("doc_id") * 4096).alias("offset"), F.octet_length("text").cast("bigint").alias("size")), [16, 4096])


def manifest_print(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.printed(_tree(spark, sf))


def cdc_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of content-defined chunks by each test: bytes in all, whether unique chunks are no more
    than all, and how many chunks break the size limits (a text's last may be short)."""
    out = None
    least, most, _ = chunking.sizes(256)
    for name in chunking.PREDICATES:
        c = chunking.content_defined(table(spark, sf, "documents"), "doc_id", "text", 256, predicate=name).select("doc_id", "ord", "hash", "size")
        ends = c.groupBy("doc_id").agg(F.max("ord").alias("ord"), F.sum("size").alias("bytes"), F.count("*").alias("n"), F.sum((F.col("size") > most).cast("bigint")).alias("long"), F.sum((F.col("size") <= least).cast("bigint")).alias("short"), F.min_by("size", -F.col("ord")).alias("last"))
        bad = F.sum(F.col("long") + F.col("short") - (F.col("last") <= least).cast("bigint"))
        one = ends.agg(F.sum("bytes").alias("total_bytes"), (F.sum("n") == F.sum(F.col("ord") + 1)).alias("numbered"), bad.alias("out_of_limits")).select(F.lit(name).alias("predicate"), "*")
        out = one if out is None else out.union(one)
    return out


def file_cache_trailer(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written with a trailer and read back; one in seven is damaged and gives null."""
    file = crc.with_trailer(F.coalesce("html", F.lit("")))
    damaged = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(b"x"), file)).otherwise(file)
    back = crc.without_trailer(damaged)
    return table(spark, sf, "pages").select("page_id", F.octet_length(back).cast("bigint").alias("size"), F.sha1(back).alias("sha1"))


def package_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as packages with suppliers as attachments: one is looked up, some go, some come."""
    one = lambda c: F.struct(addr(c.cast("string")).alias("hash"), F.when(c % 2 == 0, "object_attachment").otherwise("binary_attachment").alias("kind"))
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(one(F.col("l_suppkey")))).alias("a"))  # the lines of one order
    left, gone = frames.without_attachments(F.col("a"), F.array(*(addr(F.lit(str(i))) for i in range(0, 20))))
    more = frames.with_attachments(F.col("left"), F.array(one(F.lit(3)), one(F.lit(30))))
    p = p.select("l_orderkey", "a", left.alias("left"), gone.alias("gone")).withColumn("more", more)
    return p.select("l_orderkey", frames.find_attachment(F.col("a"), addr(F.lit("7")))["kind"].alias("seven"), "gone", F.size("more").alias("after"), frames.same_package(F.lit("x"), F.col("a"), F.lit("x"), F.col("more")).alias("same"))


def typed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Typed accessors with defaults and errors over orders as documents."""
    d = table(spark, sf, "orders").select("o_orderkey", F.parse_json(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") - 1000).alias("n"), (F.col("o_custkey") == 1).alias("b"), F.struct(addr(F.col("o_orderstatus")).alias("$hash")).alias("h")))).alias("v"))
    out = {"k8": ("k", "int8", 7), "n16": ("n", "uint16", 7), "k64": ("k", "int64", 7), "s": ("s", "string", "none"), "sn": ("s", "int32", -1), "b": ("b", "bool", False), "x": ("x", "double", 0.5), "kf": ("k", "double", 0.0), "h": ("h", "hash", "")}
    got = {c: frames.typed(F.col("v"), *how) for c, how in out.items()}
    return d.select("o_orderkey", *(v.alias(c) for c, (v, _) in got.items()), *(e.alias(f"{c}_error") for c, (_, e) in got.items()))


QUERIES = {f.__name__: f for f in (cas_batch_ordered, chunk_store_stats, duplicate_pairs, files_by_size, files_by_path, oplog_files, oplog_count_mismatch, oplog_attachments, oplog_open, need_paths, route_captures, cache_admission, cache_log_records, cache_put_offsets, upstream_put, store_counters, write_cursors, manifest_print, cdc_invariants, file_cache_trailer, package_operations, typed_fields)}
_h = "substr(sha256(CAST({} AS VARCHAR)), 1, 40)"
_stored_sql = f"SELECT {_h.format('p_partkey')} AS hash, octet_length(encode(p_name)) AS size FROM part WHERE p_size <= 25"
_bytes = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents"
_piece = "SELECT lang, encode(text)[i * 64 + 1 : i * 64 + 64] AS chunk FROM documents, range((octet_length(encode(text)) + 63) // 64) r(i)"
_full = "^(?:{})$"
_host, _rest = "(https?)://([^/]+)/([a-z]{2})/([0-9]+)", "(https?)://(.+?)"
SQL = {
    "cas_batch_ordered": f"SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY pos, hash) AS nth, pos, hash, size, count(*) OVER (PARTITION BY batch) AS hits FROM (SELECT l_orderkey AS batch, l_linenumber AS pos, {_h.format('l_partkey')} AS hash FROM lineitem) JOIN ({_stored_sql}) USING (hash)",
    "chunk_store_stats": f"""SELECT CAST(sum(n * size) AS BIGINT) AS total_bytes, CAST(sum(n) AS BIGINT) AS total_chunks, CAST(sum(n * ((size + 2) // 3)) AS BIGINT) AS total_compressed,
 CAST(sum(size) AS BIGINT) AS unique_bytes, count(*) AS unique_chunks, CAST(sum((size + 2) // 3) AS BIGINT) AS unique_compressed, CAST(sum((n - 1) * size) AS BIGINT) AS duplicate_bytes,
 CAST(sum(CASE WHEN en THEN 0 ELSE 1 END) AS BIGINT) AS new_chunks, CAST(sum(CASE WHEN en THEN 0 ELSE size END) AS BIGINT) AS new_bytes
 FROM (SELECT chunk, octet_length(chunk) AS size, count(*) AS n, bool_or(lang = 'en') AS en FROM ({_piece}) GROUP BY chunk)""",
    "duplicate_pairs": "SELECT octet_length(encode(text)) AS size, canonical, doc_id AS duplicate FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents WHERE text IS NOT NULL) WHERE doc_id > canonical",
    "files_by_size": "SELECT url AS path, octet_length(encode(html)) AS size FROM pages",
    "files_by_path": "SELECT url AS path, arg_max(octet_length(encode(html)), page_id) AS size FROM pages GROUP BY url",
    "oplog_files": "SELECT l_orderkey AS op, l_linenumber AS id, min(concat(l_linestatus, '/', l_partkey)) AS client_path, min(CASE WHEN l_returnflag <> 'R' THEN concat(l_linestatus, '/', l_suppkey) END) AS server_path FROM lineitem GROUP BY 1, 2",
    "oplog_count_mismatch": "SELECT l_orderkey AS op, count(*) AS client_files, count(*) FILTER (l_returnflag <> 'R') AS server_files FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')",
    "oplog_attachments": f"SELECT DISTINCT {_h.format('l_partkey')} AS hash, length(CAST(l_partkey AS VARCHAR)) AS size FROM lineitem WHERE {_h.format('l_partkey')} NOT IN (SELECT hash FROM ({_stored_sql}))",
    "oplog_open": "SELECT n_name AS project, c_custkey AS oplog, count(*) AS entries FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "need_paths": f"SELECT l_orderkey, l_linenumber, {_h.format('l_partkey')} AS hash, path, path IS NOT NULL AS known FROM lineitem LEFT JOIN (SELECT p_partkey % 150 AS k, arg_max(p_name, p_partkey) AS path FROM part WHERE p_size > 10 GROUP BY 1) ON k = l_partkey",
    "route_captures": f"""SELECT page_id, route, CASE route WHEN 'page' THEN concat_ws('|', regexp_extract(url, '{_full.format(_host)}', 1), regexp_extract(url, '{_full.format(_host)}', 2), regexp_extract(url, '{_full.format(_host)}', 3), regexp_extract(url, '{_full.format(_host)}', 4))
 WHEN 'put' THEN concat_ws('|', regexp_extract(url, '^(https?)://([^/]+)/(.+?)$', 1), regexp_extract(url, '^(https?)://([^/]+)/(.+?)$', 2), regexp_extract(url, '^(https?)://([^/]+)/(.+?)$', 3))
 WHEN 'any' THEN concat_ws('|', regexp_extract(url, '{_full.format(_rest)}', 1), regexp_extract(url, '{_full.format(_rest)}', 2)) END AS captures
 FROM (SELECT page_id, url, CASE WHEN page_id % 3 IN (0, 2) AND regexp_full_match(url, '{_host}') THEN 'page' WHEN page_id % 3 = 1 AND regexp_full_match(url, '(https?)://([^/]+)/(.+?)') THEN 'put' WHEN page_id % 3 = 0 AND regexp_full_match(url, '{_rest}') THEN 'any' END AS route FROM pages)""",
    "cache_admission": "SELECT page_id AS key, CASE WHEN octet_length(encode(html)) <= 16384 THEN octet_length(encode(html)) ELSE 3 END AS size FROM pages WHERE octet_length(encode(html)) <= 16384 OR page_id % 5 = 0",
    "cache_log_records": f"SELECT doc_id, n // 48 AS records, n % 48 AS torn, greatest(n - 64, 0) // 48 AS after_header, greatest(n - 64, 0) % 48 AS torn_after_header FROM ({_bytes})",
    "cache_put_offsets": 'SELECT user_id, event_id, row_number() OVER w AS lsn, CAST(coalesce(sum((octet_length(encode(props)) + 15) // 16 * 16) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)',
    "upstream_put": "SELECT doc_id AS key, substr(sha256(text), 1, 40) AS hash, octet_length(encode(text)) AS size FROM documents",
    "store_counters": "SELECT CASE WHEN event_type = 'purchase' THEN 'put' ELSE 'get' END AS op, count(*) AS accesses, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "write_cursors": f"SELECT align, CAST((e + align - 1) // align * align AS BIGINT) AS next_offset FROM (SELECT max(doc_id * 4096 + n) AS e FROM ({_bytes})), (VALUES (16), (4096)) a(align)",
    "manifest_print": "SELECT 'root' AS path, 'root' AS line UNION ALL SELECT 'root/' || r_name, '  ' || r_name FROM region UNION ALL SELECT 'root/' || r_name || '/' || n_name, '    ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'root/' || r_name || '/' || n_name || '/' || s_name, '      ' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cdc_invariants": f"SELECT predicate, CAST(sum(n) AS BIGINT) AS total_bytes, true AS numbered, CAST(0 AS BIGINT) AS out_of_limits FROM ({_bytes}), (VALUES ('threshold'), ('mask'), ('modulo')) p(predicate) GROUP BY 1",
    "file_cache_trailer": "SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN octet_length(encode(coalesce(html, ''))) END AS size, CASE WHEN page_id % 7 <> 0 THEN sha1(coalesce(html, '')) END AS sha1 FROM pages",
    "package_operations": """SELECT l_orderkey, max(CASE WHEN l_suppkey = 7 THEN 'binary_attachment' END) AS seven, CAST(count(DISTINCT l_suppkey) FILTER (l_suppkey < 20) AS INTEGER) AS gone,
 CAST(count(DISTINCT l_suppkey) FILTER (l_suppkey >= 20) + 1 + CASE WHEN bool_or(l_suppkey = 30) THEN 0 ELSE 1 END AS INTEGER) AS after,
 count(DISTINCT l_suppkey) FILTER (l_suppkey < 20 AND l_suppkey <> 3) = 0 AND bool_or(l_suppkey = 3) AND bool_or(l_suppkey = 30) AS same FROM lineitem GROUP BY 1""",
    "typed_fields": f"""SELECT o_orderkey, CAST(CASE WHEN o_orderkey <= 127 THEN o_orderkey ELSE 7 END AS TINYINT) AS k8, CAST(CASE WHEN n BETWEEN 0 AND 65535 THEN n ELSE 7 END AS INTEGER) AS n16, CAST(o_orderkey AS BIGINT) AS k64, o_orderstatus AS s, -1 AS sn, o_custkey = 1 AS b, CAST(0.5 AS DOUBLE) AS x, CAST(o_orderkey AS DOUBLE) AS kf, {_h.format('o_orderstatus')} AS h,
 CASE WHEN o_orderkey > 127 THEN 'range' END AS k8_error, CASE WHEN n NOT BETWEEN 0 AND 65535 THEN 'range' END AS n16_error, CAST(NULL AS VARCHAR) AS k64_error, CAST(NULL AS VARCHAR) AS s_error, 'type' AS sn_error, CAST(NULL AS VARCHAR) AS b_error, 'missing' AS x_error, CAST(NULL AS VARCHAR) AS kf_error, CAST(NULL AS VARCHAR) AS h_error
 FROM (SELECT *, o_orderkey - 1000 AS n FROM orders)""",
}
