"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import addr as a, numbers as n, text as t, ticks
from .tables import table


def hash_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", a.addr(c).alias("addr"), a.sha1(c).alias("sha1"), a.md5(c).alias("md5"), a.key_id(c).alias("key_id"), a.checksum32(c).alias("checksum"), a.to_hex(F.substring(c.cast("binary"), 1, 8)).alias("head"), a.shard_path(a.addr(c)).alias("shard"))


def int_math(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.is_pow2(c).alias("is_pow2"), n.floor_log2(c).alias("floor_log2"), n.ceil_log2(c).alias("ceil_log2"), n.next_pow2(c).alias("next_pow2"), n.leading_zeros64(c).alias("leading"), n.trailing_zeros64(c).alias("trailing"), n.round_up(c, 16).alias("round_up"), n.varuint_len(c).alias("varuint"))


def object_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", a.oid(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"), F.col("o_custkey")).alias("oid"))
    return o.withColumn("seconds", a.oid_seconds(F.col("oid")))


def tick_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", ticks.to_ticks(F.col("o_orderdate")).alias("ticks"), ticks.is_leap(F.year("o_orderdate")).alias("leap"))
    return o.withColumn("filetime_seconds", ticks.filetime_seconds(F.col("ticks") - ticks.UNIX_TICKS + ticks.UNIX_FILETIME))


def range_read(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("html").cast("binary")
    cut = t.byte_range(b, F.col("page_id") * 3, F.lit(100).cast("bigint"))
    return table(spark, sf, "pages").select("page_id", F.octet_length(cut).cast("bigint").alias("n"), F.sha1(cut).alias("sha1"), F.octet_length(b).cast("bigint").alias("size"))


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.extension(F.col("url")).alias("extension"), t.relative(F.col("url"), F.lit("http:/")).alias("below"))


def parse_int(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(t.parse_int(F.col("o_orderpriority")).alias("priority")).agg(F.count("*").alias("orders"))


def nice_numbers(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    return table(spark, sf, "documents").select("doc_id", t.nice_bytes(size).alias("bytes"), t.nice_number(size).alias("number"), t.nice_span_ms(size * 50).alias("span"), t.nice_byte_rate(size, F.col("n_chars")).alias("rate"))


QUERIES = {f.__name__: f for f in (hash_functions, int_math, object_ids, tick_dates, range_read, path_parts, parse_int, nice_numbers)}
_part = "lower(lpad(to_hex({}), 8, '0'))"
_oid = " || ".join(_part.format(c) for c in ("CAST(epoch(o_orderdate) AS BIGINT)", "o_orderkey", "o_custkey"))
# the widest of two, one or no decimals that fits four characters before the letter; ties to even
_unit = "CASE WHEN {n} % {u} = 0 THEN CAST({n} // {u} AS VARCHAR) WHEN {n} < 9.995 * {u} THEN printf('%.2f', round_even({n} * 100.0 / {u}, 0) / 100) WHEN {n} < 99.95 * {u} THEN printf('%.1f', round_even({n} * 10.0 / {u}, 0) / 10) ELSE printf('%.0f', round_even({n} * 1.0 / {u}, 0)) END"
_nice = lambda n, first: f"CASE WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || '{first}' WHEN {n} < 1048576 THEN {_unit.format(n=n, u=1024)} || 'K' WHEN {n} < 1073741824 THEN {_unit.format(n=n, u=1048576)} || 'M' ELSE {_unit.format(n=n, u=1073741824)} || 'G' END"
_span = """CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 10000 THEN printf('%.2fs', round_even(ms / 10.0, 0) / 100) WHEN ms < 60000 THEN printf('%.1fs', round_even(ms / 100.0, 0) / 10)
 WHEN ms < 3600000 THEN (ms // 60000) || 'm' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || 's' ELSE (ms // 3600000) || 'h' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || 'm' END"""
SQL = {
    "nice_numbers": f"SELECT doc_id, {_nice('n', 'B')} AS bytes, {_nice('n', '')} AS number, {_span} AS span, {_nice('r', 'B')} || '/s' AS rate FROM (SELECT doc_id, n, n * 50 AS ms, CAST(trunc(n * 1000 / nullif(n_chars, 0)) AS BIGINT) AS r FROM (SELECT doc_id, n_chars, octet_length(encode(text)) AS n FROM documents))",
    "hash_functions": "SELECT doc_id, h[1:40] AS addr, sha1(text) AS sha1, md5(text) AS md5, h[1:24] AS key_id, h[1:8] AS checksum, lower(hex(encode(text)[1:8])) AS head, h[1:3] || '/' || h[4:5] || '/' || h[6:40] AS shard FROM (SELECT doc_id, text, sha256(text) AS h FROM documents)",
    "int_math": "SELECT l_orderkey, l_linenumber, (k & (k - 1)) = 0 AS is_pow2, CASE WHEN k >= 1 THEN CAST(length(bin(k)) - 1 AS INTEGER) END AS floor_log2, CASE WHEN k = 1 THEN 0 WHEN k > 1 THEN CAST(length(bin(k - 1)) AS INTEGER) END AS ceil_log2, CASE WHEN k <= 1 THEN 1 ELSE CAST(pow(2, length(bin(k - 1))) AS BIGINT) END AS next_pow2, CASE WHEN k = 0 THEN 64 ELSE CAST(64 - length(bin(k)) AS INTEGER) END AS leading, CASE WHEN k = 0 THEN 64 ELSE CAST(length(bin(k)) - length(rtrim(bin(k), '0')) AS INTEGER) END AS trailing, (k + 15) // 16 * 16 AS round_up, CASE WHEN k = 0 THEN 1 ELSE CAST(least((length(bin(k)) - 1) // 7 + 1, 9) AS INTEGER) END AS varuint FROM (SELECT *, l_partkey AS k FROM lineitem)",
    "object_ids": f"SELECT o_orderkey, {_oid} AS oid, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders",
    "tick_dates": "SELECT o_orderkey, epoch_us(o_orderdate) * 10 + 621355968000000000 AS ticks, (year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0)) AS leap, CAST(epoch(o_orderdate) AS BIGINT) AS filetime_seconds FROM orders",
    "range_read": "SELECT page_id, octet_length(c) AS n, sha1(c) AS sha1, octet_length(b) AS size FROM (SELECT page_id, b, b[least(page_id * 3, octet_length(b)) + 1 : least(page_id * 3 + 100, octet_length(b))] AS c FROM (SELECT page_id, encode(html) AS b FROM pages))",
    "path_parts": "SELECT page_id, nullif(regexp_extract(url, '(\\.[^.]*)$', 1), '') AS extension, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) END AS below FROM pages",
    "parse_int": "SELECT TRY_CAST(regexp_extract(o_orderpriority, '^-?[0-9]+', 0) AS BIGINT) AS priority, count(*) AS orders FROM orders GROUP BY 1",
}
