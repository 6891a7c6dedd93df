"""Queries on logs and keyed stores: events, conversations and orders as operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.addr import addr, checksum32
from ..operators import access, logs
from .tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("size", F.octet_length("props").cast("bigint"))


def cache_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    return logs.last_writer(_events(spark, sf), ["event_type", "user_id"], ["ts", "event_id"], ["event_id", "value"])


def cache_tiered_get(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus", "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("v"))
    memory = logs.last_writer(o.where("o_orderstatus = 'P'"), ["key"], ["o_orderdate", "o_orderkey"], ["v"])
    disk = logs.last_writer(o, ["key"], ["o_orderdate", "o_orderkey"], ["v"])
    c = table(spark, sf, "customer")
    upstream = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("v"))
    return logs.tiered(c.select(F.col("c_custkey").alias("key")), [("memory", memory), ("disk", disk), ("upstream", upstream)], ["key"], "v")


def oplog_lsn_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sequenced(_events(spark, sf), "user_id", ["ts", "event_id"], "size").select("user_id", "event_id", "lsn", "offset")


def oplog_high_water(spark: SparkSession, sf: str) -> DataFrame:
    return logs.high_water(logs.sequenced(_events(spark, sf), "user_id", ["ts", "event_id"], "size"), "user_id")


def oplog_first_writer_map(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("hash", addr(F.col("text")))
    return logs.first_writer(c, ["conv_id"], ["turn", "role", "hash"], ["turn", "role", "hash"])


def oplog_latest_op(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("hash", addr(F.col("text")))
    return logs.last_writer(c, ["conv_id"], ["turn", "role", "hash"], ["turn", "role", "hash"])


def oplog_resolve(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag", "l_orderkey", "l_linenumber", addr(F.col("l_orderkey").cast("string")).alias("hash"))
    maps = [logs.first_writer(li.where(F.col("l_returnflag") == f), ["id"], ["l_orderkey", "l_linenumber"], ["hash"]) for f in ("R", "A", "N")]
    stored = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(addr(F.col("o_orderkey").cast("string")).alias("hash"), F.octet_length("o_orderpriority").cast("bigint").alias("size"))
    return logs.resolve(table(spark, sf, "part").select(F.col("p_partkey").alias("id")), maps, stored).select("id", "map", "hash", "size")


def oplog_replay_checksum(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("claimed", F.when(F.col("event_type") == "error", checksum32(F.col("event_type"))).otherwise(checksum32(F.col("props"))))
    return logs.replay(e, "props", "claimed").groupBy("user_id").agg(F.count("*").alias("records"), F.max("event_id").alias("last"))


def oplog_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("l_returnflag") == "R", F.lit(None).cast("string")).otherwise(F.col("l_shipdate").cast("date").cast("string"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), path.alias("path"))).alias("files"))  # the lines of one order
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("op"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("key")).join(li, F.col("op") == F.col("l_orderkey"), "left")
    good, bad = logs.valid_ops(o)
    return good.select("op", F.lit(True).alias("valid")).unionByName(bad.select("op", F.lit(False).alias("valid")))


def log_whole_records(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    return logs.whole_records(d, "n", 32).drop("n")


def ewma_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return logs.fold_rate(e, "event_type", "day", "n", 0.25, 86400.0)


def access_counts(spark: SparkSession, sf: str) -> DataFrame:
    return access.counts(_events(spark, sf), "user_id", "event_type")


def request_rates(spark: SparkSession, sf: str) -> DataFrame:
    return access.rates(_events(spark, sf), "user_id", "ts")


def peer_liveness(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(F.col("user_id").alias("session"), "ts", "event_id", F.col("props").alias("address"), F.col("event_type").isin("signup", "error").alias("bye"))
    return access.liveness(e, "session", ["ts", "event_id"], "bye")


def route_match(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"scheme": "https?", "host": "[^/]+", "lang": "[a-z]{2}", "id": "[0-9]+"}
    routes = [(n, logs.route_pattern(t, kinds)) for n, t in (("plain", "{scheme}://{host}/{lang}/{id}"), ("anchor", "{scheme}://{host}/{lang}/{id}#{rest}"), ("query", "{scheme}://{host}/{lang}/{id}[?]{rest}"), ("other", "{rest}"))]
    return table(spark, sf, "pages").groupBy(logs.routed(F.col("url"), routes).alias("route")).agg(F.count("*").alias("pages"))


def query_params(spark: SparkSession, sf: str) -> DataFrame:
    q = F.regexp_extract("url", r"\?([^#]*)", 1)
    return table(spark, sf, "pages").select("page_id", logs.query_value(q, "PAGE").alias("page"), logs.query_value(q, "ref").alias("ref"), logs.query_value(q, "none").alias("none"))


def cache_key_validation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("/"), F.when(F.col("url").contains("?"), F.upper(addr(F.col("html")))).otherwise(F.sha1(F.col("html").cast("binary"))), F.when(F.col("url").contains("#"), "x").otherwise("")).alias("uri"))
    bucket, hash_ = logs.cache_key(F.col("uri"))
    return p.select("page_id", bucket.alias("bucket"), hash_.alias("hash"))


QUERIES = {f.__name__: f for f in (cache_last_writer, cache_tiered_get, oplog_lsn_offsets, oplog_high_water, oplog_first_writer_map, oplog_latest_op, oplog_resolve, oplog_replay_checksum, oplog_required_fields, log_whole_records, ewma_rates, access_counts, request_rates, peer_liveness, route_match, query_params, cache_key_validation)}

_seq = """SELECT user_id, event_id, size, row_number() OVER w AS lsn,
 CAST(coalesce(sum((size + 31) // 32 * 32) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
 FROM (SELECT *, octet_length(encode(props)) AS size FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_nth = """SELECT conv_id, turn, role, hash FROM (SELECT conv_id, turn, role, substr(sha256(text), 1, 40) AS hash,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn {0}, role {0}, substr(sha256(text), 1, 40) {0}) AS n FROM conversations) WHERE n = 1"""
_orders = "SELECT o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders"
SQL = {
    "cache_last_writer": "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "cache_tiered_get": f"SELECT c_custkey AS key, coalesce(m.v, d.v, c_name) AS v, CASE WHEN m.v IS NOT NULL THEN 'memory' WHEN d.v IS NOT NULL THEN 'disk' ELSE 'upstream' END AS tier FROM customer LEFT JOIN (SELECT * FROM ({_orders} WHERE o_orderstatus = 'P') WHERE n = 1) m ON m.key = c_custkey LEFT JOIN (SELECT * FROM ({_orders}) WHERE n = 1) d ON d.key = c_custkey",
    "oplog_lsn_offsets": f'SELECT user_id, event_id, lsn, "offset" FROM ({_seq})',
    "oplog_high_water": f'SELECT user_id, max(lsn) AS max_lsn, CAST(max(("offset" + size + 31) // 32 * 32) AS BIGINT) AS next_offset FROM ({_seq}) GROUP BY user_id',
    "oplog_first_writer_map": _nth.format("ASC"),
    "oplog_latest_op": _nth.format("DESC"),
    "oplog_resolve": """SELECT p_partkey AS id, map, r.hash, size FROM part LEFT JOIN (
 SELECT id, hash, map, row_number() OVER (PARTITION BY id ORDER BY map, l_orderkey, l_linenumber) AS n FROM (
 SELECT l_partkey AS id, substr(sha256(CAST(l_orderkey AS VARCHAR)), 1, 40) AS hash, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS map FROM lineitem)) r ON r.id = p_partkey AND r.n = 1
 LEFT JOIN (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS hash, octet_length(encode(o_orderpriority)) AS size FROM orders WHERE o_orderstatus = 'F') s ON s.hash = r.hash""",
    "oplog_replay_checksum": "SELECT user_id, count(*) AS records, max(event_id) AS last FROM events WHERE substr(sha256(props), 1, 8) = CASE WHEN event_type = 'error' THEN substr(sha256(event_type), 1, 8) ELSE substr(sha256(props), 1, 8) END GROUP BY user_id",
    "oplog_required_fields": "SELECT o_orderkey AS op, o_orderstatus <> 'P' AND o_orderpriority IS NOT NULL AND NOT coalesce(bad, false) AS valid FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "log_whole_records": "SELECT doc_id, octet_length(encode(text)) // 32 AS records, octet_length(encode(text)) % 32 AS torn FROM documents",
    "ewma_rates": "SELECT event_type, list_reduce(list(CAST(n AS DOUBLE) / 86400.0 ORDER BY day), lambda r, x: r + 0.25 * (x - r)) AS rate, count(*) AS ticks FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
    "access_counts": "SELECT user_id, event_type, count(*) AS accesses FROM events GROUP BY ALL",
    "request_rates": "SELECT user_id, count(*) AS n, count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS per_second FROM events GROUP BY user_id",
    "peer_liveness": "SELECT user_id AS session, max(ts) AS last_seen, count(*) AS messages, count(DISTINCT props) AS addresses FROM events GROUP BY user_id HAVING arg_max(event_type, {'ts': ts, 'id': event_id}) NOT IN ('signup', 'error')",
    "route_match": "SELECT CASE WHEN regexp_full_match(url, 'https?://[^/]+/[a-z]{2}/[0-9]+') THEN 'plain' WHEN regexp_full_match(url, 'https?://[^/]+/[a-z]{2}/[0-9]+#.+?') THEN 'anchor' WHEN regexp_full_match(url, 'https?://[^/]+/[a-z]{2}/[0-9]+[?].+?') THEN 'query' ELSE 'other' END AS route, count(*) AS pages FROM pages GROUP BY 1",
    "query_params": "SELECT page_id, nullif(regexp_extract(q, '(?:^|&)(page=([^&]*))', 2), '') AS page, nullif(regexp_extract(q, '(?:^|&)(ref=([^&]*))', 2), '') AS ref, CAST(NULL AS VARCHAR) AS none FROM (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)",
    "cache_key_validation": "SELECT page_id, CASE WHEN NOT contains(url, '#') THEN regexp_replace(url, '[?#].*', '') END AS bucket, CASE WHEN NOT contains(url, '#') THEN CASE WHEN contains(url, '?') THEN substr(sha256(html), 1, 40) ELSE sha1(html) END END AS hash FROM pages",
}
