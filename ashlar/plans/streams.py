"""Queries that run as streams over the events table and must equal their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.addr import addr
from ..streaming import stateful
from .tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    # as a pattern, since the file source takes a plain path for a folder
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def stream_access_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.finished(stateful.access_counts(_events(spark, sf), "user_id"), "complete", final=True)


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select(addr(F.concat_ws("|", "user_id", "event_type")).alias("hash"))
    return stateful.finished(stateful.first_of_key(e, "hash"), "append")


def stream_liveness(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("user_id", "ts", "event_id", F.col("event_type").isin("signup", "error").alias("bye"))
    return stateful.finished(stateful.liveness(e, "user_id"), "update", key="user_id")


def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    got = stateful.finished(stateful.windowed_counts(e, "at", "1 day", "1 hour", "event_type"), "complete", final=True)
    return got.select(F.to_date("start").alias("day"), "event_type", "accesses")


QUERIES = {f.__name__: f for f in (stream_access_counts, stream_first_seen, stream_liveness, stream_windowed_counts)}
SQL = {
    "stream_access_counts": "SELECT user_id, count(*) AS accesses FROM events GROUP BY user_id",
    "stream_first_seen": "SELECT DISTINCT substr(sha256(concat(user_id, '|', event_type)), 1, 40) AS hash FROM events",
    "stream_liveness": "SELECT user_id, epoch_us(max(ts)) AS last_seen, count(*) AS messages, arg_max(event_type, {'ts': ts, 'id': event_id}) NOT IN ('signup', 'error') AS alive FROM events GROUP BY user_id",
    "stream_windowed_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS accesses FROM events GROUP BY ALL",
}
