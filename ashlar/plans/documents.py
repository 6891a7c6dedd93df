"""Queries on binary documents made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..documents import frames
from ..functions import crc
from .tables import table


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("event_id", "user_id", "event_type", "value", F.split("event_type", "").alias("letters"), F.struct(F.sha1(F.col("props").cast("binary")).alias("$binary_attachment")).alias("props"))
    return table(spark, sf, "events").select("event_id", frames.from_json(F.to_json(row)).alias("document"))


def _get(c: str, path: str, kind: str) -> Column:
    return F.try_variant_get(c, path, kind)


def document_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows encoded, validated, decoded to VARIANT and read back by path."""
    d = _encoded(spark, sf).withColumns({"v": frames.to_variant(F.col("document")), "errors": frames.validate("document")})
    return d.select("event_id", _get("v", "$.user_id", "bigint").alias("user_id"), _get("v", "$.event_type", "string").alias("event_type"), _get("v", "$.value", "double").alias("value"), _get("v", "$.letters[0]", "string").alias("first"), "errors")


def document_attachments(spark: SparkSession, sf: str) -> DataFrame:
    d = _encoded(spark, sf).select("event_id", F.explode(frames.attachments("document")).alias("a"))
    return d.select("event_id", F.col("a.kind").alias("kind"), F.col("a.hash").alias("hash"))


def document_measure(spark: SparkSession, sf: str) -> DataFrame:
    d = _encoded(spark, sf)
    return d.select("event_id", (frames.measure("document") == F.octet_length("document")).alias("whole"), frames.measure(F.expr("substring(document, 1, octet_length(document) - 1)")).isNull().alias("cut"))


def blake3_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", crc.blake3_addr(F.col("html")).alias("addr"), crc.name_shard("url").alias("shard"), crc.payload_crc(F.col("html")).alias("crc32"))


QUERIES = {f.__name__: f for f in (document_round_trip, document_attachments, document_measure, blake3_addresses)}
SQL = {
    "document_round_trip": "SELECT event_id, user_id, event_type, value, event_type[1] AS first, CAST(0 AS BIGINT) AS errors FROM events",
    "document_attachments": "SELECT event_id, 'binary_attachment' AS kind, sha1(props) AS hash FROM events",
    "document_measure": "SELECT event_id, true AS whole, true AS cut FROM events",
}
