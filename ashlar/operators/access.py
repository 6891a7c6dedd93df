"""Access logs: counts, rates and liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def counts(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("accesses"))


def counters(df: DataFrame, op: str, size: str) -> DataFrame:
    """Number and bytes of accesses by operation."""
    return df.groupBy(op).agg(F.count("*").alias("accesses"), F.sum(size).alias("bytes"))


def rates(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Requests a second between a key's first and last; null if those are one moment."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))).alias("us"))
    return g.select(key, "n", (F.col("n") / F.nullif(F.col("us") / 1e6, F.lit(0.0))).alias("per_second"))


def liveness(df: DataFrame, session: str, order: list[str], bye: str) -> DataFrame:
    """Sessions whose last message is not a goodbye (boolean column), with their message count and addresses seen."""
    g = df.groupBy(session).agg(F.max_by(F.struct(bye, "ts"), F.struct(*order)).alias("last"), F.count("*").alias("messages"), F.countDistinct("address").alias("addresses"))
    return g.where(~F.col(f"last.{bye}")).select(session, F.col("last.ts").alias("last_seen"), "messages", "addresses")
