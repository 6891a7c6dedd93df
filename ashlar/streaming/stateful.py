"""Structured Streaming forms of the stateful operators, and running one to the end of its input."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-ashlar-"))
        base = _own[0]
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str, final: bool = False, key: str | None = None) -> DataFrame:
    """Run a stream over what its source has now and read what it wrote: all rows, with
    ``final`` the last batch's (for results that each batch states anew), with ``key`` each
    key's from the last batch that has it (for updates).  Every batch has its own part, so one
    that is tried again replaces itself."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}/out"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    if final:
        last = got.agg(F.max("batch")).first()[0]
        got = got.where(F.col("batch") == F.lit(last))
    elif key:
        got = got.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("v")).select("v.*")
    return got.select(*stream.columns)


def first_of_key(stream: DataFrame, key: str, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before; with a time column, keys are kept for ``delay`` only."""
    if ts is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, width: str, delay: str, *key: str) -> DataFrame:
    """Accesses by key and window; windows are final once the watermark has passed them."""
    w = F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), *key).agg(F.count("*").alias("accesses")).select(F.col("w.start").alias("start"), *key, "accesses")


def access_counts(stream: DataFrame, *key: str) -> DataFrame:
    return stream.groupBy(*key).agg(F.count("*").alias("accesses"))


def rates(stream: DataFrame, key: str, tick: str, count: str, alpha: float, interval: float) -> DataFrame:
    """Each key's exponentially weighted rate after the ticks so far; ticks of a batch in order."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, ticks = state.get if state.exists else (None, 0)
        for c in pd.concat(list(parts)).sort_values(tick)[count]:
            now = c / interval
            rate = now if rate is None else rate + alpha * (now - rate)
            ticks += 1
        state.update((rate, ticks))
        yield pd.DataFrame({key: [k[0]], "rate": [rate], "ticks": [ticks]})

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, rate double, ticks bigint", "rate double, ticks bigint", "update", GroupStateTimeout.NoTimeout)


def liveness(stream: DataFrame, session: str) -> DataFrame:
    """session, last_seen, messages, alive after each batch, from rows (session, ts, event_id, bye):
    alive until a goodbye is the latest message."""
    kind = dict(stream.dtypes)[session]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, event, bye, n = state.get if state.exists else (None, None, False, 0)
        for p in parts:
            n += len(p)
            top = p.sort_values(["ts", "event_id"]).iloc[-1]
            at = (int(top["ts"].value) // 1000, int(top["event_id"]))
            if last is None or at > (last, event):
                last, event, bye = at[0], at[1], bool(top["bye"])
        state.update((last, event, bye, n))
        yield pd.DataFrame({session: [k[0]], "last_seen": [last], "messages": [n], "alive": [not bye]})

    return stream.groupBy(session).applyInPandasWithState(step, f"`{session}` {kind}, last_seen bigint, messages bigint, alive boolean", "last bigint, event bigint, bye boolean, n bigint", "update", GroupStateTimeout.NoTimeout)


def append_new(spark: SparkSession, folder: str):
    """A foreachBatch writer for content-addressed rows (hash, ...): appends those not in ``folder``
    yet, each batch to its own part, so a batch that is tried again replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        new = batch.dropDuplicates(["hash"])
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            stored = batch.sparkSession.read.parquet(folder)
            new = new.join(stored.where(F.col("batch") != n).select("hash"), "hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return write
