from pyspark.sql import functions as F

from ashlar.operators import logs
from ashlar.streaming import stateful


def stream(spark, tmp_path, df, files=3):
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_rates_over_batches_equal_the_fold(spark, tmp_path):
    d = spark.createDataFrame([(k, t, float((k * 7 + t * 3) % 11)) for k in range(3) for t in range(20)], "k int, t int, c double")
    d.where("t < 10").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    q = stateful.rates(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in/a")), "k", "t", "c", 0.5, 1.0)
    got = {r["k"]: r["rate"] for r in stateful.finished(q, "update", final=True).collect()}
    want = {r["k"]: r["rate"] for r in logs.fold_rate(d.where("t < 10"), "k", "t", "c", 0.5, 1.0).collect()}
    assert got == want


def test_first_of_key_over_batches(spark, tmp_path):
    d = spark.range(100).select((F.col("id") % 10).alias("hash"))
    assert stateful.finished(stateful.first_of_key(stream(spark, tmp_path, d), "hash"), "append").count() == 10


def test_append_new_over_batches(spark, tmp_path):
    d = spark.range(100).select((F.col("id") % 10).cast("string").alias("hash"))
    out = f"file://{tmp_path}/store"
    q = stream(spark, tmp_path, d).writeStream.foreachBatch(stateful.append_new(spark, out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_liveness_over_batches(spark, tmp_path):
    d = spark.sql("SELECT id % 5 AS s, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts, id AS event_id, id >= 48 AS bye FROM range(50)")
    got = stateful.finished(stateful.liveness(stream(spark, tmp_path, d), "s"), "update")
    last = {}
    for r in got.collect():
        if r["s"] not in last or r["messages"] > last[r["s"]]["messages"]:
            last[r["s"]] = r
    assert {s: r["alive"] for s, r in last.items()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_updates_keep_each_keys_last_batch(spark, tmp_path):
    for n in (1, 2):
        spark.createDataFrame([(n, 10 * n, n, False)], "s bigint, t bigint, event_id bigint, bye boolean").selectExpr("s", "timestamp_seconds(t) AS ts", "event_id", "bye").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = spark.readStream.schema("s bigint, ts timestamp, event_id bigint, bye boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.finished(stateful.liveness(e, "s"), "update", key="s").collect()
    assert sorted((r["s"], r["messages"], r["alive"]) for r in got) == [(1, 1, True), (2, 1, True)]
