import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from ashlar.llm import mixing
from ashlar.llm.common import words
from ashlar.llm.queries import op4_mixing


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again, sources in order."""
    total, w = sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while free:
        level = rest / sum(w[i] for i in free)
        over = {i for i in free if level * w[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = level * w[i]
            return out
        for i in over:
            out[i] = most * float(sizes[i])
            rest -= out[i]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1000, 5], [1, 2, 3, 4, 5, 6, 7], [0, 5, 0], [100, 1, 1, 100, 1, 1, 100]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint")).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(shared(sizes))


def test_order_is_by_code_point_and_null_last(spark):
    rows = [("b", 100), ("B", 100), (None, 100), ("é", 100)]
    got = {r["source"]: r["weight"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size bigint")).collect()}
    assert got == {"B": 5.0, "b": 2.0, "é": 1.0, None: 5.0}


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, 12345)
    assert sorted(p.tolist()) == list(range(n))
    if n == 1000:
        assert p.tolist() != mixing.permuted(np.arange(n), n, 12346).tolist()


def test_query_over_its_table(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet")
    docs = {i: (s, len(words(x or ""))) for i, s, x in zip(*(t[c].to_pylist() for c in ("doc_id", "source", "text")))}
    rows = op4_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    names = sorted({s for s, _ in docs.values()})
    size = {n: sum(k for s, k in docs.values() if s == n) for n in names}
    target = dict(zip(names, shared([size[n] for n in names])))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s, k = docs[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (k, size[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 3 * k
        taken[s] += r["taken"]
    assert all(abs(taken[n] / target[n] - 1) < 0.05 for n in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op4_mixing(spark, sf).collect()))


def test_odd_rows(spark):
    d = odd.docs(spark)
    rows, taken = mixing.mix(d)
    assert rows.count() == len(odd.texts())
    own = rows.join(taken.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")), "row")
    assert own.where("taken > 3 * size").count() == 0
    assert own.where("source IS NULL").count() > 0
    text = mixing.texts(d, rows, taken)
    assert text.columns == d.columns
    assert text.agg(F.sum(mixing.size(F.col("text")))).first()[0] == own.agg(F.sum("taken")).first()[0]
    rows, taken = mixing.mix(odd.none(spark))
    assert rows.count() == 0 and taken.count() == 0


def test_text_of_a_mix_is_cut_from_the_documents(spark):
    d = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(50)), f"s{i % 2}", 0) for i in range(20)], "doc_id bigint, text string, source string, n_chars bigint")
    rows, taken = mixing.mix(d, block=8, shard=5)
    texts = mixing.texts(d, rows, taken).collect()
    for r in texts:
        w = words(r["text"])
        assert all(x.startswith(f"d{r['doc_id']}w") for x in w) and len(set(w)) == len(w) and r["n_chars"] == len(r["text"])
    assert sum(len(words(r["text"])) for r in texts) == taken.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0]


def broadcast(df):
    """What a DataFrame that has run sent to all tasks: the part of its last plan below each broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    for i, line in enumerate(plan):
        if (at := line.find("BroadcastExchange")) >= 0:
            below = next((j for j in range(i + 1, len(plan)) if len(plan[j]) - len(plan[j].lstrip(" :+-*()0123456789")) <= at), len(plan))
            yield "\n".join(plan[i:below])


def test_slots_are_not_broadcast(spark):
    """One shard of thousands of slots: Spark takes them for as few as the draws they are made of."""
    d = spark.createDataFrame([(i, "w " * 400, f"s{i % 2}") for i in range(40)], "doc_id bigint, text string, source string")
    _, taken = mixing.mix(d, block=8)
    assert len(taken.collect()) > 1000
    assert not [x for x in broadcast(taken) if "MapInArrow" in x or "Generate" in x]


def test_groups_of_sources_joined_or_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 2)
    s = spark.createDataFrame([(i, 10 + i, 20 + i) for i in range(7)], "sid bigint, blocks bigint, slots bigint")
    few = sorted(map(tuple, mixing.drawn(s, 8, 1).collect()))
    monkeypatch.setattr(mixing, "LISTS", 1)
    assert sorted(map(tuple, mixing.drawn(s, 8, 1).collect())) == few
    assert {i: sum(r[3] for r in few if r[0] == i) for i in range(7)} == {i: 20 + i for i in range(7)}
