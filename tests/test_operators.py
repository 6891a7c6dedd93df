import pytest
from pyspark.sql import functions as F

from ashlar.functions.addr import addr
from ashlar.operators import cas, closure, logs, manifest


def test_insert_new_twice_adds_nothing(spark):
    d = spark.createDataFrame([(f"{i} ".ljust(5 + i * 7 % 50),) for i in range(1000)] * 2, "p string")
    c = cas.chunks(d, "p")
    new = cas.insert_new(c, c.limit(0))
    assert new.count() == 1000 and cas.insert_new(c, new).count() == 0
    got = cas.lookup(c.select("hash"), new)
    assert got.where(addr(F.col("payload")) != F.col("hash")).count() == 0 and got.count() == 2000


def test_first_map_decides_even_when_its_chunk_is_missing(spark):
    m = lambda h: spark.createDataFrame([("a", h)], "id string, hash string")
    stored = spark.createDataFrame([("h2", 5)], "hash string, size int")
    r = logs.resolve(spark.createDataFrame([("a",), ("b",)], "id string"), [m("h1"), m("h2")], stored).orderBy("id").collect()
    assert (r[0]["hash"], r[0]["map"], r[0]["size"]) == ("h1", 0, None) and r[1]["hash"] is None


def test_first_and_last_writers_differ(spark):
    d = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, None)], "k string, n int, v string")
    assert logs.first_writer(d, ["k"], ["n"], ["v"]).first()["v"] == "a"
    assert logs.last_writer(d, ["k"], ["n"], ["v"]).first()["v"] is None


def test_rate_converges(spark):
    alpha = 1 - 2.718281828459045 ** (-5 / 60)
    d = spark.createDataFrame([(1, t, 25 if t == 0 else 50) for t in range(61)], "k int, t int, c int")
    r = logs.fold_rate(d, "k", "t", "c", alpha, 5.0).first()
    want = 5.0
    for _ in range(60):
        want += alpha * (10 - want)
    assert r["rate"] == want and 5 < want < 10


@pytest.mark.parametrize("query,name,want", [("a=1&b=2&A=3", "a", "1"), ("x&a=1", "x", None), ("a=b=c", "A", "b=c"), ("a=%20", "a", "%20"), ("", "a", None), ("a=", "a", "")])
def test_query_values(spark, query, name, want):
    assert spark.range(1).select(logs.query_value(F.lit(query), name)).first()[0] == want


def test_routes_take_the_first_full_match(spark):
    routes = [("one", logs.route_pattern("/a/{n}", {"n": "[0-9]+"})), ("two", logs.route_pattern("/a/{any}", {}))]
    rows = spark.createDataFrame([("/a/12",), ("/a/x/y",), ("/a/",), ("q/a/1",)], "u string").select(logs.routed(F.col("u"), routes)).collect()
    assert [r[0] for r in rows] == ["one", "two", None, None]


@pytest.mark.parametrize("pattern,want", [("*.TXT", True), ("a?c.txt", True), ("abc", False), ("", True), ("%", False), ("a*", True)])
def test_wildcards(spark, pattern, want):
    assert spark.range(1).select(manifest.like(F.lit("abc.txt"), pattern)).first()[0] is want


def test_listing_goes_on_after_a_name(spark):
    d = spark.createDataFrame([("r", n) for n in ("b", "A", "c")], "parent string, name string")
    assert [r["name"] for r in manifest.listing(d).orderBy("place").collect()] == ["A", "b", "c"]
    assert [r["name"] for r in manifest.listing(d, after="B").collect()] == ["c"]


def test_closure_of_a_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert closure.closure(spark.createDataFrame([("a",)], "root string"), e).count() == 3


def test_quarantine(spark):
    ops = spark.createDataFrame([("k", [("1", "p")]), ("k", [("1", None)]), (None, []), ("k", None)], "key string, files array<struct<id:string,path:string>>")
    good, bad = logs.valid_ops(ops)
    assert good.count() == 2 and bad.count() == 2


def test_empty_store(spark):
    r = cas.stats(spark.createDataFrame([], "hash string, size bigint")).first()
    assert r["total_chunks"] == 0 and r["mean_bytes"] is None
