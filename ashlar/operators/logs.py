"""Append-only logs: sequence numbers, offsets, first and last writers, replay, resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.addr import checksum32
from ..functions.numbers import round_up


def sequenced(df: DataFrame, log: str, order: list[str], size: str, align: int = 32) -> DataFrame:
    """Adds lsn (from 1) and offset (running aligned size) within each log."""
    w = Window.partitionBy(log).orderBy(*order)
    before = F.sum(round_up(F.col(size), align)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumns({"lsn": F.row_number().over(w).cast("bigint"), "offset": F.coalesce(before, F.lit(0).cast("bigint"))})


def high_water(df: DataFrame, log: str, align: int = 32) -> DataFrame:
    """Per log: the last lsn and the next offset."""
    return df.groupBy(log).agg(F.max("lsn").alias("max_lsn"), F.max(round_up(F.col("offset") + F.col("size"), align)).alias("next_offset"))


def last_writer(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row in order (replay of a log into an index)."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in values))


def first_writer(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's first row in order (maps that are never overwritten)."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in values))


def replay(df: DataFrame, payload: str, checksum: str) -> DataFrame:
    """Records whose checksum fits; others are passed over."""
    return df.where(checksum32(F.col(payload)) == F.col(checksum))


def whole_records(df: DataFrame, length: str, record: int, header: int = 0) -> DataFrame:
    """Adds records and torn: how many whole fixed-size records bytes hold after a header, and
    what is left over.  Cache logs have no header; what is shorter than one holds nothing."""
    n = F.greatest(F.col(length) - header, F.lit(0))
    return df.withColumns({"records": F.floor(n / record).cast("bigint"), "torn": n % record})


def file_view(ops: DataFrame) -> DataFrame:
    """op, id, client_path, server_path: a row for each file of operations (op, files, serverfiles:
    arrays of (id, path)), server files matched by id; either path may be null."""
    one = lambda c, name: ops.select("op", F.explode(c).alias("f")).select("op", F.col("f.id").alias("id"), F.col("f.path").alias(name))
    a, b = one("files", "client_path"), one("serverfiles", "server_path")
    return a.groupBy("op", "id").agg(F.min("client_path").alias("client_path")).join(b.groupBy("op", "id").agg(F.min("server_path").alias("server_path")), ["op", "id"], "full")


def count_mismatch(ops: DataFrame) -> DataFrame:
    """Operations (op, files, serverfiles) whose numbers of files differ; a null list has none."""
    n = [F.coalesce(F.size(c), F.lit(0)) for c in ("files", "serverfiles")]
    n = [F.greatest(x, F.lit(0)).cast("bigint").alias(c) for x, c in zip(n, ("client_files", "server_files"))]
    return ops.select("op", *n).where("client_files <> server_files")


def valid_ops(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) operations: a key is there, and every file and server file has a path."""
    ok = F.col("key").isNotNull()
    for name in ("files", "serverfiles"):
        if name in df.columns:
            ok = ok & F.coalesce(F.forall(name, lambda f: f["path"].isNotNull()), F.lit(True))
    return df.where(ok), df.where(~ok)


def resolve(requests: DataFrame, maps: list[DataFrame], stored: DataFrame) -> DataFrame:
    """Requests (id) through maps (id, hash) in order: the first map that has the id decides,
    even if its hash is not stored; then the stored columns, null where absent."""
    every = None
    for rank, m in enumerate(maps):
        one = m.select("id", F.lit(rank).alias("rank"), "hash")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.min_by("hash", "rank").alias("hash"), F.min("rank").alias("map"))
    return requests.join(best, "id", "left").join(stored, "hash", "left")


def tiered(requests: DataFrame, tiers: list[tuple[str, DataFrame]], key: list[str], value: str) -> DataFrame:
    """Requests through tiers in order: the first tier that has the key gives value and tier name."""
    out, got, name = requests, [], []
    for label, t in tiers:
        out = out.join(t.select(*key, F.col(value).alias(f"_{label}"), F.lit(True).alias(f"_has_{label}")), key, "left")
        got.append(F.when(F.col(f"_has_{label}"), F.col(f"_{label}")))
        name.append(F.when(F.col(f"_has_{label}"), F.lit(label)))
    return out.select(*requests.columns, F.coalesce(*got).alias(value), F.coalesce(*name).alias("tier"))


#: Largest value that the memory tier takes.
ADMITTED = 16384


def promoted(memory: DataFrame, reads: DataFrame, key: str, value: str) -> DataFrame:
    """The memory tier (key, value) after reads (key, value) that came from lower tiers: values of
    at most ADMITTED bytes are put in, in place of what their key had; null values are misses.
    Reads of one key agree; of others the largest value counts."""
    fit = reads.where(F.octet_length(value) <= ADMITTED).groupBy(key).agg(F.max(value).alias(value))
    return memory.select(key, value).join(fit.select(key), key, "left_anti").unionByName(fit)


def fold_rate(df: DataFrame, key: str, tick: str, count: str, alpha: float, interval: float) -> DataFrame:
    """Exponentially weighted rate after each key's ticks in order: the first tick sets it."""
    e = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(tick).alias("t"), F.col(count).cast("double").alias("c")))),
        F.lit(None).cast("double"),
        lambda r, x: F.when(r.isNull(), x["c"] / interval).otherwise(r + alpha * (x["c"] / interval - r)),
    )
    return df.groupBy(key).agg(e.alias("rate"), F.count("*").alias("ticks"))


def routed(uri: Column, routes: list[tuple[str, str]]) -> Column:
    """Name of the first route whose pattern matches the whole URI."""
    out = None
    for name, pattern in routes:
        test = uri.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def route_pattern(template: str, patterns: dict[str, str]) -> str:
    """A template's ``{name}`` parts as their patterns; unknown names match anything, shortest first."""
    out, at = "", 0
    while (i := template.find("{", at)) >= 0:
        j = template.index("}", i)
        out += template[at:i] + "(" + patterns.get(template[i + 1 : j], ".+?") + ")"
        at = j + 1
    return out + template[at:]


def routed_with(uri: Column, verb: Column, routes: list[tuple[str, str, set[str]]]) -> tuple[Column, Column]:
    """(name, captures) of the first route (name, pattern, verbs) whose pattern matches the whole
    URI and that takes the verb; captures are the pattern's groups in order."""
    name, captures = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for label, pattern, verbs in reversed(routes):
        ok = uri.rlike(f"^(?:{pattern})$") & verb.isin(*verbs)
        groups = re.compile(pattern).groups
        name = F.when(ok, label).otherwise(name)
        captures = F.when(ok, F.array(*(F.regexp_extract(uri, f"^(?:{pattern})$", i + 1) for i in range(groups))).cast("array<string>")).otherwise(captures)
    return name, captures


def query_value(query: Column, name: str) -> Column:
    """A parameter's value: parts between ``&``, cut at the first ``=``; parts without one do
    not count; names in any case, the first wins; nothing is unescaped."""
    parts = F.filter(F.split(query, "&"), lambda p: p.contains("=") & (F.lower(F.substring_index(p, "=", 1)) == name.lower()))
    first = F.get(parts, F.lit(0))
    return F.substring(first, F.length(F.substring_index(first, "=", 1)) + 2, F.length(first))


def cache_key(uri: Column) -> tuple[Column, Column]:
    """(bucket, hash) of ``bucket/hash``, cut at the last slash; null unless 40 digits follow it."""
    shape = "^(.*)/([0-9A-Fa-f]{40})$"
    ok = uri.rlike(shape)
    return F.when(ok, F.regexp_extract(uri, shape, 1)), F.when(ok, F.lower(F.regexp_extract(uri, shape, 2)))
