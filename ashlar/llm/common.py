"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word of the contracts: a run of characters other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
_words = re.compile(WORD)
_root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[str] = []
_own_scratch: list[str] = []


def words(text: str) -> list[str]:
    """The words of a text, as the contracts define them."""
    return _words.findall(text)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LOWER = {i: i + 32 for i in range(65, 91)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the session's own path lacks it, and
    hand them Arrow batches of at most 8 MB unless the session was set up otherwise: the
    JVM and the worker of every task hold one each, whatever the length of the texts."""
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(8 << 20))
    env = spark.sparkContext.environment
    # workers live through many stages: let them give freed blocks back to the system
    for name, value in (("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", str(1 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(4 << 20)), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    if _root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), _root) if x)
    return spark


_caches: dict[str, Callable[[], None]] = {}


def cached(module: str, clear: Callable[[], None]) -> None:
    """Name what frees the tables that a module keeps in a worker process between tasks."""
    _caches[module] = clear


def turn(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run as a worker's turn: tables that other modules have kept in the process go first,
    and what the turn has freed goes back to the system at its end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, clear in _caches.items():
            if module != run.__module__:
                clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where all
    is one machine (tests), a temporary one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        if not _own_scratch:
            _own_scratch.append("file://" + tempfile.mkdtemp(prefix="spark-ashlar-"))
        base = _own_scratch[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/ashlar/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later jobs neither
    recompute it nor depend on an executor that may be lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that keep() and new_path() made.  Call it only once their results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _written:
            _written.remove(p)


def written() -> list[str]:
    """The paths made so far and not forgotten."""
    return list(_written)


def fresh(columns: list[str], name: str) -> str:
    """name, or that with underscores before it, such that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of a range that before() sums up in one task.
RANGE = 200_000


def before(df: DataFrame, order: list[Column], sums: dict[str, str | Column], by: str | None = None) -> DataFrame:
    """df with a column for each of ``sums``: the sum over all rows before it in that order
    (of its group ``by``, null being one).  The order must tell rows apart; it is cut into
    ranges, and sums run within a range and over the ranges' totals, so no task holds a group."""
    names = {c: fresh(df.columns, c) for c in ("range", "_by", "_range")}
    here = names["range"]
    parts = max(1, -(-df.count() // RANGE))
    group = [F.col(by)] if by else []
    d = keep(df.repartitionByRange(parts, *(c.asc_nulls_first() for c in group), *order).withColumn(here, F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(here, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(*(group or [F.lit(0)])).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    zero = F.lit(0)
    total = d.groupBy(here, *group).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    total = total.select(F.col(here).alias(names["_range"]), *(c.alias(names["_by"]) for c in group), *(F.coalesce(F.sum(n).over(first), zero).alias(f"_{n}") for n in sums))
    d = d.withColumns({n: F.coalesce(F.sum(c).over(inner), zero) for n, c in sums.items()})
    same = F.col(here) == F.col(names["_range"])
    if by:
        same = same & F.col(by).eqNullSafe(F.col(names["_by"]))
    d = d.join(total, same).withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums})
    return d.drop(here, names["_range"], names["_by"], *(f"_{n}" for n in sums))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df, a kept table, has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def held_out(c: Column, folds: int) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves no remainder (a null id is kept too)."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(True))


#: Characters that a line or sentence of a sample's text counts as.
PART = 100


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int, folds: int = 5, most: int = 8 << 20, parts: str = "") -> tuple[list[tuple[str, int]], dict[int, float]]:
    """(whole text, label) of at most ``each`` learning rows of either label, the first by a hash
    of id and text, and for each label the learning rows that a row of the sample stands for.
    Fewer rows are taken where their texts pass ``most`` characters a label (one row at least),
    each of the characters ``parts`` that a text has counting as PART; so the sample is
    safe to hold in the driver.  An id labelled twice counts once, as 1 if any label is 1; a
    row repeated with its text counts once."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.xxhash64("doc_id", "text")
    size = F.length("text").cast("bigint")
    if parts:
        size = size + PART * (F.length("text") - F.length(F.translate("text", parts, "")))
    learning = keep(docs.select("doc_id", mark.alias("mark"), size.alias("size")).join(known, "doc_id").distinct(), "learning")
    total = {r["y"]: r["count"] for r in learning.groupBy("y").count().collect()}
    first = [learning.where(F.col("y") == y).orderBy("mark", "doc_id").limit(each) for y in (1, 0)]
    up_to = F.sum("size").over(Window.partitionBy("y").orderBy("mark", "doc_id"))  # of 2 * each rows
    chosen = keep(first[0].union(first[1]).withColumn("up_to", up_to).where((F.col("up_to") <= most) | (F.col("up_to") == F.col("size"))).select("doc_id", "mark", "y"), "sample")
    rows = docs.join(F.broadcast(chosen), "doc_id").where(mark == F.col("mark")).select("doc_id", "text", "y")
    sample = [(r["text"], r["y"]) for r in rows.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").collect()]
    taken = Counter(y for _, y in sample)
    return sample, {y: total[y] / n for y, n in taken.items()}


def shares(y, stands_for: dict[int, float] | None):
    """A weight for each row of a sample with labels y, by what a row of its label stands for; 1 in the mean."""
    import numpy as np

    v = np.array([(stands_for or {}).get(int(b), 1.0) for b in y])
    return v / v.mean()


def slices(batch, column: int, most: int, rows: int = 1 << 30):
    """A record batch in slices of about ``most`` bytes of a string or binary column (one row at least)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = max(at + 1, min(to, at + rows))
        yield batch.slice(at, to - at)
        at = to


def logistic(x, y, rounds: int = 50, ridge: float = 1e-3, weight=None):
    """Weights (bias last) of a ridge logistic regression, by Newton's steps; small bounded inputs only."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    v = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (v * (p - y)) + ridge * w
        h = (x * (v * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
