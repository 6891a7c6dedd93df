"""A content-addressed store as a table (hash, size, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.addr import addr, data

TINY, HUGE = 1024, 1 << 20


def chunks(df: DataFrame, payload: str) -> DataFrame:
    """hash, size, payload of each row."""
    p = data(F.col(payload))
    return df.select(addr(F.col(payload)).alias("hash"), F.octet_length(p).cast("bigint").alias("size"), p.alias("payload"))


def tier(size: Column) -> Column:
    return F.when(size < TINY, "tiny").when(size >= HUGE, "huge").otherwise("small")


def insert_new(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of incoming (hash, ...) to append: absent from stored, one a hash."""
    return incoming.join(stored.select("hash").distinct(), "hash", "left_anti").dropDuplicates(["hash"])


def lookup(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (pos, hash) that hit, with the stored columns; misses are left out, repeats stay."""
    return requests.join(stored, "hash")


def batch_lookup(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches of requests (batch, pos, hash): the hits with the stored columns, ``nth`` (their
    place among the batch's hits in request order, equal places by hash, from 1) and ``hits`` (how many those are).
    Repeats stay, misses and null hashes are left out, a batch without hits has no row; of
    stored rows that repeat a hash one counts.  A batch is one request and as small."""
    got = requests.join(stored.dropDuplicates(["hash"]), "hash")
    w = Window.partitionBy("batch")
    return got.withColumns({"nth": F.row_number().over(w.orderBy("pos", "hash")).cast("bigint"), "hits": F.count("*").over(w)})


def need_paths(needs: DataFrame, local: DataFrame) -> DataFrame:
    """Needed hashes (hash, ...) with the local path that has them and ``known``; of files (hash,
    path, ord) with one hash the last counts.  Unknown hashes have a null path."""
    last = local.groupBy("hash").agg(F.max_by("path", "ord").alias("path"))
    return needs.join(last, "hash", "left").withColumn("known", F.col("path").isNotNull())


def need(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests whose hash is not stored; repeats stay."""
    return requests.join(stored, "hash", "left_anti")


def materialise(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Per job (job, hash): how many chunks, how many missing, and whether it can run (none missing)."""
    have = stored.select("hash").distinct().withColumn("have", F.lit(1))
    j = jobs.groupBy("job", "hash").agg(F.count("*").alias("n")).join(have, "hash", "left")
    j = j.groupBy("job").agg(F.sum("n").alias("chunks"), F.sum(F.when(F.col("have").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    return j.withColumn("ready", F.col("missing") == 0)


def verified(df: DataFrame, payload: str, claimed: str) -> DataFrame:
    """Rows whose payload has the claimed address."""
    return df.where(addr(F.col(payload)) == F.col(claimed))


def scrub(df: DataFrame, payload: str, claimed: str) -> DataFrame:
    """Rows whose payload has another address than claimed."""
    return df.where(~addr(F.col(payload)).eqNullSafe(F.col(claimed)))


def unreferenced(stored: DataFrame, refs: DataFrame, key: str = "hash") -> DataFrame:
    """Stored rows that nothing refers to."""
    return stored.join(refs.select(key).distinct(), key, "left_anti")


def stats(df: DataFrame) -> DataFrame:
    """Totals over chunks (hash, size): all, unique and duplicate; two-level aggregation, so a
    hash that a third of all rows share is combined before it is shuffled."""
    each = df.groupBy("hash").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("total_bytes"),
        F.count("*").alias("unique_chunks"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("duplicate_bytes"),
        F.expr("try_divide(sum(n * size), sum(n))").cast("bigint").alias("mean_bytes"),
    )


def store_stats(df: DataFrame, stored: DataFrame) -> DataFrame:
    """The nine sums over chunks (hash, size, compressed) against a store (hash): all, unique and
    duplicate, and what the store does not have yet.  Equal hashes are combined before they are
    shuffled; an empty table gives zeros."""
    each = df.groupBy("hash").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("compressed").alias("packed"))
    new = each.join(stored.select("hash").distinct().withColumn("have", F.lit(True)), "hash", "left").withColumn("new", F.col("have").isNull())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    n, size, packed = F.col("n"), F.col("size"), F.col("packed")
    return new.agg(
        total(n * size).alias("total_bytes"), total(n).alias("total_chunks"), total(n * packed).alias("total_compressed"),
        total(size).alias("unique_bytes"), F.count("*").alias("unique_chunks"), total(packed).alias("unique_compressed"),
        total((n - 1) * size).alias("duplicate_bytes"), total(F.col("new").cast("bigint")).alias("new_chunks"), total(F.when(F.col("new"), size)).alias("new_bytes"),
    )


def first_seen(df: DataFrame, *order: str) -> DataFrame:
    """is_new: whether a row is the first of its hash by the order, which tells rows apart."""
    least = df.groupBy("hash").agg(F.min(F.struct(*order)).alias("_first"))  # combined before the shuffle
    return df.join(least, "hash").withColumn("is_new", F.struct(*order) == F.col("_first")).drop("_first")


def cursors(df: DataFrame, aligns: list[int]) -> DataFrame:
    """align, next_offset: the cursor() of records (offset, size) for each alignment."""
    end = F.coalesce(F.max(F.col("offset") + F.col("size")), F.lit(0))
    return df.agg(end.alias("e")).select("e", F.explode(F.array(*map(F.lit, aligns))).alias("align")).select("align", F.expr("(e + align - 1) div align * align").alias("next_offset"))


def cursor(df: DataFrame, align: int) -> DataFrame:
    """Next write position after records (offset, size), rounded up."""
    return df.agg(F.coalesce(F.max(F.expr(f"(offset + size + {align - 1}) div {align} * {align}")), F.lit(0)).alias("next_offset"))
