"""The corpus pipeline: documents in, token ids out.

Toxic documents go; of near duplicates one document of each group stays; personal data is
replaced; sources are mixed to their weights; what is left is encoded.  Each stage takes
what the one before it kept, as a table, and all but the last return the columns of
documents.  The rules for odd rows are those of the stages' operators: null texts are
empty, repeated rows count each until near duplicates are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ashlar.llm import bpe, jaccard, mixing, pii, toxicity
from ashlar.llm.common import bounded, forget, fresh, keep, read, written
from ashlar.llm.queries import vocabulary

_left: list[str] = []


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, dropping first the working tables of the stage before it, whose result is written by now."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _left)
        before = set(written())
        out = stage(spark, docs, sf_dir)
        _left[:] = [p for p in written() if p not in before]
        return out

    return run


@_tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@_tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all documents
    without words.  Rows that repeat an id and a text count once."""
    rows, _ = jaccard.join(docs)
    rows = keep(rows, "near-duplicates")
    by_id = keep(rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.coalesce((F.col("doc_id") == F.col("component_id")) | F.col("key").isNull(), F.lit(True))).alias("stays")), "ids")
    gone = keep(by_id.where("NOT stays").select("doc_id"), "gone")
    many = keep(by_id.where("stays AND rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "many")
    small = lambda ids: F.broadcast(ids) if bounded(ids, jaccard.FILTER) else ids
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if many.isEmpty():
        return left
    once = left.join(small(many), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(small(many), "doc_id", "left_anti").unionByName(once).select(*docs.columns)


@_tidy
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    base, spans = fresh(docs.columns, "base"), fresh(docs.columns, "spans")
    found = pii.find(docs, pii.fit(docs), base=base, spans=spans)
    text = pii.redacted(F.coalesce(F.col("text"), F.lit("")), F.col(spans))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


@_tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document, a row for each time it is taken."""
    return mixing.texts(docs, *mixing.mix(docs))


@_tidy
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text."""
    done = bpe.round_trip(docs, vocabulary())
    return done.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Trained models and pseudorandom blocks cannot be put in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
