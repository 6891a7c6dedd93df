"""The registered queries of this subpackage: thin, each through its operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, fingerprints, jaccard, lm, mixing, neighbours, pii, quality, toxicity, warc
from .common import held_out, keep, new_path, read


def vocabulary() -> str:
    """The vocabulary file of the BPE query; any file of that format can be given to the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = keep(warc.write(read(spark, sf_dir, "pages"), folder), "warc-index")
    got = warc.read(index, folder)
    return got.select(
        F.col("key").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), "declared_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "declared_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP1_SQL = """
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN rev THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN rev THEN latest END AS refers_to
FROM (SELECT page_id, h, latest, octet_length(encode(h)) >= 1000 AND page_id < latest AS rev
      FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages))
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())
    return done.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = jaccard.join(read(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, taken = mixing.mix(read(spark, sf_dir, "documents"))
    words = taken.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return rows.join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    count = [F.size(F.array_remove(F.col("base.kind"), i)) for i in range(len(pii.KINDS))]
    count = [(F.size("base") - c).cast("bigint").alias(f"n_{k}") for k, c in zip(pii.KINDS, count)]
    return found.select("doc_id", *count, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP6_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.e, q.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprints.chain(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {"op1_warc": op1_warc, "op2_bpe": op2_bpe, "op3_jaccard": op3_jaccard, "op4_mixing": op4_mixing, "op5_pii": op5_pii, "op6_neighbours": op6_neighbours, "op7_fingerprints": op7_fingerprints, "op8_lm": op8_lm, "op9_quality": op9_quality, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_neighbours": OP6_SQL}
