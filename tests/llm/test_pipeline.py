import corpus_pipeline as p
import odd
from pyspark.sql import functions as F
from test_mixing import broadcast

from ashlar.llm import jaccard, mixing, pii
from ashlar.llm.common import keep, read


def test_stages_in_turn(spark, sf):
    docs = read(spark, sf, "documents")
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(keep(stage(spark, seen[-1], sf), f"test-{name}"))
    start, polite, single, clean, mixed, ids = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    assert 0.8 * start.count() < polite.count() < start.count()
    rows = jaccard.join(polite)[0]
    want = {r[0] for r in rows.where("doc_id = component_id").select("doc_id").collect()}
    assert {r[0] for r in single.select("doc_id").collect()} == want and single.count() == len(want)
    assert jaccard.join(single)[0].where("doc_id <> component_id").count() == 0
    left = pii.find(clean, pii.Model())
    assert clean.count() == single.count() and left.where(F.size("base") > 0).count() == 0
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    total = clean.agg(F.sum(mixing.size(F.col("text")))).first()[0]
    assert abs(mixed.agg(F.sum(mixing.size(F.col("text")))).first()[0] / total - 1) < 0.02
    assert ids.count() == mixed.count() and ids.where("n_tokens * 4 <> octet_length(ids)").count() == 0
    text = mixed.select(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    assert ids.select(F.col("decoded_sha256").alias("h")).exceptAll(text).count() == 0


def test_run_agrees_with_itself(spark, sf):
    a, b = (sorted((r["doc_id"], r["decoded_sha256"]) for r in p.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark, sf):
    start = odd.docs(spark)
    extra = [c for c in start.columns if c not in ("text", "n_chars")]
    have = {tuple(r) for r in start.select(*extra).collect()}
    for docs, some in ((start, True), (odd.none(spark), False)):
        for name, stage in p.STAGES[:-1]:
            docs = keep(stage(spark, docs, sf), f"test-{name}")
            assert docs.dtypes == start.dtypes, name
            assert {tuple(r) for r in docs.select(*extra).collect()} <= have, name
        ids = p.STAGES[-1][1](spark, docs, sf)
        assert ids.count() == docs.count() and (docs.count() > 0) == some


def test_mixing_broadcasts_neither_texts_nor_slots(spark, sf):
    """Texts of a few KB as Parquet are many MB in a broadcast."""
    d = spark.createDataFrame([(i, f"w{i} " * 4000, f"s{i % 2}", 0) for i in range(40)], "doc_id bigint, text string, source string, n_chars bigint")
    mixed = p.mix_sources(spark, keep(d, "test-repeats"), sf)
    assert mixed.collect()
    assert not [x for x in broadcast(mixed) if "text#" in x or "MapInArrow" in x or "Generate" in x or "collect_list" in x]
