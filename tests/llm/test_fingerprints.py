import hashlib
import random
from collections import Counter

import numpy as np
import odd

from ashlar.llm import fingerprints as f
from ashlar.llm.common import LOWER, words
from ashlar.llm.queries import op7_fingerprints


def jaccard(a, b):
    x, y = (Counter(words(t.translate(LOWER))) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_collisions_estimate_generalised_jaccard():
    r = random.Random(4)
    s = f.Sampler(1024)
    for share in (0.2, 0.5, 0.8):
        a = [f"t{r.randrange(80)}" for _ in range(400)]
        b = a[: int(400 * share)] + [f"u{r.randrange(80)}" for _ in range(400 - int(400 * share))]
        a, b = " ".join(a), " ".join(b)
        assert abs(f.likeness(s(a), s(b)) - jaccard(a, b)) < 0.06


def test_weights_matter():
    s = f.Sampler(2048)
    for n in (2, 4, 10):
        assert abs(f.likeness(s("a"), s("a " * n)) - 1 / n) < 0.05  # one term: always the sample, at the same position or not
        assert abs(f.likeness(s("a b"), s("a " * n + "b")) - 2 / (n + 1)) < 0.05


def check(rows, got):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 2
        new = t[: len(t) - n] + after[:n]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == sorted(want, key=repr)


def test_query_over_its_table(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet")
    rows = op7_fingerprints(spark, sf).collect()
    texts = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    check(list(texts.items()), [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows])
    assert abs(np.mean([r["near_edited"] for r in rows]) - 0.37) < 0.1
    by = {}
    for r in rows:
        assert by.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_odd_rows(spark):
    rows = f.chain(odd.docs(spark)).collect()
    assert len(rows) == len(odd.texts())
    check(odd.texts(), [(r["doc_id"], r["n_chars"], hashlib.sha256(r["edited_text"].encode()).hexdigest()) for r in rows])
    assert f.chain(odd.none(spark)).count() == 0
    assert f.fingerprint(odd.docs(spark)).count() == len(odd.texts())


def test_far_apart_ids_and_one_document(spark):
    ids = [-5, 3, 3, 2047, 2048, 10**9, 10**15]
    rows = [(i, f"text of {i} " * 3) for i in ids]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(rows, [(r["doc_id"], r["n_chars"], hashlib.sha256(r["edited_text"].encode()).hexdigest()) for r in f.chain(d).collect()])
    one = f.chain(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert [(r["edited_text"], r["near_next"]) for r in one] == [("abab", 1.0)]
