import random

import odd
import pytest

from ashlar.llm import jaccard
from ashlar.llm.common import LOWER, words
from ashlar.llm.queries import op3_jaccard


def shingled(text):
    w = words((text or "").translate(LOWER))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(n_shingles, component) of (id, text) rows by comparing all of them."""
    s = [shingled(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                    up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        ids = [x for x in (least.get(top(i)), k) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return sorted(((k, len(s[i]), least[top(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def found(spark, rows, **how):
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(d, **how)[0].collect()), key=repr)


def corpus(seed, n=160):
    """Families of edited copies around shared passages, of many sizes."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    while len(rows) < n:
        doc = [r.choice(vocab) for _ in range(r.choice([3, 8, 30, 120, 400]))]
        if r.random() < 0.5:
            at = r.randrange(len(doc))
            doc[at:at] = passage
        for _ in range(r.choice([1, 1, 2, 3, 12, 30])):
            copy = list(doc)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6]) * len(copy) // 100 + r.choice([0, 0, 1])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"frequent_over": 3, "longest": 4}), (3, {"frequent_over": 8, "longest": 6}), (4, {"frequent_over": 3, "longest": 2, "block": 7}), (5, {"frequent_over": 1, "longest": 1, "block": 20})])
def test_equals_comparing_all(spark, seed, how):
    rows = corpus(seed)
    assert found(spark, rows, **how) == brute(rows)


def test_similarity_at_the_limit(spark):
    # 4 of 5 shingles shared: union 5, intersection 4
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c d e f g"), (4, "A B C D E F G H")]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = odd.texts()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(odd.docs(spark))[0].collect()), key=repr)
    assert got == brute(rows)
    assert jaccard.join(odd.none(spark))[0].count() == 0


def test_query_over_its_table(spark, sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet")
    got = sorted(map(tuple, op3_jaccard(spark, sf).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))


def similar(s, t):
    both = len(s & t)
    return bool(s and t) and 100 * both >= 80 * (len(s) + len(t) - both)


@pytest.mark.parametrize("how", [{}, {"frequent_over": 3, "longest": 4}, {"frequent_over": 3, "longest": 2, "block": 7}])
def test_every_link_is_counted_and_listed(spark, how):
    rows = corpus(6, 120)
    rows += [(i + 1000, t) for i, t in rows[:20]] + [(None, t + " tail") for _, t in rows[20:30]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    documents, links = jaccard.join(d, every_link=True, **how)
    few = jaccard.join(d, **how)[0]
    s = [shingled(t) for _, t in rows]
    want = sorted(((k, sum(similar(s[i], x) for j, x in enumerate(s) if i != j)) for i, (k, _) in enumerate(rows)), key=repr)
    for got in (documents, few):
        assert sorted(((r["doc_id"], r["n_links"]) for r in got.collect()), key=repr) == want
    sets = list({frozenset(x) for x in s})
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert len(set(pairs)) == len(pairs) == sum(similar(x, y) for i, x in enumerate(sets) for y in sets[:i])


def test_rows_without_an_id_link_others(spark):
    w = [f"w{i}" for i in range(44)]
    rows = [(1, " ".join(w)), (None, " ".join(w[4:] + ["a", "b", "c"])), (2, " ".join(w[8:] + ["a", "b", "c", "d", "e", "f"]))]
    assert found(spark, rows) == brute(rows) and {r[2] for r in found(spark, rows)} == {1}
