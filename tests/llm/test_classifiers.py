import itertools
import zlib

import duckdb
import numpy as np
import odd
import pytest

from ashlar.llm import quality, toxicity
from ashlar.llm.common import labelled_sample
from ashlar.llm.queries import op9_quality, op10_toxicity

LARGER = "/root/testdata/sf0.01"


def known(sf, label):
    return dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())


@pytest.mark.parametrize("query,label,limit,least", [(op9_quality, "quality", 0.3, 0.9), (op10_toxicity, "toxic", 0.5, 0.8)])
def test_held_out_documents(spark, query, label, limit, least):
    y = known(LARGER, label)
    rows = query(spark, LARGER).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{LARGER}/documents.parquet'").fetchall()[0][0]
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in y]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in out]) >= least


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, module, label):
    d = odd.docs(spark)
    for labels in (odd.labels(spark, label), odd.labels(spark, label).limit(0)):
        rows = module.score(d, module.fit(d, labels)).collect()
        assert len(rows) == len(odd.texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(odd.none(spark), module.fit(d, odd.labels(spark, label))).count() == 0
    assert module.fit(odd.none(spark), odd.labels(spark, label)).scores is not None


def test_marginals_equal_summing_over_all_labelings():
    g = np.random.default_rng(3)
    first = np.array([0, 1, 4, 9])
    u, trans = g.normal(size=9), g.normal(size=(2, 2))
    p, joint, z = quality.marginals(u, trans, first)
    want, pairs, logz = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(u[a + i] * v for i, v in enumerate(y)) + sum(trans[v, w] for v, w in zip(y, y[1:])))
        total = sum(weights.values())
        logz += np.log(total)
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / total
            for v, x in zip(y, y[1:]):
                pairs[v, x] += w / total
    assert p == pytest.approx(want) and joint == pytest.approx(pairs) and z == pytest.approx(logz)


def test_lines_of_one_text_do_not_depend_on_others():
    texts = ["A b\nC!! d\n\n", "", "x x x x", "last | one\nmore"]
    whole = quality.lines(texts)
    alone = np.concatenate([quality.lines([t]).features for t in texts])
    assert np.allclose(whole.features, alone) and np.diff(whole.first).tolist() == [4, 1, 1, 2]


def subsequence_kernel(s, t):
    """Sum over shared subsequences of three letters inside spans, by brute force."""

    def phi(w):
        w, out = "^" + w, {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = phi(s), phi(t)
    return sum(v * b.get(u, 0) for u, v in a.items()) / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_kernel_equals_brute_force():
    marks, words = ["stupid", "loser"], ["stupid", "stxupid", "loser", "closer", "thing", "sup"]
    got = toxicity.Kernel([m.encode() for m in marks]).values([w.encode() for w in words])
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert got[i, j] == pytest.approx(max(0, subsequence_kernel(w, m) - toxicity.FLOOR) / (1 - toxicity.FLOOR), abs=1e-5)


def test_gapped_and_inserted_insults():
    clean = [(f"The quiet river {a} along {b} green hills. It was a fine day.", 0) for a, b in itertools.product(("runs", "winds", "goes", "flows"), ("low", "some", "many", "old", "wide"))]
    bad = [(f"The quiet river runs. You {w} {x}. It was a fine day.", 1) for w, x in itertools.product(("idiot", "moron", "stupid"), ("there", "now", "again", "people", "man", "over"))]
    m = toxicity.train(clean + bad)
    k = m.kernel()
    for t in ("what an IDIOT", "what an id-iot", "an i d i o t", "a m.o.r.o.n", "so st_upid", "1d1ot!", "stuupid fool"):
        assert m.scores(k, [t])[0] >= 0.5, t
    for t in ("A calm evening by the river.", "", "the the the", "many green hills"):
        assert m.scores(k, [t])[0] < 0.5, t
    long_ = "so it goes " * 60_000
    assert m.scores(k, [long_, long_ + " you moron", ""]).round().tolist() == [0, 1, 0]


GOOD, JUNK, INSULT = "The river runs along the hills.", "|| ## {} == || !! @@", "You idiot there."


@pytest.mark.parametrize(
    "module,label,texts,looks,group,share",
    [
        # 200 rows of label 1 and 600 of label 0 look the same
        (quality, "quality", (JUNK, GOOD), lambda i: i % 10 == 0 or i % 3 == 1, 1, 200 / 800),
        # 100 of label 1 and 1,800 of label 0 look the same
        (toxicity, "toxic", (GOOD, INSULT), lambda i: i % 20 == 0, 0, 100 / 1900),
        # no landmark tells the labels apart: one score for all
        (toxicity, "toxic", (GOOD, INSULT), lambda i: i % 10 == 0 or i % 3 == 1, 1, 200 / 2000),
    ],
)
def test_probabilities_keep_the_shares_of_all_learning_rows(spark, module, label, texts, looks, group, share):
    rows = [(i, f"{texts[looks(i)]} {zlib.crc32(str(i).encode()):08x}", int(i % 10 == 0)) for i in range(2000)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id bigint, {label} int")
    for each in (4000, 120):  # all rows; 120 of either label
        scores = module.score(d, module.fit(d, known, each)).collect()
        assert np.mean([r["score"] for r in scores if looks(r["doc_id"]) == group]) == pytest.approx(share, abs=0.07)


def learned(spark, monkeypatch, module, label, texts, **how):
    """The (text, label) rows that a model is trained on."""
    got = []
    with monkeypatch.context() as m:
        m.setattr(module, "train", lambda sample, *_: got.extend(sample))
        d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
        module.fit(d, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], f"doc_id bigint, {label} int"), **how)
    return got


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_samples_have_whole_texts(spark, monkeypatch, module, label):
    texts = [(f"{'river ' * 10_000}{i}", i % 2) for i in range(20)]
    got = learned(spark, monkeypatch, module, label, texts)
    assert {t for t, _ in got} == {t for i, (t, _) in enumerate(texts) if zlib.crc32(str(i).encode()) % 5}


def test_samples_take_fewer_texts_not_shorter_ones(spark):
    texts = [(f"{'river ' * (500 * (1 + i % 3))}{i}", i % 2) for i in range(60)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id bigint, toxic int")
    for most in (1, 40_000):
        got, stands_for = labelled_sample(d, known, "toxic", 100, most=most)
        for y in (0, 1):
            mine = [t for t, b in got if b == y]
            learning = sum(b == y and zlib.crc32(str(i).encode()) % 5 > 0 for i, (_, b) in enumerate(texts))
            assert mine and set(mine) <= {t for t, _ in texts} and stands_for[y] == learning / len(mine)
            assert len(mine) == 1 if most == 1 else 1 < len(mine) < learning and sum(map(len, mine)) <= most


def test_lines_far_down_are_learned():
    start = "\n".join(["The river runs along the hills."] * 410)
    fields = [quality.train([(start, 1), (start + tail, 0)] * 5).weights for tail in ("\n|| ## {} ==" * 50, "\n!!?? 77 88" * 50)]
    assert not np.allclose(*fields)


def test_clean_sentences_far_down_are_learned(monkeypatch):
    seen = []
    machine = toxicity.machine
    monkeypatch.setattr(toxicity, "machine", lambda x, y, w: seen.append(w[y == 0].sum()) or machine(x, y, w))
    toxicity.train([("The day is fine. " * 150, 0)] * 20 + [(f"You idiot {w}.", 1) for w in "there now again people man over here still today friend".split()])
    assert seen[0] == 20 * 150


def test_held_out_toxic_and_clean_documents(spark):
    """Of the labelled toxic documents outside learning, some hold no insult at all."""
    y = known("/root/testdata/sf0.1", "toxic")
    rows = [r for r in op10_toxicity(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in y]
    hit = sum(r["predicted"] and y[r["doc_id"]] for r in rows)
    assert hit >= 0.8 * sum(y[r["doc_id"]] for r in rows)
    assert hit >= 0.8 * sum(r["predicted"] for r in rows)


SCRIPTS = {
    "cyrillic": ("дурак идиот болван".split(), "Сегодня тихая река течёт {} за холмами. Был хороший день."),
    "cjk": ("混蛋东西 白痴家伙 笨蛋蠢货".split(), "今天 河水 {} 静静地 流淌。天气 很好。"),
    "arabic": ("أحمق غبي تافه".split(), "النهر هادئ {} اليوم. كان يوما جميلا."),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_other_scripts_are_read(script):
    bad, text = SCRIPTS[script]
    sample = [(text.format(i), 0) for i in range(60)] + [(text.format(f"{w} {i}"), 1) for w in bad for i in range(15)]
    m = toxicity.train(sample)
    k = m.kernel()
    for w in bad:
        assert m.scores(k, [text.format(w + " x")])[0] >= 0.5
    assert m.scores(k, [text.format("x")])[0] < 0.5


def test_lookalikes_read_as_letters():
    want = toxicity.tokens("you idiot here")
    for t in ("you \u0456d\u0456ot here", "you \uff49\uff44\uff49\uff4f\uff54 here", "you i\u0301di\u200bo\u0300t here", "YOU 1D10T HERE", "you i d i o t here"):
        assert toxicity.tokens(t) == want, t
    assert toxicity.tokens("na\xefve caf\xe9") == toxicity.tokens("na\xefve caf\xe9\u200b") == [b"naive", b"cafe"]
