import hashlib

import numpy as np
import odd
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ashlar.llm import bpe
from ashlar.llm.queries import op2_bpe, vocabulary

theirs = Tokenizer.from_file(vocabulary())
ours = bpe.Automaton(open(vocabulary(), encoding="utf-8").read())
SAMPLES = [t or "" for _, t in odd.texts()] + ["aaaaaaa" * 9, "777777777", "      x", "it's WE'LL 'd", "<|endoftext|><|endoftext|>a", "한국어 中文 العربية ١٢٣", "\r\n\t  x"]


def ids(text):
    return np.frombuffer(ours.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", SAMPLES)
def test_equals_the_library(text):
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert ours.decode(ours.encode(text)) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abethinrs '\n.0179é"), max_size=60) | st.text(max_size=30))
def test_any_text(text):
    assert ids(text) == theirs.encode(text, add_special_tokens=False).ids
    assert ours.decode(ours.encode(text)) == text


def test_a_tiny_automaton_equals_merging_by_rank():
    letters = "ab"
    merges = [("a", "a"), ("aa", "a"), ("a", "b"), ("b", "ab"), ("aa", "aa")]
    vocab = {c: i for i, c in enumerate(bpe.byte_letters())}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    import itertools
    import json

    a = bpe.Automaton(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    for n in range(1, 10):
        for word in map("".join, itertools.product(letters, repeat=n)):
            parts = list(word)
            while found := [(merges.index(p), -0, i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
                rank = min(f[0] for f in found)
                i = min(f[2] for f in found if f[0] == rank)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [a.labels[x].decode() for x in a.path(word.encode())] == parts


def test_query_over_its_table(spark, sf):
    import pyarrow.parquet as pq

    want = {}
    for i, t in zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))):
        e = theirs.encode(t or "", add_special_tokens=False)
        text = theirs.decode(e.ids, skip_special_tokens=False)
        want[i] = (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op2_bpe(spark, sf).collect()}
    assert got == want


def test_odd_rows(spark):
    d = odd.docs(spark)
    rows = bpe.round_trip(d, vocabulary()).collect()
    assert sorted(repr((r["doc_id"], r["decoded"])) for r in rows) == sorted(repr((i, t or "")) for i, t in odd.texts())
    back = bpe.decode(bpe.encode(d, vocabulary()), vocabulary()).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr((r["doc_id"], r["decoded"])) for r in rows)
    assert bpe.round_trip(odd.none(spark), vocabulary()).count() == 0
