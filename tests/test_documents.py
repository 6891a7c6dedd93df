import pytest

from hypothesis import given, settings, strategies as st

from ashlar.documents import codec
from ashlar.documents.codec import Tagged

scalars = st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.binary(max_size=20) | st.text(max_size=20) | st.binary(min_size=20, max_size=20).map(lambda b: Tagged("hash", b)) | st.integers(-(2**63), 2**63 - 1).map(lambda n: Tagged.ticks("datetime", n))
values = st.recursive(scalars, lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(min_size=1, max_size=6).filter(lambda s: s[:1] != "$"), x, max_size=5), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(values)
def test_round_trip_is_valid_and_canonical(v):
    b = codec.encode(v)
    assert codec.decode(b) == v
    assert codec.validate(b) == 0
    assert codec.measure(b) == len(b)
    assert codec.encode(codec.decode(b)) == b
    assert codec.from_plain(codec.to_plain(v)) == v


@settings(max_examples=100, deadline=None)
@given(values, st.integers(0, 200))
def test_cut_documents_are_never_whole(v, n):
    b = codec.encode(v)
    if n < len(b):
        assert codec.measure(b[:n]) is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_are_judged_without_a_crash(b):
    codec.validate(b)


def test_errors():
    assert codec.validate(codec.encode(1) + b"x") == codec.EXTRA
    assert codec.validate(b"") == codec.OUT_OF_BOUNDS
    assert codec.validate(b"\x1f") == codec.INVALID_TYPE
    assert codec.validate(bytes([codec.POSITIVE, 0x80, 0x01])) == codec.INVALID_INTEGER
    assert codec.validate(bytes([codec.FLOAT64]) + b"\x3f\xf0" + bytes(6)) == codec.INVALID_FLOAT
    one, two = (bytes([codec.POSITIVE | codec.NAMED, 1]) + name + b"\1" for name in (b"a", b"a"))
    body = one + two
    assert codec.validate(bytes([codec.OBJECT, len(body)]) + body) == codec.DUPLICATE_NAME | codec.NON_UNIFORM_OBJECT
    assert codec.validate(bytes([codec.ARRAY, 5, 1]) + one) == codec.ARRAY_NAME


def test_uniform_containers():
    assert codec.encode([5, 6]).hex() == "050402080506"
    assert codec.encode([None, None])[0] == codec.ARRAY
    assert codec.encode({"a": None, "b": None})[0] == codec.UNIFORM_OBJECT
    assert codec.encode([])[0] == codec.ARRAY


def test_access():
    assert codec.as_integer(300, 7, 8) == (7, "range") and codec.as_integer("x", 7) == (7, "type") and codec.as_integer(-1, 7, signed=False) == (7, "range")
    assert codec.as_float(2**24, 0.0, 32) == (0.0, "range") and codec.as_float(5, 0.0, 32) == (5.0, None) and codec.as_float(0.1, 0.0, 32) == (0.0, "range")
    assert codec.find({"Ab": 1}, "aB") is None and codec.find({"Ab": 1}, "aB", any_case=True) == 1


def test_attachments_of_nested_documents():
    inner = {"x": [Tagged("binary_attachment", b"\1" * 20), {"y": Tagged("object_attachment", b"\2" * 20)}], "h": Tagged("hash", b"\3" * 20)}
    assert list(codec.attachments(inner)) == [("binary_attachment", "01" * 20), ("object_attachment", "02" * 20)]


def test_packages(spark):
    from ashlar.documents import frames
    from ashlar.functions.addr import addr
    from pyspark.sql import functions as F

    o = spark.createDataFrame([(1, bytearray(codec.encode({"a": 1})))], "pkg int, object binary")
    a = spark.createDataFrame([(1, "binary_attachment", "x"), (1, "object_attachment", "x"), (1, "binary_attachment", "y")], "pkg int, kind string, payload string")
    row = frames.packages(o, a).first()
    assert [x["kind"] for x in sorted(row["attachments"], key=lambda x: x["payload"])] == ["object_attachment", "binary_attachment"]
    assert row["object_hash"] == o.select(addr(F.col("object"))).first()[0]


def test_counts_and_depth_are_bounded():
    for code in (codec.NULL, codec.TRUE, codec.FALSE):
        body = bytes([0x8F, 0x42, 0x40, code])  # far more fields than bytes
        assert codec.validate(bytes([codec.UNIFORM_ARRAY, len(body)]) + body) & codec.OUT_OF_BOUNDS
    deep = codec.encode(1)
    for _ in range(300):
        deep = bytes([codec.ARRAY]) + codec.encode_varuint(len(deep) + 1) + b"\1" + deep
    assert codec.validate(deep) & codec.OUT_OF_BOUNDS and codec.measure(deep) is None
    with pytest.raises(ValueError):
        codec.decode(deep)
