from pyspark.sql import functions as F

from ashlar.documents import codec, package as p
from ashlar.documents.codec import Tagged
from ashlar.functions.addr import addr

DOC = {"key": "foo", "n": 5}
LOOSE = [("binary_attachment", b"\1\2\3"), ("binary_attachment", codec.encode({"a": 1})), ("object_attachment", codec.encode({"a": 1})), ("binary_attachment", b"\1\2\3")]


def test_round_trip_keeps_one_attachment_a_hash():
    data = p.save(DOC, LOOSE)
    assert p.validate(data) == 0
    document, found = p.load(data)
    assert document == DOC and sorted(k for k, _, _ in found) == ["binary_attachment", "object_attachment"]
    assert [h for _, h, _ in found] == sorted(p.content_hash(b).hex() for _, _, b in found)
    assert p.load(p.save({}, [])) == (None, [])


def test_errors():
    good, one = p.save(DOC, []), codec.encode(b"x")
    mark = lambda b: codec.encode(Tagged("binary_attachment", p.content_hash(b)))
    end = codec.encode(None)
    assert p.validate(one + mark(b"x") + one + mark(b"x") + end) == p.DUPLICATES
    assert p.validate(one + mark(b"y") + end) == p.INVALID_HASH
    assert p.validate(codec.encode(b"") + end) == p.NULL_ATTACHMENT
    assert p.validate(good[:-1] + good) == p.MANY_OBJECTS
    assert p.validate(codec.encode(5) + end) == p.INVALID_FORMAT
    assert p.validate(good + b"z") == codec.EXTRA
    assert p.validate(good[:-1]) == codec.OUT_OF_BOUNDS
    assert p.validate(one + mark(b"y") + end, codec.ALL) == 0


def test_gathering_goes_through_four_levels():
    store, refer = {}, None
    for level in range(4):
        body = codec.encode({"level": level, **({"next": refer} if refer else {}), "lost": Tagged("binary_attachment", bytes(20))})
        refer = Tagged("object_attachment", p.content_hash(body))
        store[refer.raw.hex()] = body
    assert len(p.gather({"root": refer}, store.get)) == 4


def test_in_frames(spark):
    d = spark.createDataFrame([(1, bytearray(p.save(DOC, LOOSE))), (2, bytearray(b"\xff")), (3, None)], "i int, package binary")
    rows = d.select("i", p.errors("package").alias("e"), F.explode_outer(p.unpacked("package")).alias("a")).select("i", "e", "a.hash", addr(F.col("a.payload")).alias("again")).collect()
    assert all(r["hash"] == r["again"] for r in rows) and [r["i"] for r in rows] == [1, 1, 2, 3]
