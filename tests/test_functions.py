import pandas as pd
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from ashlar.functions import addr, crc, numbers, text, ticks

NUMBERS = {1: "1", 1000: "1000", 1023: "1023", 1024: "1K", 10000: "9.77K", 100000: "97.7K", 1000000: "977K", 10**7: "9.54M", 10**8: "95.4M", 10**9: "954M", 10**10: "9.31G", 10**13: "9.09T", 10**16: "8.88P", 10**18: "888P", 1024**2: "1M", 0: "0"}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_nice_numbers(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS], "n bigint").select("n", text.nice_number(F.col("n")), text.nice_bytes(F.col("n")), text.nice_latency_ns(F.col("n"))).collect()
    for n, number, size, latency in rows:
        assert number == NUMBERS[n]
        assert size == NUMBERS[n] + ("B" if n < 1024 else "")
    assert {r[0]: r[3] for r in rows}[1000000] == "1ms" and {r[0]: r[3] for r in rows}[1023] == "1us"


@pytest.mark.parametrize("ms,want", [(999, "999ms"), (1500, "1.50s"), (12345, "12.3s"), (60000, "1m00s"), (61000, "1m01s"), (3600000, "1h00m"), (7320000, "2h02m")])
def test_nice_span(spark, ms, want):
    assert one(spark, text.nice_span_ms(F.lit(ms).cast("bigint"))) == (want,)


def test_digests(spark):
    assert one(spark, addr.sha1(F.lit("")), addr.sha1(F.lit("ABC"))) == ("da39a3ee5e6b4b0d3255bfef95601890afd80709", "3c01bdbb26f358bab27f267924aa2c9a03fcfdb8")
    assert one(spark, addr.md5(F.lit("a"))) == ("0cc175b9c0f1b6a831c399e269772661",)


@pytest.mark.parametrize(
    "data,want",
    [(b"", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (b"1234567890" * 4, "a7142c8c3905cd11b1e35105c7ac588b75d6798822f71e1145187ad46f3e8df4")],
)
def test_blake3(data, want):
    assert crc.blake3(data).hex() == want


def test_blake3_of_many_chunks_differs_by_every_byte():
    data = bytes(i % 251 for i in range(5000))
    seen = {crc.blake3(data)} | {crc.blake3(data[:i] + b"\xff" + data[i + 1 :]) for i in range(0, 5000, 499)}
    assert len(seen) == 12


#: Published digests of 0, 1, ... 250, 0, 1, ... by length.
BLAKE3 = {1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2", 7168: "61da957ec2499a95d6b8023e2b0e604ec7f6b50e80a9678b89d2628e99ada77a", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"}


def test_blake3_of_many_payloads_side_by_side(monkeypatch):
    pattern = bytes(i % 251 for i in range(102400))
    calls, compress = [], crc._compress
    monkeypatch.setattr(crc, "_compress", lambda *a: calls.append(1) or compress(*a))
    sizes = [*BLAKE3] * 3 + [3000] * 300
    got = crc.blake3_hex.func(pd.Series([None, *(pattern[:n] for n in sizes), b"", None]))
    assert got[0] is None and got.iloc[-1] is None and got.iloc[-2].startswith("af1349b9f5f9a1a6")
    assert list(got[1:22]) == list(BLAKE3.values()) * 3 and len(set(got[22:322])) == 1
    assert len(calls) < 100  # of small payloads as well, not so many for each


@given(st.integers(0, 2**64 - 1))
def test_varuint_round_trip(n):
    b = numbers.encode_varuint(n)
    assert numbers.decode_varuint(b) == (n, len(b))
    assert numbers.encode_varuint(min(n + 1, 2**64 - 1)) >= b


def test_varint_lengths(spark):
    values = [0, 1, -1, 63, 64, 127, 128, 16383, 16384, 2**40, 2**61]
    rows = spark.createDataFrame([(v,) for v in values], "n bigint").select("n", numbers.varuint_len(F.abs("n")), numbers.zigzag(F.col("n"))).collect()
    for n, length, zig in rows:
        assert length == len(numbers.encode_varuint(abs(n)))
        assert zig == (2 * n if n >= 0 else -2 * n - 1)


def test_hex_and_paths(spark):
    assert one(spark, F.hex(addr.from_hex(F.lit("aF09"))), addr.from_hex(F.lit("xz")), addr.from_hex(F.lit("abc"))) == ("AF09", None, None)
    assert one(spark, addr.shard_path(F.lit("0123456789abcdef0123456789abcdef01234567"))) == ("012/34/56789abcdef0123456789abcdef01234567",)
    assert one(spark, text.extension(F.lit("a/b.tar.gz")), text.extension(F.lit("none")), text.relative(F.lit("/r/a/b"), F.lit("/r")), text.relative(F.lit("/q/a"), F.lit("/r"))) == (".gz", None, "a/b", None)
    assert one(spark, text.parse_int(F.lit("12ab")), text.parse_int(F.lit("x")), text.parse_int(F.lit("99999999999999999999"))) == (12, None, None)


def test_byte_range_is_clamped(spark):
    b = F.lit("0123456789").cast("binary")
    cut = lambda o, n: F.decode(text.byte_range(b, F.lit(o).cast("bigint"), F.lit(n).cast("bigint")), "utf-8")
    assert one(spark, cut(1, 3), cut(8, 10), cut(20, 5), cut(4, None)) == ("123", "89", "", "456789")


def test_ticks(spark):
    t = F.lit("2020-05-13 15:10:00").cast("timestamp")
    assert one(spark, ticks.to_ticks(t), ticks.from_ticks(ticks.to_ticks(t)) == t, ticks.span_ticks(*(F.lit(x).cast("bigint") for x in (1, 2, 4, 8, 0)))) == (637249794000000000, True, 938_480_000_000)
    assert one(spark, ticks.filetime_seconds(F.lit(116444736010000000).cast("bigint"))) == (1,)


def test_name_shards(spark):
    rows = spark.createDataFrame([("Name",), ("name",), (None,)], "n string").select(crc.name_shard("n")).collect()
    assert rows[0][0] == rows[1][0] and len(rows[0][0]) == 5 and rows[2][0] is None
