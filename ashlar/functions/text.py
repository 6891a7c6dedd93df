"""Readable sizes, rates and times; paths, numbers in text, byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


BINARY = ("K", "M", "G", "T", "P", "E")


def _scaled(n: Column, first: str, units: tuple[str, ...], base: int, decimals: bool = True) -> Column:
    """n by the largest unit it reaches; whole multiples (and times) without decimals, else as
    many of two, one or no decimals as fit five characters with the letter."""
    out = F.concat(n.cast("string"), F.lit(first))
    size = 1
    for letter in units:
        size *= base
        whole = F.floor(n.cast("decimal(38,0)") / F.lit(size).cast("decimal(38,0)")).cast("string")
        if decimals:
            q = n.cast("decimal(38,10)") / F.lit(size).cast("decimal(38,0)")
            two, one, none = (F.bround(q, d).cast(f"decimal(38,{d})").cast("string") for d in (2, 1, 0))
            whole = F.when(n % size == 0, whole).when(F.length(two) <= 4, two).when(F.length(one) <= 4, one).otherwise(none)
        out = F.when(n >= size, F.concat(whole, F.lit(letter))).otherwise(out)
    return out


def nice_number(n: Column) -> Column:
    return _scaled(n, "", BINARY, 1024)


def nice_bytes(n: Column) -> Column:
    return _scaled(n, "B", BINARY, 1024)


def nice_latency_ns(n: Column) -> Column:
    return _scaled(n, "ns", ("us", "ms", "s"), 1000, decimals=False)


def nice_rate(n: Column, ms: Column, unit: str = "") -> Column:
    """n a second, as a number with a unit; a time of zero counts as one millisecond."""
    return F.concat(nice_number((n * 1000 / F.greatest(ms, F.lit(1))).cast("bigint")), F.lit(f"{unit}/s"))


def nice_byte_rate(n: Column, ms: Column) -> Column:
    """Bytes a second; null for no time."""
    return F.concat(nice_bytes((n * 1000 / F.nullif(ms, F.lit(0))).cast("bigint")), F.lit("/s"))


def nice_span_ms(ms: Column) -> Column:
    """Milliseconds as ms, seconds, XmYYs or XhYYm."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = (ms / 1000).cast("bigint")
    m = (ms / 60000).cast("bigint")
    h = (ms / 3600000).cast("bigint")
    sec = lambda d: F.concat(F.bround(ms.cast("decimal(20,3)") / 1000, d).cast(f"decimal(20,{d})").cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 10000, sec(2)).when(ms < 60000, sec(1)).when(ms < 3600000, F.concat(m.cast("string"), F.lit("m"), two(s - m * 60), F.lit("s"))).otherwise(F.concat(h.cast("string"), F.lit("h"), two(m - h * 60), F.lit("m")))


def extension(path: Column) -> Column:
    """From the last dot on; null without one."""
    return F.nullif(F.regexp_extract(path, r"(\.[^.]*)$", 1), F.lit(""))


def parse_int(s: Column) -> Column:
    """The leading whole number; null without one or beyond 64 bits.  What follows it is ignored."""
    return F.regexp_extract(s, "^-?[0-9]+", 0).try_cast("bigint")


def relative(path: Column, root: Column) -> Column:
    """path below root, or null."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


def byte_range(b: Column, offset: Column, size: Column) -> Column:
    """size bytes from offset on, both held to what there is; a null size means the rest."""
    n = F.octet_length(b).cast("bigint")
    at = F.least(offset, n)
    return F.substring(b, (at + 1).cast("int"), F.least(F.coalesce(size, n), n - at).cast("int"))
