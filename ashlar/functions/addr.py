"""Content addresses, digests, hexadecimal text, object ids and shard paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def data(c: Column) -> Column:
    """Bytes of a value; a string's UTF-8."""
    return c.cast("binary")


def addr(c: Column) -> Column:
    """Content address: the leading 160 bits of SHA-256, 40 lower-case digits."""
    return F.substring(F.sha2(data(c), 256), 1, 40)


def sha1(c: Column) -> Column:
    return F.sha1(data(c))


def md5(c: Column) -> Column:
    return F.md5(data(c))


def key_id(c: Column) -> Column:
    """A key's object id: the first 12 bytes of its address."""
    return F.substring(addr(c), 1, 24)


def checksum32(c: Column) -> Column:
    """A record checksum of eight digits."""
    return F.substring(addr(c), 1, 8)


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(data(c)))


def from_hex(c: Column) -> Column:
    """Bytes of hexadecimal text in either case; null if a digit is wrong or the length is odd."""
    return F.when(c.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(c))


def shard_path(h: Column) -> Column:
    """Folder path of an address: three digits, two digits, the rest."""
    return F.concat_ws("/", F.substring(h, 1, 3), F.substring(h, 4, 2), F.substring(h, 6, 64))


def oid(seconds: Column, serial: Column, run: Column) -> Column:
    """Object id text from unix seconds, serial and run id: sorts by time."""
    part = lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 8, "0"))
    return F.concat(part(seconds), part(serial), part(run))


def oid_seconds(o: Column) -> Column:
    return F.conv(F.substring(o, 1, 8), 16, 10).cast("bigint")
