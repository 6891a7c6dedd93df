"""Whole-number helpers and variable-length integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_pow2(n: Column) -> Column:
    """Whether n has at most one bit set (0 counts)."""
    return n.bitwiseAND(n - 1) == 0


def floor_log2(n: Column) -> Column:
    """Index of the highest bit; null below 1."""
    return F.when(n >= 1, F.length(F.bin(n)) - 1)


def ceil_log2(n: Column) -> Column:
    return F.when(n == 1, 0).when(n > 1, F.length(F.bin(n - 1)))


def next_pow2(n: Column) -> Column:
    """The smallest power of two that is not below n; 1 for n <= 1."""
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("bigint"))


def leading_zeros64(n: Column) -> Column:
    return F.when(n == 0, 64).otherwise(64 - F.length(F.bin(n)))


def trailing_zeros64(n: Column) -> Column:
    return F.when(n == 0, 64).otherwise(F.length(F.bin(n)) - F.length(F.rtrim(F.translate(F.bin(n), "0", " "))))


def round_up(n: Column, unit: int) -> Column:
    """The next multiple of a power of two."""
    return (n + (unit - 1)).bitwiseAND(F.lit(-unit).cast("bigint"))


def varuint_len(n: Column) -> Column:
    """Bytes of a prefix-length unsigned integer: seven bits a byte, nine at most."""
    return F.when(n == 0, 1).otherwise(F.least(F.floor(floor_log2(n) / 7) + 1, F.lit(9))).cast("int")


def zigzag(n: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def varint_len(n: Column) -> Column:
    return varuint_len(zigzag(n))


def encode_varuint(n: int) -> bytes:
    """Big-endian, its length told by the leading ones of the first byte, so bytes sort as numbers."""
    size = min((max(n.bit_length(), 1) - 1) // 7 + 1, 9)
    if size == 9:
        return b"\xff" + n.to_bytes(8, "big")
    return (n | ((0xFF00 >> (size - 1)) & 0xFF) << 8 * (size - 1)).to_bytes(size, "big")


def decode_varuint(b: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes used)."""
    first = b[at]
    size = 9 if first == 0xFF else 9 - (first ^ 0xFF).bit_length()
    body = b[at : at + size]
    if len(body) < size:
        raise ValueError("integer cut short")
    if size == 9:
        return int.from_bytes(body[1:], "big"), 9
    return int.from_bytes(body, "big") & ((1 << 7 * size) - 1), size
