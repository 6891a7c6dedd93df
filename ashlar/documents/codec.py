"""Self-describing binary documents: encode, decode, measure, validate, attachments.

A field is a type byte (0x80: a name follows), the name if any, and a payload.  Objects
and arrays whose fields share one type byte are uniform: it stands once, before the first.
Numbers are prefix-length integers; all else is big-endian.  Python values stand for
fields: None, bool, int, float, bytes, str, list, dict, and Tagged for the other types.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..functions.numbers import decode_varuint, encode_varuint

#: Type codes.
NULL, OBJECT, UNIFORM_OBJECT, ARRAY, UNIFORM_ARRAY, BINARY, STRING, POSITIVE, NEGATIVE = range(1, 10)
FLOAT32, FLOAT64, FALSE, TRUE = 10, 11, 12, 13
SIZED = {14: ("object_attachment", 20), 15: ("binary_attachment", 20), 16: ("hash", 20), 17: ("uuid", 16), 18: ("datetime", 8), 19: ("timespan", 8), 20: ("object_id", 12)}
CODES = {name: code for code, (name, _) in SIZED.items()}
NAMED = 0x80
ATTACHMENTS = ("object_attachment", "binary_attachment")

#: Validation modes and errors.
DEFAULT, NAMES, FORMAT, PADDING, PACKAGE = 1, 2, 4, 8, 16
ALL = DEFAULT | NAMES | FORMAT | PADDING
OUT_OF_BOUNDS, INVALID_TYPE, DUPLICATE_NAME, MISSING_NAME, ARRAY_NAME, INVALID_STRING, INVALID_INTEGER, INVALID_FLOAT, NON_UNIFORM_OBJECT, NON_UNIFORM_ARRAY, EXTRA = (1 << i for i in range(11))


#: Containers inside each other that a document may have.
DEEPEST = 128


@dataclass(frozen=True)
class Tagged:
    """A hash, attachment, id or time: kind and raw bytes (times: ticks of 100 ns, signed)."""

    kind: str
    raw: bytes

    @classmethod
    def ticks(cls, kind: str, n: int) -> Tagged:
        return cls(kind, n.to_bytes(8, "big", signed=True))

    @property
    def number(self) -> int:
        return int.from_bytes(self.raw, "big", signed=True)


def _text(s: str) -> bytes:
    b = s.encode()
    return encode_varuint(len(b)) + b


def _value(v: Any) -> tuple[int, bytes]:
    """Type code and payload."""
    if v is None:
        return NULL, b""
    if isinstance(v, bool):
        return (TRUE if v else FALSE), b""
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 64:
            raise ValueError("integer beyond 64 bits")
        return (POSITIVE, encode_varuint(v)) if v >= 0 else (NEGATIVE, encode_varuint(~v))
    if isinstance(v, float):
        try:
            short = struct.pack(">f", v)
            if struct.unpack(">f", short)[0] == v:
                return FLOAT32, short
        except OverflowError:
            pass
        return FLOAT64, struct.pack(">d", v)
    if isinstance(v, bytes):
        return BINARY, encode_varuint(len(v)) + v
    if isinstance(v, str):
        return STRING, _text(v)
    if isinstance(v, Tagged):
        if len(v.raw) != SIZED[CODES[v.kind]][1]:
            raise ValueError(f"wrong size for {v.kind}")
        return CODES[v.kind], v.raw
    if isinstance(v, dict):
        fields = [(code | NAMED, _text(k) + body) for k, (code, body) in ((k, _value(x)) for k, x in v.items())]
        uniform = bool(fields) and len({c for c, _ in fields}) == 1
        body = _joined(fields, uniform)
        return (UNIFORM_OBJECT if uniform else OBJECT), encode_varuint(len(body)) + body
    if isinstance(v, (list, tuple)):
        fields = [_value(x) for x in v]
        uniform = bool(fields) and len({c for c, _ in fields}) == 1 and fields[0][0] not in (NULL, FALSE, TRUE)
        body = encode_varuint(len(fields)) + _joined(fields, uniform)
        return (UNIFORM_ARRAY if uniform else ARRAY), encode_varuint(len(body)) + body
    raise TypeError(f"no field type for {type(v).__name__}")


def _joined(fields: list[tuple[int, bytes]], uniform: bool) -> bytes:
    if uniform:
        return bytes([fields[0][0]]) + b"".join(b for _, b in fields)
    return b"".join(bytes([c]) + b for c, b in fields)


def encode(v: Any, name: str | None = None) -> bytes:
    """One field."""
    code, body = _value(v)
    return bytes([code]) + body if name is None else bytes([code | NAMED]) + _text(name) + body


class Reader:
    """Reads fields and gathers errors by mode; with mode 0 the first error raises."""

    def __init__(self, data: bytes, mode: int = 0):
        self.data, self.mode, self.errors, self.depth = data, mode, 0, 0

    def fail(self, error: int) -> None:
        self.errors |= error
        if not self.mode or error in (OUT_OF_BOUNDS, INVALID_TYPE):
            raise ValueError("malformed document")

    def number(self, at: int, end: int) -> tuple[int, int]:
        if at >= end or at + max(1, 9 - (self.data[at] ^ 0xFF).bit_length()) > end:
            self.fail(OUT_OF_BOUNDS)
        n, used = decode_varuint(self.data, at)
        if self.mode & FORMAT and len(encode_varuint(n)) < used:
            self.fail(INVALID_INTEGER)
        return n, at + used

    def bytes_(self, at: int, end: int, n: int | None = None) -> tuple[bytes, int]:
        if n is None:
            n, at = self.number(at, end)
        if at + n > end:
            self.fail(OUT_OF_BOUNDS)
        return self.data[at : at + n], at + n

    def field(self, at: int, end: int, shared: int | None = None) -> tuple[str | None, Any, int, int]:
        """(name, value, type byte, end)."""
        if shared is None:
            if at >= end:
                self.fail(OUT_OF_BOUNDS)
            kind, at = self.data[at], at + 1
        else:
            kind = shared
        name = None
        if kind & NAMED:
            raw, at = self.bytes_(at, end)
            name = raw.decode("utf-8", "replace")
        v, at = self.payload(kind & 0x3F, at, end)
        if kind & 0x40:
            self.fail(INVALID_TYPE)
        return name, v, kind, at

    def payload(self, code: int, at: int, end: int) -> tuple[Any, int]:
        if code in (NULL, FALSE, TRUE):
            return {NULL: None, FALSE: False, TRUE: True}[code], at
        if code in (OBJECT, UNIFORM_OBJECT, ARRAY, UNIFORM_ARRAY):
            n, at = self.number(at, end)
            if at + n > end:
                self.fail(OUT_OF_BOUNDS)
            return self.container(code, at, at + n), at + n
        if code == BINARY:
            return self.bytes_(at, end)
        if code == STRING:
            raw, at = self.bytes_(at, end)
            return raw.decode("utf-8", "replace"), at
        if code in (POSITIVE, NEGATIVE):
            n, at = self.number(at, end)
            return (n if code == POSITIVE else ~n), at
        if code == FLOAT32:
            raw, at = self.bytes_(at, end, 4)
            return struct.unpack(">f", raw)[0], at
        if code == FLOAT64:
            raw, at = self.bytes_(at, end, 8)
            v = struct.unpack(">d", raw)[0]
            if self.mode & FORMAT and _value(v)[0] == FLOAT32:
                self.fail(INVALID_FLOAT)
            return v, at
        if code in SIZED:
            kind, n = SIZED[code]
            raw, at = self.bytes_(at, end, n)
            return Tagged(kind, raw), at
        self.fail(INVALID_TYPE)
        return None, at

    def container(self, code: int, at: int, end: int) -> Any:
        is_array = code in (ARRAY, UNIFORM_ARRAY)
        count = None
        if is_array:
            count, at = self.number(at, end)
        shared = None
        if code in (UNIFORM_OBJECT, UNIFORM_ARRAY) and at < end:
            shared, at = self.data[at], at + 1
            if not shared & NAMED and shared & 0x3F in (NULL, FALSE, TRUE):  # fields of no bytes: any count would do
                self.fail(OUT_OF_BOUNDS)
        if count is not None and count > end - at:  # a field has a byte at least
            self.fail(OUT_OF_BOUNDS)
        self.depth += 1
        if self.depth > DEEPEST:
            self.fail(OUT_OF_BOUNDS)
        items: list[tuple[str | None, Any]] = []
        kinds: set[int] = set()
        while at < end if count is None else len(items) < count:
            name, v, kind, at = self.field(at, end, shared)
            items.append((name, v))
            kinds.add(kind)
        self.depth -= 1
        if at != end:
            self.fail(OUT_OF_BOUNDS)
        if is_array:
            if self.mode & NAMES and any(n is not None for n, _ in items):
                self.fail(ARRAY_NAME)
            if self.mode & FORMAT and shared is None and len(kinds) == 1 and len(items) > 1 and not kinds & {NULL, FALSE, TRUE}:
                self.fail(NON_UNIFORM_ARRAY)
            return [v for _, v in items]
        if self.mode & NAMES:
            names = [n for n, _ in items]
            if not all(names):
                self.fail(MISSING_NAME)
            if len(set(names)) < len(names):
                self.fail(DUPLICATE_NAME)
        if self.mode & FORMAT and shared is None and len(kinds) == 1 and len(items) > 1:
            self.fail(NON_UNIFORM_OBJECT)
        out: dict[str, Any] = {}
        for n, v in items:
            out.setdefault(n or "", v)  # lookup finds the first
        return out


def decode(data: bytes) -> Any:
    """The first field's value."""
    return Reader(data).field(0, len(data))[1]


def measure(data: bytes) -> int | None:
    """Bytes of the first field; null if it is cut short or no field."""
    try:
        return Reader(data).field(0, len(data))[3]
    except ValueError:
        return None


def validate(data: bytes, mode: int = ALL) -> int:
    """Error bits of one document; 0 is valid."""
    r = Reader(data, mode | DEFAULT)
    try:
        at = r.field(0, len(data))[3]
        if mode & PADDING and at != len(data):
            r.errors |= EXTRA
    except ValueError:
        pass
    return r.errors


def attachments(v: Any) -> Iterator[tuple[str, str]]:
    """(kind, hexadecimal hash) of all attachments inside a value, in order."""
    if isinstance(v, Tagged):
        if v.kind in ATTACHMENTS:
            yield v.kind, v.raw.hex()
    elif isinstance(v, dict):
        for x in v.values():
            yield from attachments(x)
    elif isinstance(v, list):
        for x in v:
            yield from attachments(x)


def find(v: Any, name: str, any_case: bool = False) -> Any:
    """An object's first field of a name; None where there is none."""
    if not isinstance(v, dict):
        return None
    if not any_case:
        return v.get(name)
    return next((x for k, x in v.items() if k.lower() == name.lower()), None)


def as_integer(v: Any, default: int, bits: int = 64, signed: bool = True) -> tuple[int, str | None]:
    """(value, error): the default with "type" or "range" where a value is no integer of that size."""
    if isinstance(v, bool) or not isinstance(v, int):
        return default, "type"
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return (v, None) if low <= v <= high else (default, "range")


def as_float(v: Any, default: float, bits: int = 64) -> tuple[float, str | None]:
    """(value, error): integers count while every one of their size is exact."""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return default, "type"
    if isinstance(v, int):
        return (float(v), None) if abs(v) < 1 << (24 if bits == 32 else 53) else (default, "range")
    if bits == 32 and _value(v)[0] == FLOAT64:
        return default, "range"
    return v, None


def to_plain(v: Any) -> Any:
    """A value for JSON: tagged and binary values as one-field objects whose name starts with $."""
    if isinstance(v, Tagged):
        return {f"${v.kind}": v.number if v.kind in ("datetime", "timespan") else v.raw.hex()}
    if isinstance(v, bytes):
        return {"$binary": v.hex()}
    if isinstance(v, dict):
        return {k: to_plain(x) for k, x in v.items()}
    return [to_plain(x) for x in v] if isinstance(v, list) else v


def from_plain(v: Any) -> Any:
    if isinstance(v, dict):
        if len(v) == 1:
            (k, x), = v.items()
            if k == "$binary":
                return bytes.fromhex(x)
            if k[:1] == "$" and k[1:] in CODES:
                return Tagged.ticks(k[1:], x) if k[1:] in ("datetime", "timespan") else Tagged(k[1:], bytes.fromhex(x))
        return {k: from_plain(x) for k, x in v.items()}
    return [from_plain(x) for x in v] if isinstance(v, list) else v
