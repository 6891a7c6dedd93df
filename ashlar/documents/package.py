"""Packages: one document with the attachments it may refer to, as one run of fields.

The document's field and its hash come first, then each attachment as a binary field and
its hash (an object attachment's says that the bytes are a document), then a null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .codec import ATTACHMENTS, DEFAULT, EXTRA, FORMAT, NAMES, NULL, PACKAGE, PADDING, Reader, Tagged, attachments, decode, encode

#: Package errors, after the document errors.
INVALID_FORMAT, INVALID_HASH, DUPLICATES, MANY_OBJECTS, NULL_OBJECT, NULL_ATTACHMENT = (1 << i for i in range(11, 17))


def content_hash(data: bytes) -> bytes:
    """The leading 160 bits of SHA-256, as addr()."""
    return hashlib.sha256(data).digest()[:20]


def save(document: dict, loose: list[tuple[str, bytes]]) -> bytes:
    """A package of a document and (kind, payload) attachments: sorted by hash, one each, an
    object attachment before a binary one of the same hash."""
    head = encode(document)
    out = [head, encode(Tagged(ATTACHMENTS[0], content_hash(head)))] if document else []
    best: dict[bytes, tuple[str, bytes]] = {}
    for kind, payload in loose:
        h = content_hash(payload)
        if h not in best or kind == ATTACHMENTS[0]:
            best[h] = (kind, payload)
    for h, (kind, payload) in sorted(best.items()):
        out += [encode(payload), encode(Tagged(kind, h))]
    return b"".join(out) + encode(None)


def fields(data: bytes, mode: int = 0) -> Iterator[tuple[Any, bytes]]:
    """(value, encoded field) up to the null that ends a package."""
    r, at = Reader(data, mode), 0
    while True:
        _, value, kind, end = r.field(at, len(data))
        if kind == NULL:
            return
        yield value, data[at:end]
        at = end


def load(data: bytes) -> tuple[Any, list[tuple[str, str, bytes]]]:
    """(document, [(kind, hash, payload)]); malformed packages raise ValueError."""
    document, found, wait = None, [], None
    for value, raw in fields(data):
        if wait is None and isinstance(value, (bytes, dict)):
            wait = value
            if isinstance(value, bytes) and not value:
                wait = None  # an empty attachment has no hash
        elif wait is not None and isinstance(value, Tagged) and value.kind in ATTACHMENTS:
            if isinstance(wait, dict):
                document = wait
            else:
                found.append((value.kind, value.raw.hex(), wait))
            wait = None
        else:
            raise ValueError("malformed package")
    if wait is not None:
        raise ValueError("malformed package")
    return document, found


def validate(data: bytes, mode: int = DEFAULT | NAMES | FORMAT | PADDING | PACKAGE) -> int:
    """Error bits: those of its documents, wrong form or hash, more than one or an empty
    object, empty or repeated attachments."""
    r, at, objects, seen = Reader(data, mode & ~PACKAGE | DEFAULT), 0, 0, []
    bad = 0
    try:
        while True:
            start = at
            _, value, kind, at = r.field(at, len(data))
            if kind == NULL:
                break
            if isinstance(value, bytes):
                if not value:
                    bad |= NULL_ATTACHMENT
                    continue
                want = content_hash(value)
            elif isinstance(value, dict):
                objects += 1
                bad |= MANY_OBJECTS * (objects > 1) | NULL_OBJECT * (not value)
                want = content_hash(data[start:at])
            else:
                bad |= INVALID_FORMAT
                continue
            _, mark, _, at = r.field(at, len(data))
            if not isinstance(mark, Tagged) or mark.kind not in ATTACHMENTS:
                bad |= INVALID_FORMAT
                continue
            bad |= INVALID_HASH * (mark.raw != want)
            if isinstance(value, bytes):
                seen.append(mark.raw)
        if mode & PADDING and at != len(data):
            r.errors |= EXTRA
    except ValueError:
        pass
    bad |= DUPLICATES * (len(set(seen)) < len(seen))
    return r.errors | (bad if mode & PACKAGE else 0)


def gather(document: Any, resolve: Callable[[str], bytes | None]) -> list[tuple[str, bytes]]:
    """Attachments that a document refers to, and those that object attachments refer to in
    turn; what resolve() does not know is passed over."""
    out, seen, todo = [], set(), list(attachments(document))
    while todo:
        kind, h = todo.pop(0)
        if h in seen or (payload := resolve(h)) is None:
            continue
        seen.add(h)
        out.append((kind, payload))
        if kind == ATTACHMENTS[0]:
            todo += attachments(decode(payload))
    return out


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("hash", StringType()), StructField("payload", BinaryType())])))
def unpacked(packages: pd.Series) -> pd.Series:
    """A package's attachments; null where malformed."""

    def one(p: bytes | None) -> list | None:
        try:
            return None if p is None else [{"kind": k, "hash": h, "payload": b} for k, h, b in load(bytes(p))[1]]
        except ValueError:
            return None

    return packages.map(one)


@F.pandas_udf(LongType())
def errors(packages: pd.Series) -> pd.Series:
    return packages.map(lambda p: None if p is None else validate(bytes(p)))
