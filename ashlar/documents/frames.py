"""Documents in DataFrames: Arrow-batched functions between binary, JSON text and VARIANT."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..functions.addr import addr
from . import codec


def _guarded(f):
    def one(x):
        if x is None:
            return None
        try:
            return f(x)
        except (ValueError, TypeError, KeyError):
            return None

    return lambda s: s.map(one)


@F.pandas_udf(StringType())
def to_json(documents: pd.Series) -> pd.Series:
    """JSON text of documents; null where malformed."""
    return _guarded(lambda b: json.dumps(codec.to_plain(codec.decode(bytes(b)))))(documents)


@F.pandas_udf(BinaryType())
def from_json(texts: pd.Series) -> pd.Series:
    """Documents from JSON text; null where it is no JSON."""
    return _guarded(lambda t: codec.encode(codec.from_plain(json.loads(t))))(texts)


def to_variant(document: Column) -> Column:
    return F.try_parse_json(to_json(document))


@F.pandas_udf(LongType())
def validate(documents: pd.Series) -> pd.Series:
    """Error bits, all modes."""
    return documents.map(lambda b: None if b is None else codec.validate(bytes(b)))


@F.pandas_udf(LongType())
def measure(documents: pd.Series) -> pd.Series:
    """Bytes of the first field; null if cut short."""
    return documents.map(lambda b: None if b is None else codec.measure(bytes(b))).astype("Int64")


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("hash", StringType())])))
def attachments(documents: pd.Series) -> pd.Series:
    """Attachments referred to, in order."""
    return _guarded(lambda b: [{"kind": k, "hash": h} for k, h in codec.attachments(codec.decode(bytes(b)))])(documents)


def document_hash(document: Column) -> Column:
    """Address of the canonical bytes; equal documents, equal hashes."""
    return addr(document)


def packages(objects: DataFrame, loose: DataFrame) -> DataFrame:
    """pkg, object, object_hash, attachments (sorted by hash, one each; an object attachment
    wins over a binary one) from objects (pkg, object) and loose (pkg, kind, payload)."""
    a = loose.groupBy("pkg", addr(F.col("payload")).alias("hash")).agg(F.min_by(F.struct("kind", "payload"), F.when(F.col("kind") == "object_attachment", 0).otherwise(1)).alias("a"))
    a = a.groupBy("pkg").agg(F.sort_array(F.collect_list(F.struct("hash", F.col("a.kind").alias("kind"), F.col("a.payload").alias("payload")))).alias("attachments"))
    return objects.select("pkg", "object", document_hash(F.col("object")).alias("object_hash")).join(a, "pkg", "left")


def find_attachment(attachments: Column, hash_: Column) -> Column:
    """The attachment of a package (hash, kind, payload) with that hash, or null."""
    return F.get(F.filter(attachments, lambda a: a["hash"] == hash_), F.lit(0))


def without_attachments(attachments: Column, hashes: Column) -> tuple[Column, Column]:
    """(the attachments whose hash is not among hashes, how many went)."""
    left = F.filter(attachments, lambda a: ~F.array_contains(hashes, a["hash"]))
    return left, F.size(attachments) - F.size(left)


def with_attachments(attachments: Column, more: Column) -> Column:
    """Both, sorted by hash, one each: of one hash an object attachment stays before a binary one."""
    every = F.concat(attachments, more)
    rank = lambda a: F.when(a["kind"] == "object_attachment", 0).otherwise(1)
    kept = F.filter(F.transform(every, lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda x: ~F.exists(F.transform(every, lambda o, j: (o["hash"] == x["a"]["hash"]) & ((rank(o) < rank(x["a"])) | ((rank(o) == rank(x["a"])) & (j < x["i"])))), lambda v: v))
    return F.array_sort(F.transform(kept, lambda x: x["a"]), lambda a, b: F.when(a["hash"] < b["hash"], -1).when(a["hash"] > b["hash"], 1).otherwise(0))


def same_package(object_a: Column, attachments_a: Column, object_b: Column, attachments_b: Column) -> Column:
    """Whether two packages have the same object hash and the same attachments; those are sorted."""
    parts = lambda c: F.transform(c, lambda a: F.struct(a["hash"].alias("hash"), a["kind"].alias("kind")))
    return object_a.eqNullSafe(object_b) & parts(attachments_a).eqNullSafe(parts(attachments_b))


#: The typed accessors: SQL type read from a VARIANT, and the range of whole numbers.
TYPED = {f"int{b}": ("decimal(38,0)", -(1 << b - 1), (1 << b - 1) - 1) for b in (8, 16, 32, 64)}
TYPED |= {f"uint{b}": ("decimal(38,0)", 0, (1 << b) - 1) for b in (8, 16, 32, 64)}
TYPED |= {"float": ("float", None, None), "double": ("double", None, None), "bool": ("boolean", None, None), "string": ("string", None, None)}
#: Accessors of tagged values, which the JSON form has as one-field objects.
TAGGED = ("binary", "hash", "object_attachment", "binary_attachment", "uuid", "object_id", "datetime", "timespan")


def typed(document: Column, name: str, kind: str, default) -> tuple[Column, Column]:
    """(value, error) of a VARIANT document's field: the default with "missing", "type" or "range"
    where the field is not there, of another type, or a whole number beyond the kind's size.  A
    number is no text and a text no number; whole numbers read as float or double, not the other way."""
    path = f"$.{name}"
    raw = F.variant_get(document, path, "variant")
    shape = F.schema_of_variant(raw)
    if kind in TAGGED:
        value = F.try_variant_get(document, f"{path}['${kind}']", "bigint" if kind in ("datetime", "timespan") else "string")
        return F.coalesce(value, F.lit(default)), F.when(raw.isNull(), "missing").when(value.isNull(), "type")
    sql, low, high = TYPED[kind]
    of = {"bool": ["BOOLEAN"], "string": ["STRING"]}.get(kind, ["BIGINT"] if low is not None else ["BIGINT", "DOUBLE", "FLOAT"])
    ok = F.substring_index(shape, "(", 1).isin(*of, "DECIMAL")
    if low is None and kind in ("bool", "string"):
        ok = shape.isin(*of)
    elif low is not None:
        ok = ok & ~shape.rlike(r"DECIMAL\([0-9]+,[1-9]")
    value = F.try_variant_get(document, path, sql)
    inside = F.lit(True) if low is None else value.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
    to = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}.get(kind, sql)
    value = F.when(ok & inside, value.try_cast(to))
    return F.coalesce(value, F.lit(default).cast(to)), F.when(raw.isNull(), "missing").when(~ok, "type").when(~inside, "range")
