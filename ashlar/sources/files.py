"""Folders, fixed-record logs and reports as DataFrames."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of a log file's header: magic, and header bytes (magic, record size, checksum, zeros).
MAGIC, HEADER = b"ASHLRLOG", 64


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified, content of the regular files below root; the content is only
    read where it is used.  Spark's listing passes over names that start with a dot or an
    underscore."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def visible(files: DataFrame, root: str) -> DataFrame:
    """Files in no folder below root whose name starts with a dot; files of such names stay.
    Adds ``relative``."""
    at = F.instr("path", root.rstrip("/") + "/")
    rel = F.when(at > 0, F.substring("path", at + len(root.rstrip("/")) + 1, F.length("path")))
    folders = F.slice(F.split("relative", "/"), 1, F.size(F.split("relative", "/")) - 1)
    return files.withColumn("relative", rel).where("relative IS NOT NULL").where(~F.exists(folders, lambda p: p.startswith(".")))


def two_roots(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """Files of two scans above a size."""
    return a.unionByName(b).where(F.col("size") > threshold)


def report(files: DataFrame) -> DataFrame:
    """Lines ``path,hash`` to be written as text."""
    return files.select(F.concat_ws(",", "path", F.sha2("content", 256)).alias("value"))


def log_header(record: int) -> bytes:
    head = MAGIC + struct.pack("<I", record)
    return (head + hashlib.sha256(head).digest()[:4]).ljust(HEADER, b"\0")


def read_log(spark: SparkSession, path: str, record: int) -> DataFrame:
    """path, seq, record of log files: a checked header, then records of one size; a torn tail
    is left out.  A mangled header fails the job."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if body[:HEADER] != log_header(record):
                    raise ValueError(f"{name}: not a log of {record}-byte records")
                n = (len(body) - HEADER) // record
                for at in range(0, n, 10_000):
                    part = range(at, min(n, at + 10_000))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.int64()), pa.array([body[HEADER + i * record : HEADER + (i + 1) * record] for i in part], pa.binary())], ["path", "seq", "record"])

    return files.mapInArrow(run, "path string, seq bigint, record binary")


def scan_blocks(spark: SparkSession, path: str, block: int, step: Callable[[bytes], int]) -> DataFrame:
    """path, ord, result: step() over the blocks of files in order, the last one short; an empty file has none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(body.as_buffer())
                got = [step(bytes(view[at : at + block])) for at in range(0, len(view), block)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array(got, pa.int64())], ["path", "ord", "result"])

    return files.mapInArrow(run, "path string, ord bigint, result bigint")
