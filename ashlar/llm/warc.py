"""WARC archives on shared storage: index first, then coalesced sorted byte-range reads.

Writing puts every record, one gzip member each, into archives in a shared folder and
returns the index: file, offset, length, URL and digest per record.  Only the index is
needed to choose records; reading sorts the chosen entries by file and offset, joins
ranges that lie close together into one read, and cuts the records out of it.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import reachable, turn

GZIP_LEVEL = 3
#: Ranges this close are read together, up to so many bytes a read.
GAP, READ = 64 << 10, 8 << 20
#: Archive bytes a reading task is given.
TASK_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "key {key}, file string, `offset` bigint, length bigint, url string, digest string, record_type string"
RECORD = "key {key}, url string, record_type string, refers_to {key}, declared_digest string, declared_bytes bigint, payload binary"


def urn(key: object) -> str:
    return f"<urn:page:{key}>"


def record(key: object, url: str | None, date: str, digest: str, refers_to: object, size: int, payload: bytes) -> bytes:
    """One WARC/1.1 record, gzipped.  A revisit (refers_to given) holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names; http-* for the HTTP header's) and the payload of one gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields["http-" + name.lower()] = value.strip()
    return fields, payload


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row into archives below ``folder`` and return the index.

    Payload: the html in UTF-8; null means empty.  Of rows with equal payloads of at least
    ``least`` bytes, those with the largest key are responses and the others revisit it.
    Shorter payloads and rows with a null key are always responses.  Repeated rows get a
    record each.  The result is lazy and writes when it is first computed, so keep it as a
    table: its rows name the files of the attempts that succeeded, and files of lost
    attempts are never read.
    """
    kind = dict(pages.dtypes)[key]
    p = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    ids = p.where(F.col("size") >= least).groupBy("digest", "key").agg(F.count("*").alias("n"))
    first = ids.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.drop("n").join(first, "digest").where("key < refers_to")
    rows = p.join(again.hint("shuffle_hash"), ["key", "digest"], "left").select("key", "url", "digest", "refers_to", "size", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            index = []
            for k, u, d, r, n, body in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(k, u, date, d, r, n, body or b"")
                out.write(data)
                index.append((k, name, at, len(data), u, d, "response" if r is None else "revisit"))
                at += len(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), [b.schema.field("key").type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])], ["key", "file", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.close()

    reachable(pages.sparkSession)
    return rows.mapInArrow(turn(run), INDEX.format(key=kind))


def read(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the index rows (all, or a selection) point to.

    Returns key, url, record_type, refers_to, declared_digest (lower-case hex),
    declared_bytes (of the full payload) and payload (null for a revisit).
    """
    kind = dict(index.dtypes)["key"]
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    chosen = index.select("key", "file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        whole = re.compile(r"<urn:page:(.*)>").fullmatch
        number = kind in ("bigint", "int", "smallint", "tinyint")
        key_type = None
        opened: list = ["", None]

        def cut(near: list) -> pa.RecordBatch:
            name, start = near[0][1], near[0][2]
            if opened[0] != name:
                opened[:] = [name, store.open_input_file(f"{base}/{name}")]
            data = memoryview(opened[1].read_at(near[-1][2] + near[-1][3] - start, start))
            got = []
            for k, _, at, n in near:
                f, body = parse(data[at - start : at - start + n])
                r = whole(f["warc-refers-to"])[1] if "warc-refers-to" in f else None
                got.append((k, f.get("warc-target-uri"), f["warc-type"], int(r) if r is not None and number else r, base64.b32decode(f["warc-payload-digest"][5:]).hex(), int(f["http-content-length"]), body if r is None else None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), [key_type, pa.string(), pa.string(), key_type, pa.string(), pa.int64(), pa.binary()])], ["key", "url", "record_type", "refers_to", "declared_digest", "declared_bytes", "payload"])

        near: list = []
        for b in batches:
            key_type = b.schema.field("key").type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if near and (row[1] != near[-1][1] or row[2] - near[-1][2] - near[-1][3] > GAP or row[2] + row[3] - near[0][2] > READ):
                    yield cut(near)
                    near = []
                near.append(row)
        if near:
            yield cut(near)

    reachable(index.sparkSession)
    return chosen.mapInArrow(turn(run), RECORD.format(key=kind))
