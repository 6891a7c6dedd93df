import zlib

from ashlar.llm import warc
from ashlar.llm.common import keep, new_path
from ashlar.llm.queries import op1_warc, oracle_sql

BIG = "é" * 600


def pages(spark):
    rows = [(1, "http://a/ b\n", BIG), (2, "http://a", BIG), (7, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", BIG), (None, "u", BIG), (8, "u", "x" * 200_000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, offset int")


def test_query_equals_its_sql(spark, sf, same_rows):
    same_rows(op1_warc(spark, sf), oracle_sql()["op1_warc"])


def test_odd_rows_and_selection(spark):
    folder = new_path(spark, "warc")
    index = keep(warc.write(pages(spark), folder, archive_bytes=1000), "index")
    got = sorted(((r["key"], r["record_type"], r["refers_to"], r["declared_bytes"]) for r in warc.read(index, folder).collect()), key=repr)
    assert got == sorted([(1, "revisit", 7, 1200), (2, "revisit", 7, 1200), (7, "response", None, 1200), (7, "response", None, 1200), (None, "response", None, 1200), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0), (8, "response", None, 200_000)], key=repr)
    some = warc.read(index.where("key = 8"), folder).collect()
    assert len(some) == 1 and bytes(some[0]["payload"]) == b"x" * 200_000
    assert index.select("file").distinct().count() > 1


def test_every_range_is_a_record_by_itself(spark):
    from pyarrow import fs

    folder = new_path(spark, "warc")
    store, base = fs.FileSystem.from_uri(folder)
    for r in keep(warc.write(pages(spark), folder), "index").collect():
        with store.open_input_file(f"{base}/{r['file']}") as f:
            raw = zlib.decompress(f.read_at(r["length"], r["offset"]), 31)
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        head, _, block = raw[:-4].partition(b"\r\n\r\n")
        assert int(head.split(b"Content-Length: ")[1]) == len(block)


def test_empty(spark):
    folder = new_path(spark, "warc")
    index = keep(warc.write(pages(spark).limit(0), folder), "index")
    assert warc.read(index, folder).count() == 0
