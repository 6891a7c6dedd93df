import pytest

from ashlar.sources import files


@pytest.fixture
def tree(tmp_path):
    for name in ("A.txt", "dir/D.txt", ".git/x.txt", "dir/.hidden", "dir/.deep/y.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(p.stem)
    return str(tmp_path)


def test_scan_and_pruning(spark, tree):
    f = files.scan(spark, tree)
    assert f.count() == 2
    assert files.two_roots(f, f, 0).count() == 4 and files.two_roots(f, f, 1).count() == 0
    assert files.report(f).count() == 2
    listed = spark.createDataFrame([(f"file:{tree}/{n}",) for n in ("A.txt", "dir/D.txt", ".git/x.txt", "dir/.hidden", "dir/.deep/y.txt")] + [("file:/elsewhere/z",)], "path string")
    assert sorted(r["relative"] for r in files.visible(listed, tree).collect()) == ["A.txt", "dir/.hidden", "dir/D.txt"]


def test_log_records_and_torn_tail(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(files.log_header(8) + b"".join(i.to_bytes(8, "big") for i in range(5)) + b"torn")
    rows = files.read_log(spark, str(tmp_path / "a.log"), 8).orderBy("seq").collect()
    assert [int.from_bytes(r["record"], "big") for r in rows] == list(range(5))


def test_mangled_header_fails(spark, tmp_path):
    (tmp_path / "b.log").write_bytes(b"x" + files.log_header(8)[1:] + bytes(16))
    with pytest.raises(Exception, match="not a log"):
        files.read_log(spark, str(tmp_path / "b.log"), 8).count()


def test_blocks_of_a_file_in_order(spark, tmp_path):
    from ashlar.sources.files import scan_blocks

    (tmp_path / "f.bin").write_bytes(bytes(range(10)))
    rows = scan_blocks(spark, str(tmp_path / "f.bin"), 4, sum).orderBy("ord").collect()
    assert [(r["ord"], r["result"]) for r in rows] == [(0, 6), (1, 22), (2, 17)]
