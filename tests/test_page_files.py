"""The data source of page files: trees, errors, commits, aborts, repeated tasks."""

import os

import pytest
from pyarrow import fs

from folio.sources import images, page_files

ROWS = "folder string, name string, content binary, error string"


def names(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def rows(spark, of, parts=3):
    return spark.createDataFrame(of, ROWS).repartition(parts, "name")


def test_written_and_read(spark, tmp_path):
    root = str(tmp_path / "out")
    page_files.write(rows(spark, [("a", "1.png", b"one", None), ("a/b", "2.TIF", b"", None), (None, "3.bmp", b"three", None), ("a", "4.png", b"x", "torn"), ("a", "notes.txt", b"no page", None)]), root)
    assert [n for n in names(root) if not n.startswith("_errors/")] == ["3.bmp", "a/1.png", "a/b/2.TIF", "a/notes.txt"]
    got = {os.path.relpath(r.path, root): (r.base_name, r.ext, r.length, bytes(r.content), r.error) for r in page_files.read(spark, root).collect()}
    assert got == {"3.bmp": ("3", "bmp", 5, b"three", None), "a/1.png": ("1", "png", 3, b"one", None), "a/b/2.TIF": ("2", "tif", 0, b"", None)}
    assert {os.path.basename(r.path) for r in page_files.read(spark, root, recursive=False).collect()} == {"3.bmp"}
    assert [r.content for r in page_files.read(spark, f"file://{root}", content=False).collect()] == [None] * 3
    assert [tuple(r) for r in page_files.errors(spark, root).collect()] == [("a", "4.png", "torn")]
    page_files.write(rows(spark, [("a", "5.png", b"five", "torn too"), ("c", "1.png", b"new", None)]), root)
    assert page_files.errors(spark, root).count() == 2 and page_files.read(spark, root).count() == 4
    page_files.write(rows(spark, [("c", "9.png", b"nine", None)]), root, "overwrite")
    assert names(root) == ["c/9.png"] and page_files.errors(spark, root).count() == 0


def test_parts_are_of_some_bytes(spark, tmp_path):
    page_files.write(rows(spark, [("f", f"{i}.png", bytes(100), None) for i in range(40)]), str(tmp_path))
    reader = page_files.Reader({"path": str(tmp_path), "bytes": "450"})
    parts = reader.partitions()
    assert len(parts) == 10 and all(len(p.files) == 4 for p in parts)
    assert page_files.read(spark, str(tmp_path), bytes=450).select("path").distinct().count() == 40
    assert page_files.read(spark, str(tmp_path), bytes=10).rdd.getNumPartitions() == 40


def test_folders_that_are_passed_over_or_cannot_be_read(tmp_path, monkeypatch):
    for folder in ("open/.hidden", "open/$RECYCLE.BIN", "open/System Volume Information", "closed", "_temporary/run"):
        os.makedirs(tmp_path / folder)
        (tmp_path / folder / "p.png").write_bytes(b"1")
    (tmp_path / "open" / "q.jpeg").write_bytes(b"22")
    (tmp_path / "open" / "png").write_bytes(b"no extension")

    class Torn(fs.LocalFileSystem):
        def get_file_info(self, x):
            if isinstance(x, fs.FileSelector) and x.base_dir.endswith("closed"):
                raise PermissionError("closed to us")
            return super().get_file_info(x)

    monkeypatch.setattr(page_files, "opened", lambda uri: (Torn(), uri))
    reader = page_files.Reader({"path": str(tmp_path)})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(os.path.relpath(r["path"], tmp_path), r["length"], r["error"]) for r in got] == [("closed", None, "PermissionError: closed to us"), ("open/q.jpeg", 2, None)]


def test_empty_tree_and_no_rows(spark, tmp_path):
    page_files.write(rows(spark, []), str(tmp_path / "none"))
    assert page_files.read(spark, str(tmp_path / "none")).count() == 0


def test_failed_runs_leave_nothing(spark, tmp_path):
    root = str(tmp_path)
    page_files.write(rows(spark, [("a", "1.png", b"kept", None)]), root)
    with pytest.raises(Exception, match="no page of that number|name of a page file"):
        page_files.write(rows(spark, [("a", f"{i}.png", b"new", None) for i in range(30)] + [("a", "../x.png", b"bad", None)]), root)
    assert names(root) == ["a/1.png"] and (tmp_path / "a" / "1.png").read_bytes() == b"kept"
    assert not (tmp_path / "_temporary").exists()


def test_repeated_attempts_count_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    writer = page_files.Writer({"path": str(tmp_path)}, False)
    batch = pa.RecordBatch.from_pylist([{"folder": "a", "name": "1.png", "content": b"whole", "error": None}], pa.schema([("folder", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 7

    monkeypatch.setattr(page_files, "TaskContext", Context)
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    other = page_files.Writer({"path": str(tmp_path)}, False)
    waits = other.write(iter([batch]))
    assert first.attempt != second.attempt and not (tmp_path / "a").exists()
    writer.commit([second])
    assert names(tmp_path) == sorted(["a/1.png", os.path.relpath(f"{waits.attempt}/a/1.png", tmp_path)])  # the other run is still under way
    other.abort([waits])
    assert names(tmp_path) == ["a/1.png"] and not (tmp_path / "_temporary").exists()


def test_images_through_the_source(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, 2, 1, bytearray(b"\x00\x10\x20\xff")), (2, 1, 1, 3, bytearray(b"\x01\x02\x03"))], "page_id bigint, width int, height int, channels int, pixels binary")
    files = images.encoded(pages, "png").selectExpr("'f' as folder", "concat(page_id, '.png') as name", "content", "cast(null as string) as error")
    page_files.write(files.unionByName(rows(spark, [("f", "3.png", b"\x89PNG torn", None)])), str(tmp_path))
    got = {r.path[-5:]: (r.pixels and bytes(r.pixels), r.error is None) for r in images.decoded(page_files.read(spark, str(tmp_path))).collect()}
    assert got == {"1.png": (b"\x00\x10\x20\xff", True), "2.png": (b"\x01\x02\x03", True), "3.png": (None, False)}
