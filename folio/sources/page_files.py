"""Trees of page files as a Spark data source, ``spark.read.format("pagefiles")`` and ``df.write.format("pagefiles")``, after :func:`register`.

Reading: the driver lists names and sizes of a tree (as Spark does for its own file sources) and deals the files into partitions of about as many bytes;
tasks read the contents. Folders that are hidden or of the system are passed over, folders and files that can't be read are rows with ``error``, so none ends a batch.
Options: ``path``; ``recursive`` (true); ``bytes`` of a partition (64 MB; a larger file is one of its own); ``content`` (true; false reads names only); ``extensions``, comma-separated.

Writing: rows (folder, name, content, error). A task writes below ``_temporary/<run>/<attempt>`` and reports what it wrote; only when all tasks have succeeded are the files of the
attempts that counted renamed to where they belong, each at once. A task that failed, was repeated or was run twice leaves nothing, and an abort takes the whole run away. Rows with an error write no file: they are the
table ``_errors`` (folder, name, error) beside the pages, which is there only if there are any. Overwriting takes away what was there before once all new files are written. Of rows of one folder and name the
last of the last partition stays.

All files are reached by URI over ``pyarrow.fs`` (local paths, file:, hdfs:, s3:, gs:); no call of the local file system is made. What only Hadoop can open is read by ``batch.scan``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from folio.sources.batch import IMAGES

READ = "path string, folder string, base_name string, ext string, length bigint, content binary, error string"
WRITTEN = T.StructType([T.StructField(c, T.BinaryType() if c == "content" else T.StringType()) for c in ("folder", "name", "content", "error")])
#: Names of folders that are passed over.
SKIPPED = re.compile(r"^[._$]|^System Volume Information$")
TEMPORARY, ERRORS = "_temporary", "_errors"
BATCH = 32_000_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or of a local path) and the path within it."""
    system, path = fs.FileSystem.from_uri(uri) if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+:", uri) else (fs.LocalFileSystem(), uri)
    return system, path.rstrip("/")


@dataclass
class Part(InputPartition):
    """Files (path, length) and folders that can't be read (path, error)."""

    files: list[tuple[str, int]] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def __hash__(self) -> int:
        return id(self)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.bytes = int(options.get("bytes", 64_000_000))
        self.extensions = tuple(options.get("extensions", ",".join(IMAGES)).lower().split(","))

    def partitions(self) -> list[Part]:
        system, root = opened(self.uri)
        todo, found, errors = [root], [], []
        while todo:
            folder = todo.pop()
            try:
                for info in system.get_file_info(fs.FileSelector(folder)):
                    if info.type == fs.FileType.Directory:
                        if self.recursive and not SKIPPED.match(info.base_name):
                            todo.append(info.path)
                    elif info.base_name.rpartition(".")[2].lower() in self.extensions and "." in info.base_name:
                        found.append((info.path, max(0, info.size or 0)))
            except OSError as e:
                errors.append((folder, f"{type(e).__name__}: {e}"))
        out, held = [Part(errors=errors)] if errors else [], 0
        for path, size in sorted(found):
            if not out or out[-1].errors or held + size > self.bytes or len(out[-1].files) >= 10_000:
                out.append(Part())
                held = 0
            out[-1].files.append((path, size))
            held += size
        return out or [Part()]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.uri)
        kinds = [("path", pa.string()), ("folder", pa.string()), ("base_name", pa.string()), ("ext", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
        rows: list[tuple] = [(path, path, None, None, None, None, error) for path, error in part.errors]
        held = 0
        for path, size in part.files:
            folder, _, name = path.rpartition("/")
            content = error = None
            if self.content:
                try:
                    with system.open_input_file(path) as f:
                        content = f.read()
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((path, folder, name.rpartition(".")[0], name.rpartition(".")[2].lower(), size, content, error))
            held += len(content or b"") + 200
            if held > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))


@dataclass
class Wrote(WriterCommitMessage):
    """What an attempt wrote: its folder, and the files below it."""

    partition: int
    attempt: str
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.run = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        system, root = opened(self.uri)
        number = TaskContext.get().partitionId()
        attempt = f"{root}/{TEMPORARY}/{self.run}/{number}-{uuid.uuid4().hex}"
        files, errors, made = [], [], set()
        for batch in batches:
            for row in batch.select([f.name for f in WRITTEN]).to_pylist():
                if row["error"] is not None:
                    errors.append({c: row[c] for c in ("folder", "name", "error")})
                    continue
                name = "/".join(p for p in ((row["folder"] or "").strip("/"), row["name"]) if p)
                if not row["name"] or "/" in row["name"] or ".." in name.split("/"):
                    raise ValueError(f"no name of a page file: {name}")
                target = f"{attempt}/{name}"
                if (folder := target.rpartition("/")[0]) not in made:
                    system.create_dir(folder)
                    made.add(folder)
                with system.open_output_stream(target) as f:
                    f.write(row["content"] or b"")
                files.append(name)
        if errors:
            system.create_dir(f"{attempt}/{ERRORS}")
            name = f"{ERRORS}/{self.run}-{number:06d}.parquet"
            pq.write_table(pa.Table.from_pylist(errors, pa.schema([(c, pa.string()) for c in ("folder", "name", "error")])), f"{attempt}/{name}", filesystem=system)
            files.append(name)
        return Wrote(number, attempt, files)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, root = opened(self.uri)
        system.create_dir(root)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name != TEMPORARY:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        made = set()
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name in message.files:
                target = f"{root}/{name}"
                if (folder := target.rpartition("/")[0]) not in made:
                    system.create_dir(folder)
                    made.add(folder)
                system.move(f"{message.attempt}/{name}", target)
        self.clear()

    def abort(self, messages: list[Wrote | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Takes away what this run left, and the folder of runs if this was the only one."""
        system, root = opened(self.uri)
        runs = f"{root}/{TEMPORARY}"
        if system.get_file_info(f"{runs}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{runs}/{self.run}")
        if system.get_file_info(runs).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(runs)):
            system.delete_dir(runs)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        return READ

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        missing = {f.name for f in WRITTEN} - set(schema.names)
        if missing:
            raise ValueError(f"page files need the columns {sorted(missing)}")
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("pagefiles").options(**{k: str(v) for k, v in options.items()}).load(path)


def write(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Files (folder, name, content, error) below a folder."""
    register(pages.sparkSession)
    pages.select(*[f.name for f in WRITTEN]).write.format("pagefiles").mode(mode).save(path)


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, error) of the rows that wrote no file, of all runs below a folder."""
    system, root = opened(path)
    if system.get_file_info(f"{root}/{ERRORS}").type != fs.FileType.Directory:
        return spark.createDataFrame([], "folder string, name string, error string")
    return spark.read.schema("folder string, name string, error string").parquet(f"{path.rstrip('/')}/{ERRORS}")
