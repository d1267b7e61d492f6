"""Pages of books as files in order, with a summary index that plans and prunes reads."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

SCHEMA = T.StructType([T.StructField("book", T.StringType()), T.StructField("page", T.LongType()), T.StructField("text", T.StringType())])
SUMMARY = "_summary.jsonl"
#: Bytes of a file, bytes of a range that one task reads, and pages of a batch.
FILE, RANGE, BATCH = 256 << 20, 32 << 20, 1000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that Arrow knows: local, HDFS, S3 or GCS."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict[str, Any]]


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    end: int


class _Writer(DataSourceWriter):
    """Each task writes its rows as they come, one JSON line a page; the driver adds the summary when all are done.

    A file holds pages of one book. Every ``range_bytes`` its summary notes where a page begins.
    A failed task's files are in no summary, so they are never read.
    """

    def __init__(self, path: str, file_bytes: int, range_bytes: int) -> None:
        self.path, self.file_bytes, self.range_bytes = path, file_bytes, range_bytes

    def write(self, iterator: Iterator[T.Row]) -> WriterCommitMessage:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files: list[dict[str, Any]] = []
        out = None
        for book, page, text in iterator:
            line = json.dumps([book, page, text], ensure_ascii=False).encode() + b"\n"
            now = files[-1] if out else None
            if now is None or now["book"] != book or now["bytes"] + len(line) > self.file_bytes:
                if out:
                    out.close()
                files.append(now := {"file": f"pages-{uuid.uuid4().hex}.jsonl", "book": book, "first": page, "last": page, "pages": 0, "bytes": 0, "marks": []})
                out = store.open_output_stream(f"{folder}/{now['file']}")
            if not now["marks"] or now["bytes"] - now["marks"][-1] >= self.range_bytes:
                now["marks"].append(now["bytes"])
            out.write(line)
            known = [p for p in (now["first"], page) if p is not None]
            now["first"] = min(known, default=None)
            now["last"] = max([p for p in (now["last"], page) if p is not None], default=None)
            now["pages"] += 1
            now["bytes"] += len(line)
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{SUMMARY}") as out:
            for f in sorted((f for m in messages if m for f in m.files), key=_order):
                out.write(json.dumps(f, ensure_ascii=False).encode() + b"\n")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _store(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{folder}/{f['file']}")


def _order(f: dict[str, Any]) -> tuple:
    """Books by name and pages by number; nulls first."""
    return f["book"] is not None, f["book"] or "", f["first"] is not None, f["first"] or 0, f["file"]


def load_summary(path: str) -> list[dict[str, Any]]:
    """The files of a folder in order of book and page: a row for each, with its first and last page."""
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/{SUMMARY}") as f:
        return [json.loads(line) for line in f.read().decode().splitlines()]


class _Reader(DataSourceReader):
    """Plans ranges of files in order of book and page; files that cannot hold what is asked for are left out.

    What is asked for comes as options, not by filter push-down: a pushed filter stays with
    the relation and would prune later queries on the same DataFrame too.
    """

    def __init__(self, path: str, books: list[str] | None, first: int | None, last: int | None) -> None:
        self.path, self.books, self.first, self.last = path, books, first, last

    def _may_hold(self, f: dict[str, Any]) -> bool:
        if self.books is not None and f["book"] not in self.books:
            return False
        if self.first is None and self.last is None:
            return True
        if f["first"] is None:
            return False  # pages without a number are in no range
        return (self.first is None or f["last"] >= self.first) and (self.last is None or f["first"] <= self.last)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for f in load_summary(self.path):
            if self._may_hold(f):
                out += [_Range(f["file"], a, b) for a, b in zip(f["marks"], [*f["marks"][1:], f["bytes"]], strict=True)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("book", pa.string()), ("page", pa.int64()), ("text", pa.string())])
        if not partition.file:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as f:
            f.seek(partition.start)
            at, held, rest = partition.start, [], b""
            while at < partition.end:
                piece = f.read(min(1 << 20, partition.end - at))
                if not piece:
                    raise OSError(f"{partition.file} ends before its summary says")
                at += len(piece)
                *lines, rest = (rest + piece).split(b"\n")
                held += [json.loads(line) for line in lines]
                if len(held) >= BATCH or lines and len(piece) >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class PageFiles(DataSource):
    """Format ``page_files``: options ``path``; to write ``file_bytes`` and ``range_bytes``; to read, as JSON, ``books``, ``first`` and ``last``."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        books, first, last = (json.loads(self.options.get(k, "null")) for k in ("books", "first", "last"))
        return _Reader(self.options["path"], books, first, last)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("file_bytes", FILE)), int(self.options.get("range_bytes", RANGE)))


def write_pages(df: DataFrame, path: str, book: str, page: str, text: str, file_bytes: int = FILE, range_bytes: int = RANGE) -> None:
    """Write pages to a new folder in order of book and page (nulls first; equal pages by their text).

    Ranges of (book, page) are dealt to tasks, so a book of very many pages is many files.
    """
    df.sparkSession.dataSource.register(PageFiles)
    rows = df.select(F.col(book).cast("string").alias("book"), F.col(page).cast("long").alias("page"), F.col(text).cast("string").alias("text"))
    placed = rows.repartitionByRange("book", "page", F.xxhash64("text")).sortWithinPartitions("book", "page", "text")
    placed.write.format("page_files").option("path", path).option("file_bytes", file_bytes).option("range_bytes", range_bytes).mode("append").save()


def read_pages(spark: SparkSession, path: str, books: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """``book, page, text``: of these books and pages from ``first`` to ``last``, or of all.

    Partitions come in order of book and page, and rows of one in theirs. Files that hold
    none of what is asked for are left out by the summary before any is opened; pages
    without a number are in no range of pages.
    """
    spark.dataSource.register(PageFiles)
    reader = spark.read.format("page_files").option("path", path).option("books", json.dumps(books)).option("first", json.dumps(first)).option("last", json.dumps(last))
    out = reader.load()
    if books is not None:
        out = out.where(F.col("book").isin(books))
    if first is not None:
        out = out.where(F.col("page") >= first)
    return out if last is None else out.where(F.col("page") <= last)
