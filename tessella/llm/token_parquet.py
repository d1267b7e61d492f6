"""Token ids as Parquet list columns, in order of documents, with reads of chosen parts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import shared_folder, text_of, with_workers
from .packing import encode

#: Bytes of a row group, bytes of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 1000
ENCODINGS = ("dictionary", "delta")


def write_tokens(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, special: bool = True) -> None:
    """Write ``doc_id, part, local_start, n_tokens, tokens`` of all documents, in ascending order of ids.

    File ``part-<k>`` holds the k-th range of ids, in order (null ids first). Rows of one id
    go by a hash of their text and then as they are read, so that an id, or null, of very
    many rows is dealt to many files. ``local_start`` counts the tokens before a document in
    its part: what a part needs of the others is one sum. Tokens have a dictionary, whose
    indexes are packed to the bits they need, or are stored as packed differences; the
    ascending columns are always differences. Pages are small and indexed, so a reader
    skips those whose ids or positions it does not want, and metadata without tokens.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {ENCODINGS}")
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            coded = [x + end for x in encode(batch.column(1).to_pylist(), path, pattern, special)]
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(coded))]))
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), lists], names=["id", "part", "local_start", "n_tokens", "tokens"])
            start += int(ends[-1])

    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    keyed = rows.withColumns({"h": F.xxhash64("text"), "k": F.monotonically_increasing_id()})
    placed = keyed.repartitionByRange("id", "h", "k").sortWithinPartitions("id", "h", "k").select("id", "text")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    coded = with_workers(placed).mapInArrow(run, schema).withColumnRenamed("id", "doc_id")
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group,
        "parquet.page.size": page,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
    }
    coded.write.options(**{k: str(v) for k, v in options.items()}).parquet(folder)


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """``part, before``: tokens of all parts before each; reads three narrow columns, gives one row a file."""
    sums = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def read_documents(spark: SparkSession, folder: str, *columns: str, where: Column | None = None) -> DataFrame:
    """``doc_id, start, n_tokens`` and, if named, ``tokens``, of all documents or of those that ``where`` keeps.

    Without ``tokens`` the lists are not read. A condition on ``doc_id`` goes down to the
    files, and skips row groups and pages by their indexes. ``start`` counts the tokens of
    all documents before.
    """
    rows = spark.read.parquet(folder)
    kept = rows if where is None else rows.where(where)
    starts = F.broadcast(_starts(spark, folder))  # one row for each file
    return kept.join(starts, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def read_range(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """``start, tokens``: the tokens from place ``begin`` of the whole stream up to ``end``, piece by piece.

    Parts outside the range are not read at all, and of the others only pages that their
    indexes of ``local_start`` leave; ``start`` is each piece's place in the stream.
    """
    sums = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).orderBy("part").collect()  # one row for each file
    pieces, before = [], 0
    for r in sums:
        if before < end and begin < before + r["n"]:
            near = (F.col("part") == r["part"]) & (F.col("local_start") < end - before) & (F.col("local_start") > begin - before - r["longest"])
            place = F.col("local_start") + before
            head, tail = F.greatest(F.lit(0).cast("long"), begin - place), F.least(F.col("n_tokens"), end - place)
            pieces.append(spark.read.parquet(folder).where(near).select((place + head).alias("start"), F.slice("tokens", (head + 1).cast("int"), F.greatest(F.lit(0), tail - head).cast("int")).alias("tokens")).where(F.size("tokens") > 0))
        before += r["n"]
    out = pieces[0] if pieces else spark.read.parquet(folder).where("false").select(F.col("local_start").alias("start"), "tokens")
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def crc32_of(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """These rows with ``ids_crc32`` in place of the list: of its ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("ids_crc32", T.LongType())])
    return with_workers(rows).select(*kept, column).mapInArrow(run, schema)


def document_tokens(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", special: bool = True) -> DataFrame:
    """``<id>, start, n_tokens, ids_crc32`` of each document, from files written for the purpose.

    A document is its ids and then ``end_id``; null and empty texts are that one id. Texts of
    any length, ties, repeated rows, null ids (first of all) and extra columns are taken row
    by row, and equal ids go by their texts; an empty table gives an empty result. ``docs``
    must read the same rows in the same partitions each time, as file scans and checkpoints
    do. Texts are shuffled once, to be ordered, and encoded a few MB at a time.
    """
    folder = shared_folder(docs.sparkSession, "token_parquet")
    write_tokens(docs, folder, path, pattern, end_id, id_col, text_col, encoding, special=special)
    found = crc32_of(read_documents(docs.sparkSession, folder, "tokens"))
    return found.withColumnRenamed("doc_id", id_col)
