"""Token counts of documents in flat, unindexed token files, by a scan for separators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import shared_folder, text_of, with_workers
from .packing import encode

#: Bytes of a block; a multiple of the two bytes of an id.
BLOCK = 1 << 18
#: Documents of one file at most: a file is read as a whole, by one task, before it is cut.
RECORDS = 1 << 15


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int, text_col: str = "text") -> None:
    """Write all texts' ids, little-endian 16-bit and nothing else, ``end_id`` after each text.

    One stream of files for each partition, in order of its rows: ``part-<partition>-...``.
    Spark's text writer puts the raw bytes and the separator, so any file system will do
    and lost tasks are written again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=0):
            ids = [np.frombuffer(x, "<u4") for x in encode(batch.column(0).to_pylist(), path, pattern)]
            if any(len(x) and (x.max() > 0xFFFF or (x == end_id).any()) for x in ids):
                raise ValueError("an id has more than 16 bits or is the separator")
            yield pa.record_batch([pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], names=["ids"])

    raw = with_workers(docs).select(text_of(docs, text_col)).mapInArrow(run, "ids binary")
    raw.select(F.col("ids").cast("string")).write.option("maxRecordsPerFile", RECORDS).option("encoding", "UTF-16LE").option("lineSep", chr(end_id)).text(folder)


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner, n, first, tail = [], [], [], []
            for block in batch.column(3):
                ids = np.frombuffer(block.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == end_id)
                n.append(len(ends))
                first.append(int(ends[0]) if len(ends) else None)
                tail.append(len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids))
                inner.append(np.diff(ends) - 1)
            flat = np.concatenate(inner) if inner else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in inner]))).astype(np.int32)
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(tail, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))],
                names=["part", "file", "block", "ends", "first", "tail", "inner"],
            )

    return run


def token_counts(spark: SparkSession, folder: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """``part, ordinal, n_tokens, ended`` for each document of the streams in ``folder``.

    Files are cut into blocks, and each block is searched on its own. What a document has in
    earlier blocks is a prefix sum over the blocks' summaries, a few numbers a block, within
    each stream of files. Empty documents count 0; a stream that does not end with the
    separator gives a last row with ``ended`` false; empty files give none.
    """
    if block % 2:
        raise ValueError("a block has whole ids")
    size = F.greatest(F.lit(0), F.ceil(F.col("length") / block).cast("int"))
    name = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1)
    blocks = (
        spark.read.format("binaryFile").load(folder)
        .where(name != "")
        .select(
            name.cast("int").alias("part"),
            F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).try_cast("int").alias("file"),
            F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("block"), F.substring(F.col("content"), (i - 1) * block + 1, F.lit(block)).alias("ids")))).alias("b"),
        )
        .where("length(b.ids) > 0")
        .select("part", F.coalesce("file", F.lit(0)).alias("file"), "b.block", "b.ids")
    )
    found = with_workers(blocks).mapInArrow(_scan(end_id), "part int, file int, block int, ends long, first long, tail long, inner array<long>")
    order = Window.partitionBy("part").orderBy("file", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.withColumns({"past": F.coalesce(F.sum("ends").over(before), F.lit(0)), "tails": F.coalesce(F.sum("tail").over(before), F.lit(0))})
    # the tails before the latest block with a separator belong to documents that have ended
    done = F.when(F.col("ends") > 0, F.col("tails"))
    sums = sums.withColumns({"open": F.col("tails") - F.coalesce(F.max(done).over(before), F.lit(0)), "last": F.lead("block").over(order).isNull()})
    held = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))
    whole = F.when(F.col("ends") > 0, F.concat(F.array(F.col("open") + F.col("first")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    counts = F.when(F.col("last") & (held > 0), F.concat(whole, F.array(held))).otherwise(whole)
    return sums.select("part", "past", "ends", F.posexplode(counts).alias("k", "n_tokens")).select(
        "part", (F.col("past") + F.col("k")).alias("ordinal"), "n_tokens", (F.col("k") < F.col("ends")).alias("ended")
    )


def document_token_counts(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``<id>, n_tokens`` of each row, counted in token files written for the purpose.

    ``docs`` must read the same rows in the same partitions each time, as file scans and
    checkpoints do: ids are found again by partition and ordinal, and a row that has no
    count, or the other way round, stops the job. Null text counts as empty; texts of any
    length, ties, repeated rows, null ids and extra columns are taken row by row; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token_files")
    write_token_files(docs, folder, path, pattern, end_id, text_col)
    at = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col), at.alias("__at")).select(id_col, F.shiftright("__at", 33).cast("int").alias("part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("ordinal"), F.lit(True).alias("__row"))
    counts = token_counts(spark, folder, end_id, block)
    both = rows.join(counts, ["part", "ordinal"], "full")
    wrong = F.col("__row").isNull() | F.col("n_tokens").isNull()
    return both.select(id_col, F.when(wrong, F.raise_error("token files and rows differ").cast("long")).otherwise(F.col("n_tokens")).alias("n_tokens"))
