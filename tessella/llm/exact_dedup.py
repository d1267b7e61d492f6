"""Exact dedup with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Return ``<id>, keep_id, group_size, kept, text_sha256`` for each row.

    Rows are grouped by a 128-bit digest *and* by the bytes themselves, so a collision of
    digests cannot merge two texts; the grouping combines before its shuffle, so a text
    that a third of all rows share is a handful of rows by then. Ids go back to rows by
    digest and SHA-256, which are checked to name one text each; only groups with
    copies take part, and AQE splits a hot digest in that join.

    ``keep`` is ``min`` or ``max``: which id of a group stays. Null text counts as empty.
    A null id never stays while its group has another; a group of null ids only keeps
    null. Rows that repeat both id and text are all reported and all ``kept``. Extra
    columns are ignored; an empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    rows = docs.select(F.col(id_col).alias("__id"), text_of(docs, text_col).alias("__text")).withColumn("__h", F.unhex(F.md5("__text")))
    texts = rows.groupBy("__h", "__text").agg(best("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = (
        texts.where("group_size > 1")
        .select("__h", F.unhex(F.sha2("__text", 256)).alias("__s"), "keep_id", "group_size")
        .groupBy("__h", "__s")
        .agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count(F.lit(1)).alias("__texts"))
        .withColumn("group_size", F.when(F.col("__texts") == 1, F.col("group_size")).otherwise(F.raise_error("two texts share both digests").cast("long")))
        .drop("__texts")
    )
    copies = checkpoint(copies)
    sums = rows.select("__id", "__h", F.unhex(F.sha2("__text", 256)).alias("__s"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return sums.join(copies, ["__h", "__s"], "left").select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("__s")).alias("text_sha256"),
    )


def exact_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns.

    The same grouping as ``exact_dedup``, carrying the row of the best id along, so texts
    are shuffled once. Of rows that repeat both id and text one stays: the least by its
    other columns (for ``max`` the greatest), which must be of types that have an order; a null id
    stays only where a text has no other. Columns may have any names.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    own = [f"c{i}" for i in range(len(docs.columns))]
    row = F.struct(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True) if c != text_col], F.col(text_col).isNull().alias("none"))
    best = F.min_by(row, F.struct(F.col(id_col).isNull(), F.col(id_col), row)) if keep == "min" else F.max_by(row, F.struct(F.col(id_col).isNotNull(), F.col(id_col), row))
    texts = docs.groupBy(F.unhex(F.md5(text_of(docs, text_col))).alias("__h"), text_of(docs, text_col).alias("__text")).agg(best.alias("__row"))
    return texts.select(*[F.when(~F.col("__row.none"), F.col("__text")).alias(c) if c == text_col else F.col(f"__row.{o}").alias(c) for c, o in zip(docs.columns, own, strict=True)])
