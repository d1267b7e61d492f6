"""Dictionary pages: observations to lines, lines to regions, headings to entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.lineage import checkpoint
from pyspark.sql import types as T

from tessella.operators.quality import share


def group_lines(observations: DataFrame, page: str = "page", y: str = "y", tolerance: float = 0.01) -> DataFrame:
    """``line`` number of each observation of a page.

    Greedy in the order of ``y``: an observation joins the latest line whose running mean
    is within the tolerance. The mean moves with each, so this is no window. Spark sorts a
    page and it streams by: since ``y`` falls, a line once out of reach stays so, and only
    lines within the tolerance are held, however many rows a page has.
    """
    at, y_at = observations.columns.index(page), observations.columns.index(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = object(), 0
        lines: list[list] = []  # number, count and mean of each line within reach
        for batch in batches:
            out = []
            for key, v in zip(batch.column(at).to_pylist(), batch.column(y_at).to_pylist(), strict=True):
                if key != now:
                    now, made, lines = key, 0, []
                if v is None or v != v:
                    out.append(made)
                    made += 1
                    continue
                lines = [x for x in lines if x[2] - v <= tolerance]
                for x in reversed(lines):
                    if abs(x[2] - v) <= tolerance:
                        x[1], x[2] = x[1] + 1, x[2] + (v - x[2]) / (x[1] + 1)
                        break
                else:
                    x = [made, 1, v]
                    lines.append(x)
                    made += 1
                out.append(x[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "line"])

    value = F.col(y).cast("double")
    order = [F.col(page), F.when(~F.isnan(value), value).desc_nulls_last(), F.col("obs_id")]
    schema = T.StructType([*observations.schema, T.StructField("line", T.IntegerType())])
    return observations.repartition(page).sortWithinPartitions(*order).mapInArrow(run, schema)


def merge_lines(lined: DataFrame, page: str = "page", k: int = 3) -> DataFrame:
    """One row for each line: its text from left to right, its box, its best candidates."""
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("confidence")).alias("c"), "text"))), 1, k)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "obs_id", "text"))), lambda o: o["text"]), " ")
    return lined.groupBy(page, "line").agg(
        text.alias("text"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.array_join(F.transform(best, lambda b: b["text"]), "|").alias("candidates"), F.count(F.lit(1)).alias("n"),
    )


def _before(counts: DataFrame, book: str, part: str, n: str) -> DataFrame:
    """``<book>, <part>, before``: the sum of ``n`` over the earlier parts of a book.

    Parts are dealt by ranges and kept so; a window over the ranges' sums, one row for each
    range of a book, and one within each range give the prefix sums. No task holds more
    than a range.
    """
    ranged = checkpoint(counts.repartitionByRange(book, part).select("*", F.spark_partition_id().alias("__r")))
    sums = ranged.groupBy(book, "__r").agg(F.sum(n).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(book).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    past = sums.select(F.col(book).alias("__b"), F.col("__r").alias("__range"), F.coalesce(earlier, F.lit(0)).alias("__past"))
    within = F.sum(n).over(Window.partitionBy(book, "__r").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranged.withColumn("__within", F.coalesce(within, F.lit(0)))
    met = rows.join(past, F.col(book).eqNullSafe(F.col("__b")) & (F.col("__r") == F.col("__range")))
    return met.select(book, part, (F.col("__past") + F.col("__within")).alias("before"))


def entries(lines: DataFrame, book: str, part: str, k: str, heading: Column, text: str, origin: str) -> DataFrame:
    """A heading opens an entry; lines belong to it until the next, across pages and parts.

    A book's lines are in order of ``part`` and ``k``, which name a line: ``first_part``, ``first_k``,
    ``last_part`` and ``last_k`` tell where an entry begins and ends. The first line that
    matches ``origin`` gives the entry's origin and makes it AUTO. Lines before the first
    heading belong to no entry. Headings are numbered within each part, and after those of
    earlier parts, so no task sorts a whole book.
    """
    rows = lines.withColumn("__h", heading)
    h = F.col("__h").cast("int")
    counts = rows.groupBy(book, part).agg(F.coalesce(F.sum(h), F.lit(0)).alias("__n"))
    before = _before(counts, book, part, "__n").withColumnsRenamed({book: "__book", part: "__part"})
    order = Window.partitionBy(book, part).orderBy(k)
    rows = rows.withColumn("__in", F.coalesce(F.sum(h).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.join(before, F.col(book).eqNullSafe(F.col("__book")) & F.col(part).eqNullSafe(F.col("__part")))
    rows = rows.withColumn("entry", F.col("before") + F.col("__in")).where("entry > 0")
    at = F.struct(F.col(part).alias("part"), F.col(k).alias("k"))
    found = F.min_by(text, F.when(~F.col("__h") & F.col(text).rlike(origin), at))
    made = rows.groupBy(book, "entry").agg(
        F.min_by(text, at).alias("heading"), (F.count(F.lit(1)) - 1).alias("n_lines"), found.alias("origin"), F.when(found.isNotNull(), "AUTO").otherwise("REVIEW").alias("status"), F.min(at).alias("__first"), F.max(at).alias("__last")
    )
    ends = [F.col(f"__{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("part", "k")]
    return made.select(book, "entry", "heading", "n_lines", "origin", "status", *ends)


def region(x0: Column, x1: Column, y: Column, width: Column, heading: Column) -> Column:
    """Type of a line by its place: header, footnote, heading, poetry (narrow and centred) or body."""
    narrow = (x1 - x0) < width * 0.55
    centred = F.abs((x0 + x1) / 2 - width / 2) < width * 0.1
    return F.when(y > 0.93, "HEADER").when(heading, "HEADING").when(y < 0.12, "FOOTNOTE").when(narrow & centred, "POETRY").otherwise("BODY")


def coverage_report(entry: DataFrame, expected: DataFrame) -> DataFrame:
    """Entries by first letter against what is expected: ``letter, n, auto, expected, auto_rate, thin``."""
    letter = F.substring("heading", 1, 1)
    seen = entry.groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "AUTO").alias("auto"))
    out = expected.join(seen, "letter", "left").select("letter", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("auto", F.lit(0)).alias("auto"), "expected")
    return out.select("*", share(F.col("auto"), F.col("n")).alias("auto_rate"), (F.col("n") < F.col("expected") * 0.2).alias("thin"))


def should_repair(stored: Column, parsed: Column) -> Column:
    """``repair, reason``: whether a parsed root replaces a stored one."""
    blank = F.coalesce(stored, F.lit("")) == ""
    pairs = F.zip_with(F.split(stored, ""), F.split(parsed, ""), lambda a, b: (a != b).cast("int"))
    differ = F.aggregate(pairs, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(1)))
    swapped = F.array_join(F.array_sort(F.split(stored, "")), "") == F.array_join(F.array_sort(F.split(parsed, "")), "")
    reason = (
        F.when(F.coalesce(parsed, F.lit("")) == "", "NO_PARSE").when(blank, "WAS_BLANK").when(stored == parsed, "SAME").when(~F.length(parsed).between(2, 4), "BAD_LENGTH")
        .when(swapped, "SWAP").when(F.substring(stored, 1, 1) != F.substring(parsed, 1, 1), "FIRST_LETTER").when(differ == 1, "ONE_RADICAL").otherwise("TOO_DIFFERENT")
    )
    return F.struct(reason.isin("WAS_BLANK", "ONE_RADICAL", "SWAP").alias("repair"), reason.alias("reason"))
