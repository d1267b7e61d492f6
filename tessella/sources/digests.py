"""Order-free digests of a table's rows, and runs held against each other by them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def row_md5(df: DataFrame) -> Column:
    """MD5 of a row's values in the order of its columns' names; each with its length, nulls apart.

    Numbers, dates and texts count as Spark casts them to strings, all else as JSON.
    """
    parts = []
    for name, kind in sorted(df.dtypes):
        value = F.to_json(F.struct(F.col(name))) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("N")))
    return F.md5(F.concat_ws("|", *parts))


def digest_columns(df: DataFrame) -> list[Column]:
    """``n_rows, digest_sum, digest_xor``: aggregates that tell a bag of rows, whatever their order.

    The sum takes a row as often as it comes; the xor is of other bits of the hash. Both
    combine before any shuffle, and can be observed while the rows pass by.
    """
    word = lambda start: F.conv(F.substring(row_md5(df), start, 15), 16, 10)
    total = F.coalesce(F.sum(word(1).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
    return [F.count(F.lit(1)).alias("n_rows"), total.cast("string").alias("digest_sum"), F.coalesce(F.bit_xor(word(16).cast("long")), F.lit(0).cast("long")).alias("digest_xor")]


def multiset_digest(df: DataFrame) -> DataFrame:
    """One row, of an empty table too."""
    return df.agg(*digest_columns(df))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and what will hold its digest once an action has run over it: no second pass."""
    seen = Observation(name)
    return df.observe(seen, *digest_columns(df)), seen


def determinism(run: Callable[[DataFrame], DataFrame], source: DataFrame, ways: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``way, n_rows, digest_sum, digest_xor, stable`` of a query on one table partitioned in several ways.

    ``stable`` is false where the runs differ: the query then depends on how its input is
    dealt out, and a retried task may change its result.
    """
    runs = [multiset_digest(run(deal(source))).select(F.lit(name).alias("way"), "*") for name, deal in ways.items()]
    found = reduce(DataFrame.unionByName, runs)
    rows = found.agg(F.array_sort(F.collect_list(F.struct(*found.columns))).alias("runs"))  # one for each way
    same = F.size(F.array_distinct(F.transform("runs", lambda r: F.struct(r["n_rows"], r["digest_sum"], r["digest_xor"])))) == 1
    return rows.select(F.explode("runs").alias("r"), same.alias("stable")).select("r.*", "stable")
