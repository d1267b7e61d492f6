"""Counting, first-wins dedup, top-k, invariants and snapshot comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; unlike ``dropDuplicates`` it says which.

    An aggregation of the row of least order, so a hot key is combined before the shuffle.
    """
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("__key")).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, salt: int = 16) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; ``order`` must be total.

    Each of ``salt`` slices of a group is cut to ``k`` first, so a hot group is never
    sorted in one task.
    """
    cut = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    cut = cut.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__s").orderBy(*order))).where(F.col("__r") <= k)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).drop("__s", "__r")


def best_candidates(df: DataFrame, by: list[str], text: str, score: str, k: int = 3) -> DataFrame:
    """One row for each text with its best score, the best ``k`` of each group."""
    best = df.groupBy(*by, text).agg(F.max(score).alias(score))
    return top_per_group(best, by, [F.col(score).desc(), F.col(text)], k)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, half to even; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * part / whole, digits))


def coverage(df: DataFrame, by: str, hit: Column, distinct: str) -> DataFrame:
    """Rows, hits, hit rate and distinct values of each group."""
    hits = F.count_if(hit)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), share(hits, F.count(F.lit(1))).alias("hit_rate"), F.count_distinct(distinct).alias("n_distinct"))


def below_ratio(df: DataFrame, by: str, expected: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Groups with less than ``ratio`` of their expected rows, none at all included."""
    seen = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return expected.join(seen, by, "left").select(by, "expected", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < F.lit(ratio) * F.col("expected"))


def invariants(df: DataFrame, rules: dict[str, Column], key: Column, offenders: int = 25) -> DataFrame:
    """``rule, n, first_offenders``: rows that break each rule, and the least keys of those.

    One pass; the rows are unpivoted only where they break a rule, and offenders are cut
    in each task by the aggregation of a sorted, bounded list.
    """
    broken = df.select(key.alias("key"), F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())).alias("rule"))
    counts = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_per_group(broken.distinct(), ["rule"], [F.col("key")], offenders)
    listed = ranked.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"].cast("string")), ",").alias("first_offenders"))
    every = df.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    return every.join(counts, "rule", "left").join(listed, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_offenders", F.lit("")).alias("first_offenders"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], declared: DataFrame | None = None) -> DataFrame:
    """``<key>, field, old, new`` where two snapshots differ, less the declared changes.

    Both are unpivoted and joined in full; null equals null, and a missing row differs in
    all fields that the other has.
    """
    long = lambda df, name: df.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(key, fields, "field", name)
    out = long(old, "old").join(long(new, "new"), [key, "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return out if declared is None else out.join(declared, [key, "field"], "left_anti")


def check_gold(rows: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``field, checked, wrong``: a null in ``gold`` leaves a field open; a missing row is wrong."""
    a, b = rows.alias("a"), gold.alias("b")
    joined = b.join(a, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("string").alias("is"), F.col(f"b.{f}").cast("string").alias("should")) for f in fields])
    long = joined.select(F.explode(pairs).alias("p")).select("p.*").where("should is not null")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("is").eqNullSafe(F.col("should"))).alias("wrong"))


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def not_measured(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """Declared rows that were not measured, as a set."""
    return declared.subtract(measured)


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows, mean and median of each group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))
