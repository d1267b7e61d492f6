"""Inverse morphology: every form that a generator makes, indexed by its surface."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """How a stem takes a feature: if it ends so, that many letters go and these come."""

    feature: str
    ending: str
    strip: int
    add: str


def _form(stem: Column, rules: list[Rule]) -> Column:
    """The form by the first rule that the stem's ending fits; null if none does or nothing of the stem is left."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        fits = stem.endswith(r.ending) & (F.length(stem) > r.strip)
        out = F.when(fits, F.concat(F.left(stem, F.length(stem) - r.strip), F.lit(r.add))).otherwise(out)
    return out


def generate(stems: DataFrame, stem: str, rules: list[Rule]) -> DataFrame:
    """``root, feature, surface``: each distinct stem in each of its forms.

    Rules of a feature are tried in their order. Rules are a closed list and unfold inside a
    row; only the stems are shuffled, to be made distinct.
    """
    features = list(dict.fromkeys(r.feature for r in rules))
    forms = [F.struct(F.lit(f).alias("feature"), _form(F.col("root"), [r for r in rules if r.feature == f]).alias("surface")) for f in features]
    distinct = stems.select(F.col(stem).alias("root")).where("length(root) > 0").distinct()
    return distinct.select("root", F.inline(F.array(*forms))).where("surface IS NOT NULL")


def write_index(generated: DataFrame, table: str, buckets: int) -> None:
    """Keep generated forms as a table bucketed and sorted by surface, which lookups join to without a shuffle of it."""
    generated.write.bucketBy(buckets, "surface").sortBy("surface").saveAsTable(table)


def analyse(words: DataFrame, word_id: str, word: str, index: DataFrame) -> DataFrame:
    """``<word_id>, root, feature, n_roots, verdict``: all readings of each word.

    Readings come from one equi-join to the index of forms. A word whose readings agree on
    a root is ACCEPTed, with a row for each of its features; one that several roots make is
    DEFERred and keeps them all; a word that nothing makes is a row of its own, UNKNOWN. Null
    words are UNKNOWN.
    """
    readings = index.select(F.col("surface").alias("__surface"), "root", "feature")
    # how many roots make a surface is a property of the index: counted there, once
    roots = index.groupBy("surface").agg(F.count_distinct("root").alias("n_roots")).withColumnRenamed("surface", "__surface")
    found = words.select(word_id, F.col(word).alias("__surface")).join(readings.join(roots, "__surface"), "__surface", "left")
    verdict = F.when(F.col("n_roots") == 1, "ACCEPT").when(F.col("n_roots") > 1, "DEFER").otherwise("UNKNOWN")
    return found.select(word_id, "root", "feature", F.coalesce("n_roots", F.lit(0).cast("long")).alias("n_roots"), verdict.alias("verdict"))
