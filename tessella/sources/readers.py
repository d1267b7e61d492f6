"""Readers with explicit schemas, and the checks that a catalog must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; a bad line stops the read, blank ones are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all values as text; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def csv_folder(spark: SparkSession, path: str, columns: list[str], either: dict[str, list[str]], skip: list[str] = ()) -> DataFrame:
    """All CSV files of a folder with their names; a column may go by one of several names."""
    rows = spark.read.csv(path, header=True, pathGlobFilter="*.csv").withColumn("source", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    rows = rows.where(~F.col("source").isin(list(skip))) if skip else rows
    have = set(rows.columns)
    pick = lambda c: F.coalesce(*[F.col(n) for n in either.get(c, [c]) if n in have], F.lit(None).cast("string")).alias(c)
    return rows.select(*[pick(c) for c in columns], "source")


def catalog(spark: SparkSession, path: str, schema: StructType | str, entries: str, key: str) -> DataFrame:
    """Rows of a JSON catalog's list; a missing key, an empty list or a repeated key stops the read."""
    rows = json_document(spark, path, schema).select(F.explode_outer(entries).alias("e")).select("e.*")
    problems = catalog_violations(rows, key).limit(5).collect()
    if problems:
        raise ValueError(f"catalog {path}: {problems}")
    return rows


def catalog_violations(rows: DataFrame, key: str) -> DataFrame:
    """``rule, key``: what is wrong with a catalog."""
    missing = rows.where(F.col(key).isNull()).select(F.lit("MISSING_KEY").alias("rule"), F.lit(None).cast("string").alias("key"))
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.lit("REPEATED_KEY"), F.col(key).cast("string"))
    return missing.union(twice)


def corpus_violations(cases: DataFrame, case_id: str, domains: dict[str, list[str]], required: list[str], declared: int | None = None) -> DataFrame:
    """``case_id, rule``: repeated ids, blank fields, values outside their domain, a wrong count."""
    rules = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"blank:{c}")) for c in required]
    rules += [F.when(~F.coalesce(F.col(c).isin(v), F.lit(False)), F.lit(f"domain:{c}")) for c, v in domains.items()]
    row = cases.select(F.col(case_id).cast("string").alias("case_id"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    twice = cases.groupBy(F.col(case_id).cast("string").alias("case_id")).count().where("count > 1").select("case_id", F.lit("repeated").alias("rule"))
    out = row.unionByName(twice)
    if declared is not None:
        total = cases.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != declared)
        out = out.unionByName(total.select(F.lit(None).cast("string").alias("case_id"), F.lit("count").alias("rule")))
    return out


def registry_violations(stages: DataFrame) -> DataFrame:
    """``ordinal, rule`` of a stage list: each stage follows the one before it, the last is terminal."""
    from pyspark.sql import Window

    order = Window.orderBy("ordinal")  # a list of a few dozen stages
    rows = stages.withColumns({"__before": F.lag("stage_id").over(order), "__last": F.lead("stage_id").over(order).isNull()})
    wrong = F.array_compact(F.array(F.when(~F.col("predecessor").eqNullSafe(F.col("__before")), "predecessor"), F.when(F.col("terminal") != F.col("__last"), "terminal")))
    return rows.select("ordinal", F.explode(wrong).alias("rule"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file: ``name, sha256``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def drifted(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``name, problem``: files of the manifest that are missing or have changed."""
    both = manifest.alias("m").join(found.alias("f"), "name", "left")
    return both.where(~F.col("m.sha256").eqNullSafe(F.col("f.sha256"))).select("name", F.when(F.col("f.sha256").isNull(), "MISSING").otherwise("DRIFTED").alias("problem"))
