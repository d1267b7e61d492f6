"""Writers for results; Spark decides the number of files unless one is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.operators.ledger import to_flat


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Arrays are written as text, parted by "; "."""
    flat = to_flat(df)
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
