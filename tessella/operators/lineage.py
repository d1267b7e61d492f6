"""Cutting lineage in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """A replicated copy in the folder of ``spark.checkpoint.dir``; below the warehouse where a session names none, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as Parquet in a new folder there: columns in place of serialised rows, for large tables."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
