"""Helpers shared by the document operators: reading, checkpoints, worker imports."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_workers(df: DataFrame) -> DataFrame:
    """Let Python workers find this package even if the driver was started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])
    return df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a replicated copy in the shared folder of ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) is a folder below the
    warehouse used instead; nothing is ever put into a machine's own temp folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or df.sparkSession.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return df.checkpoint(eager=True)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def free(taken: list[str], *names: str) -> list[str]:
    """These names, each with so many underscores before it that no column has it (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder that the session names for checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
