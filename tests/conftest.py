"""One Spark session for all tests, and helpers to hold queries against DuckDB."""

from __future__ import annotations

import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def bag(rows) -> Counter:
    return Counter(repr(tuple(_plain(x) for x in r)) for r in rows)


def oracle(sql: str, folder: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def assert_same(df, sql: str, folder: str = DATA) -> None:
    columns, rows = oracle(sql, folder)
    assert sorted(columns) == sorted(df.columns)
    assert bag([[r[c] for c in columns] for r in df.collect()]) == bag(rows)
