"""Every query of the reference operators against its DuckDB statement."""

from __future__ import annotations

import importlib

import pytest
from conftest import DATA, assert_same

MODULES = [importlib.import_module(f"tessella.plans.{m}_queries") for m in ("text", "quality", "sequence", "ledger", "lexicon", "arabic", "dictionary", "word", "root", "claim", "span", "derivation", "judgment", "run")]
CASES = [(f, m.ORACLES.get(f.__name__)) for m in MODULES for f in m.QUERIES]


@pytest.mark.parametrize(("query", "sql"), CASES, ids=[f.__name__ for f, _ in CASES])
def test_query(spark, query, sql):
    df = query(spark, DATA)
    if sql is None:
        assert df.count() > 0
    else:
        assert_same(df, sql)


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f.__name__ for f, _ in CASES} <= names
    assert set(entry.oracle_sql()) <= names
    assert entry.entry(spark).count() > 0
