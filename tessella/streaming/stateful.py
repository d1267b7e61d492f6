"""The sequence operators on streams: windowed counts and a stateful write guard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.ledger import write_judge


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and sum of each group and window; state of windows older than ``late`` is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def write_guard(log: DataFrame, field: str, order: str, value: str, state: str, terminal: list[str], rank: str, filled: str | None = None) -> DataFrame:
    """``outcome`` of each write of a stream, as ``operators.ledger.guarded_writes`` judges it.

    For each field the state is what it holds: value, state and rank of the last write that
    took effect. A field's rows of one batch are gathered from their pieces and taken in
    ``order``; the size of a batch bounds them. Later batches are later writes.
    """
    schema = f"`{field}` {dict(log.dtypes)[field]}, `{order}` long, outcome string"
    judge = write_judge(terminal, filled)

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(kept.get) if kept.exists else None
        batch = pd.concat([f[[order, value, state, rank]] for f in frames]).sort_values([order, value, state])
        plain = lambda v: None if pd.isna(v) else str(v)
        out = []
        for at, v, s, r in batch.itertuples(index=False):
            outcome, held = judge(held, plain(v), plain(s), None if pd.isna(r) else float(r))
            out.append((key[0], at, outcome))
        kept.update(held)
        yield pd.DataFrame(out, columns=[field, order, "outcome"])

    return log.groupBy(field).applyInPandasWithState(run, schema, "last string, state string, top double", "append", GroupStateTimeout.NoTimeout)
