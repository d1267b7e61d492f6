"""Execution ledger: every item at every stage, its checks, summaries and hash chain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stage identifiers in order, and the scope from which each applies.
STAGES = [
    (1, "P0_UNICODE_CANDIDATE", "TOKEN"),
    (2, "P0_TYPED_CODEPOINT", "TOKEN"),
    (3, "P0_GLYPH_CLASSIFICATION", "TOKEN"),
    (4, "P1_LETTER_IDENTITY_CARRIER", "TOKEN"),
    (5, "P1_HARAKA_MARK_IDENTITY_CARRIER", "TOKEN"),
    (6, "P1_CONDITIONED_TYPED_SEQUENCE", "TOKEN"),
    (7, "P1_POSITION_CARRIER", "TOKEN"),
    (8, "P1_SLOT_CANDIDATE", "TOKEN"),
    (9, "P2_REGISTRY_PROJECTION", "TOKEN"),
    (10, "P3_ROOT_STEM_CLOSURE", "TOKEN"),
    (11, "P4_JAMID_MUSHTAQ", "TOKEN"),
    (12, "P5_MUFRAD_WORD_CONTRACTS", "TOKEN"),
    (13, "P6_VERBAL_SIGNIFIED_ALONE", "TOKEN"),
    (14, "P7_COMPOSITION_READINESS", "TOKEN"),
    (15, "P8_AMIL_MAMUL", "TOKEN"),
    (16, "P9_SENTENCE_GEOMETRY", "SENTENCE"),
    (17, "P10_RELATION_GEOMETRY", "SENTENCE"),
    (18, "P11_IRAB_GEOMETRY", "SENTENCE"),
    (19, "P12_IFADAH_SPEECH_FORCE", "SENTENCE"),
]


def free(taken: list[str], *names: str) -> list[str]:
    """These names, with underscores before those that a column has."""
    return ["_" * next(i for i in range(99) if "_" * i + n not in taken) + n for n in names]


def densify(executed: DataFrame, item: str) -> DataFrame:
    """One row for each item and stage: ``ordinal, stage_id, status, executed``.

    ``executed(item, ordinal, status)``. A token stage without a record was NOT_OPENED; a
    stage of wider scope is NOT_APPLICABLE_AT_TOKEN_SCOPE. An item's stages are columns of
    one aggregation and are spread over the fixed list, so no item is joined with the list and
    records are dealt and sorted by item once.
    """
    dealt = executed.select(item, "ordinal", "status").repartition(F.col(item)).sortWithinPartitions(item)
    done = dealt.groupBy(item).agg(*[F.max(F.when(F.col("ordinal") == o, F.col("status"))).alias(f"__{o}") for o, _, scope in STAGES if scope == "TOKEN"])
    fixed = F.array(*[
        F.struct(F.lit(o).alias("ordinal"), F.lit(s).alias("stage_id"), F.lit(c).alias("scope"), (F.col(f"__{o}") if c == "TOKEN" else F.lit(None).cast("string")).alias("own")) for o, s, c in STAGES
    ])
    rows = done.select(item, F.inline(fixed))
    status = F.when(F.col("scope") != "TOKEN", "NOT_APPLICABLE_AT_TOKEN_SCOPE").otherwise(F.coalesce("own", F.lit("NOT_OPENED")))
    return rows.select(item, "ordinal", "stage_id", status.alias("status"), F.col("own").isNotNull().alias("executed"))


def missing_stages(records: DataFrame, item: str) -> DataFrame:
    """``item, n_missing``: items that do not have all stages."""
    return records.groupBy(item).agg((F.lit(len(STAGES)) - F.count_distinct("ordinal")).alias("n_missing")).where("n_missing > 0")


def impossible(records: DataFrame) -> DataFrame:
    """Records that claim an execution that did not happen."""
    return records.where(F.col("status").startswith("EXECUTED_") & ~F.col("executed"))


def summary(records: DataFrame, item: str, approved: str, stopped: list[str]) -> DataFrame:
    """Executed stages, the last approved one and the last stop of each item, by the fixed list of stages.

    Only numbers are aggregated, so records are not sorted; the stage of a number comes after.
    """
    at = lambda cond: F.max(F.when(cond, F.col("ordinal")))
    found = records.groupBy(item).agg(
        F.count_if("executed").alias("n_executed"),
        F.count_if(F.col("status") == "NOT_OPENED").alias("n_not_opened"),
        at(F.col("status") == approved).alias("last_approved"),
        at(F.col("status").isin(stopped)).alias("last_stop"),
    )
    stage = lambda c: F.get(F.array(*[F.lit(s) for _, s, _ in STAGES]), F.col(c) - 1).alias(c)
    return found.select(item, "n_executed", "n_not_opened", stage("last_approved"), stage("last_stop"))


def broken_order(records: DataFrame, item: str, accept: str) -> DataFrame:
    """Accepted stages whose predecessor in the ledger was not accepted."""
    order = Window.partitionBy(item).orderBy("ordinal", "status")
    before = F.lag("status").over(order)
    return records.withColumn("before", before).where((F.col("status") == accept) & F.col("before").isNotNull() & (F.col("before") != accept)).select(item, "ordinal", "status", "before")


def to_json(records: DataFrame, item: str) -> DataFrame:
    """One JSON document for each item, its stages in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "stage_id", "status", "executed")))
    return records.groupBy(item).agg(parts.alias("records")).select(item, F.to_json(F.struct(item, "records")).alias("json"))


def to_flat(df: DataFrame) -> DataFrame:
    """Arrays as text, parted by "; ", for CSV."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def layers(df: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """One row for each item and layer."""
    return df.select(item, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(item, fields, "layer", "value")


def certificate_chain(records: DataFrame, item: str, pos: str, value: str, certified: str) -> DataFrame:
    """``head, verdict`` of each item's ordered records; each link hashes the one before it.

    A certified record after one that is not is a jump. Verdict: NO_JUMP_VIOLATION over
    ALL_CERTIFIED over HONEST_DEFER (some certified) over CLOSED.
    """
    rows = records.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("__r"))
    values = F.transform("__r", lambda r: r["v"])
    head = F.aggregate(values, F.lit(""), lambda acc, v: F.sha2(F.concat(acc, F.lit("|"), v), 256))
    after = F.arrays_zip(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))).alias("a"), F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))).alias("b"))
    jump = F.exists(after, lambda x: (x["a"] != certified) & (x["b"] == certified))
    verdict = F.when(jump, "NO_JUMP_VIOLATION").when(F.forall(values, lambda v: v == certified), "ALL_CERTIFIED").when(F.exists(values, lambda v: v == certified), "HONEST_DEFER").otherwise("CLOSED")
    return rows.select(item, F.size(values).alias("links"), head.alias("head"), verdict.alias("verdict"))


def propositions(relations: DataFrame, clause: str) -> DataFrame:
    """Approved where a clause has a closed relation: its shape, and the best rank up to 4."""
    closed = F.col("status") == "CLOSED"
    types = F.array_join(F.array_sort(F.collect_set(F.when(closed, F.col("relation")))), "+")
    return relations.groupBy(clause).agg(
        F.count_if(closed).alias("n_closed"),
        F.when(F.count_if(closed) > 0, "APPROVED").otherwise("DEFERRED").alias("verdict"),
        types.alias("shape"),
        F.least(F.coalesce(F.max(F.when(closed, F.col("confidence"))), F.lit(0)), F.lit(4)).alias("rank"),
    )


def rulings(propositions: DataFrame, modality: Column) -> DataFrame:
    """A ruling for each approved proposition."""
    return propositions.withColumn("ruling", F.when(F.col("verdict") == "APPROVED", modality))


def answer_audit(leaps: Column, residuals: Column) -> Column:
    """Leaps block, residuals defer, else approved; arguments are arrays."""
    return F.when(F.size(leaps) > 0, "BLOCKED").when(F.size(residuals) > 0, "DEFERRED").otherwise("APPROVED")


def write_judge(terminal: list[str], filled: str | None = None) -> Callable:
    """A function of what a field holds and a write to it: the outcome, and what the field holds then.

    Held is None or (value, state, rank) of the last write that took effect; refused writes
    change nothing.
    """

    def judge(held: tuple | None, value: object, state: str | None, rank: float | None, allowed: bool = True) -> tuple[str, tuple | None]:
        if not allowed:
            return "NON_OWNER", held
        if held is not None:
            last, was, top = held
            if value == last:
                return "IDEMPOTENT", held
            if was in terminal:
                return "TERMINAL", held
            if filled is not None and was == state == filled:
                return "VALUE_CHANGE", held
            if top is not None and (rank is None or rank < top):
                return "DOWNGRADE", held
        return "WRITTEN", (value, state, rank)

    return judge


def guarded_writes(log: DataFrame, field: str, order: str, value: str, state: str, terminal: list[str], rank: Column, allowed: Column | None = None, filled: str | None = None) -> DataFrame:
    """``outcome`` of each write of an ordered log, all columns kept.

    In this order: NON_OWNER where ``allowed`` is false; IDEMPOTENT for the value that the
    field holds; TERMINAL after a terminal state; VALUE_CHANGE of a value in the state
    ``filled``; DOWNGRADE to a lower rank; else WRITTEN. Each write is judged by the last one
    that took effect, so a field's log is read in order, as a stream: a task holds a
    batch and one value. Null values are values; a null rank is below all others. Fields
    are dealt over tasks; equal orders of a field follow each other by value and state.
    """
    names = free(log.columns, "value", "state", "rank", "allowed")
    extra = [F.col(value).cast("string"), F.col(state), rank.cast("double"), F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)]
    rows = log.select("*", *[c.alias(n) for c, n in zip(extra, names, strict=False)])
    rows = rows.repartition(F.col(field)).sortWithinPartitions(field, order, value, state)
    width, at, names, judge = len(log.columns), log.columns.index(field), [*log.columns, "outcome"], write_judge(terminal, filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), None
        for batch in batches:
            out = []
            for key, *write in zip(*(batch.column(i).to_pylist() for i in (at, *range(width, width + 4))), strict=True):
                if key != now:
                    now, held = key, None
                outcome, held = judge(held, *write)
                out.append(outcome)
            yield pa.record_batch([*batch.columns[:width], pa.array(out, pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*log.schema.fields, T.StructField("outcome", T.StringType())]))
