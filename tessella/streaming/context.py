"""Context that a sequence's words carry on, on a stream: state that ends."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: transformWithState keeps its state there.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Carry(StatefulProcessor):
    """What the rows before put on each row of a sequence: their last word, and the mood it hands on.

    A row holds a list of words, so state is read and written once for all of a batch's rows of
    a sequence, and Python sees no single word. The value's time to live is renewed with
    each batch of the sequence; after it the state store drops the value at the end of a
    batch, so a sequence that falls silent leaves nothing behind.
    """

    def __init__(self, seq: str, pos: str, negators: list[str], after: list[str], ttl_ms: int) -> None:
        self.seq, self.pos, self.negators, self.after, self.ttl_ms = seq, pos, negators, after, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "surface string, mood string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before, mood = self.last.get() or (None, None)
        # a batch's rows of a sequence, which one trigger bounds; later batches are later words
        for r in sorted(rows, key=lambda r: r[self.pos]):
            words = r["__words"]
            yield Row(**{self.seq: key[0], self.pos: r[self.pos], "__words": words, "__before": before, "__into": mood})
            idle = words[-1] in self.negators and (words[-2] if len(words) > 1 else before) in self.after
            before, mood = words[-1], None if idle else r["__mood"]
        self.last.update((before, mood))

    def close(self) -> None:
        pass


def carry_mood(tokens: DataFrame, governs: DataFrame, seq: str, pos: str, surface: str = "surface", negators: list[str] = (), after: list[str] = (), ttl_ms: int = 3_600_000) -> DataFrame:
    """``carried_mood`` of each token of a stream, as ``operators.sequence.carry_mood`` has it for a table.

    ``governs`` is a closed list of markers. Tokens of a sequence come in order from batch to
    batch; within one they are put in the order of ``pos``. State is one word a sequence
    and is dropped ``ttl_ms`` after the sequence's last batch, by the value's time to live; a
    sequence that goes on later begins anew. Words without a marker carry null. Needs the
    state store that ``STORE`` names.
    """
    lists = tokens.select(seq, pos, F.array(surface).alias("__list"))
    return carry_mood_lists(lists, governs, seq, pos, "__list", surface, negators, after, ttl_ms)


def carry_mood_lists(lists: DataFrame, governs: DataFrame, seq: str, pos: str, words: str, surface: str = "surface", negators: list[str] = (), after: list[str] = (), ttl_ms: int = 3_600_000) -> DataFrame:
    """The rows of ``carry_mood`` for a stream whose rows hold lists of words; ``pos`` is the place of a list's first one.

    Only what one row hands to the next goes by state; words inside a list look at those
    before them there. Empty and null lists are left out.
    """
    of, moods = lists.schema, governs.select(F.col("marker").alias("__m"), F.col("mood").alias("__mood"))
    rows = lists.where(F.size(words) > 0).select(seq, pos, F.col(words).alias("__words"))
    marked = rows.join(moods, F.element_at("__words", -1) == F.col("__m"), "left").drop("__m")
    schema = T.StructType([T.StructField(seq, of[seq].dataType), T.StructField(pos, of[pos].dataType), T.StructField("__words", of[words].dataType), T.StructField("__before", T.StringType()), T.StructField("__into", T.StringType())])
    held = marked.groupBy(seq).transformWithState(_Carry(seq, pos, list(negators), list(after), ttl_ms), schema, "append", "processingTime")
    # each word with the two before it
    near = F.transform("__words", lambda w, i: F.struct(w.alias("w"), F.get("__words", i - 1).alias("one"), F.when(i == 1, F.col("__before")).otherwise(F.get("__words", i - 2)).alias("two")))
    each = held.select(seq, pos, "__into", F.posexplode(near).alias("__i", "__w"))
    idle = F.col("__w.one").isin(list(negators)) & F.coalesce(F.col("__w.two").isin(list(after)), F.lit(False))
    met = each.join(moods, F.col("__w.one") == F.col("__m"), "left")
    carried = F.when(F.col("__i") == 0, F.col("__into")).when(idle, None).otherwise(F.col("__mood"))
    return met.select(seq, (F.col(pos) + F.col("__i")).cast(of[pos].dataType).alias(pos), F.col("__w.w").alias(surface), carried.alias("carried_mood"))
