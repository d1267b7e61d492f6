"""Conversation structure repair: cheapest edits of turns, one dynamic programme over a shared trie.

A conversation's rows become a signature, one letter a row for its role and fault. The
signatures are sorted and inserted into a prefix trie; a node holds the layer of the
programme after its prefix, so a prefix that many conversations share is computed once.
The answer of a signature is read at its terminal node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, with_workers

#: Fixed costs: a turn is kept for nothing; a truncated one that is not deleted costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space that makes a text blank.
SPACES = " \t\n\x0b\x0c\r"
#: Where a role takes each state of ``(s?(ua)+)?``: 0 before all, 1 after s, 2 after u, 3 after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
#: Letters of a signature by role (s, u, a, any other, an empty one that has no initial and so
#: may stay anywhere): a sound turn and a truncated one. A blank or repeated turn must go
#: whatever its role.
SOUND, CUT, MUST_GO = b"suaoe", b"SUAOE", b"x"
FINE, BLANK, DUPLICATE, TRUNCATION = range(4)

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class Layer(NamedTuple):
    """The cheapest edits of a prefix that end in each state, and in a row's own edit.

    ``cost`` is counted from the least one, which ``base`` adds up. ``rank`` orders the audits
    of the states. None of them is a prefix of another, as each has the same number of
    rows' edits and ends in one, so what is appended never turns their order round.
    ``back`` holds the state before and what this row appended.
    """

    base: int
    cost: tuple[float, ...]
    rank: tuple[int, ...]
    back: tuple[tuple[int, str], ...]


NONE = float("inf")
ROOT = Layer(0, (0, NONE, NONE, NONE), (0, 0, 0, 0), ((0, ""),) * 4)


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """Inserts before an edit, and the state they lead to; after two, states come again."""
    for n in range(3):
        yield n, state
        state = 3 if state == 2 else 2


def _edits(letter: str) -> list[tuple[int, int, int, str]]:
    """All ways past a row: state before, state after, cost, what the audit gains."""
    out = []
    extra = TRUNCATED if letter.isupper() else 0
    for begin in range(4):
        for n, at in _inserted(begin):
            out.append((begin, at, INSERT * n + DELETE, "I" * n + "D"))
            if letter == "x":
                continue
            if letter in "eE":
                out.append((begin, at, INSERT * n + extra, "I" * n + "K"))
            if (at, letter.lower()) in NEXT:
                out.append((begin, NEXT[at, letter.lower()], INSERT * n + extra, "I" * n + "K"))
            out += [(begin, NEXT[at, role], INSERT * n + REROLE + extra, "I" * n + "R") for role in "ua" if (at, role) in NEXT]
    return out


EDITS = {letter: _edits(letter) for letter in (SOUND + CUT + MUST_GO).decode()}


@lru_cache(maxsize=1 << 16)
def _step(cost: tuple[float, ...], rank: tuple[int, ...], letter: str) -> Layer:
    best: dict[int, tuple[float, int, str, int]] = {}
    for begin, end, more, piece in EDITS[letter]:
        if cost[begin] < NONE:
            way = (cost[begin] + more, rank[begin], piece, begin)
            best[end] = min(best.get(end, way), way)
    least = min(way[0] for way in best.values())
    order = {end: k for k, end in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
    return Layer(
        int(least),
        tuple(best[s][0] - least if s in best else NONE for s in range(4)),
        tuple(order.get(s, 0) for s in range(4)),
        tuple((best[s][3], best[s][2]) if s in best else (0, "") for s in range(4)),
    )


class Trie:
    """A prefix trie of signatures that come sorted.

    Only the path to the latest signature is held: sorted signatures never come back to a
    branch they have left. ``made`` counts the layers that were computed.
    """

    def __init__(self) -> None:
        self.key, self.path, self.answer, self.made = "", [ROOT], (0, ""), 0

    def insert(self, signature: str) -> tuple[int, str]:
        """Cost and audit of the cheapest edits; of equally cheap ones the least in ASCII."""
        if signature == self.key:
            return self.answer
        shared, most = 0, min(len(signature), len(self.key))
        while shared < most and signature[shared] == self.key[shared]:
            shared += 1
        del self.path[shared + 1 :]
        for letter in signature[shared:]:
            last = self.path[-1]
            layer = _step(last.cost, last.rank, letter)
            self.path.append(layer._replace(base=last.base + layer.base))
            self.made += 1
        self.key, self.answer = signature, self._terminal()
        return self.answer

    def _terminal(self) -> tuple[int, str]:
        last = self.path[-1]
        cost, _, tail, state = min((last.cost[s] + INSERT * n, last.rank[s], "I" * n, s) for s in range(4) for n, at in _inserted(s) if at in ACCEPTING)
        pieces = [tail]
        for layer in reversed(self.path[1:]):
            state, piece = layer.back[state]
            pieces.append(piece)
        return last.base + int(cost), "".join(reversed(pieces))


def blank(text: Column) -> Column:
    """A text of nothing but spaces, tabs and line ends."""
    return F.rtrim(text, F.lit(SPACES)) == ""


def truncated(text: Column) -> Column:
    """A text whose last character, white space aside, ends no sentence."""
    return ~F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1).isin(".", "!", "?")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _slim(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows as ``id, turn, role, digest, copies, code, fault``, without their texts.

    Equal rows of a turn are counted before the shuffle. A row is a duplicate if its role
    and text came at an earlier turn; what a row repeats itself, its copies tell.
    """
    text = F.col("text")
    seen = rows.select("id", "turn", "role", _digest(text).alias("digest"), F.when(blank(text), BLANK).when(truncated(text), TRUNCATION).otherwise(FINE).alias("own"))
    counted = seen.groupBy("id", "turn", "role", "digest", "own").agg(F.count("*").alias("copies"))
    if ids is not None:
        none = counted.schema
        counted = counted.unionByName(ids.distinct().select("id", *(F.lit(c).cast(none[f].dataType).alias(f) for f, c in (("turn", None), ("role", ""), ("digest", None), ("own", BLANK), ("copies", 0)))))
    first = F.row_number().over(Window.partitionBy("id", "role", "digest").orderBy("turn")) == 1
    initial = F.substring("role", 1, 1)
    return counted.repartition("id").select(
        "id", "turn", "role", "digest", "copies",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).when(initial == "", 4).otherwise(3).alias("code"),
        F.when((F.col("own") == BLANK) | first, F.col("own")).otherwise(DUPLICATE).cast("int").alias("fault"),
    )


class _Open:
    """What is known of the conversation whose rows are passing by."""

    def __init__(self) -> None:
        self.letters: list[bytes] = []
        self.last = -1
        self.faults = np.zeros(4, np.int64)
        self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turns: list[int | None], copies: np.ndarray, code: np.ndarray, fault: np.ndarray) -> None:
        for t, n in zip(turns, copies.tolist(), strict=True):
            if t is not None and n:
                self.turns += t != self.most  # they ascend
                self.most = t
                self.least = t if self.least is None else self.least
        again = np.where(fault == BLANK, BLANK, DUPLICATE)
        first = np.cumsum(copies) - copies
        code, all_faults = np.repeat(code, copies), np.repeat(again, copies)
        all_faults[first[copies > 0]] = fault[copies > 0]
        self.faults += np.bincount(all_faults, minlength=4)
        before = np.concatenate(([self.last], code[:-1])) if len(code) else code
        # su, ua and au are legal; nothing is before the first
        legal = (before == -1) | ((code == 1) & ((before == 0) | (before == 2))) | ((code == 2) & (before == 1))
        self.illegal += int((~legal).sum())
        letters = np.where(all_faults == TRUNCATION, np.frombuffer(CUT, np.uint8)[code], np.frombuffer(SOUND, np.uint8)[code])
        self.letters.append(np.where((all_faults == BLANK) | (all_faults == DUPLICATE), MUST_GO[0], letters).astype(np.uint8).tobytes())
        if len(code):
            self.last = int(code[-1])

    def row(self) -> list[Any]:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return [b"".join(self.letters).decode(), gaps, *(int(self.faults[f]) for f in (BLANK, DUPLICATE, TRUNCATION)), self.illegal]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, is_open = None, None
    names = ["id", "signature", *COUNTS]
    for batch in batches:
        ids, turns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        copies, code, fault = (batch.column(k).to_numpy() for k in (2, 3, 4))
        out: list[list[Any]] = []
        cuts = [k for k in range(1, len(ids)) if ids[k] != ids[k - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if is_open is None or ids[a] != now:
                if is_open is not None:
                    out.append([now, *is_open.row()])
                now, is_open = ids[a], _Open()
            is_open.add(turns[a:b], copies[a:b], code[a:b], fault[a:b])
        kind = batch.schema.field(0).type
        yield _batch(out, names, kind)
    if is_open is not None:
        yield _batch([[now, *is_open.row()]], names, kind)


def _batch(rows: list[list[Any]], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = [id_type, pa.string(), *[pa.int64()] * (len(names) - 2)]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        found = [trie.insert(s) for s in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [batch.column(0), *batch.columns[2:], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            names=["id", *COUNTS, "cost", "audit"],
        )


def _fields(id_type: T.DataType, *names: str) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *(T.StructField(n, T.StringType() if n in ("signature", "audit", "role", "text", "edit") else T.LongType()) for n in names)])


def _audits(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``id``, counts, ``cost`` and ``audit`` of each conversation."""
    id_type = rows.schema["id"].dataType
    ordered = _slim(rows, ids).sortWithinPartitions("id", "turn", "role", "digest").select("id", "turn", "copies", "code", "fault")
    signed = checkpoint(with_workers(ordered).mapInArrow(_signatures, _fields(id_type, "signature", *COUNTS)))
    # a signature that very many conversations have is dealt to many tasks, by their ids
    sorted_ = signed.repartitionByRange("signature", F.xxhash64("id")).sortWithinPartitions("signature")
    return sorted_.mapInArrow(_answers, _fields(id_type, *COUNTS, "cost", "audit"))


def _named(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Any] | None, str, str, str]]:
    """Edited turns as (None, edit, role, text); before those of a conversation (its head, '', '', '').

    A conversation's audit row comes first and its texts follow in order, so that one text
    at a time is held. The role that an edit gives follows from the turns before it.
    """
    head: list[Any] = []
    audit, at, state = "", 0, 0

    def inserts() -> Iterator[tuple[None, str, str, str]]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, 3 if state == 2 else 2
            yield None, "I", "assistant" if state == 3 else "user", ""

    for batch in batches:
        texts, roles = batch.column("text"), batch.column("role")
        heads = [batch.column(n).to_pylist() for n in ["id", "audit", *COUNTS, "cost"]]
        for k in range(batch.num_rows):
            if heads[1][k] is not None:
                yield from inserts()
                head = [h[k] for h in heads]
                audit, at, state = head[1], 0, 0
                yield head, "", "", ""
                continue
            yield from inserts()
            edit, at = audit[at : at + 1], at + 1
            if edit == "D":
                yield None, "D", "", ""
                continue
            if edit == "R":
                state = 3 if state == 2 else 2
                role = "assistant" if state == 3 else "user"
            else:
                role = roles[k].as_py()
                state = NEXT[state, role[0]] if role else state
            yield None, edit, role, texts[k].as_py()
    yield from inserts()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", *COUNTS, "cost", "audit", "sha256"]
    now, sha, begun, kind = None, None, False, None
    out: list[list[Any]] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.record_batch([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names=names)

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("id").type
            yield batch

    for head, edit, role, text in _turns(watched()):
        if head is not None:
            if sha is not None:
                out.append([*now, sha.hexdigest()])
            now, sha, begun = [head[0], *head[2:], head[1]], hashlib.sha256(), False
            if len(out) >= 10_000:
                yield made()
        elif edit != "D":
            sha.update(f"{'' if not begun else chr(10)}{role}:{text}".encode())
            begun = True
    if sha is not None:
        out.append([*now, sha.hexdigest()])
        yield made()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, now, position, size = None, None, 0, 0
    out: list[tuple[Any, ...]] = []

    def made() -> pa.RecordBatch:
        ids, positions, edits, roles, texts = zip(*out, strict=True)
        out.clear()
        return pa.record_batch([pa.array(ids, kind), pa.array(positions, pa.int64()), *(pa.array(c, pa.string()) for c in (edits, roles, texts))], names=["id", "position", "edit", "role", "text"])

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("id").type
            yield batch

    for head, edit, role, text in _turns(watched()):
        if head is not None:
            now, position = head[0], 0
        elif edit != "D":
            out.append((now, position, edit, role, text))
            position, size = position + 1, size + len(text)
            if len(out) >= 10_000 or size > 4 << 20:
                yield made()
                size = 0
    if out:
        yield made()


def _merged(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Audits and texts of a conversation next to each other, the audit first: one shuffle of texts."""
    audits = _audits(rows, ids)
    both = audits.withColumn("kind", F.lit(0)).unionByName(rows.withColumns({"kind": F.lit(1), "digest": _digest(F.col("text"))}), allowMissingColumns=True)
    placed = both.repartition("id").sortWithinPartitions("id", "kind", "turn", "role", "digest")
    return with_workers(placed.select("id", "audit", *COUNTS, "cost", "role", "text"))


def repair_report(rows: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``<id>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    Rows are taken by turn, null turns first; rows of one turn by role and then by the
    SHA-256 of their text. Null roles and texts count as one space; a null id is a
    conversation of its own. Equal rows of a turn are duplicates of the first. ``ids`` (of
    one column) names conversations to report even if they have no row: zeros, an empty
    audit and the hash of nothing. An empty table gives an empty result. Ids may be of any
    type but floating point; extra columns are ignored, whatever their names.

    Each conversation passes as a stream of rows, and only its signature and audit, a letter
    a row, are held; texts are shuffled once.
    """
    named = _named(rows, id_col, turn_col, role_col, text_col)
    known = None if ids is None else ids.toDF("id")
    fields = _fields(named.schema["id"].dataType, *COUNTS, "cost", "audit").add("sha256", T.StringType())
    found = _merged(named, known).mapInArrow(_digests, fields)
    return found.select(F.col("id").alias(id_col), *COUNTS, "cost", "audit", F.col("sha256").alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns: ``<id>, position, edit, role, text``, by the edits that ``repair_report`` audits.

    ``edit`` is K (kept), R (of another role) or I (inserted, empty). Order, nulls, ties and
    empty tables as in ``repair_report``; a conversation that loses all its turns has no row.
    """
    named = _named(rows, id_col, turn_col, role_col, text_col)
    schema = _fields(named.schema["id"].dataType, "position", "edit", "role", "text")
    return _merged(named, None).mapInArrow(_repaired, schema).withColumnRenamed("id", id_col)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``id:turn`` (nulls as one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes full stops, exclamation and question marks,
    3 repeats the row, 4 makes it the user's. Null roles and texts become one space.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    how = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn_col))) % 20
    text, role = part(text_col), part(role_col)
    return (
        rows.select(F.col(id_col).alias(id_col), F.col(turn_col).alias(turn_col), role.alias(role_col), text.alias(text_col), how.alias("__how"))
        .where("__how <> 0")
        .select(
            id_col, turn_col,
            F.when(F.col("__how") == 4, "user").otherwise(F.col(role_col)).alias(role_col),
            F.when(F.col("__how") == 1, "").when(F.col("__how") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col)).alias(text_col),
            F.explode(F.when(F.col("__how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
        )
        .drop("__copy")
    )
