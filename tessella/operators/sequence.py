"""Operators over ordered rows: marker-delimited groups, carried state, pairs and scopes.

All are parametrised by small marker tables, so the same operator serves a clause
segmenter and a session builder. ``seq`` names the sequence column, ``pos`` the order in it.
A sequence (a sentence, a conversation, a user's events) is what one window partition holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundaries(tokens: DataFrame, markers: DataFrame, surface: str = "surface", bare: Column | None = None) -> DataFrame:
    """``boundary``: the type of the marker a token is, by its surface or else its bare form.

    ``markers(marker, boundary, priority)`` is a list of words, which Spark broadcasts if its size allows.
    """
    kinds = markers.groupBy("marker").agg(F.min_by("boundary", "priority").alias("boundary"), F.min("priority").alias("priority"))
    full = kinds.select(F.col("marker").alias("__m1"), F.col("boundary").alias("__b1"), F.col("priority").alias("__p1"))
    own = kinds.select(F.col("marker").alias("__m2"), F.col("boundary").alias("__b2"), F.col("priority").alias("__p2"))
    bare = F.col(surface) if bare is None else bare
    out = tokens.withColumn("__bare", bare).join(full, F.col(surface) == F.col("__m1"), "left").join(own, F.col("__bare") == F.col("__m2"), "left")
    kind = F.when(F.col("__p2") < F.coalesce("__p1", F.lit(1 << 30)), F.col("__b2")).otherwise(F.col("__b1"))
    return out.withColumn("boundary", kind).select(*tokens.columns, "boundary")


def number_groups(df: DataFrame, seq: str, pos: str, opens: Column, name: str = "group") -> DataFrame:
    """Running number of the groups that ``opens`` starts; a sequence's first row opens none."""
    order = Window.partitionBy(seq).orderBy(pos)
    first = F.lag(F.lit(1)).over(order).isNull()
    flagged = df.withColumn("__open", F.coalesce(opens, F.lit(False)) & ~first)
    return flagged.withColumn(name, F.sum(F.col("__open").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")


def group_clauses(tokens: DataFrame, seq: str, pos: str, surface: str = "surface", predicate: Column | None = None) -> DataFrame:
    """One row for each clause of tokens with a ``boundary`` column.

    ``token_start`` and ``token_end`` count from 1; ``operator`` is the word that opens the
    next clause, null for the last; ``opened_by`` the one that opens this; ``predicates``
    are the tokens for which ``predicate`` holds.
    """
    order = Window.partitionBy(seq).orderBy(pos)
    rows = tokens.withColumn("__n", F.row_number().over(order))
    rows = number_groups(rows, seq, pos, F.col("boundary").isNotNull(), "clause")
    held = F.lit(False) if predicate is None else predicate
    part = F.collect_list(F.struct("__n", F.col(surface).alias("s"), held.alias("p"), "boundary"))
    out = rows.groupBy(seq, "clause").agg(F.min("__n").alias("token_start"), F.max("__n").alias("token_end"), F.array_sort(part).alias("__t"))
    out = out.withColumn("opened_by", F.when(F.col("__t")[0]["boundary"].isNotNull(), F.col("__t")[0]["s"]))
    out = out.withColumn("operator", F.lead(F.col("__t")[0]["s"]).over(Window.partitionBy(seq).orderBy("clause")))
    return out.select(
        seq, "clause", "token_start", "token_end",
        F.concat_ws(" ", F.filter(F.transform("__t", lambda t: t["s"]), lambda s: s != "")).alias("surface"),
        "opened_by", "operator",
        F.concat_ws(" ", F.transform(F.filter("__t", lambda t: t["p"]), lambda t: t["s"])).alias("predicates"),
    )


def carry_mood(tokens: DataFrame, governs: DataFrame, seq: str, pos: str, surface: str = "surface", negators: list[str] = (), after: list[str] = ()) -> DataFrame:
    """``carried_mood``: what the word before puts on this one.

    ``governs(marker, mood)`` is a closed list. A word of ``negators`` that itself follows
    one of ``after`` governs nothing. The state lives for one row, so it is a window.
    """
    order = Window.partitionBy(seq).orderBy(pos)
    out = tokens.join(governs.select(F.col("marker").alias("__m"), F.col("mood").alias("__mood")), F.col(surface) == F.col("__m"), "left")
    idle = F.col(surface).isin(list(negators)) & F.coalesce(F.lag(surface).over(order).isin(list(after)), F.lit(False))
    out = out.withColumn("__own", F.when(~idle, F.col("__mood")))
    return out.withColumn("carried_mood", F.lag("__own").over(order)).select(*tokens.columns, "carried_mood")


def agreement(tokens: DataFrame, seq: str, pos: str, evidence: Column, verb: Column, coordinated: Column, fixed: Column) -> DataFrame:
    """``agrees``: whether subject evidence bears on an ambiguous verb.

    Looks up to three rows ahead, no further than a verb that is not coordinated; else the
    last decision is inherited, which a ``fixed`` (unambiguous) verb resets.
    """
    order = Window.partitionBy(seq).orderBy(pos)
    rows = tokens.withColumns({"__e": evidence, "__stop": verb & ~coordinated, "__v": verb, "__f": fixed})
    seen, stopped = F.lit(False), F.lit(False)
    for k in (1, 2, 3):
        stop = F.coalesce(F.lead("__stop", k).over(order), F.lit(False))
        seen = seen | (F.coalesce(F.lead("__e", k).over(order), F.lit(False)) & ~stopped & ~stop)
        stopped = stopped | stop
    rows = rows.withColumn("__ahead", seen)
    rows = rows.withColumn("__flag", F.when(F.col("__v") & F.col("__f"), F.lit(False)).when(F.col("__v") & F.col("__ahead"), F.lit(True)))
    past = F.last("__flag", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    agrees = F.col("__v") & ~F.col("__f") & (F.col("__ahead") | F.coalesce(past, F.lit(False)))
    return rows.withColumn("agrees", agrees).select(*tokens.columns, "agrees")


def relation_type(source: Column, target: Column, prepositions: list[str], conjunctions: list[str]) -> Column:
    return F.when(source.isin(prepositions), "PREPOSITIONAL").when(target.isin(conjunctions) | source.isin(conjunctions), "COORDINATION").otherwise("SYNTACTIC_DEPENDENCY")


def adjacent_relations(tokens: DataFrame, seq: str, pos: str, rank: str, kind, closed: bool = False) -> DataFrame:
    """``source, target, relation, confidence`` of neighbours; confidence is the lower rank, 1 at least.

    With ``closed`` also the ``status`` that ``close_relations`` gives, by the ranks at hand: nothing is joined.
    """
    order = Window.partitionBy(seq).orderBy(pos)
    pairs = tokens.select(seq, F.col(pos).alias("source_pos"), F.col("surface").alias("source"), F.lead("surface").over(order).alias("target"), F.lead(pos).over(order).alias("target_pos"), F.col(rank).alias("__a"), F.lead(rank).over(order).alias("__b"))
    pairs = pairs.where("target_pos is not null")
    status = [_status(F.col("__a"), F.col("__b")).alias("status")] if closed else []
    return pairs.select(seq, "source_pos", "target_pos", "source", "target", kind(F.col("source"), F.col("target")).alias("relation"), F.greatest(F.least("__a", "__b"), F.lit(1)).alias("confidence"), *status)


def _status(source_rank: Column, target_rank: Column) -> Column:
    zero, none = F.lit(0), F.lit("")
    good = (F.coalesce(source_rank, zero) > 0) & (F.coalesce(target_rank, zero) > 0) & (F.coalesce("source", none) != "") & (F.coalesce("target", none) != "")
    return F.when(good, "CLOSED").otherwise("OPEN")


def close_relations(relations: DataFrame, ranks: DataFrame, seq: str, pos: str, rank: str) -> DataFrame:
    """CLOSED where both parties have a rank above 0 and a surface, else OPEN."""
    side = lambda name: ranks.select(seq, F.col(pos).alias(f"{name}_pos"), F.col(rank).alias(f"{name}_rank"))
    out = relations.join(side("source"), [seq, "source_pos"], "left").join(side("target"), [seq, "target_pos"], "left")
    return out.withColumn("status", _status(F.col("source_rank"), F.col("target_rank"))).drop("source_rank", "target_rank")


def government(tokens: DataFrame, seq: str, pos: str, governors: list[str], surface: str = "surface") -> DataFrame:
    """``governor, governed`` where a governing word precedes one that governs nothing."""
    order = Window.partitionBy(seq).orderBy(pos)
    pairs = tokens.select(seq, F.col(pos).alias("governor_pos"), F.col(surface).alias("governor"), F.lead(surface).over(order).alias("governed"))
    return pairs.where(F.col("governor").isin(governors) & F.col("governed").isNotNull() & ~F.col("governed").isin(governors))


def scopes(tokens: DataFrame, seq: str, pos: str, opens: Column) -> DataFrame:
    """``scope_start, scope_end`` of each opening row: up to the row before the next one, or the last."""
    order = Window.partitionBy(seq).orderBy(pos)
    every = Window.partitionBy(seq)
    marked = tokens.select(seq, pos, opens.alias("__o"), F.max(pos).over(every).alias("__last")).where("__o")
    return marked.select(seq, F.col(pos).alias("scope_start"), F.coalesce(F.lead(pos).over(order) - 1, F.col("__last")).alias("scope_end"))


def in_scope(tokens: DataFrame, scope: DataFrame, seq: str, pos: str) -> DataFrame:
    """Range join: each row with the scope that holds it, its opening row excepted."""
    t, s = tokens.alias("t"), scope.alias("s")
    held = (F.col(f"t.{seq}") == F.col(f"s.{seq}")) & (F.col(f"t.{pos}") > F.col("s.scope_start")) & (F.col(f"t.{pos}") <= F.col("s.scope_end"))
    return t.join(s, held).select("t.*", "s.scope_start", "s.scope_end")


def span_ends(members: DataFrame, span: list[str], pos: str, surface: str = "surface") -> DataFrame:
    """First and last member of each span of two at least."""
    out = members.groupBy(*span).agg(F.count(F.lit(1)).alias("n"), F.min_by(surface, pos).alias("first"), F.max_by(surface, pos).alias("last"))
    return out.where("n >= 2")


def nothing_after_stop(rows: DataFrame, seq: str, pos: str, stop: Column, opened: Column) -> DataFrame:
    """Rows that were opened though a stop came before: should be none."""
    before = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumns({"__s": stop.cast("int"), "__o": opened})
    return marked.withColumn("__past", F.coalesce(F.max("__s").over(before), F.lit(0))).where((F.col("__past") == 1) & F.col("__o")).select(*rows.columns)
