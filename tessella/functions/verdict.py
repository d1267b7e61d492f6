"""Verdicts (block over defer over accept), their composition, and content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Higher ranks win and are never lifted.
RANKS = {"ACCEPT": 0, "DEFER": 1, "BLOCK": 2}
_BLOCKED = ["BLOCKED", "BLOCK", "REJECTED", "FORBIDDEN_LEAP"]


def rank(v: Column) -> Column:
    """A verdict's place in the lattice; what is not known ranks as DEFER."""
    return F.when(v == "BLOCK", 2).when(v == "ACCEPT", 0).otherwise(1)


def of_rank(r: Column) -> Column:
    return F.element_at(F.array(F.lit("ACCEPT"), F.lit("DEFER"), F.lit("BLOCK")), r + 1)


def worst(v: Column) -> Column:
    """Aggregate: the highest verdict of a group; ACCEPT for none."""
    return of_rank(F.coalesce(F.max(rank(v)), F.lit(0)))


def worst_of(verdicts: Column) -> Column:
    """The highest verdict of an array; ACCEPT for an empty one."""
    return of_rank(F.coalesce(F.array_max(F.transform(verdicts, rank)), F.lit(0)))


def compose(upstream: Column, gate: Column) -> Column:
    """Effective verdict of an upstream one and a gate's: a block or deferral is never lifted."""
    known = lambda c: F.upper(F.trim(F.when(F.coalesce(c, F.lit("")) == "", F.lit("DEFERRED")).otherwise(c)))
    up, gate = known(upstream), known(gate)
    blocked = gate.isin(_BLOCKED)
    return (
        F.when(up.isin("BLOCKED", "BLOCK") | blocked, "BLOCKED")
        .when(up == "RESIDUAL", "RESIDUAL")
        .when(up.isin("ACCEPTED", "LICENSED", "ACCEPT", "COMPLETE") & gate.isin("LICENSED", "RESIDUAL"), gate)
        .otherwise("DEFERRED")
    )


def content_key(prefix: str, *parts: Column) -> Column:
    """Prefix and 16 hexadecimal digits of SHA-256 over the parts, a zero byte between each two."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 16))


def claim_key(surface: Column, stage: Column, rule: Column, salt: Column | None = None) -> Column:
    """Key of a claim; ``surface`` is expected in NFC (see ``functions.unicode.nfc``)."""
    return content_key("CK-", surface, stage, rule, salt if salt is not None else F.lit(""))


def evaluation_id(surface: Column, run: Column) -> Column:
    return content_key("EV-", surface, run)


def residual_verdict(active: Column, resolved: Column, blocking: list[str]) -> Column:
    """Hidden (both active and resolved) over blocking over deferrable over clear."""
    is_blocking = F.exists(active, lambda r: r.isin(blocking)) if blocking else F.lit(False)
    return (
        F.when(F.size(F.array_intersect(active, resolved)) > 0, "HIDDEN_FORBIDDEN").when(is_blocking, "BLOCKING").when(F.size(active) > 0, "DEFERRABLE").otherwise("CLEAR")
    )
