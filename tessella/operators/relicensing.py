"""Hypothesise, restore, test again: a fixpoint over the words that are still deferred."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lineage import checkpoint


class Hypothesis(NamedTuple):
    """A change that may uncover the licensed form.

    ``side`` is prefix or suffix (``pattern`` is taken off and ``becomes`` put there) or weak (every
    letter of ``pattern`` becomes the one at its place in ``becomes``). ``licence`` names the
    hypotheses of which one must have been made before; none: it stands on its own.
    """

    name: str
    side: str
    pattern: str
    becomes: str = ""
    licence: tuple[str, ...] = ()


def _applied(form: Column, h: Hypothesis, shortest: int) -> Column:
    """The form after a hypothesis, null where it does not apply."""
    if h.side == "weak":
        made = F.translate(form, h.pattern, h.becomes)
        return F.when(made != form, made)
    rest = F.length(form) - len(h.pattern)
    if h.side == "prefix":
        fits, made = form.startswith(h.pattern), F.concat(F.lit(h.becomes), F.substr(form, F.lit(len(h.pattern) + 1)))
    else:
        fits, made = form.endswith(h.pattern), F.concat(F.left(form, rest), F.lit(h.becomes))
    return F.when(fits & (rest + len(h.becomes) >= shortest), made)


def _checked(hypotheses: list[Hypothesis]) -> dict[str, int]:
    """Bit of each hypothesis; they must be told apart, do something, and fit into a long."""
    bits = {h.name: 1 << k for k, h in enumerate(hypotheses)}
    if len(bits) < len(hypotheses) or len(bits) > 62:
        raise ValueError("hypotheses are at most 62, each with a name of its own")
    for h in hypotheses:
        if h.side not in ("prefix", "suffix", "weak") or not h.pattern or h.pattern == h.becomes or set(h.licence) - set(bits):
            raise ValueError(f"{h.name} changes nothing or names no known licence")
        if h.side == "weak" and (len(h.pattern) != len(h.becomes) or set(h.pattern) & set(h.becomes)):
            raise ValueError(f"{h.name} restores a weak letter to a weak one")
    return bits


def relicense(words: DataFrame, word_id: str, word: str, licensed: DataFrame, hypotheses: list[Hypothesis], blocked: Column, shortest: int = 2) -> DataFrame:
    """``<word_id>, verdict, root, rounds, used``: the fewest hypotheses that lead to a licensed form.

    Round 0 tests the word itself against ``licensed`` (a column ``root``). Words that it does
    not license are carried on; each round makes one more hypothesis on each of their forms
    and tests what is new. A word with licensed forms leaves at that round: ACCEPT if it is
    one form, AMBIGUOUS with none named if there are several. Words that run out of
    hypotheses are DEFERred; where ``blocked`` holds (a null word too) the word is BLOCKed and
    never carried on. ``used`` names the hypotheses in their order in the list, the least such
    list if several lead to the form.

    It ends: a state is a form with the set of hypotheses made, each at most once on a path,
    so the states of round k have k of them. No state comes again in a later round, hence
    no table of seen states is needed and there are at most ``len(hypotheses)`` rounds after
    the first. The frontier holds deferred words alone and is checkpointed each round.
    """
    bits = _checked(hypotheses)
    roots = licensed.select(F.col("root").alias("form"), F.lit(True).alias("__licensed")).where("form IS NOT NULL").distinct()
    start = words.select(F.col(word_id).alias("__id"), F.col(word).alias("form"), F.coalesce(blocked, F.lit(True)).alias("__blocked"))
    shut = start.where("__blocked OR form IS NULL")
    frontier = start.where("NOT __blocked AND form IS NOT NULL").select("__id", "form", F.lit(0).cast("long").alias("used"))
    done = [shut.select("__id", F.lit("BLOCK").alias("verdict"), F.lit(None).cast("string").alias("root"), F.lit(0).alias("rounds"), F.lit(0).cast("long").alias("used"))]
    for k in range(len(hypotheses) + 1):
        tested = frontier.join(roots, "form", "left")
        found = tested.groupBy("__id").agg(F.count_distinct(F.when(F.col("__licensed"), F.col("form"))).alias("n"), F.min(F.when(F.col("__licensed"), F.struct("form", "used"))).alias("b"))
        one = F.col("n") == 1
        done.append(found.where("n > 0").select("__id", F.when(one, "ACCEPT").otherwise("AMBIGUOUS").alias("verdict"), F.when(one, F.col("b.form")).alias("root"), F.lit(k).alias("rounds"), F.when(one, F.col("b.used")).otherwise(0).alias("used")))
        open_ = frontier.join(found.where("n = 0").select("__id"), "__id", "left_semi")
        ways = []
        for h in hypotheses:
            licence = reduce(int.__or__, (bits[x] for x in h.licence), 0)
            free = F.col("used").bitwiseAND(bits[h.name]) == 0
            free = free & (F.col("used").bitwiseAND(licence) != 0) if licence else free
            ways.append(F.when(free, F.struct(_applied(F.col("form"), h, shortest).alias("form"), F.col("used").bitwiseOR(bits[h.name]).alias("used"))))
        stepped = checkpoint(open_.select("__id", "used", F.explode(F.array_compact(F.array(*ways))).alias("w")).where("w.form IS NOT NULL").select("__id", "w.form", "w.used").distinct())
        carried = stepped.select("__id").distinct()
        done.append(open_.select("__id").distinct().join(carried, "__id", "left_anti").select("__id", F.lit("DEFER").alias("verdict"), F.lit(None).cast("string").alias("root"), F.lit(k).alias("rounds"), F.lit(0).cast("long").alias("used")))
        frontier = stepped
        if stepped.isEmpty():
            break
    out = reduce(DataFrame.unionByName, done)
    names = F.array_compact(F.array(*[F.when(F.col("used").bitwiseAND(b) != 0, name) for name, b in bits.items()]))
    return out.select(F.col("__id").alias(word_id), "verdict", "root", "rounds", F.array_join(names, "+").alias("used"))
