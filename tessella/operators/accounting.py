"""Every letter of a word accounted for once, at least cost: dynamic programming in a column."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

WAY = "struct<cost:int,prefix:int,roots:array<int>,suffix:int>"


class Costs(NamedTuple):
    """What a letter costs in each role; a letter that a role does not list may not take it.

    ``root`` and ``augment`` have a cost for all other letters too, None where these may not.
    """

    prefix: dict[str, int]
    root: dict[str, int]
    augment: dict[str, int]
    suffix: dict[str, int]
    other_root: int | None = 0
    other_augment: int | None = None


def _cost(letter: Column, known: dict[str, int], other: int | None = None) -> Column:
    out = F.lit(other).cast("int")
    for cost in sorted(set(known.values())):
        out = F.when(letter.isin([x for x, c in known.items() if c == cost]), cost).otherwise(out)
    return out


def account(word: Column, costs: Costs, fewest: int = 2, most: int = 4) -> Column:
    """``cost, prefix, roots, suffix`` of the cheapest account of a word, null if it has none.

    Letters are prefix letters, then root letters and augments in any order, then suffix
    letters; the root has ``fewest`` to ``most`` letters. ``prefix`` is how many letters are
    prefix, ``roots`` the places of root letters from 0, and ``suffix`` the place where the
    suffix begins; the rest in between are augments. Of equally cheap accounts the one with
    the fewest prefix letters, then the earliest root letters, then the longest suffix.

    One pass over the letters holds the best account for each number of root letters in
    the middle and in the suffix, so it takes time in proportion to the word's length and
    no memory but those few. A way is kept by three facts, never as a string of roles. The
    account of an empty word, and of null, is null.
    """
    middle, ends = 1, most + 2  # states: 0 prefix; 1 + r in the middle; most + 2 + r in the suffix, with r root letters
    n_states = ends + most + 1
    none = F.lit(None).cast(WAY)
    way = lambda cost, prefix, roots, suffix: F.struct(cost.cast("int").alias("cost"), prefix.cast("int").alias("prefix"), roots.cast("array<int>").alias("roots"), suffix.cast("int").alias("suffix"))
    letters = F.transform(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), lambda c, k: F.struct(k.alias("k"), _cost(c, costs.prefix).alias("p"), _cost(c, costs.root, costs.other_root).alias("r"), _cost(c, costs.augment, costs.other_augment).alias("a"), _cost(c, costs.suffix).alias("s")))

    def step(states: Column, x: Column) -> Column:
        at = lambda j: states[j]
        plus = lambda w, c, roots=None, suffix=None: F.when(w.isNotNull() & c.isNotNull(), way(w["cost"] + c, w["prefix"], w["roots"] if roots is None else roots, w["suffix"] if suffix is None else suffix))
        begin = at(0)
        out = [F.when(begin.isNotNull() & x["p"].isNotNull(), way(begin["cost"] + x["p"], begin["prefix"] + 1, begin["roots"], begin["suffix"]))]
        for r in range(most + 1):
            before = [at(middle + r), *([begin] if r == 0 else [])]
            ways = [plus(w, x["a"]) for w in before]
            if r:
                less = [at(middle + r - 1), *([begin] if r == 1 else [])]
                ways += [plus(w, x["r"], roots=F.concat(w["roots"], F.array(x["k"]))) for w in less]
            out.append(F.least(*ways) if len(ways) > 1 else ways[0])
        for r in range(most + 1):
            stay, enter = plus(at(ends + r), x["s"]), plus(at(middle + r), x["s"], suffix=x["k"])
            out.append(F.least(stay, enter))
        return F.array(*[o.cast(WAY) for o in out])

    start = way(F.lit(0), F.lit(0), F.array(), F.lit(0))
    first = F.array(start.cast(WAY), *[none] * (n_states - 1))
    final = F.aggregate(letters, first, step)
    size = F.length(word)
    last = [F.when(final[middle + r].isNotNull(), way(final[middle + r]["cost"], final[middle + r]["prefix"], final[middle + r]["roots"], size)) for r in range(fewest, most + 1)]
    return F.least(*last, *[final[ends + r] for r in range(fewest, most + 1)])


def roles(word: Column, accounted: Column) -> Column:
    """The account as a letter for each letter: P, R, A or S."""
    size = F.length(word)
    of = lambda k: F.when(k < accounted["prefix"], "P").when(k >= accounted["suffix"], "S").when(F.array_contains(accounted["roots"], k), "R").otherwise("A")
    return F.when(accounted.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), size - 1), of), ""))
