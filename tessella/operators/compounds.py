"""Words as a known beginning and the rest: prefix joins by length, and the cascade over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_matches(words: DataFrame, word_id: str, word: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``<word_id>, prefix, rest`` for every known prefix of each word that leaves something over.

    The index is bucketed by length: a word is looked up once for each length that a prefix
    has (these few numbers are read first), by the hash of so many of its letters, and what
    meets is compared letter by letter. It is one equi-join whatever the prefixes are, with
    no condition on pairs that hash apart. Null words and empty prefixes match nothing.
    """
    known = prefixes.select(F.col(prefix).alias("prefix")).where("length(prefix) > 0").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    index = known.select("prefix", F.length("prefix").alias("__n"), F.xxhash64("prefix").alias("__h"))
    cut = lambda n: F.struct(n.alias("__n"), F.xxhash64(F.left(word, n)).alias("__h"))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n < F.length(word))
    keys = words.select(word_id, word, F.inline(F.transform(fitting, cut)))
    met = keys.join(index, ["__n", "__h"]).where(F.left(word, F.col("__n")) == F.col("prefix"))
    return met.select(word_id, "prefix", F.substr(word, F.col("__n") + 1).alias("rest"))


def longest_prefix(words: DataFrame, word_id: str, word: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``<word_id>, prefix, rest``: the longest known prefix of each word that has one."""
    met = prefix_matches(words, word_id, word, prefixes, prefix)
    best = met.groupBy(word_id).agg(F.max_by(F.struct("prefix", "rest"), F.length("prefix")).alias("b"))
    return best.select(word_id, "b.*")


def _readings(index: DataFrame) -> DataFrame:
    """``key, entry, n_entries``: an entry only where the key has no other."""
    n = index.groupBy("key").agg(F.count_distinct("entry").alias("n_entries"), F.min("entry").alias("entry"))
    return n.select("key", "n_entries", F.when(F.col("n_entries") == 1, F.col("entry")).alias("entry"))


def compound_lookup(words: DataFrame, word_id: str, word: str, prefixes: DataFrame, index: DataFrame, key) -> DataFrame:
    """``<word_id>, status, prefix, rest, entry`` of each word, read as a prefix and a known rest.

    ``index`` holds (key, entry), and ``key`` makes a column's key. The longest prefix whose
    rest names one entry wins: COMPOUND. If no rest does, but one names several, it is a
    COLLISION, told of the longest such prefix and never settled by a pick; with prefixes
    but no known rest the word is OPEN, without any it is NONE.
    """
    met = prefix_matches(words, word_id, word, prefixes).withColumn("key", key(F.col("rest")))
    found = met.join(_readings(index), "key", "left")
    rank = F.when(F.col("n_entries") == 1, 3).when(F.col("n_entries") > 1, 2).otherwise(1)
    best = found.groupBy(word_id).agg(F.max(F.struct(rank.alias("rank"), F.length("prefix").alias("size"), "prefix", "rest", "entry")).alias("b"))
    status = F.when(F.col("b.rank") == 3, "COMPOUND").when(F.col("b.rank") == 2, "COLLISION").when(F.col("b.rank") == 1, "OPEN").otherwise("NONE")
    told = lambda c: F.when(F.col("b.rank") > 1, F.col(f"b.{c}")).alias(c)
    return words.select(word_id).join(best, word_id, "left").select(word_id, status.alias("status"), told("prefix"), told("rest"), told("entry"))


#: Routes of a host in order of precedence.
ROUTES = ["WHOLE", "FUNCTION", "KNOWN", "PREFIX_AND_CORE", "OPEN"]


def recognise(words: DataFrame, word_id: str, word: str, ways: DataFrame, prefixes: DataFrame, known: DataFrame, blocked: Column | None = None) -> DataFrame:
    """``<word_id>, route, stem, taken, prefix, n_ways, verdict``: a cascade over all ways to take a word apart.

    ``ways`` are (word_id, stem, taken) rows, the whole word among them with nothing taken.
    A known whole word stops the search (WHOLE). Else every way's host is routed: it is
    itself a prefix (FUNCTION), a known word (KNOWN), a prefix before a known word
    (PREFIX_AND_CORE, the longest) or OPEN. The best route over all ways decides; of its
    ways the one that takes most off. Several such ways are AMBIGUOUS, one is CLOSED, an
    open host is DEFERRED, and a word for which ``blocked`` holds is BLOCKED without a look.

    Hosts are routed as distinct strings, so a stem that many words share is looked up once.
    """
    stop = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    status = words.select(word_id, F.col(word).alias("__word"), stop.alias("__stop"))
    entries = known.select(F.col("entry").alias("stem")).distinct()
    open_ways = ways.join(status.where(~F.col("__stop")).select(word_id), word_id, "left_semi")
    hosts = open_ways.select("stem").distinct()
    function = prefixes.select(F.col("prefix").alias("stem"), F.lit(True).alias("__function")).distinct()
    core = prefix_matches(hosts, "stem", "stem", prefixes)
    core = core.join(entries.withColumnRenamed("stem", "rest"), "rest", "left_semi").groupBy("stem").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    routed = hosts.join(function, "stem", "left").join(entries.withColumn("__known", F.lit(True)), "stem", "left").join(core, "stem", "left")
    found = open_ways.join(routed, "stem")
    rank = F.when(F.col("__known") & (F.col("taken") == ""), 0).when(F.col("__function"), 1).when(F.col("__known"), 2).when(F.col("prefix").isNotNull(), 3).otherwise(4)
    ranked = found.select(word_id, rank.alias("rank"), F.when(rank == 3, F.col("prefix")).alias("prefix"), "stem", "taken")
    size = F.length("stem").alias("size")
    # the best route and, within it, the shortest host: how many ways there are of that kind, and the least of them
    kinds = ranked.groupBy(word_id, "rank", size).agg(F.count("*").alias("n_ways"), F.min(F.struct("stem", "taken", "prefix")).alias("w"))
    best = kinds.groupBy(word_id).agg(F.min_by(F.struct("rank", "n_ways", "w"), F.struct("rank", "size")).alias("b"))
    verdict = F.when(F.col("__stop"), "BLOCKED").when(F.col("b.rank") == 4, "DEFERRED").when(F.col("b.n_ways") > 1, "AMBIGUOUS").otherwise("CLOSED")
    one = lambda c: F.when((F.col("b.n_ways") == 1) & (F.col("b.rank") < 4), F.col(f"b.w.{c}")).alias(c)
    return status.join(best, word_id, "left").select(
        word_id, F.when(F.col("b").isNotNull(), F.element_at(F.lit(ROUTES), F.col("b.rank") + 1)).alias("route"), one("stem"), one("taken"), one("prefix"), F.coalesce("b.n_ways", F.lit(0).cast("long")).alias("n_ways"), verdict.alias("verdict")
    )
