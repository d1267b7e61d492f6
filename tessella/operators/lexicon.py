"""Lexical lookups: joins in tiers of precedence, with guards against ambiguity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.arabic import mark_mask, masked_marks, strip_marks


def tiered_lookup(words: DataFrame, word_id: str, tiers: list[tuple[str, Column, DataFrame, bool]]) -> DataFrame:
    """``word_id, tier, entry, n_entries``: entries of the first tier in which a word is found.

    A tier is (name, key of a word, table(key, entry), guarded). A guarded tier only counts
    where its key names a single entry: an ambiguous key is no match, never a pick. All
    tiers meet in one equi-join: a word has a key for each tier, so words are read once;
    Spark broadcasts the tables if their size allows.
    """
    tables = [t.select(F.lit(i).alias("__i"), F.lit(guarded).alias("__g"), "key", "entry") for i, (_, _, t, guarded) in enumerate(tiers)]
    index = reduce(DataFrame.unionByName, tables).groupBy("__i", "__g", "key").agg(F.array_sort(F.collect_set("entry")).alias("entries"))
    index = index.where(~F.col("__g") | (F.size("entries") == 1)).drop("__g")
    keys = F.array(*[F.struct(F.lit(i).alias("__i"), key.alias("key")) for i, (_, key, _, _) in enumerate(tiers)])
    hits = words.select(word_id, F.inline(keys)).where("key IS NOT NULL").join(index, ["__i", "key"])
    best = hits.groupBy(word_id).agg(F.min_by(F.struct("__i", "entries"), "__i").alias("b"))
    tier = F.element_at(F.array(*[F.lit(name) for name, *_ in tiers]), F.col("b.__i") + 1)
    return best.select(word_id, tier.alias("tier"), F.array_join("b.entries", ",").alias("entry"), F.size("b.entries").alias("n_entries"))


def lookup_or_collide(words: DataFrame, word_id: str, tiers: list[tuple[str, Column, DataFrame]]) -> DataFrame:
    """As above, but a key with several entries is a COLLISION that ends the search."""
    found = tiered_lookup(words, word_id, [(*t, False) for t in tiers])
    status = F.when(F.col("n_entries") > 1, "COLLISION").otherwise("FOUND")
    return words.select(word_id).join(found.select(word_id, "tier", F.when(F.col("n_entries") == 1, F.col("entry")).alias("entry"), status.alias("status")), word_id, "left").select(
        word_id, "tier", "entry", F.coalesce("status", F.lit("NOT_FOUND")).alias("status")
    )


def lookup_vocalised(words: DataFrame, word_id: str, word: str, known: DataFrame) -> DataFrame:
    """``<word_id>, status, entry, n_entries``: a word with few marks among fully vocalised entries.

    Words and the ``entry`` column of ``known`` meet by their letters without marks and by the
    marks that a word writes: for each set of letters that are marked in some word, an entry is
    cut down to the marks of these and counted. No word meets all entries of its letters.
    One entry is FOUND, several are a COLLISION with none named, none is
    NOT_FOUND, or CONTRADICTED if letters met and marks did not agree. Null words are NOT_FOUND.
    ``word_id`` names a word.
    """
    at = ["__bare", "__mask", "__key"]
    entries = known.select(F.col("entry"), strip_marks(F.col("entry")).alias("__bare")).where("__bare <> ''").distinct()
    given = words.select(word_id, strip_marks(F.col(word)).alias("__bare"), mark_mask(F.col(word)).alias("__mask"), masked_marks(F.col(word)).alias("__key"))
    masks = given.select("__bare", "__mask").distinct()
    cut = masks.join(entries, "__bare").select("__bare", "__mask", masked_marks(F.col("entry"), F.col("__mask")).alias("__key"), "entry")
    n = cut.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("one"))
    letters = entries.select("__bare", F.lit(True).alias("__met")).distinct()
    found = given.join(letters, "__bare", "left").join(n, at, "left")
    status = F.when(F.col("n") == 1, "FOUND").when(F.col("n") > 1, "COLLISION").when(F.col("__met"), "CONTRADICTED").otherwise("NOT_FOUND")
    return found.select(word_id, status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("entry"), F.coalesce("n", F.lit(0).cast("long")).alias("n_entries"))


def strip_suffixes(words: DataFrame, word_id: str, word: str, suffixes: list[str], depth: int = 3, shortest: int = 2) -> DataFrame:
    """All ways to take up to ``depth`` suffixes off: ``word_id, stem, taken``.

    ``suffixes`` is a closed list. A word's ways stay in its row, level by level, so words are
    read once and nothing is joined; a stem keeps ``shortest`` letters.
    """
    by_length = {n: sorted({s for s in suffixes if len(s) == n}) for n in sorted({len(s) for s in suffixes if s})}

    def shorter(way: Column) -> Column:
        """What one more suffix leaves of a way; at most one suffix of each length fits."""
        cuts = []
        for n, endings in by_length.items():
            end = F.right(way["stem"], F.lit(n))
            fits = end.isin(endings) & (F.length(way["stem"]) >= n + shortest)
            taken = F.concat_ws("+", end, F.when(way["taken"] != "", way["taken"]))
            cuts.append(F.when(fits, F.struct(F.left(way["stem"], F.length(way["stem"]) - n).alias("stem"), taken.alias("taken"))))
        return F.array_compact(F.array(*cuts))

    out = words.select(word_id, F.array(F.struct(F.col(word).alias("stem"), F.lit("").alias("taken"))).alias("__0"))
    for level in range(depth):
        out = out.select("*", F.flatten(F.transform(f"__{level}", shorter)).alias(f"__{level + 1}"))
    return out.select(word_id, F.inline(F.concat(*[F.col(f"__{level}") for level in range(depth + 1)])))


def choose_segmentation(ways: DataFrame, word_id: str, stems: DataFrame) -> DataFrame:
    """The only way whose stem is known; AMBIGUOUS for several, OPEN for none."""
    known = ways.join(stems.select(F.col("stem")).distinct(), "stem", "left_semi").groupBy(word_id).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("stem", "taken")).alias("w"))
    out = ways.select(word_id).distinct().join(known, word_id, "left")
    one = F.col("n") == 1
    verdict = F.when(one, "CLOSED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("OPEN")
    return out.select(word_id, verdict.alias("verdict"), F.when(one, F.col("w.stem")).alias("stem"), F.when(one, F.col("w.taken")).alias("taken"))


def merge_group(pages: DataFrame, key: str, order: str, status: str, kind: str, source: str, winner: str = "AUTO", none: str = "NONE") -> DataFrame:
    """One entry for each key of several pages.

    ``winner`` as any page's status wins; the first kind in order that is not ``none``;
    sources in order of their first page, each once.
    """
    first = pages.groupBy(key, source).agg(F.min(order).alias("__at"))
    sources = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(source).alias("s")))), lambda x: x["s"].cast("string")), ",").alias("sources"))
    merged = pages.groupBy(key).agg(
        F.when(F.bool_or(F.col(status) == winner), winner).otherwise(F.min_by(status, order)).alias("status"),
        F.coalesce(F.min_by(kind, F.when(F.col(kind) != none, F.col(order))), F.lit(none)).alias("kind"),
        F.count(F.lit(1)).alias("n_pages"),
    )
    return merged.join(sources, key)


def typed_lookup(queries: DataFrame, key: str, registry: DataFrame, covered: DataFrame, first: Column, valid: Column) -> DataFrame:
    """FOUND_<status>, NOT_FOUND, COVERAGE_GAP (no entry begins alike) or INVALID for each key."""
    hit = registry.select(F.col(key).alias("__k"), F.col("status").alias("__status"))
    area = covered.select(F.col("first").alias("__f")).distinct()
    out = queries.withColumn("__first", first).join(hit, F.col(key) == F.col("__k"), "left").join(area, F.col("__first") == F.col("__f"), "left")
    result = F.when(~valid, "INVALID").when(F.col("__status").isNotNull(), F.concat(F.lit("FOUND_"), F.col("__status"))).when(F.col("__f").isNull(), "COVERAGE_GAP").otherwise("NOT_FOUND")
    return out.withColumn("result", result).select(*queries.columns, "result")


def evidence_chain(candidates: DataFrame, key: str, proposed: DataFrame, closed: DataFrame, lexicon: DataFrame, certified: DataFrame) -> DataFrame:
    """The first link at which a candidate fails: semi, anti, semi and left joins in turn."""
    flag = lambda df, name: df.select(F.col(key)).distinct().withColumn(name, F.lit(True))
    out = candidates
    for df, name in ((proposed, "__p"), (closed, "__c"), (lexicon, "__l"), (certified, "__z")):
        out = out.join(flag(df, name), key, "left")
    outcome = (
        F.when(F.col("__p").isNull(), "NOT_PROPOSED").when(F.col("__c").isNotNull(), "CLOSED_FORM").when(F.col("__l").isNull(), "NOT_IN_LEXICON").when(F.col("__z").isNull(), "NOT_CERTIFIED").otherwise("LICENSED")
    )
    return out.withColumn("outcome", outcome).select(*candidates.columns, "outcome")


def unique_or_refuse(proofs: DataFrame, key: str, value: str) -> DataFrame:
    """LICENSED where all proofs of a key name one value."""
    n = proofs.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("v"))
    return n.select(key, "n_values", F.when(F.col("n_values") == 1, F.col("v")).alias("value"), F.when(F.col("n_values") == 1, "LICENSED").otherwise("AMBIGUOUS").alias("verdict"))


def consensus(forms: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """A position's value is accepted where all forms that identify it agree."""
    n = forms.where(F.col(value).isNotNull()).groupBy(key, position).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"))
    return n.select(key, position, F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 1, "ACCEPT").otherwise("DEFER").alias("verdict"))


def rank_rules(rules: DataFrame, by: list[str]) -> DataFrame:
    """Rules of each family in order of priority, then id."""
    return rules.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("priority", "rule_id")))
