"""Text cleaning and tokenising as Column expressions; all run inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's \s alone is ASCII.
SPACE = r"(?U)\s+"


def lower(c: Column) -> Column:
    return F.lower(c)


def remove_punctuation(c: Column) -> Column:
    """Deletes the 32 ASCII punctuation characters only."""
    return F.translate(c, string.punctuation, "")


def squeeze_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+|www\.\S+", "")


def remove_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\d+", "")


def clean(c: Column, *, lowercase: bool = True, punctuation: bool = True, numbers: bool = False, urls: bool = True, html: bool = True) -> Column:
    """Tags, addresses, case, punctuation, digits, space: always in this order."""
    steps = [(html, remove_tags), (urls, remove_urls), (lowercase, lower), (punctuation, remove_punctuation), (numbers, remove_numbers)]
    for wanted, step in steps:
        c = step(c) if wanted else c
    return squeeze_space(c)


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def sentences(c: Column) -> Column:
    """Cuts after . ! or ? where white space follows."""
    return F.filter(F.split(F.trim(c), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def strip_punctuation(word: Column, marks: str) -> Column:
    """``left, word, right``: what of ``marks`` stands at either end."""
    rest = F.ltrim(word, F.lit(marks))
    core = F.rtrim(rest, F.lit(marks))
    return F.struct(F.left(word, F.length(word) - F.length(rest)).alias("left"), core.alias("word"), F.right(rest, F.length(rest) - F.length(core)).alias("right"))


def split_prefix(word: Column, prefixes: list[str], bare: Column, protected: list[str]) -> Column:
    """``surface, kind, original``: the first of ``prefixes`` is a token of its own.

    Nothing is split whose bare form is protected, nor a prefix that is the whole word.
    """
    token = lambda s, kind: F.struct(s.alias("surface"), F.lit(kind).alias("kind"), word.alias("original"))
    whole = F.array(token(word, "word"))
    out = F.when(bare.isin(protected), whole) if protected else F.when(F.lit(False), whole)
    for p in prefixes:
        out = out.when(word.startswith(p) & (F.length(word) > len(p)), F.array(token(F.lit(p), "clitic"), token(F.substring(word, F.lit(len(p) + 1), F.length(word)), "word")))
    return out.otherwise(whole)


def tokens(c: Column, marks: str, prefixes: list[str], bare, protected: list[str]) -> Column:
    """All tokens of a text in order: punctuation, prefixes and words. ``bare``: Column -> Column."""
    mark = lambda s: F.struct(s.alias("surface"), F.lit("punct").alias("kind"), F.lit("").alias("original"))

    def one(raw: Column) -> Column:
        p = strip_punctuation(raw, marks)
        parts = F.concat(F.array(mark(p["left"])), split_prefix(p["word"], prefixes, bare(p["word"]), protected), F.array(mark(p["right"])))
        return F.filter(parts, lambda t: t["surface"] != "")

    return F.flatten(F.transform(words(c), one))


def token_rows(docs: DataFrame, keys: list[str], c: Column, marks: str, prefixes: list[str], bare, protected: list[str]) -> DataFrame:
    """``<keys>, pos, part, surface, kind``: the tokens of ``tokens`` as rows.

    Words are exploded first, and each step is a projection of its own, so that what a word
    is cut into is computed once and in generated code. ``pos`` counts words from 0 and ``part``
    the mark before (0), prefix (1), word (2) and mark after (3).
    """
    raw = docs.select(*keys, F.posexplode(words(c)).alias("pos", "__raw"))
    rest = raw.select("*", F.ltrim("__raw", F.lit(marks)).alias("__rest"))
    core = rest.select("*", F.rtrim("__rest", F.lit(marks)).alias("__word"))
    word = F.col("__word")
    prefix = F.when(bare(word).isin(protected), F.lit("")) if protected else F.when(F.lit(False), "")
    for p in prefixes:
        prefix = prefix.when(word.startswith(p) & (F.length(word) > len(p)), p)
    cut = core.select("*", prefix.otherwise("").alias("__prefix"))
    part = lambda i, s, kind: F.struct(F.lit(i).alias("part"), s.alias("surface"), F.lit(kind).alias("kind"))
    parts = F.array(
        part(0, F.left("__raw", F.length("__raw") - F.length("__rest")), "punct"),
        part(1, F.col("__prefix"), "clitic"),
        part(2, F.substr("__word", F.length("__prefix") + 1), "word"),
        part(3, F.right("__rest", F.length("__rest") - F.length("__word")), "punct"),
    )
    return cut.select(*keys, "pos", F.inline(parts)).where("surface <> ''")


def tidy_spacing(c: Column) -> Column:
    """One space at most; none before closing or after opening punctuation."""
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r" +([.,:;!?)\]»،؛؟])", "$1")
    return F.trim(F.regexp_replace(c, r"([(\[«]) +", "$1"))


def top_words(docs: DataFrame, by: str = "lang", text_col: str = "text", k: int = 10) -> DataFrame:
    """``<by>, rank, word, n``: the most frequent cleaned words of each group; ties by word.

    Counts combine before the shuffle, so a hot group sends each word once a task; ranks
    are taken over words that a first cut, a top-k for each slice of words, leaves.
    """
    from pyspark.sql import Window

    counted = docs.select(by, F.explode(words(clean(F.col(text_col)))).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("word")]
    sliced = counted.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(64)))
    cut = sliced.withColumn("r", F.row_number().over(Window.partitionBy(by, "slice").orderBy(*order))).where(F.col("r") <= k)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select(by, "rank", "word", "n")
