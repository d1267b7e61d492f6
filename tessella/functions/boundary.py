"""Boundary kinds, root-path directives, morphology paths and host routes of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import arabic
from tessella.functions.arabic import ALEF, ALEF_MAQSURA, FATHA, HAMZA, SHADDA, TANWIN

#: Closed function words after hamza normalisation, their class and kind.
FUNCTION_WORDS = [
    ("مِنْ", "preposition", "CLOSED_FUNCTION_WORD"), ("هَلْ", "interrogative_particle", "CLOSED_FUNCTION_WORD"), ("لَمْ", "negation_particle", "CLOSED_FUNCTION_WORD"), ("لَنْ", "negation_particle", "CLOSED_FUNCTION_WORD"),
    ("فِي", "preposition", "CLOSED_FUNCTION_WORD"), ("هُوَ", "pronoun", "CLOSED_FUNCTION_WORD"), ("هِيَ", "pronoun", "CLOSED_FUNCTION_WORD"), ("عَلَى", "ambiguous_preposition", "POSSIBLE_FUNCTION_WORD"),
    ("ءِلَى", "ambiguous_preposition", "POSSIBLE_FUNCTION_WORD"), ("مَتَى", "ambiguous_particle", "POSSIBLE_FUNCTION_WORD"),
]
#: What a kind of boundary does to the root path.
DIRECTIVES = {
    "ROOT_ELIGIBLE": "OPEN", "COMPRESSED_VERB_CANDIDATE": "OPEN", "AMBIGUOUS": "DEFER", "POSSIBLE_FUNCTION_WORD": "DEFER", "UNDERLICENSED_SHORT_SURFACE": "DEFER",
    "CLOSED_FUNCTION_WORD": "BLOCK", "NON_VERBAL_SURFACE": "BLOCK", "CLITICIZED_SURFACE": "BLOCK",
}
#: Endings that only nouns have.
NOMINAL_TAILS = ["ةً", "ةٌ", "ةِ", "ةُ", "انِ", "انُ", "يْنِ", "ونَ", "ينَ", "اتٌ", "اتِ", "اتُ", "اتً"]
RESIDUALS = {"DEFER": ["structural:defer"], "BLOCK": ["structural:block"], "ACCEPT": []}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def directive_for(kind: Column) -> Column:
    """OPEN, DEFER or BLOCK; an unknown kind blocks."""
    return F.coalesce(F.try_element_at(_map(DIRECTIVES), kind), F.lit("BLOCK"))


def structural_kind(phones: Column) -> Column:
    """Kind of a word by its phones: their number, the first two and the last."""
    first, second, last, n = F.get(phones, F.lit(0)), F.get(phones, F.lit(1)), F.try_element_at(phones, F.lit(-1)), F.size(phones)
    compressed = (first["role"] == "M") & (second["role"] == "S")
    prefixed = first["char"].isin("ي", "ت", "ن", HAMZA) & first["marks"].contains(FATHA) & (last["role"] == "VL")
    consonants = F.size(F.filter(phones, lambda p: p["role"] != "VL"))
    short = F.when((n == 2) & compressed, "COMPRESSED_VERB_CANDIDATE").otherwise("UNDERLICENSED_SHORT_SURFACE")
    long = F.when((n == 3) & prefixed, "AMBIGUOUS").when(consonants >= 2, "ROOT_ELIGIBLE").otherwise("NON_VERBAL_SURFACE")
    return F.when(n < 3, short).otherwise(long)


def function_words(surface: Column) -> Column:
    """``word_class, kind`` of a closed word, or null: a lookup in a literal of ten entries."""
    table = F.create_map(*[x for word, cls, kind in FUNCTION_WORDS for x in (F.lit(word), F.struct(F.lit(cls).alias("word_class"), F.lit(kind).alias("kind")))])
    return F.try_element_at(table, arabic.normalize_hamza(surface))


def assess(surface: Column) -> Column:
    """``kind, directive, source`` of a word: the inventory first, else its structure."""
    known = function_words(surface)["kind"]
    kind = F.coalesce(known, structural_kind(arabic.phones(surface)))
    return F.struct(kind.alias("kind"), directive_for(kind).alias("directive"), F.when(known.isNotNull(), "INVENTORY").otherwise("STRUCTURE").alias("source"))


def imperfect_surface(c: Column) -> Column:
    """A prefix letter with fatha or damma before a consonant; not a final alef maqsura, nor alla."""
    particle = c.rlike(f"^[أإ][َِ]ل.{{0,3}}{SHADDA}") & c.rlike("^(أَ|إِ)")
    return (F.length(c) >= 4) & c.rlike("^[يتنأ][َُ][^واي]") & ~c.endswith(ALEF_MAQSURA) & ~((F.length(c) >= 5) & particle)


def broken_plural(c: Column) -> Column:
    """An initial alef of any seat, an alef inside and a short case mark at the end."""
    return (F.length(c) >= 5) & c.rlike("^[أإا]") & F.substring(c, F.lit(4), F.length(c)).contains(ALEF) & c.rlike("[ُِ]$")


#: Paths that a kind of boundary decides by itself.
KIND_PATHS = {
    "CLOSED_FUNCTION_WORD": "functional_path", "POSSIBLE_FUNCTION_WORD": "functional_path", "UNDERLICENSED_SHORT_SURFACE": "no_morphology_path",
    "NON_VERBAL_SURFACE": "nominal_morphology_path", "AMBIGUOUS": "ambiguous_morphology_path", "CLITICIZED_SURFACE": "ambiguous_morphology_path",
}


def morphology_path(host: Column, kind: Column) -> Column:
    """Which path a host takes: the boundary's kind decides, else signs of nouns and of verbs.

    Tanwin and the shape of a broken plural outweigh an imperfect's prefix, which outweighs
    the endings of nouns; a case mark alone is the weakest sign, and without any the path
    is ambiguous. No host has no path.
    """
    noun = broken_plural(host) | host.rlike(f"[{TANWIN}]$")
    verb = imperfect_surface(host)
    ending = host.rlike(f"({'|'.join(NOMINAL_TAILS)})$")
    case_mark = ((F.length(host) >= 4) & host.rlike("[ُِ]$")) | ((F.length(host) >= 3) & host.rlike(f"[ُِ]{SHADDA}$"))
    signs = (
        F.when(noun | (ending & ~verb), "nominal_morphology_path")
        .when(verb | host.endswith("تْ") | (kind == "COMPRESSED_VERB_CANDIDATE"), "verbal_root_path")
        .when(case_mark, "nominal_morphology_path")
        .otherwise("ambiguous_morphology_path")
    )
    return F.when(F.coalesce(host, F.lit("")) == "", "no_morphology_path").otherwise(F.coalesce(F.try_element_at(_map(KIND_PATHS), kind), signs))


def verdict_of(directive: Column) -> Column:
    """A directive as a verdict; an unknown one defers."""
    return F.when(directive == "OPEN", "ACCEPT").when(directive == "BLOCK", "BLOCK").otherwise("DEFER")


def residuals_of(verdict: Column) -> Column:
    """Residual codes that a verdict leaves."""
    table = F.create_map(*[x for v, codes in RESIDUALS.items() for x in (F.lit(v), F.array(*[F.lit(c) for c in codes]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(table, verdict), F.array().cast("array<string>"))


def route_host(host: Column, operator: Column, fixed: Column) -> Column:
    """``route, directive, next_stage``: an empty host, then an operator, then an indeclinable word, else morphology."""
    made = lambda route, directive, stage: F.struct(F.lit(route).alias("route"), F.lit(directive).alias("directive"), F.lit(stage).alias("next_stage"))
    return (
        F.when(F.trim(F.coalesce(host, F.lit(""))) == "", made("EMPTY", "BLOCK", "EMPTY"))
        .when(operator, made("CLOSED_OPERATOR_HOST", "BLOCK", "OPERATOR"))
        .when(fixed, made("MABNI_HOST", "BLOCK", "MABNI"))
        .otherwise(made("MORPHOLOGY_PATH", "OPEN", "ROOT_ENGINE"))
    )


def pre_root(words: DataFrame, surface: str, operator: Column, fixed: Column, slot_verdict: Column) -> DataFrame:
    """``words`` with ``article, host, kind, route, path, verdict, residuals``: the steps before a root.

    The verdict is the highest of BLOCK, DEFER, ACCEPT among those of the boundary, the
    route and the phonological slots; an ambiguous path defers.
    """
    split = words.withColumn("__a", arabic.project_article(F.col(surface))).withColumns({"article": F.col("__a.kind"), "host": F.col("__a.rest")}).drop("__a")
    rows = split.withColumn("__b", assess(F.col("host"))).withColumn("kind", F.col("__b.kind")).withColumn("__d", F.col("__b.directive")).drop("__b")
    rows = rows.withColumn("__r", route_host(F.col("host"), operator, fixed)).withColumns({"route": F.col("__r.route"), "path": morphology_path(F.col("host"), F.col("kind"))})
    path = F.when(F.col("path") == "ambiguous_morphology_path", "DEFER").otherwise("ACCEPT")
    verdicts = F.array(verdict_of(F.col("__d")), verdict_of(F.col("__r.directive")), slot_verdict, path)
    rank = F.array_max(F.transform(verdicts, lambda v: F.when(v == "ACCEPT", 0).when(v == "BLOCK", 2).otherwise(1)))
    verdict = F.when(rank == 2, "BLOCK").when(rank == 1, "DEFER").otherwise("ACCEPT")
    return rows.withColumn("verdict", verdict).withColumn("residuals", residuals_of(F.col("verdict"))).drop("__d", "__r")
