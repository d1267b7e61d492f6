"""Glyphs of Arabic words: base classes, licences, traces with places, shapes of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.arabic import _MARK, DAMMA, FATHA, KASRA, SHADDA, SUKUN, TANWIN, mark_class, mark_state

#: Classes of base letters; the plain consonants are a range without these.
BASE_CLASSES = {
    "ء": "HAMZA_ALONE", "آ": "ALEF_MADDA", "أ": "HAMZA_ON_ALEF_ABOVE", "ؤ": "HAMZA_ON_WAW", "إ": "HAMZA_ON_ALEF_BELOW", "ئ": "HAMZA_ON_YA",
    "ا": "LONG_VOWEL_ALEF", "ة": "CONSONANT_TA_MARBUTA", "ـ": "TATWEEL", "و": "SEMI_VOWEL_WAW", "ى": "ALIF_MAQSURA", "ي": "SEMI_VOWEL_YA",
}
#: Classes that the first gate lets through; seated hamzas are normalised before it.
LICENSED = ["CONSONANT_PLAIN", "CONSONANT_TA_MARBUTA", "HAMZA_ALONE", "LONG_VOWEL_ALEF", "ALIF_MAQSURA", "SEMI_VOWEL_WAW", "SEMI_VOWEL_YA"]


def base_class(letter: Column) -> Column:
    """Class of one base character; UNKNOWN for any that is no Arabic letter."""
    table = F.create_map(*[F.lit(x) for pair in BASE_CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, letter), F.when(letter.rlike("^[ب-غف-ه]$"), "CONSONANT_PLAIN"), F.lit("UNKNOWN"))


def licensed(kind: Column) -> Column:
    return kind.isin(LICENSED)


def traces(word: Column) -> Column:
    """``base, marks, kind, state, start, stop`` of each base character with its marks, in order.

    Places are of the word as given (in composed form, see ``unicode.nfc``); ends are exclusive.
    """
    units = F.regexp_extract_all(word, F.lit(f"([^{_MARK[1:-1]}]{_MARK}*)"), F.lit(1))
    empty = F.array().cast("array<struct<base:string,marks:string,kind:string,state:string,start:int,stop:int>>")

    def step(acc: Column, u: Column) -> Column:
        base, marks, stop = F.substring(u, 1, 1), F.substring(u, F.lit(2), F.length(u)), acc["at"] + F.length(u)
        classes = F.transform(F.filter(F.split(marks, ""), lambda m: m != ""), mark_class)
        one = F.struct(base.alias("base"), marks.alias("marks"), base_class(base).alias("kind"), mark_state(classes).alias("state"), acc["at"].alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(units, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def judgment(trace: Column) -> Column:
    """``verdict, reason`` of one trace at the first gate."""
    ok = licensed(trace["kind"])
    return F.struct(F.when(ok, "PASS").otherwise("BLOCK").alias("verdict"), F.concat(trace["base"], F.when(ok, " licensed: ").otherwise(" not licensed: "), trace["kind"]).alias("reason"))


def _bases(glyphs: Column) -> Column:
    return F.filter(glyphs, lambda t: t["kind"] != "TATWEEL")


def last_base(glyphs: Column) -> Column:
    """The last trace that is no tatweel, or null."""
    return F.try_element_at(_bases(glyphs), F.lit(-1))


def imperfect_shape(glyphs: Column) -> Column:
    """ya or ta with fatha, then a letter with sukun, of four letters at least."""
    b = _bases(glyphs)
    first, second = F.get(b, F.lit(0)), F.get(b, F.lit(1))
    return F.coalesce((F.size(b) >= 4) & first["base"].isin("ي", "ت") & (first["state"] == "EXPLICIT_VOWEL") & first["marks"].contains(FATHA) & (second["state"] == "EXPLICIT_SUKUN"), F.lit(False))


def dual_host(glyphs: Column) -> Column:
    """A past form that the dual's alef may follow: it begins with fatha, not on ya, nor with the article."""
    b = _bases(glyphs)
    first, second = F.get(b, F.lit(0)), F.get(b, F.lit(1))
    article = (first["kind"] == "HAMZA_ALONE") & first["marks"].contains(FATHA) & (second["base"] == "ل")
    return F.coalesce((F.size(b) >= 3) & (first["base"] != "ي") & (first["state"] == "EXPLICIT_VOWEL") & first["marks"].contains(FATHA) & ~article, F.lit(False))


def first_mark(cluster: Column) -> Column:
    """The first mark of a letter's cluster, or null."""
    return F.nullif(F.regexp_extract(cluster, _MARK, 0), F.lit(""))


def has_short_vowel(cluster: Column) -> Column:
    return cluster.rlike(f"[{FATHA}{DAMMA}{KASRA}]")


def is_vowelless(cluster: Column) -> Column:
    """A sukun, or no vowel and no tanwin."""
    return cluster.contains(SUKUN) | ~cluster.rlike(f"[{FATHA}{DAMMA}{KASRA}{TANWIN}]")


def double(letter: Column, vowel: Column) -> Column:
    """A doubled letter as two: the first without a vowel, the second with it."""
    return F.struct(F.concat(letter, F.lit(SUKUN)).alias("first"), F.concat(letter, vowel).alias("second"))


def is_doubled(cluster: Column) -> Column:
    return cluster.contains(SHADDA)
