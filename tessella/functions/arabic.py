"""Vocalised Arabic as Column expressions: marks, normalisation, phones, syllables.

Every function takes and returns Columns, so a token pipeline stays one projection. All
letters and marks are in the basic plane, so Java's regular expressions see one unit each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks and letters.
FATHA, DAMMA, KASRA, SHADDA, SUKUN = "َ", "ُ", "ِ", "ّ", "ْ"
TANWIN = "ًٌٍ"
HAMZA, ALEF, ALEF_MADDA, ALEF_MAQSURA, WAW, YEH, TATWEEL = "ء", "ا", "آ", "ى", "و", "ي", "ـ"
SEATED_HAMZA = "أإؤئ"
_MARK = "[ً-ٰٕ]"
_OTHER_MARK = "[ً-ِْ-ٰٕ]"
_BASE = "[ء-غف-ي]"
_VOWEL = f"[{FATHA}{DAMMA}{KASRA}{TANWIN}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, _MARK, "")


def letters(c: Column) -> Column:
    """Letters without marks, as an array; spaces go too."""
    return F.filter(F.split(strip_marks(F.regexp_replace(c, " ", "")), ""), lambda x: x != "")


def count_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(strip_marks(c), f"[^{_BASE[1:-1]}]", ""))


def normalize_hamza(c: Column) -> Column:
    """Seated hamzas become bare ones; alef with madda becomes hamza, fatha, alef."""
    return F.regexp_replace(F.regexp_replace(c, ALEF_MADDA, HAMZA + FATHA + ALEF), f"[{SEATED_HAMZA}]", HAMZA)


def normalize_article(c: Column) -> Column:
    """Alef and lam at the beginning of a word become hamza, fatha, lam."""
    return F.regexp_replace(c, f"(^| ){ALEF}ل", f"$1{HAMZA}{FATHA}ل")


def normalize_shadda(c: Column) -> Column:
    """A doubled letter becomes the letter with sukun and the letter with its other marks."""
    return F.regexp_replace(c, f"({_BASE})({_OTHER_MARK}*){SHADDA}({_OTHER_MARK}*)", f"$1{SUKUN}$1$2$3")


def normalize(c: Column) -> Column:
    """Hamza, article, doubling: always in this order."""
    return normalize_shadda(normalize_article(normalize_hamza(c)))


def normalize_host(c: Column) -> Column:
    """For roots and patterns: hamza and doubling, not the article."""
    return normalize_shadda(normalize_hamza(c))


def starts_with_article(c: Column) -> Column:
    return strip_marks(c).startswith(ALEF + "ل")


#: Letters before which the article's lam is assimilated.
SOLAR = "تثدذرزسشصضطظلن"


def project_article(c: Column) -> Column:
    """``kind, article, rest``: LUNAR with a sukun on lam, SOLAR before a solar letter, which loses its doubling."""
    lunar = f"^({ALEF}ل{SUKUN})(.+)$"
    solar = f"^({ALEF}ل)([{SOLAR}])({_OTHER_MARK}*){SHADDA}(.*)$"
    part = lambda p, i: F.regexp_extract(c, p, i)
    none = F.struct(F.lit("NONE").alias("kind"), F.lit("").alias("article"), c.alias("rest"))
    return (
        F.when(c.rlike(lunar), F.struct(F.lit("LUNAR").alias("kind"), part(lunar, 1).alias("article"), part(lunar, 2).alias("rest")))
        .when(c.rlike(solar), F.struct(F.lit("SOLAR").alias("kind"), part(solar, 1).alias("article"), F.concat(part(solar, 2), part(solar, 3), part(solar, 4)).alias("rest")))
        .otherwise(none)
    )


def attach_article(c: Column) -> Column:
    return F.concat(F.lit(ALEF + "ل"), c)


def mark_class(mark: Column) -> Column:
    """Class of one combining mark."""
    kinds = {FATHA: "VOWEL", DAMMA: "VOWEL", KASRA: "VOWEL", SUKUN: "SUKUN", SHADDA: "SHADDA", "ٰ": "DAGGER", "ٓ": "MADDA", "ٔ": "HAMZA", "ٕ": "HAMZA"}
    kinds |= dict.fromkeys(TANWIN, "TANWIN")
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mark), F.lit("UNKNOWN"))


def mark_state(marks: Column) -> Column:
    """State of a letter by the classes of its marks: conflicts first, then the strongest."""
    n = lambda k: F.size(F.filter(marks, lambda m: m == k))
    clash = (n("VOWEL") > 1) | ((n("VOWEL") > 0) & (n("SUKUN") > 0)) | ((n("TANWIN") > 0) & (n("SUKUN") > 0)) | ((n("VOWEL") > 0) & (n("TANWIN") > 0)) | ((n("SHADDA") > 0) & (n("SUKUN") > 0))
    return (
        F.when(clash, "CONFLICT").when(n("TANWIN") > 0, "TANWIN").when(n("VOWEL") > 0, "EXPLICIT_VOWEL").when(n("SUKUN") > 0, "EXPLICIT_SUKUN").when(n("SHADDA") > 0, "SHADDA_COMPOUND").otherwise("ABSENT")
    )


def phones(c: Column) -> Column:
    """``char, marks, role`` of each letter of a word, doubled letters and madda expanded.

    Role: VL for a letter that lengthens, M for one with a vowel, S for one without.
    Characters that are no letters are left out.
    """
    text = F.regexp_replace(F.regexp_replace(c, TATWEEL, ""), ALEF_MADDA, HAMZA + FATHA + ALEF)
    units = F.regexp_extract_all(normalize_shadda(text), F.lit(f"({_BASE}{_MARK}*)"), F.lit(1))

    def phone(u: Column) -> Column:
        char, marks = F.substring(u, 1, 1), F.substring(u, F.lit(2), F.length(u))
        vowelled = marks.rlike(_VOWEL)
        role = F.when(char.isin(ALEF, ALEF_MAQSURA) | (char.isin(WAW, YEH) & ~vowelled), "VL").when(vowelled, "M").otherwise("S")
        return F.struct(char.alias("char"), marks.alias("marks"), role.alias("role"))

    return F.transform(units, phone)


def gate_phone(phone: Column) -> Column:
    """Cell that a phone builds: CV, C or V; BLOCK for marks outside the licensed ones."""
    bad = phone["marks"].rlike("[ٓ-ٰٕ]")
    return F.when(bad, "BLOCK").when(phone["role"] == "VL", "V").when(phone["role"] == "M", "CV").otherwise("C")


_OPEN = ["CV", "CVV", "CVC", "CVVC", "CVCC", "CVVCC"]


def syllables(p: Column) -> Column:
    """``surface, pattern, gate, reason`` of the slots of a word's phones, by a fold.

    A vowelled letter closes the open slot and opens CV; a lengthening letter turns CV into
    CVV; a vowelless one adds a coda. Two silent alefs have slots without a gate: at the
    beginning before a vowelless letter, and at the end after CVV.
    """
    slot = lambda surface, pattern, gate, reason: F.struct(surface.alias("surface"), pattern.alias("pattern"), gate.alias("gate"), reason.alias("reason"))
    lit = F.lit
    empty = F.array().cast("array<struct<surface:string,pattern:string,gate:string,reason:string>>")
    gate = lambda pat: F.when(pat.isin(_OPEN), "ACCEPT").when(pat.isin("", "C"), "DEFER").otherwise("BLOCK")
    n = F.size(p)
    numbered = F.transform(
        p,
        lambda x, i: F.struct(
            F.concat(x["char"], x["marks"]).alias("s"), x["role"].alias("role"), (x["char"] == ALEF).alias("alef"), (i == n - 1).alias("last"), F.coalesce(F.get(p, i + 1)["role"] == "S", lit(False)).alias("next_s")
        ),
    )
    start = F.struct(lit("").alias("surface"), lit("").alias("pattern"), empty.alias("done"))

    def closed(acc: Column, reason: Column) -> Column:
        return F.when(acc["surface"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(slot(acc["surface"], acc["pattern"], gate(acc["pattern"]), reason))))

    def state(surface: Column, pattern: Column, done: Column) -> Column:
        return F.struct(surface.alias("surface"), pattern.alias("pattern"), done.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        pat, grown = acc["pattern"], F.concat(acc["surface"], x["s"])
        vowelled = state(x["s"], lit("CV"), closed(acc, F.when(pat.isin(_OPEN), "SATURATED").otherwise("BLOCK_ORPHAN")))
        longer = F.when(pat.isin("C", "CV"), F.concat(pat, lit("V")))
        silent = F.concat(acc["done"], F.array(slot(x["s"], lit("WASL"), lit(""), lit("SILENT_INITIAL"))))
        final = F.concat(closed(acc, lit("FINAL_ALEF")), F.array(slot(x["s"], lit("FARQA"), lit(""), lit("FINAL_ALEF"))))
        vowel = (
            F.when(longer.isNotNull(), state(grown, longer, acc["done"]))
            .when((pat == "") & x["alef"] & x["next_s"], state(lit(""), lit(""), silent))
            .when((pat == "CVV") & x["alef"] & x["last"], state(lit(""), lit(""), final))
            .otherwise(state(grown, F.concat(pat, lit("+V")), acc["done"]))
        )
        coda = F.when(pat.isin("", "CV", "CVV", "CVC", "CVVC"), F.concat(pat, lit("C")))
        still = F.when(coda.isNotNull(), state(grown, coda, acc["done"])).otherwise(state(x["s"], lit("C"), closed(acc, lit("BLOCK_SAKIN"))))
        return F.when(x["role"] == "M", vowelled).when(x["role"] == "VL", vowel).otherwise(still)

    return F.aggregate(numbered, start, step, lambda acc: closed(acc, lit("WORD_END")))


def word_gate(slots: Column) -> Column:
    """BLOCK over DEFER over ACCEPT of a word's slots; DEFER for none."""
    any_of = lambda g: F.exists(slots, lambda s: s["gate"] == g)
    return F.when(F.size(slots) == 0, "DEFER").when(any_of("BLOCK"), "BLOCK").when(any_of("DEFER"), "DEFER").otherwise("ACCEPT")


def align_spans(raw: Column) -> Column:
    """``raw_start, raw_end, norm_start, norm_end, op`` of the hamza and doubling steps.

    One entry for each letter with its marks, in order; ends are exclusive. The article
    step changes lengths only at word beginnings and is left to ``normalize``.
    """
    units = F.regexp_extract_all(raw, F.lit(f"({_BASE}{_MARK}*|.)"), F.lit(1))
    pairs = F.transform(units, lambda u: F.struct(u.alias("r"), normalize_host(u).alias("n")))
    empty = F.array().cast("array<struct<raw_start:int,raw_end:int,norm_start:int,norm_end:int,op:string>>")
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("n"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        r, n = acc["r"] + F.length(x["r"]), acc["n"] + F.length(x["n"])
        op = F.when(x["r"] == x["n"], "IDENTITY").when(F.length(x["n"]) > F.length(x["r"]), "EXPAND").when(F.length(x["n"]) < F.length(x["r"]), "CONTRACT").otherwise("REPLACE")
        entry = F.struct(acc["r"].alias("raw_start"), r.alias("raw_end"), acc["n"].alias("norm_start"), n.alias("norm_end"), op.alias("op"))
        return F.struct(r.alias("r"), n.alias("n"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def project_span(entries: Column, start: Column, end: Column) -> Column:
    """``start, end`` in the normalised text of a raw span; a span that meets no entry stays as it is."""
    met = F.filter(entries, lambda e: (e["raw_start"] < end) & (e["raw_end"] > start))
    same = lambda e: (e["raw_end"] - e["raw_start"]) == (e["norm_end"] - e["norm_start"])
    low = F.array_min(F.transform(met, lambda e: F.when(same(e), e["norm_start"] + F.greatest(start - e["raw_start"], F.lit(0))).otherwise(e["norm_start"])))
    high = F.array_max(F.transform(met, lambda e: F.when(same(e), e["norm_end"] - F.greatest(e["raw_end"] - end, F.lit(0))).otherwise(e["norm_end"])))
    return F.struct(F.coalesce(low, start).alias("start"), F.coalesce(high, end).alias("end"))


def _units(c: Column) -> Column:
    """Letters, each with its marks."""
    return F.regexp_extract_all(c, F.lit(f"({_BASE}{_MARK}*)"), F.lit(1))


def mark_mask(c: Column) -> Column:
    """A digit for each letter of a word: 1 if it has marks, else 0."""
    return F.array_join(F.transform(_units(c), lambda u: F.when(F.length(u) == 1, "0").otherwise("1")), "")


def masked_marks(c: Column, mask: Column | None = None) -> Column:
    """The letters of a word with the marks of those that ``mask`` marks with 1; without one, with all.

    A word is compatible with a known form of the same letters where both are the same under
    the word's own mask.
    """
    if mask is None:
        return F.array_join(_units(c), "")
    return F.array_join(F.transform(_units(c), lambda u, i: F.when(F.substr(mask, i + 1, F.lit(1)) == "0", F.substring(u, 1, 1)).otherwise(u)), "")


def marks_compatible(given: Column, known: Column) -> Column:
    """Whether each mark that is written also stands at that letter of the known form."""
    units = lambda c: F.regexp_extract_all(c, F.lit(f"({_BASE}{_MARK}*)"), F.lit(1))
    fits = lambda a, b: (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((F.length(a) == 1) | (a == b))
    a, b = units(given), units(known)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, fits), lambda x: F.coalesce(x, F.lit(False)))
