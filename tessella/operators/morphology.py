"""Roots, verb classes, patterns, features and the verb generator as Columns and joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.arabic import ALEF, ALEF_MAQSURA, DAMMA, FATHA, HAMZA, KASRA, SHADDA, SUKUN, WAW, YEH, let, letters, normalize_host, strip_marks

#: Vowel on the second radical in the past and the imperfect, by verb class.
CLASS_VOWELS = [
    ("BAB_I_NASARA", FATHA, DAMMA),
    ("BAB_II_DARABA", FATHA, KASRA),
    ("BAB_III_FATAHA", FATHA, FATHA),
    ("BAB_IV_SAMIA", KASRA, FATHA),
    ("BAB_V_KARUMA", DAMMA, DAMMA),
    ("BAB_VI_HASIBA", KASRA, KASRA),
]
#: Mark on the third radical and what follows it, by tense and mood, person, number, gender.
ENDINGS = [
    ("PAST", "3", "SG", "M", FATHA, ""), ("PAST", "3", "SG", "F", FATHA, "تْ"), ("PAST", "3", "DU", "M", FATHA, "ا"), ("PAST", "3", "DU", "F", FATHA, "تَا"),
    ("PAST", "3", "PL", "M", DAMMA, "وا"), ("PAST", "3", "PL", "F", SUKUN, "نَ"), ("PAST", "2", "SG", "M", SUKUN, "تَ"), ("PAST", "2", "SG", "F", SUKUN, "تِ"),
    ("PAST", "2", "DU", "M", SUKUN, "تُمَا"), ("PAST", "2", "DU", "F", SUKUN, "تُمَا"), ("PAST", "2", "PL", "M", SUKUN, "تُمْ"), ("PAST", "2", "PL", "F", SUKUN, "تُنَّ"),
    ("PAST", "1", "SG", "M", SUKUN, "تُ"), ("PAST", "1", "SG", "F", SUKUN, "تُ"), ("PAST", "1", "PL", "M", SUKUN, "نَا"), ("PAST", "1", "PL", "F", SUKUN, "نَا"),
]
#: Mood, person, number, gender, mark on the third radical, tail and prefix letter of the imperfect.
IMPERFECT_ENDINGS = [
    ("INDICATIVE", "1", "SG", "M", DAMMA, "", "أ"), ("INDICATIVE", "1", "SG", "F", DAMMA, "", "أ"), ("INDICATIVE", "1", "PL", "M", DAMMA, "", "ن"), ("INDICATIVE", "1", "PL", "F", DAMMA, "", "ن"),
    ("INDICATIVE", "2", "SG", "M", DAMMA, "", "ت"), ("INDICATIVE", "2", "SG", "F", KASRA, "ينَ", "ت"), ("INDICATIVE", "2", "DU", "M", FATHA, "انِ", "ت"), ("INDICATIVE", "2", "DU", "F", FATHA, "انِ", "ت"),
    ("INDICATIVE", "2", "PL", "M", DAMMA, "ونَ", "ت"), ("INDICATIVE", "2", "PL", "F", SUKUN, "نَ", "ت"), ("INDICATIVE", "3", "SG", "M", DAMMA, "", "ي"), ("INDICATIVE", "3", "SG", "F", DAMMA, "", "ت"),
    ("INDICATIVE", "3", "DU", "M", FATHA, "انِ", "ي"), ("INDICATIVE", "3", "DU", "F", FATHA, "انِ", "ت"), ("INDICATIVE", "3", "PL", "M", DAMMA, "ونَ", "ي"), ("INDICATIVE", "3", "PL", "F", SUKUN, "نَ", "ي"),
    ("SUBJUNCTIVE", "1", "SG", "M", FATHA, "", "أ"), ("SUBJUNCTIVE", "1", "SG", "F", FATHA, "", "أ"), ("SUBJUNCTIVE", "1", "PL", "M", FATHA, "", "ن"), ("SUBJUNCTIVE", "1", "PL", "F", FATHA, "", "ن"),
    ("SUBJUNCTIVE", "2", "SG", "M", FATHA, "", "ت"), ("SUBJUNCTIVE", "2", "SG", "F", KASRA, "ي", "ت"), ("SUBJUNCTIVE", "2", "DU", "M", FATHA, "ا", "ت"), ("SUBJUNCTIVE", "2", "DU", "F", FATHA, "ا", "ت"),
    ("SUBJUNCTIVE", "2", "PL", "M", DAMMA, "وا", "ت"), ("SUBJUNCTIVE", "2", "PL", "F", SUKUN, "نَ", "ت"), ("SUBJUNCTIVE", "3", "SG", "M", FATHA, "", "ي"), ("SUBJUNCTIVE", "3", "SG", "F", FATHA, "", "ت"),
    ("SUBJUNCTIVE", "3", "DU", "M", FATHA, "ا", "ي"), ("SUBJUNCTIVE", "3", "DU", "F", FATHA, "ا", "ت"), ("SUBJUNCTIVE", "3", "PL", "M", DAMMA, "وا", "ي"), ("SUBJUNCTIVE", "3", "PL", "F", SUKUN, "نَ", "ي"),
    ("JUSSIVE", "1", "SG", "M", SUKUN, "", "أ"), ("JUSSIVE", "1", "SG", "F", SUKUN, "", "أ"), ("JUSSIVE", "1", "PL", "M", SUKUN, "", "ن"), ("JUSSIVE", "1", "PL", "F", SUKUN, "", "ن"),
    ("JUSSIVE", "2", "SG", "M", SUKUN, "", "ت"), ("JUSSIVE", "2", "SG", "F", KASRA, "ي", "ت"), ("JUSSIVE", "2", "DU", "M", FATHA, "ا", "ت"), ("JUSSIVE", "2", "DU", "F", FATHA, "ا", "ت"),
    ("JUSSIVE", "2", "PL", "M", DAMMA, "وا", "ت"), ("JUSSIVE", "2", "PL", "F", SUKUN, "نَ", "ت"), ("JUSSIVE", "3", "SG", "M", SUKUN, "", "ي"), ("JUSSIVE", "3", "SG", "F", SUKUN, "", "ت"),
    ("JUSSIVE", "3", "DU", "M", FATHA, "ا", "ي"), ("JUSSIVE", "3", "DU", "F", FATHA, "ا", "ت"), ("JUSSIVE", "3", "PL", "M", DAMMA, "وا", "ي"), ("JUSSIVE", "3", "PL", "F", SUKUN, "نَ", "ي"),
]


#: Stems by root class, tense, voice and form. 1, 2 and 3 are the radicals, p and i
#: the class's vowels, P the prefix, m and t mark and tail of the ending table. A form is
#: named by person, number and gender, or by its shape: V and C in the past (a vowel or a
#: consonant follows the third radical), PLAIN, 2SGF, DU, PLM, PLF in the imperfect, with or
#: without the mood; ALL is the rest.
STEMS = [
    ("SOUND", "PAST", "ACTIVE", "ALL", "1َ2p3mt"), ("SOUND", "PAST", "PASSIVE", "ALL", "1ُ2ِ3mt"),
    ("SOUND", "IMPERFECT", "ACTIVE", "ALL", "Pَ1ْ2i3mt"), ("SOUND", "IMPERFECT", "PASSIVE", "ALL", "Pُ1ْ2َ3mt"),
    ("ASSIMILATED_WAW", "PAST", "ACTIVE", "ALL", "1َ2p3mt"), ("ASSIMILATED_WAW", "PAST", "PASSIVE", "ALL", "1ُ2ِ3mt"),
    ("ASSIMILATED_WAW", "IMPERFECT", "ACTIVE", "ALL", "Pَ2i3mt"), ("ASSIMILATED_WAW", "IMPERFECT", "PASSIVE", "ALL", "Pُو2َ3mt"),
    ("HOLLOW_WAW", "PAST", "ACTIVE", "V", "1َا3mt"), ("HOLLOW_WAW", "PAST", "ACTIVE", "C", "1ُ3mt"),
    ("HOLLOW_WAW", "IMPERFECT", "ACTIVE", "PLAIN_JUSSIVE", "Pَ1ُ3mt"), ("HOLLOW_WAW", "IMPERFECT", "ACTIVE", "PLF", "Pَ1ُ3mt"), ("HOLLOW_WAW", "IMPERFECT", "ACTIVE", "ALL", "Pَ1ُو3mt"),
    ("HOLLOW_YAA", "PAST", "ACTIVE", "V", "1َا3mt"), ("HOLLOW_YAA", "PAST", "ACTIVE", "C", "1ِ3mt"),
    ("HOLLOW_YAA", "IMPERFECT", "ACTIVE", "PLAIN_JUSSIVE", "Pَ1ِ3mt"), ("HOLLOW_YAA", "IMPERFECT", "ACTIVE", "PLF", "Pَ1ِ3mt"), ("HOLLOW_YAA", "IMPERFECT", "ACTIVE", "ALL", "Pَ1ِي3mt"),
    ("DEFECTIVE_WAW", "PAST", "ACTIVE", "3SGM", "1َ2َا"), ("DEFECTIVE_WAW", "PAST", "ACTIVE", "3SGF", "1َ2َتْ"), ("DEFECTIVE_WAW", "PAST", "ACTIVE", "3DUF", "1َ2َتَا"),
    ("DEFECTIVE_WAW", "PAST", "ACTIVE", "3PLM", "1َ2َوْا"), ("DEFECTIVE_WAW", "PAST", "ACTIVE", "ALL", "1َ2َوmt"),
    ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "PLAIN_INDICATIVE", "Pَ1ْ2ُو"), ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "PLAIN_SUBJUNCTIVE", "Pَ1ْ2ُوَ"), ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "PLAIN_JUSSIVE", "Pَ1ْ2ُ"),
    ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "2SGF", "Pَ1ْ2ِt"), ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "DU", "Pَ1ْ2ُوَt"), ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "PLM", "Pَ1ْ2ُt"), ("DEFECTIVE_WAW", "IMPERFECT", "ACTIVE", "PLF", "Pَ1ْ2ُوt"),
    ("DEFECTIVE_YAA", "PAST", "ACTIVE", "3SGM", "1َ2َى"), ("DEFECTIVE_YAA", "PAST", "ACTIVE", "3SGF", "1َ2َتْ"), ("DEFECTIVE_YAA", "PAST", "ACTIVE", "3DUF", "1َ2َتَا"),
    ("DEFECTIVE_YAA", "PAST", "ACTIVE", "3PLM", "1َ2َوْا"), ("DEFECTIVE_YAA", "PAST", "ACTIVE", "ALL", "1َ2َيmt"),
    ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "PLAIN_INDICATIVE", "Pَ1ْ2ِي"), ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "PLAIN_SUBJUNCTIVE", "Pَ1ْ2ِيَ"), ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "PLAIN_JUSSIVE", "Pَ1ْ2ِ"),
    ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "2SGF", "Pَ1ْ2ِt"), ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "DU", "Pَ1ْ2ِيَt"), ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "PLM", "Pَ1ْ2ُt"), ("DEFECTIVE_YAA", "IMPERFECT", "ACTIVE", "PLF", "Pَ1ْ2ِيt"),
    ("GEMINATED", "PAST", "ACTIVE", "V", "1َ2mّt"), ("GEMINATED", "PAST", "ACTIVE", "C", "1َ2p3mt"), ("GEMINATED", "PAST", "PASSIVE", "3SGM", "1ُ2mّt"),
    ("GEMINATED", "IMPERFECT", "ACTIVE", "PLAIN_JUSSIVE", "Pَ1i2َّ"), ("GEMINATED", "IMPERFECT", "ACTIVE", "PLF", "Pَ1ْ2i3mt"), ("GEMINATED", "IMPERFECT", "ACTIVE", "ALL", "Pَ1i2mّt"),
]
#: Second person masculine singular of the imperative; W is the silent alef with the vowel that fits.
IMPERATIVES = [
    ("SOUND", "W1ْ2i3ْ"), ("ASSIMILATED_WAW", "2i3ْ"), ("HOLLOW_WAW", "1ُ3ْ"), ("HOLLOW_YAA", "1ِ3ْ"),
    ("DEFECTIVE_WAW", "اُ1ْ2ُ"), ("DEFECTIVE_YAA", "اِ1ْ2ِ"), ("GEMINATED", "1i2َّ"),
]
#: The vowels for which these stems hold, past and imperfect; other verbs of the class are left open.
STEM_VOWELS = {"DEFECTIVE_WAW": (FATHA, DAMMA), "DEFECTIVE_YAA": (FATHA, KASRA)}


def _shape(tense: str, mood: str | None, person: str, number: str, gender: str, mark: str, tail: str) -> list[str]:
    """Names of a form in the stem table, the most special first."""
    if tense == "PAST":
        return [person + number + gender, "C" if mark == SUKUN else "V", "ALL"]
    kind = "PLAIN" if not tail else number if number == "DU" else "2SGF" if number == "SG" else number + gender
    return [f"{kind}_{mood}", kind, "ALL"]


def _forms() -> list[tuple]:
    """``tense, mood, person, number, gender, mark, tail, prefix, special, kind, rest``: 64 in all."""
    rows = [("PAST", None, *row[1:4], *row[4:], None) for row in ENDINGS] + [("IMPERFECT", *row) for row in IMPERFECT_ENDINGS]
    return [(*row, *_shape(*row[:7])) for row in rows]


def endings(spark: SparkSession) -> DataFrame:
    """The same as a table."""
    return spark.createDataFrame(_forms(), "tense string, mood string, person string, number string, gender string, mark string, tail string, prefix string, special string, kind string, rest string")


def stem_class(root: Column) -> Column:
    """The class whose stems a root takes: hamzated roots those of sound ones."""
    kind = root_class(root)
    return F.when(kind.startswith("HAMZATED"), "SOUND").otherwise(kind)


def fill_stem(template: Column, root: Column, past: Column, imperfect: Column, prefix: Column, mark: Column, tail: Column) -> Column:
    """A stem with its radicals, vowels and affixes in their places."""
    out = template
    for place, value in zip("123piPmt", (root[0], root[1], root[2], past, imperfect, prefix, mark, tail), strict=True):
        out = F.replace(out, F.lit(place), F.coalesce(value, F.lit("")))
    return out


def seat_hamza(c: Column) -> Column:
    """Bare hamzas on their seats by the vowels around them; before a sukun or at the end they stay bare."""
    c = F.regexp_replace(c, f"({KASRA}{SHADDA}?){HAMZA}([{FATHA}{DAMMA}])", "$1ئ$2")
    c = F.regexp_replace(F.regexp_replace(c, f"{HAMZA}([{FATHA}{DAMMA}])", "أ$1"), f"{HAMZA}{KASRA}", f"ئ{KASRA}")
    return F.regexp_replace(c, f"{HAMZA}([^{SUKUN}])", "أ$1")


def conjugate(verbs: DataFrame, voices: list[str] = ("ACTIVE", "PASSIVE")) -> DataFrame:
    """All forms of bare verbs: ``verbs(root array<string>, bab_id)`` with the fixed tables of stems and endings.

    ``surface`` is null, and ``status`` DEFER, where the tables have no stem: doubly weak
    roots and those that begin with ya, unknown or augmented classes, passives of hollow and
    defective verbs, defective verbs of other vowels than ``STEM_VOWELS``. Forms of weak roots
    are the grammar's own, also where the surveyed generator joins stem and ending
    without contraction.
    """
    classes = verbs.sparkSession.createDataFrame(CLASS_VOWELS, "bab_id string, past_vowel string, imperfect_vowel string")
    rows = verbs.join(F.broadcast(classes), "bab_id", "left").withColumn("stem", stem_class(F.col("root")))
    # every verb has every form: the fixed table is spread as an array, not joined
    names = ["tense", "mood", "person", "number", "gender", "mark", "tail", "prefix", "special", "kind", "rest", "voice"]
    quoted = lambda v: "cast(null as string)" if v is None else f"'{v}'"
    forms = [f"named_struct({', '.join(f'{quoted(n)}, {quoted(v)}' for n, v in zip(names, (*form, voice), strict=True))})" for form in _forms() for voice in voices]
    rows = rows.select("*", F.explode(F.expr(f"array({', '.join(forms)})")).alias("e")).select(*rows.columns, "e.*")
    stems = F.create_map(*[F.lit(x) for *key, template in STEMS for x in ("|".join(key), template)])
    of = lambda name: F.try_element_at(stems, F.concat_ws("|", "stem", "tense", "voice", name))
    fits = F.col("past_vowel").isNotNull()
    for kind, (past, imperfect) in STEM_VOWELS.items():
        fits = fits & ((F.col("stem") != kind) | ((F.col("past_vowel") == past) & (F.col("imperfect_vowel") == imperfect)))
    rows = rows.withColumn("template", F.when(fits, F.coalesce(of("special"), of("kind"), of("rest"))))
    surface = seat_hamza(fill_stem(F.col("template"), F.col("root"), F.col("past_vowel"), F.col("imperfect_vowel"), F.col("prefix"), F.col("mark"), F.col("tail")))
    return rows.select("root", "bab_id", "tense", "mood", "voice", "person", "number", "gender", surface.alias("surface"), F.when(surface.isNotNull(), "HIGH").otherwise("DEFER").alias("status"))


def imperative(root: Column, vowel: Column) -> Column:
    """Second person masculine singular, from the imperfect's vowel; null where no stem is known."""
    stems = F.create_map(*[F.lit(x) for row in IMPERATIVES for x in row])
    silent = F.concat(F.lit(ALEF), F.when(vowel == DAMMA, DAMMA).otherwise(KASRA))
    template = F.replace(F.try_element_at(stems, stem_class(root)), F.lit("W"), silent)
    none = F.lit("")
    return seat_hamza(fill_stem(template, root, none, vowel, none, none, none))


def root_class(root: Column) -> Column:
    """Class of three radicals: geminate, doubly weak, hollow, defective, assimilated, hamzated, sound."""
    c1, c2, c3 = (F.get(root, F.lit(i)) for i in range(3))
    weak = lambda c: c.isin(WAW, YEH, ALEF, ALEF_MAQSURA)
    hamza = lambda c: c.isin(HAMZA, "أ", "إ", "ؤ", "ئ")
    return (
        F.when(root.isNull() | (F.size(root) != 3), "SOUND")
        .when((c2 == c3) & ~weak(c2), "GEMINATED")
        .when(weak(c1) & weak(c3), "LAFIF_MAFRUQ")
        .when(weak(c2) & weak(c3), "LAFIF_MAQRUN")
        .when(c2 == WAW, "HOLLOW_WAW").when(c2 == YEH, "HOLLOW_YAA")
        .when(c3 == WAW, "DEFECTIVE_WAW").when(c3.isin(YEH, ALEF_MAQSURA), "DEFECTIVE_YAA")
        .when(c1 == WAW, "ASSIMILATED_WAW").when(c1 == YEH, "ASSIMILATED_YAA")
        .when(hamza(c1), "HAMZATED_C1").when(hamza(c2), "HAMZATED_C2").when(hamza(c3), "HAMZATED_C3")
        .otherwise("SOUND")
    )


#: Residual codes of roots.
ROOT_RESIDUALS = [
    "block:root:insufficient_consonants",
    "defer:root:two_consonant_form_unresolved",
    "defer:root:quadriliteral_beyond_scope",
    "defer:root:non_standard_consonant_count",
    "defer:root:lafif_mafruq_unresolved",
    "defer:root:lafif_maqrun_unresolved",
    "defer:root:hollow_underlying_radical_unresolved",
    "defer:root:defective_lam_unresolved",
    "defer:root:assimilated_fa_unresolved",
    "defer:root:prohibited_or_ambiguous_radical",
]


def analyze_root(host: Column) -> Column:
    """``directive, root, residual`` of a host by the number and weakness of its letters."""
    return let(letters(normalize_host(host)), lambda cs: let(_residual(cs), lambda r: _analysis(cs, r)))


def _residual(cs: Column) -> Column:
    """What stands in the way of taking these letters as a root; empty if nothing does."""
    code = ROOT_RESIDUALS
    n, fa, ayn, lam = F.size(cs), F.get(cs, F.lit(0)), F.get(cs, F.lit(1)), F.get(cs, F.lit(2))
    fa_weak, ayn_weak, lam_weak = fa.isin(WAW, YEH), ayn.isin(ALEF, WAW), lam.isin(ALEF, ALEF_MAQSURA, YEH)
    return (
        F.when(n < 2, code[0])
        .when(n == 2, code[1])
        .when(n == 4, code[2])
        .when(n > 4, code[3])
        .when(fa_weak & lam_weak & ~ayn_weak, code[4])
        .when(ayn_weak & lam_weak, code[5])
        .when(ayn_weak, code[6])
        .when(lam_weak, code[7])
        .when(fa_weak, code[8])
        .when(F.exists(cs, lambda c: c.isin(ALEF, ALEF_MAQSURA)), code[9])
        .otherwise("")
    )


def _analysis(cs: Column, residual: Column) -> Column:
    directive = F.when(residual == "", "ACCEPT").when(residual.startswith("block"), "BLOCK").otherwise("DEFER")
    return F.struct(directive.alias("directive"), F.when(residual == "", F.concat_ws("", cs)).alias("root"), residual.alias("residual"))


def root_type(root: Column) -> Column:
    return F.when(root[1] == root[2], "GEMINATE").when(F.exists(root, lambda c: c == HAMZA), "HAMZA").otherwise("SOUND")


#: Patterns of three radicals, with fa, ayn and lam in their places.
PATTERNS = [
    ("FA_A_LA", "فَعَلَ", "MUJARRAD", 1), ("FA_I_LA", "فَعِلَ", "MUJARRAD", 1), ("FA_U_LA", "فَعُلَ", "MUJARRAD", 1), ("FAAALA", "فَعَّلَ", "FORM_II", 2), ("FAA_A_LA", "فَاعَلَ", "FORM_III", 2),
    ("AF_A_LA", "أَفْعَلَ", "FORM_IV", 2), ("TAFA_A_LA", "تَفَعَّلَ", "FORM_V", 3), ("TAFAA_A_LA", "تَفَاعَلَ", "FORM_VI", 3), ("INFA_A_LA", "اِنْفَعَلَ", "FORM_VII", 3), ("IFTA_A_LA", "اِفْتَعَلَ", "FORM_VIII", 3),
    ("ISTAF_A_LA", "اِسْتَفْعَلَ", "FORM_X", 3), ("FAA_IL", "فَاعِل", "ACTIVE_PARTICIPLE", 4), ("MAF_UUL", "مَفْعُول", "PASSIVE_PARTICIPLE", 4),
]


def fill_pattern(pattern: Column, root: Column) -> Column:
    """The pattern with the radicals in the places of fa, ayn and lam."""
    marked = F.translate(pattern, "فعل", "123")
    return F.replace(F.replace(F.replace(marked, F.lit("1"), root[0]), F.lit("2"), root[1]), F.lit("3"), root[2])


def align_patterns(words: DataFrame, patterns: DataFrame, word_id: str, host: str, root: str) -> DataFrame:
    """``word_id, wazn_id, ending``: patterns that a host begins with, by a join on arity.

    ``ending`` is clean, inflectional (a final t with sukun), nominal (a tied t) or not
    kept. Each host meets the patterns of its root's arity, a catalog of fixed size.
    """
    catalog = patterns.select("wazn_id", "pattern", "family", "evidence_rank", F.lit(3).alias("arity"))
    pairs = words.withColumn("arity", F.size(root)).join(catalog, "arity")
    form = normalize_host(fill_pattern(F.col("pattern"), F.col(root)))
    given = normalize_host(F.col(host))
    rest = F.substring(given, F.length(form) + 1, F.length(given))
    kind = F.when(rest == "", "clean").when(rest.rlike("^(تْ)+$"), "inflectional").when(strip_marks(rest).contains("ة"), "nominal")
    return pairs.where(given.startswith(form) & kind.isNotNull()).select(word_id, "wazn_id", "family", "evidence_rank", kind.alias("ending"))


def decide_pattern(words: DataFrame, aligned: DataFrame, word_id: str) -> DataFrame:
    """One match accepts; several, or nominal ones only, defer; none blocks."""
    good = F.col("ending").isin("clean", "inflectional")
    found = aligned.groupBy(word_id).agg(F.count_if(good).alias("n"), F.count(F.lit(1)).alias("any"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_rank", "wazn_id"))), lambda x: x["wazn_id"]), ",").alias("candidates"))
    verdict = F.when(F.col("n") == 1, "ACCEPT").when(F.coalesce("any", F.lit(0)) > 0, "DEFER").otherwise("BLOCK")
    return words.select(word_id).join(found, word_id, "left").select(word_id, verdict.alias("verdict"), F.coalesce("candidates", F.lit("")).alias("candidates"))


def class_candidates(verbs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Verb classes whose vowels are those in evidence; an open vowel leaves all of them.

    One candidate accepts, several defer, none blocks; all candidates are kept.
    """
    open_ = F.col("v.imperfect_vowel").isNull()
    pairs = verbs.alias("v").join(catalog.alias("c"), (F.col("v.past_vowel") == F.col("c.past_vowel")) & (open_ | (F.col("v.imperfect_vowel") == F.col("c.imperfect_vowel"))), "left")
    found = pairs.groupBy("v.verb_id").agg(F.count("c.bab_id").alias("n"), F.array_join(F.array_sort(F.collect_list("c.bab_id")), ",").alias("babs"))
    return found.select("verb_id", F.when(F.col("n") == 1, "ACCEPT").when(F.col("n") > 1, "DEFER").otherwise("BLOCK").alias("directive"), "babs")


def tense(surface: Column) -> Column:
    """IMPERFECT by a prefix letter, IMPERATIVE by a silent alef before a vowelless letter, else PAST."""
    s = F.when(surface.rlike("^[وف]َ.{4}"), F.substring(surface, F.lit(3), F.length(surface))).otherwise(surface)
    return (
        F.when(s.rlike("^[أء]َ.ْ.*وا$"), "IMPERATIVE")
        .when(s.rlike("^[يتن][َُ].ْ") | s.rlike("^أ[َُ].ْ"), "IMPERFECT")
        .when(s.rlike("^ا[ُِ]?[^ل]ْ") & ~strip_marks(s).rlike("^.{3,}ان$"), "IMPERATIVE")
        .otherwise("PAST")
    )


def past_endings() -> list[tuple[str, bool, str]]:
    """Endings of the past in the order in which they are tried: text, whether with marks, person, number and gender."""
    unmarked = lambda x: re.sub("[\u064b-\u0652]", "", x)
    whole = [(mark + tail, True, p + n + g) for _, p, n, g, mark, tail in ENDINGS if tail]
    bare = [(unmarked(tail), False, p + n + g) for _, p, n, g, _, tail in ENDINGS]
    known: dict[tuple[str, bool], str] = {}
    for text, vocal, png in [*whole, *(x for x in bare if len(x[0]) > 1 or x[0] == ALEF)]:
        known.setdefault((text, vocal), png)
    longest = sorted(known.items(), key=lambda x: (-len(unmarked(x[0][0])), not x[0][1], -len(x[0][0])))
    return [(text, vocal, png) for (text, vocal), png in longest]


def past_features(surface: Column) -> Column:
    """``person, number, gender, voice`` of a past form: that of the longest ending it has.

    The endings are those of ``ENDINGS``, with the mark before them; a word written
    without that mark is told by the letters of its tail, if it has more than one letter
    or a final alef. Where two forms share an ending the first listed is taken, and a form
    without any is 3 SG M.
    """
    table = F.array(*[F.struct(F.lit(text).alias("end"), F.lit(vocal).alias("vocal"), F.lit(png).alias("png")) for text, vocal, png in past_endings()])
    fits = F.filter(table, lambda e: F.when(e["vocal"], surface.endswith(e["end"])).otherwise(strip_marks(surface).endswith(e["end"])))
    png = F.coalesce(F.get(fits, F.lit(0))["png"], F.lit("3SGM"))
    voice = F.when(surface.rlike(f"^.{DAMMA}.{KASRA}"), "PASSIVE").otherwise("ACTIVE")
    return F.struct(F.substring(png, 1, 1).alias("person"), F.substring(png, 2, 2).alias("number"), F.substring(png, 4, 1).alias("gender"), voice.alias("voice"))


def imperfect_readings(surface: Column) -> Column:
    """All ``person, number, gender`` readings of an imperfect form; t- without a tail has two."""
    bare = strip_marks(surface)
    first = F.substring(bare, 1, 1)
    reading = lambda p, n, g: F.struct(F.lit(p).alias("person"), F.lit(n).alias("number"), F.lit(g).alias("gender"))
    long = F.length(bare) > 4
    return (
        F.when(first.isin("أ", HAMZA), F.array(reading("1", "SG", "M")))
        .when(first == "ن", F.array(reading("1", "PL", "M")))
        .when(bare.rlike("(ون|وا)$") & long, F.array(F.struct(F.when(first == "ت", "2").otherwise("3").alias("person"), F.lit("PL").alias("number"), F.lit("M").alias("gender"))))
        .when(bare.rlike("(ين|ي)$") & (first == "ت") & long, F.array(reading("2", "SG", "F")))
        .when(bare.endswith("ان") & (first == "ت"), F.array(reading("2", "DU", "M"), reading("3", "DU", "F")))
        .when(bare.endswith("ان"), F.array(reading("3", "DU", "M")))
        .when(surface.endswith("ْنَ"), F.array(F.struct(F.when(first == "ت", "2").otherwise("3").alias("person"), F.lit("PL").alias("number"), F.lit("F").alias("gender"))))
        .when(first == "ت", F.array(reading("2", "SG", "M"), reading("3", "SG", "F")))
        .otherwise(F.array(reading("3", "SG", "M")))
    )


#: Derived nouns that a verb family licenses, by transitivity: (type, family, transitivity, verdict).
ELIGIBLE = [
    (kind, family, trans, "BLOCK" if kind == "PASSIVE_PARTICIPLE" and trans == "INTRANSITIVE" else "DEFER" if kind in ("STATIVE_ADJECTIVE", "INSTRUMENT") and family != "MUJARRAD" else "ACCEPT")
    for kind in ("ACTIVE_PARTICIPLE", "PASSIVE_PARTICIPLE", "STATIVE_ADJECTIVE", "INTENSIVE", "ELATIVE", "TIME", "PLACE", "INSTRUMENT")
    for family in ("MUJARRAD", "AUGMENTED")
    for trans in ("TRANSITIVE", "INTRANSITIVE")
]


def derived_nouns(verbs: DataFrame) -> DataFrame:
    """Each verb's eight types with a verdict, from the decision table, and the overall one."""
    table = verbs.sparkSession.createDataFrame(ELIGIBLE, "kind string, family string, transitivity string, verdict string")
    found = verbs.join(F.broadcast(table), ["family", "transitivity"])
    n = F.count_if(F.col("verdict") == "ACCEPT")
    total = found.groupBy("verb_id").agg(F.when(n == 8, "ACCEPT").when(n > 0, "PARTIAL_ACCEPT").otherwise("DEFER").alias("overall"), n.alias("n_accepted"))
    return found.join(total, "verb_id").select("verb_id", "kind", "verdict", "overall", "n_accepted")


def augmented_form(host: Column) -> Column:
    """Augmented verb form of a past host by its skeleton, or null."""
    return let(normalize_host(host), _form_of)


def _form_of(h: Column) -> Column:
    v = "[َُِ]"
    return (
        F.when(h.rlike(f"^ا{v}?سْت{v}.ْ.{v}.{v}?$"), "FORM_X").when(h.rlike(f"^ا{v}?نْ.{v}.{v}.{v}?$"), "FORM_VII").when(h.rlike(f"^ا{v}?.ْت{v}.{v}.{v}?$"), "FORM_VIII")
        .when(h.rlike(f"^ت{v}.{v}(.)ْ\\1{v}.{v}?$"), "FORM_V").when(h.rlike(f"^ت{v}.{v}ا.{v}.{v}?$"), "FORM_VI").when(h.rlike(f"^ء{v}.ْ.{v}.{v}?$"), "FORM_IV")
        .when(h.rlike(f"^.{v}(.)ْ\\1{v}.{v}?$"), "FORM_II").when(h.rlike(f"^.{v}ا.{v}.{v}?$"), "FORM_III")
    )
