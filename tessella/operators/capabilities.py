"""Capabilities of word records: one struct for each, from columns of the record.

A record has ``surface, word_class, verdict, error, number, person, gender, article,
definiteness, state, irab, derivation, root, pattern, verbal_noun``; any may be null. A
capability is ``capability, status, value, label_ar, label, residual`` with the status
PROVIDED, AMBIGUOUS, DEFERRED, BLOCKED or NOT_APPLICABLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.arabic import strip_marks

#: Labels of word classes, in Arabic and English.
WORD_CLASSES = [
    ("FI3L", "فعل", "Verb"), ("FI3L_MADI", "فعل ماضٍ", "Past Verb"), ("FI3L_MUDARI", "فعل مضارع", "Present/Future Verb"), ("FI3L_AMR", "فعل أمر", "Imperative Verb"),
    ("ISM", "اسم", "Noun"), ("ISM_MAFOOL", "اسم مفعول", "Passive Participle"), ("ISM_FAIL", "اسم فاعل", "Active Participle"), ("ISM_MASDAR", "مصدر", "Verbal Noun (Masdar)"), ("ISM_AALAM", "اسم علم", "Proper Noun"),
    ("ISM_NISBAH", "اسم نسبة", "Relative Adjective"), ("ISM_TAFDIL", "اسم تفضيل", "Elative/Comparative"), ("ISM_ZAMAN", "اسم زمان", "Noun of Time"), ("ISM_MAKAN", "اسم مكان", "Noun of Place"),
    ("DAMIR", "ضمير", "Pronoun"), ("DAMIR_MUNFASIL", "ضمير منفصل", "Detached Pronoun"), ("DAMIR_MUTTASIL", "ضمير متصل", "Attached Pronoun"),
    ("HARF", "حرف", "Particle"), ("HARF_JAR", "حرف جر", "Preposition"), ("HARF_ATF", "حرف عطف", "Conjunction"), ("HARF_NIDA", "حرف نداء", "Vocative Particle"), ("HARF_SHART", "حرف شرط", "Conditional Particle"),
    ("HARF_NAFI", "حرف نفي", "Negation Particle"), ("HARF_JAWAB", "حرف جواب", "Response Particle"), ("HARF_TAHQIQ", "حرف تحقيق", "Affirmation Particle"),
    ("ISM_MAWSOOL", "اسم موصول", "Relative Pronoun/Noun"), ("ISM_ISHARAH", "اسم إشارة", "Demonstrative"), ("ISM_SHART", "اسم شرط", "Conditional Noun"), ("ISM_ISTIFHAM", "اسم استفهام", "Interrogative Noun"),
]
#: Feature, spelling, value, labels.
FEATURES = [
    ("number", "SINGULAR", "SG", "مفرد", "SINGULAR"), ("number", "SG", "SG", "مفرد", "SINGULAR"), ("number", "1", "SG", "مفرد", "SINGULAR"), ("number", "DUAL", "DU", "مثنى", "DUAL"), ("number", "DU", "DU", "مثنى", "DUAL"),
    ("number", "PLURAL", "PL", "جمع", "PLURAL"), ("number", "PL", "PL", "جمع", "PLURAL"), ("number", "3", "PL", "جمع", "PLURAL"),
    ("gender", "M", "M", "مذكر", "MASCULINE"), ("gender", "MALE", "M", "مذكر", "MASCULINE"), ("gender", "MASC", "M", "مذكر", "MASCULINE"), ("gender", "MASCULINE", "M", "مذكر", "MASCULINE"),
    ("gender", "F", "F", "مؤنث", "FEMININE"), ("gender", "FEMALE", "F", "مؤنث", "FEMININE"), ("gender", "FEM", "F", "مؤنث", "FEMININE"), ("gender", "FEMININE", "F", "مؤنث", "FEMININE"), ("gender", "COMMON", "COMMON", "مشترك", "COMMON_GENDER"),
    ("definiteness", "DEF", "DEF", "معرفة", "DEFINITE"), ("definiteness", "DEFINITE", "DEF", "معرفة", "DEFINITE"), ("definiteness", "INDEF", "INDEF", "نكرة", "INDEFINITE"), ("definiteness", "INDEFINITE", "INDEF", "نكرة", "INDEFINITE"),
    ("definiteness", "NAKED", "INDEF", "نكرة", "INDEFINITE"), ("definiteness", "CONSTRUCT", "CONSTRUCT", "مضاف", "CONSTRUCT_STATE"), ("definiteness", "MUDAF", "CONSTRUCT", "مضاف", "CONSTRUCT_STATE"), ("definiteness", "PREDICATE", "PREDICATE", "خبر", "PREDICATE"),
    ("state", "MABNI", "MABNI", "مبني", "MABNI (invariable)"), ("state", "MURAB", "MURAB", "معرب", "MURAB (inflected)"),
    ("irab", "NOM", "MARFOO3", "مرفوع", "MARFOO3"), ("irab", "NOMINATIVE", "MARFOO3", "مرفوع", "MARFOO3"), ("irab", "MARFOO3", "MARFOO3", "مرفوع", "MARFOO3"), ("irab", "ACC", "MANSOOB", "منصوب", "MANSOOB"),
    ("irab", "ACCUSATIVE", "MANSOOB", "منصوب", "MANSOOB"), ("irab", "MANSOOB", "MANSOOB", "منصوب", "MANSOOB"), ("irab", "GEN", "MAJROOR", "مجرور", "MAJROOR"), ("irab", "GENITIVE", "MAJROOR", "مجرور", "MAJROOR"),
    ("irab", "MAJROOR", "MAJROOR", "مجرور", "MAJROOR"), ("irab", "JUS", "MAJZOOM", "مجزوم", "MAJZOOM"), ("irab", "JUSSIVE", "MAJZOOM", "مجزوم", "MAJZOOM"), ("irab", "MAJZOOM", "MAJZOOM", "مجزوم", "MAJZOOM"),
    ("derivation", "JAMID", "JAMID", "جامد", "JAMID"), ("derivation", "JAMID_AALAM", "JAMID_AALAM", "جامد", "JAMID"), ("derivation", "FROZEN", "FROZEN", "جامد", "JAMID"), ("derivation", "NON_DERIVED", "NON_DERIVED", "جامد", "JAMID"),
    ("derivation", "MUSHTAQ", "MUSHTAQ", "مشتق", "MUSHTAQ"), ("derivation", "DERIVED", "DERIVED", "مشتق", "MUSHTAQ"), ("derivation", "MUSYTAQ", "MUSYTAQ", "مشتق", "MUSHTAQ"),
]
#: Operators by type; a word of two types counts for the first.
OPERATORS = [
    ("CONJUNCTION", ["وَ", "فَ", "ثُمَّ", "أَوْ", "أَمْ", "بَلْ", "لَكِنْ"]), ("CONDITIONAL", ["إِذَا", "إِنْ", "لَوْ", "مَتَى", "أَيَّانَ", "كُلَّمَا"]), ("NEGATION", ["لَا", "لَمْ", "لَنْ", "لَيْسَ", "مَا", "لَاتَ"]),
    ("IMPERATIVE_OPERATOR", ["لِيَ", "لْيَ", "لِ"]), ("VOCATIVE", ["يَا", "أَيُّهَا", "أَيَّتُهَا", "هَيَا", "أَيَا"]), ("PREPOSITION", ["فِي", "إِلَى", "مِنْ", "عَلَى", "عَنْ", "بِ", "كَ"]),
    ("RELATIVE", ["الَّذِي", "الَّتِي", "الَّذِينَ", "اللَّاتِي", "مَنْ"]),
]
#: Classes that are never inflected.
INVARIABLE = "^(HARF|DAMIR|ISM_ISHARAH|ISM_MAWSOOL)|^FI3L_(MADI|AMR)$"


def _made(capability: str, status: str | Column, value: Column | None = None, label_ar: Column | None = None, label: Column | None = None, residual: str | Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(capability).alias("capability"), lit(status).alias("status"), lit(value).alias("value"), lit(label_ar).alias("label_ar"), lit(label).alias("label"), lit(residual).alias("residual"))


def _feature(name: str, raw: Column) -> Column:
    """``value, label_ar, label`` of a spelling of one feature, from the fixed table; unknown ones stand for themselves."""
    raw = F.trim(F.upper(raw))
    table = F.create_map(*[x for f, spelling, value, ar, en in FEATURES if f == name for x in (F.lit(spelling), F.struct(F.lit(value).alias("value"), F.lit(ar).alias("label_ar"), F.lit(en).alias("label")))])
    return F.coalesce(F.try_element_at(table, raw), F.struct(raw.alias("value"), raw.alias("label_ar"), raw.alias("label")))


def word_class() -> Column:
    known = F.nullif(F.col("word_class"), F.lit("UNKNOWN"))
    labels = F.create_map(*[x for cls, ar, en in WORD_CLASSES for x in (F.lit(cls), F.struct(F.lit(ar).alias("ar"), F.lit(en).alias("en")))])
    label, ok = F.try_element_at(labels, known), F.upper(F.coalesce("verdict", F.lit(""))).contains("ACCEPT")
    found = _made("CAP_WORD_CLASS", F.when(ok, "PROVIDED").otherwise("AMBIGUOUS"), known, F.coalesce(label["ar"], F.lit("مجهول")), F.coalesce(label["en"], known), F.when(~ok, "WORD_CLASS_VERDICT_UNCLEAR"))
    return F.when(known.isNull(), _made("CAP_WORD_CLASS", "DEFERRED", residual="WORD_CLASS_NOT_DETERMINED")).otherwise(found)


def nominal_number() -> Column:
    """SG, DU or PL. "2" is a dual only where no person is given; other digits may be a person."""
    raw = F.trim(F.upper(F.col("number")))
    raw = F.when((raw == "2") & F.col("person").isNull(), "DU").otherwise(raw)
    f, digits = _feature("number", raw), raw.rlike("^[0-9]+$") & ~raw.isin("1", "3")
    return (
        F.when(F.col("number").isNull(), _made("CAP_NOMINAL_NUMBER", "NOT_APPLICABLE", residual="NUMBER_NOT_IN_MORPHOSYNTAX"))
        .when(digits, _made("CAP_NOMINAL_NUMBER", "AMBIGUOUS", raw, residual="NUMBER_AMBIGUOUS_WITH_PERSON_FIELD"))
        .otherwise(_made("CAP_NOMINAL_NUMBER", "PROVIDED", f["value"], f["label_ar"], f["label"]))
    )


def formal_gender() -> Column:
    f = _feature("gender", F.col("gender"))
    return F.when(F.col("gender").isNull(), _made("CAP_FORMAL_GENDER", "NOT_APPLICABLE", residual="GENDER_NOT_IN_MORPHOSYNTAX")).otherwise(_made("CAP_FORMAL_GENDER", "PROVIDED", f["value"], f["label_ar"], f["label"]))


def _or_deferred(capability: str, raw: Column, name: str, residual: str) -> Column:
    f = _feature(name, raw)
    return F.when(F.coalesce(raw, F.lit("")) == "", _made(capability, "DEFERRED", residual=residual)).otherwise(_made(capability, "PROVIDED", f["value"], f["label_ar"], f["label"]))


def definiteness() -> Column:
    """What the record says, else DEF by its article."""
    return _or_deferred("CAP_DEFINITENESS", F.coalesce("definiteness", F.when(F.col("article"), "DEF")), "definiteness", "DEFINITENESS_UNDETERMINED")


def inflected_or_not() -> Column:
    """Particles, pronouns, past and imperative verbs are invariable; else what the record says."""
    raw = F.when(F.coalesce("word_class", F.lit("")).rlike(INVARIABLE), "MABNI").otherwise(F.col("state"))
    return _or_deferred("CAP_MABNI_MURAB_STATE", raw, "state", "MABNI_MURAB_UNDETERMINED")


def inflection() -> Column:
    spellings = [spelling for f, spelling, *_ in FEATURES if f == "irab"]
    odd = (F.coalesce("irab", F.lit("")) != "") & ~F.upper("irab").isin(spellings)
    return F.when(odd, _made("CAP_INFLECTION_STATE", "AMBIGUOUS", F.col("irab"), residual="IRAB_CASE_UNRECOGNIZED")).otherwise(_or_deferred("CAP_INFLECTION_STATE", F.col("irab"), "irab", "IRAB_CASE_UNDETERMINED"))


def derivation() -> Column:
    return _or_deferred("CAP_DERIVATION_STATE", F.col("derivation"), "derivation", "DERIVATION_STATE_UNDETERMINED")


def reference_form() -> Column:
    """The verbal noun, else root with pattern, else the root alone, which is ambiguous."""
    noun, root, pattern = F.col("verbal_noun"), F.col("root"), F.col("pattern")
    form = F.coalesce(noun, F.concat(root, F.lit(" ("), pattern, F.lit(")")), root)
    label = F.coalesce(F.concat(F.lit("masdar:"), noun), F.concat(F.lit("root:"), root, F.lit(" pattern:"), pattern), F.concat(F.lit("root:"), root))
    alone = noun.isNull() & pattern.isNull()
    return F.when(form.isNull(), _made("CAP_REFERENCE_FORM", "DEFERRED", residual="NO_ROOT_OR_MASDAR_FOR_REFERENCE_FORM")).otherwise(
        _made("CAP_REFERENCE_FORM", F.when(alone, "AMBIGUOUS").otherwise("PROVIDED"), form, form, label, F.when(alone, "WAZN_MISSING_REFERENCE_FORM_INCOMPLETE"))
    )


def operator_type() -> Column:
    """The type of an operator by its vocalised form or its letters, else of a particle by its class."""
    known: dict[str, str] = {}
    for kind, words in OPERATORS:
        for w in words:
            known.setdefault(w, kind)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    of = lambda c: F.try_element_at(table, c)
    return F.coalesce(of(F.col("surface")), of(strip_marks(F.col("surface"))), F.when(F.col("word_class").startswith("HARF"), F.concat(F.lit("PARTICLE:"), F.col("word_class"))))


def operator_profile() -> Column:
    kind = operator_type()
    return F.when(kind.isNull(), _made("CAP_OPERATOR_PROFILE", "NOT_APPLICABLE")).otherwise(_made("CAP_OPERATOR_PROFILE", "PROVIDED", kind, F.col("surface"), kind))


def clause_boundary() -> Column:
    """Operators that open a clause; prepositions and other particles do not."""
    kind = operator_type()
    opens = kind.isin([k for k, _ in OPERATORS if k != "PREPOSITION"])
    return F.when(opens, _made("CAP_CLAUSE_BOUNDARY", "PROVIDED", kind, F.col("surface"), F.concat(F.lit("CLAUSE_BOUNDARY:"), kind))).otherwise(_made("CAP_CLAUSE_BOUNDARY", "NOT_APPLICABLE"))


def _ready(capability: str, ok: Column, ar: str, en: str, blocked: tuple[str, str], residual: str) -> Column:
    failed = _made(capability, "BLOCKED", "false", *blocked, F.concat(F.lit("PIPELINE_ERROR:"), F.col("error")))
    return F.when(F.coalesce("error", F.lit("")) != "", failed).when(ok, _made(capability, "PROVIDED", "true", ar, en)).otherwise(_made(capability, "DEFERRED", "false", "مؤجل", "DEFERRED", residual))


def relation_readiness() -> Column:
    known = F.nullif(F.col("word_class"), F.lit("UNKNOWN")).isNotNull()
    ok = known & F.upper(F.coalesce("verdict", F.lit(""))).contains("ACCEPT")
    return _ready("CAP_RELATION_READINESS", ok, "جاهز للعلاقة", "READY_FOR_RELATION", ("غير جاهز", "NOT_READY"), "WORD_CLASS_NOT_ACCEPTED")


def form_readiness() -> Column:
    return _ready("CAP_DAL_ONLY_READINESS", F.nullif(F.col("word_class"), F.lit("UNKNOWN")).isNotNull(), "جاهز للدال", "READY_FOR_DAL_ONLY", ("مانع", "BLOCKED"), "WORD_CLASS_MISSING")


ALL = [word_class, nominal_number, formal_gender, definiteness, inflected_or_not, inflection, derivation, reference_form, operator_profile, clause_boundary, relation_readiness, form_readiness]


def capabilities(records: DataFrame, item: str) -> DataFrame:
    """One row for each record and capability: a projection and a spread of twelve, no shuffle."""
    return records.select(item, F.explode(F.array(*[f() for f in ALL])).alias("c")).select(item, "c.*")
