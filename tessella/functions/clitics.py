"""Clitic segmentation of vocalised Arabic words: an ordered cascade of nullable structs.

Each rule yields a struct or null, and the first that is not null is the segmentation. The
inventories are closed lists, held as literals of the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.arabic import _MARK, TANWIN, count_letters, let, strip_marks

#: Words that are never taken apart.
PROTECTED = [
    "اللَّهُ", "اللَّهِ", "اللَّهَ", "اللَّه", "الله", "اللهِ", "اللهَ", "هَذَا", "هَذِهِ", "هَؤُلَاءِ", "هَذَانِ", "هَاتَانِ", "هُوَ", "هِيَ", "هُمَا", "هُمْ", "هُنَّ",
    "الَّذِي", "الَّتِي", "الَّذِينَ", "اللَّوَاتِي", "اللَّاتِي", "الَّذَانِ", "اللَّذَانِ", "اللَّذَيْنِ", "الَلَّذَيْنِ", "ذَلِكَ", "ذَلِكُمْ", "تِلْكَ", "أُولَئِكَ", "إِذَا", "أَيُّهَا", "أَيَّتُهَا",
]
#: Operators, which may take an enclitic.
OPERATORS = [
    "مِنْ", "عَنْ", "إِلَى", "عَلَى", "فِي", "مَعَ", "حَتَّى", "بَيْنَ", "فَوْقَ", "تَحْتَ", "قَبْلَ", "بَعْدَ", "عِنْدَ", "لَدَى", "لَدُنْ", "إِنَّ", "أَنَّ", "كَأَنَّ", "لَكِنَّ", "لَيْتَ", "لَعَلَّ", "لَوْ", "لَوْلَا",
    "مَا", "لَا", "إِنْ", "لَمَّا", "قَدْ", "لَنْ", "هَلْ", "بَلْ", "أَمَّا", "ثُمَّ", "أَوْ", "أَمْ", "كَمَا",
    "من", "عن", "إلى", "على", "في", "مع", "حتى", "بين", "فوق", "تحت", "قبل", "بعد", "عند", "لدى", "لدن", "إن", "لما", "قد", "لن", "هل", "بل", "أما", "ثم", "أو", "أم",
    "إنَّ", "أنَّ", "كأنَّ", "لكنَّ", "ليت", "لعل", "لو", "لولا", "ما", "لا", "كما",
]
#: Letters, mark, kind and fewest letters of the host, in the order in which they are tried.
PROCLITICS = [("و", "َ", "CONJUNCTION", 3), ("ف", "َ", "CONJUNCTION", 3), ("ب", "ِ", "PREPOSITION", 2), ("ل", "ِ", "PREPOSITION", 2), ("س", "َ", "FUTURE_PARTICLE", 3)]
#: Licensed pairs and the kind of the second; the first is a conjunction.
PAIRS = [("ول", "JUSSIVE_LAM"), ("فل", "JUSSIVE_LAM"), ("فب", "PREPOSITION"), ("وب", "PREPOSITION"), ("وك", "PREPOSITION"), ("فك", "PREPOSITION"), ("وس", "FUTURE_PARTICLE"), ("فس", "FUTURE_PARTICLE")]
#: Attached pronouns without marks, longest first; endings of inflection that are none; words whose first letter is of the root.
ENCLITICS = ["هما", "كما", "هم", "كم", "نا", "ني", "ها", "ه", "ك", "ي"]
INFLECTION = ["وا", "ون", "ين", "ان", "ن", "تم", "تن"]
ROOT_INITIAL = [
    "كاتب", "كبير", "كتاب", "كريم", "كلام", "كثير", "كافر", "كفر", "فعل", "فتح", "فقير", "فسوق", "فهم", "وعد", "وجد", "ولد", "وزن", "وقف", "وقى",
    "لبس", "لعب", "لقي", "لها", "سأل", "سمع", "سبق", "سلم", "باب", "بيت", "بكى",
]
#: Letters with which an imperfect begins, and so what may follow the future particle.
IMPERFECT_INITIAL = "يتنأإآا"

_bare = lambda words: sorted({re.sub(_MARK, "", w) for w in words})
PROTECTED_BARE, OPERATORS_BARE = _bare(PROTECTED), _bare(OPERATORS)


def split_after(c: Column, n: int) -> tuple[Column, Column]:
    """The first n letters with their marks, and the rest."""
    head = F.regexp_extract(c, f"^((?:[^{_MARK[1:-1]}]{_MARK}*){{{n}}})", 1)
    return head, F.substring(c, F.length(head) + 1, F.length(c))


def is_legal_host(c: Column) -> Column:
    return count_letters(c) >= 2


def has_article(c: Column) -> Column:
    """Alef and lam with at least one more letter."""
    return strip_marks(c).rlike("^ال.")


def inflectional_na(c: Column) -> Column:
    """Whether a final na is an ending of the verb: a dual after waw."""
    return strip_marks(c).endswith("ونا")


def future_host(c: Column) -> Column:
    """Whether the future particle may stand before this: it begins like an imperfect."""
    return F.coalesce(F.substring(strip_marks(c), 1, 1).isin(*IMPERFECT_INITIAL), F.lit(False))


def mark_compatible(prefix: Column, mark: str) -> Column:
    """Whether the first mark that is written on a prefix, if any, is that of the proclitic."""
    first = F.regexp_extract(prefix, _MARK, 0)
    return (first == "") | (first == mark)


def enclitic(c: Column) -> Column:
    """``stem, enclitic`` of the longest attached pronoun, or null.

    Not after an ending of inflection, not if fewer than two letters are left, not with
    tanwin, which no pronoun has.
    """
    bare = strip_marks(c)
    listed = F.array(*[F.lit(e) for e in ENCLITICS])
    fits = F.filter(listed, lambda e: bare.endswith(e) & ~((e == "نا") & bare.endswith("ونا")) & (count_letters(F.substring(bare, F.lit(1), F.length(bare) - F.length(e))) >= 2))
    cut = lambda n: F.regexp_extract(c, f"^(.*?)((?:[^{_MARK[1:-1]}]{_MARK}*){{{n}}})$", 1)
    stem = lambda e: F.when(F.length(e) == 3, cut(3)).when(F.length(e) == 2, cut(2)).otherwise(cut(1))
    pairs = F.transform(fits, lambda e: F.struct(stem(e).alias("stem"), F.substring(c, F.length(stem(e)) + 1, F.length(c)).alias("enclitic")))
    whole = F.filter(pairs, lambda p: ~p["enclitic"].rlike(f"[{TANWIN}]"))
    return F.when(~bare.rlike(f"({'|'.join(INFLECTION)})$"), F.get(whole, F.lit(0)))


def proclitics(c: Column) -> Column:
    """``parts, rest, kinds`` of the proclitics a word begins with, or null; pairs before single ones.

    The rest must be a listed word, begin with the article or have enough letters; after a
    conjunction also without the attached pronoun that it may end with.
    """
    (one, rest1), (two, rest2) = split_after(c, 1), split_after(c, 2)
    cuts = F.struct(strip_marks(c).alias("bare"), one.alias("one"), rest1.alias("rest1"), two.alias("two"), rest2.alias("rest2"))
    return let(cuts, lambda x: let(_measured(x), lambda y: _proclitics(x, y)))


def _measured(x: Column) -> Column:
    """What the rules ask of the rests after one and two letters."""
    rest1, rest2 = x["rest1"], x["rest2"]
    bare1, listed = strip_marks(rest1), [*PROTECTED_BARE, *OPERATORS_BARE]
    known1 = F.when(rest1.rlike(_MARK), rest1.isin(*OPERATORS, *PROTECTED)).otherwise(bare1.isin(listed))
    host = count_letters(F.regexp_replace(bare1, f"^(.+?)({'|'.join(ENCLITICS)})$", "$1"))
    return F.struct(
        count_letters(rest1).alias("n1"), count_letters(rest2).alias("n2"), known1.alias("known1"), (strip_marks(rest2).isin(listed) | has_article(rest2)).alias("known2"),
        has_article(rest1).alias("article1"), host.alias("host"), future_host(rest1).alias("future"),
    )


def _proclitics(x: Column, y: Column) -> Column:
    bare, one, rest1, two, rest2 = (x[k] for k in ("bare", "one", "rest1", "two", "rest2"))
    second = F.substring(two, F.length(one) + 1, F.length(two))
    option = lambda parts, rest, kinds: F.struct(F.array(*parts).alias("parts"), rest.alias("rest"), F.array(*[F.lit(k) for k in kinds]).alias("kinds"))
    rules = [F.when(bare.startswith(pair) & (y["known2"] | (y["n2"] >= 3)), option([one, second], rest2, ["CONJUNCTION", kind])) for pair, kind in PAIRS]
    for letter, mark, kind, least in PROCLITICS:
        ok = y["known1"] | y["article1"] | (y["n1"] >= least)
        if kind == "FUTURE_PARTICLE":
            ok = ok & y["future"]
        if kind == "CONJUNCTION":
            ok = ok & (y["known1"] | y["article1"] | (y["host"] >= 3))
        rules.append(F.when(bare.startswith(letter) & (F.length(bare) > 1) & mark_compatible(one, mark) & ok, option([one], rest1, [kind])))
    return F.when(~bare.isin(ROOT_INITIAL), F.coalesce(*rules))


def segment(df: DataFrame, surface: str) -> DataFrame:
    """``df`` with ``proclitics, article, host, enclitic, rule, segments`` of each word.

    Rules in order: protected words; operators, with a pronoun or without; li before the
    article, which loses its alef; proclitics before a protected word, an operator, a
    pronoun alone, the article or any host; the article; a pronoun; the whole word.
    ``segments`` are the pieces in order with their role and place. Null stays null.
    """
    s = F.col(surface)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")

    def made(rule: str | Column, host: Column, parts: Column = empty, article: Column = none, pronoun: Column = none, kinds: Column = empty) -> Column:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        return F.struct(parts.alias("proclitics"), kinds.alias("kinds"), article.alias("article"), host.alias("host"), pronoun.alias("enclitic"), rule.alias("rule"))

    def hosted(c: Column) -> tuple[Column, Column]:
        """Host and pronoun of what is left, if the stem is legal."""
        e = enclitic(c)
        good = e.isNotNull() & is_legal_host(e["stem"])
        return F.when(good, e["stem"]).otherwise(c), F.when(good, e["enclitic"])

    rows = df.withColumns({"__bare": strip_marks(s), "__enc": enclitic(s), "__pro": proclitics(s), "__art": split_after(s, 2)[1]})
    bare, enc, pro, after = F.col("__bare"), F.col("__enc"), F.col("__pro"), F.col("__art")
    li, rest = split_after(s, 1)
    lam, inner = split_after(rest, 1)
    left = pro["rest"]
    rows = rows.withColumns({"__li": F.struct(*[c.alias(n) for c, n in zip(hosted(inner), ("h", "e"), strict=True)]), "__in": F.when(has_article(left) & is_legal_host(split_after(left, 2)[1]), F.struct(split_after(left, 2)[0].alias("a"), split_after(left, 2)[1].alias("r"))), "__enl": enclitic(left)})
    inside = F.coalesce(F.col("__in.r"), left)
    rows = rows.withColumns({"__hp": F.struct(*[c.alias(n) for c, n in zip(hosted(inside), ("h", "e"), strict=True)]), "__ha": F.struct(*[c.alias(n) for c, n in zip(hosted(after), ("h", "e"), strict=True)])})
    left_bare, enl = strip_marks(left), F.col("__enl")
    chosen = F.coalesce(
        F.when(bare.isin(PROTECTED_BARE), made("LEXICALLY_PROTECTED_HOST", s)),
        F.when(bare.isin(OPERATORS_BARE), F.when(enc.isNotNull(), made("OPERATOR_HOST_WITH_ENCLITIC", enc["stem"], pronoun=enc["enclitic"])).otherwise(made("OPERATOR_WHOLE_TOKEN", s))),
        F.when(bare.startswith("لل") & (F.length(bare) >= 4) & is_legal_host(inner), made("CONTRACTED_LI_PLUS_AL", F.col("__li.h"), F.array(li), lam, F.col("__li.e"), F.array(F.lit("PREPOSITION")))),
        F.when(pro.isNotNull() & left_bare.isin(PROTECTED_BARE), made("PROCLITIC_PLUS_PROTECTED_HOST", left, pro["parts"], kinds=pro["kinds"])),
        F.when(pro.isNotNull() & left_bare.isin(OPERATORS_BARE), F.when(enl.isNotNull(), made("PROCLITIC_PLUS_OPERATOR_HOST_WITH_ENCLITIC", enl["stem"], pro["parts"], pronoun=enl["enclitic"], kinds=pro["kinds"])).otherwise(made("PROCLITIC_PLUS_OPERATOR_HOST", left, pro["parts"], kinds=pro["kinds"]))),
        F.when(pro.isNotNull() & left_bare.isin(ENCLITICS), made("CLITIC_ONLY_CONSTRUCTION", none, pro["parts"], pronoun=left, kinds=pro["kinds"])),
        F.when(pro.isNotNull() & is_legal_host(F.col("__hp.h")), made("PROCLITIC_INVENTORY", F.col("__hp.h"), pro["parts"], F.col("__in.a"), F.col("__hp.e"), pro["kinds"])),
        F.when(has_article(s) & is_legal_host(after), made("DEFINITE_ARTICLE_PATTERN", F.col("__ha.h"), article=split_after(s, 2)[0], pronoun=F.col("__ha.e"))),
        F.when(enc.isNotNull() & is_legal_host(enc["stem"]), made("ENCLITIC_INVENTORY", enc["stem"], pronoun=enc["enclitic"])),
        F.when(s.isNotNull(), made("NO_CLITIC_FOUND", s)),
    )
    out = rows.withColumn("__seg", chosen).select(*df.columns, F.col("__seg.proclitics").alias("proclitics"), F.col("__seg.article").alias("article"), F.col("__seg.host").alias("host"), F.col("__seg.enclitic").alias("enclitic"), F.col("__seg.rule").alias("rule"), F.col("__seg.kinds").alias("__kinds"))
    return out.withColumn("segments", segments(F.col("proclitics"), F.col("__kinds"), F.col("article"), F.col("host"), F.col("enclitic"))).drop("__kinds")


def segments(parts: Column, kinds: Column, article: Column, host: Column, pronoun: Column) -> Column:
    """``surface, role, kind, start, stop`` of all pieces in order; offsets by a fold over lengths."""
    piece = lambda text, role, kind: F.struct(text.alias("surface"), F.lit(role).alias("role"), kind.alias("kind"))
    first = F.zip_with(parts, kinds, lambda p, k: piece(p, "PROCLITIC", k))
    others = F.array(piece(article, "DEFINITE_ARTICLE", F.lit("DEFINITE_ARTICLE")), piece(host, "HOST", F.lit("LEXICAL_HOST")), piece(pronoun, "ENCLITIC", F.lit("ATTACHED_PRONOUN")))
    pieces = F.filter(F.concat(first, others), lambda x: x["surface"].isNotNull())
    empty = F.array().cast("array<struct<surface:string,role:string,kind:string,start:int,stop:int>>")

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["surface"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(x["surface"], x["role"], x["kind"], acc["at"].alias("start"), stop.alias("stop")))).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
