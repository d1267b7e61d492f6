"""Arabic operators on a fixture of vocalised words, which the star schema has none of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import arabic
from tessella.operators import morphology
from tessella.plans.inputs import arabic_roots, arabic_roots_sql, arabic_words, arabic_words_sql, pick, pick_sql, rows, table, values

WORDS = list(
    enumerate(
        "كَتَبَ كَتَّبَ آمَنُوا رَدَّ قَالَ دَعَا رَمَى وَجَدَ طَوَى وَقَى الْكِتَابُ الشَّمْسُ سُئِلَ رَأْسٌ مُؤْمِنٌ أَكَلَ قُلْ مِنْ كَاتِبٌ مَكْتُوبٌ كَاتَبَ أَكْرَمَ تَعَلَّمَ تَفَاهَمَ اِنْكَسَرَ اِجْتَمَعَ اِسْتَخْرَجَ "
        "يَكْتُبُ تَكْتُبُ يَكْتُبُونَ تَكْتُبِينَ يَكْتُبَانِ تَكْتُبَانِ يَكْتُبْنَ أَكْتُبُ نَكْتُبُ اُكْتُبْ اِضْرِبُوا كَتَبُوا كَتَبْتُ كَتَبَتْ كَتَبْنَا كَتَبَا كَتَبَتَا كَتَبْتُمْ كَتَبْتُنَّ كُتِبَ وَكَتَبَ فَتَحَ عَلِمَ كَرُمَ دَحْرَجَ مَدْرَسَةٌ انْتَظَرُوا بِسْمِ كتب".split()
    )
)
ROOTS = [("ك", "ت", "ب"), ("ر", "د", "د"), ("ق", "و", "ل"), ("ب", "ي", "ع"), ("د", "ع", "و"), ("ر", "م", "ي"), ("و", "ج", "د"), ("ي", "س", "ر"), ("و", "ق", "ي"), ("ط", "و", "ي"), ("ء", "ك", "ل"), ("س", "ء", "ل"), ("ق", "ر", "ء"), ("ف", "ت", "ح"), ("ع", "ل", "م")]
BABS = ["BAB_I_NASARA", "BAB_III_FATAHA", "BAB_IV_SAMIA", "BAB_FORM_II"]
#: How a root's verb class, pattern and ending are told by its letters, in queries that need some of each.
_BAB, _PATTERN, _ENDING = "ascii(substr(root, 1, 1))", "ascii(substr(root, 2, 1))", "ascii(substr(root, 3, 1))"
_ENDS = ["", "تْ", "", "ةٌ", "نَا"]
_PATTERNS = [p[1] for p in morphology.PATTERNS]
ALIGNED = [(1, "كَتَبَ", "كتب"), (2, "كَتَّبَ", "كتب"), (3, "كَتَبَتْ", "كتب"), (4, "كَاتِبَةٌ", "كتب"), (5, "عَلِمَ", "علم"), (6, "اِسْتَخْرَجَ", "خرج"), (7, "أَكْرَمَ", "كرم"), (8, "كِتَاب", "كتب"), (9, "اِجْتَمَعَ", "جمع"), (10, "مَكْتُوب", "كتب")]
#: Vowels of a past and of an imperfect, families and transitivities, by numbers that parts have.
_PAST, _IMPERFECT = [arabic.FATHA, arabic.KASRA, arabic.DAMMA], [arabic.FATHA, arabic.KASRA, arabic.DAMMA, None]
_FAMILY, _TRANSITIVE = ["MUJARRAD", "AUGMENTED"], ["TRANSITIVE", "INTRANSITIVE", "TRANSITIVE"]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arabic_words(spark, sf_dir, WORDS)


def arabic_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("surface")
    return _words(spark, sf_dir).select("id", arabic.normalize(s).alias("norm"), arabic.normalize_host(s).alias("host"), arabic.strip_marks(s).alias("bare"), arabic.count_letters(s).alias("n"), arabic.starts_with_article(s).alias("article"))


def arabic_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("id", arabic.project_article(F.col("surface")).alias("a")).select("id", "a.*")


def arabic_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words(spark, sf_dir).select("id", F.posexplode(arabic.phones(F.col("surface"))).alias("pos", "p"))
    return found.select("id", "pos", "p.*", arabic.gate_phone(F.col("p")).alias("cell"))


def arabic_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _words(spark, sf_dir).select("id", arabic.syllables(arabic.phones(F.col("surface"))).alias("s"))
    return slots.select("id", F.array_join(F.transform("s", lambda x: x["pattern"]), ".").alias("patterns"), arabic.word_gate(F.col("s")).alias("verdict"))


def arabic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's second to fourth character, in the normalised word."""
    entries = _words(spark, sf_dir).withColumn("e", arabic.align_spans(F.col("surface")))
    return entries.select("id", F.size("e").alias("entries"), arabic.project_span(F.col("e"), F.lit(1), F.lit(4)).alias("p")).select("id", "entries", "p.*")


def arabic_mark_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of all words by the state of their marks."""
    units = F.regexp_extract_all("surface", F.lit(r"([ء-غف-ي][ً-ٰٕ]*)"), F.lit(1))
    marks = lambda u: F.filter(F.transform(F.split(F.substring(u, F.lit(2), F.length(u)), ""), arabic.mark_class), lambda m: m != "UNKNOWN")
    return _words(spark, sf_dir).select(F.explode(F.transform(units, lambda u: arabic.mark_state(marks(u)))).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def root_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("id", morphology.analyze_root(F.col("surface")).alias("r")).select("id", "r.*")


def _root_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arabic_roots(spark, sf_dir, ROOTS).select(F.split("root", "").alias("root"), F.col("root").alias("word"))


def root_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root_letters(spark, sf_dir).select(F.col("word").alias("root"), morphology.root_class(F.col("root")).alias("class"))


def _verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verb of each root, and those of the listed roots in all classes."""
    own = arabic_roots(spark, sf_dir, []).select("root", pick(_BAB, BABS).alias("bab_id"))
    return own.unionByName(rows(spark, "root string, bab_id string", [("".join(r), b) for r in ROOTS for b in BABS])).distinct().select(F.split("root", "").alias("root"), "bab_id")


def verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return morphology.conjugate(_verbs(spark, sf_dir)).withColumn("root", F.concat_ws("", "root"))


def imperatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vowels = rows(spark, "bab_id string, past string, vowel string", morphology.CLASS_VOWELS)
    verbs = _verbs(spark, sf_dir).join(F.broadcast(vowels), "bab_id")
    return verbs.select(F.concat_ws("", "root").alias("root"), "bab_id", morphology.imperative(F.col("root"), F.col("vowel")).alias("surface"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word_id, host, letters, root``: each root in a pattern with an ending, and listed words."""
    own = arabic_roots(spark, sf_dir, []).select(F.col("root").alias("word_id"), F.concat(F.translate(pick(_PATTERN, _PATTERNS), "فعل", "123"), pick(_ENDING, _ENDS)).alias("host"), F.col("root").alias("letters"))
    for k in (1, 2, 3):
        own = own.withColumn("host", F.replace("host", F.lit(str(k)), F.substring("letters", k, 1)))
    more = rows(spark, "word_id string, host string, letters string", [(f"word {k}", h, r) for k, h, r in ALIGNED])
    return own.unionByName(more).withColumn("root", F.split("letters", ""))


def _aligned(spark: SparkSession, words: DataFrame) -> DataFrame:
    patterns = rows(spark, "wazn_id string, pattern string, family string, evidence_rank int", morphology.PATTERNS)
    return morphology.align_patterns(words, patterns, "word_id", "host", "root")


def aligned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, hosts(spark, sf_dir))


def decided_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = hosts(spark, sf_dir)
    return morphology.decide_pattern(words, _aligned(spark, words), "word_id")


def verb_class_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as verbs: their size and the length of their name tell which vowels are attested."""
    verbs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("verb_id"), pick("p_size", _PAST).alias("past_vowel"), pick("length(p_name)", _IMPERFECT).alias("imperfect_vowel"))
    return morphology.class_candidates(verbs, rows(spark, "bab_id string, past_vowel string, imperfect_vowel string", morphology.CLASS_VOWELS))


def tenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("id", morphology.tense(F.col("surface")).alias("tense"))


def past_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).where(morphology.tense(F.col("surface")) == "PAST").select("id", morphology.past_features(F.col("surface")).alias("f")).select("id", "f.*")


def imperfect_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words(spark, sf_dir).where(morphology.tense(F.col("surface")) == "IMPERFECT")
    return found.select("id", F.explode(morphology.imperfect_readings(F.col("surface"))).alias("r")).select("id", "r.*")


def augmented_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("id", morphology.augmented_form(F.col("surface")).alias("form")).where("form is not null")


def derived_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("verb_id"), pick("p_size", _FAMILY).alias("family"), pick("length(p_name)", _TRANSITIVE).alias("transitivity"))
    return morphology.derived_nouns(verbs)


_AUTOMATON = """WITH RECURSIVE t(state, elem, next) AS (SELECT * FROM (VALUES ('', 'C', 'C'), ('C', 'V', 'CV'), ('CV', 'V', 'CVV'), ('CV', 'C', 'CVC'), ('CVV', 'C', 'CVVC'), ('CVC', 'C', 'CVCC'), ('CVVC', 'C', 'CVVCC'),
    ('CV', 'CV', 'CV'), ('CVV', 'CV', 'CV'), ('CVC', 'CV', 'CV'), ('CVVC', 'CV', 'CV')) AS v(state, elem, next)),
  w(string, state, n) AS (SELECT CAST('' AS {text}), CAST('' AS {text}), 0
    UNION ALL SELECT CAST(concat(w.string, t.elem) AS {text}), CAST(t.next AS {text}), CAST(n + length(t.elem) AS INT) FROM w JOIN t ON t.state = w.state WHERE n + length(t.elem) <= 8)
SELECT n, count(DISTINCT string) AS strings FROM w WHERE state NOT IN ('', 'C') GROUP BY n"""


def accepted_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many strings of each length the syllable automaton accepts, by a recursive query."""
    return spark.sql(_AUTOMATON.format(text="string"))


QUERIES = [arabic_normal, arabic_article, arabic_phones, arabic_syllables, arabic_spans, arabic_mark_states, root_analysis, root_classes, verb_forms, imperatives, aligned_patterns, decided_patterns, verb_class_candidates, tenses, past_features, imperfect_readings, augmented_forms, derived_nouns, accepted_strings]

_M, _OM, _B = "[ً-ٰٕ]", "[ً-ِْ-ٰٕ]", "[ء-غف-ي]"
_HOST = f"regexp_replace(regexp_replace(replace({{c}}, 'آ', 'ءَا'), '[أإؤئ]', 'ء', 'g'), '({_B})({_OM}*)ّ({_OM}*)', '\\1ْ\\1\\2\\3', 'g')"
_NORM = f"regexp_replace(regexp_replace(regexp_replace(replace({{c}}, 'آ', 'ءَا'), '[أإؤئ]', 'ء', 'g'), '(^| )ال', '\\1ءَل', 'g'), '({_B})({_OM}*)ّ({_OM}*)', '\\1ْ\\1\\2\\3', 'g')"
_SHADDA = f"regexp_replace(replace(replace({{c}}, 'ـ', ''), 'آ', 'ءَا'), '({_B})({_OM}*)ّ({_OM}*)', '\\1ْ\\1\\2\\3', 'g')"
_W = arabic_words_sql(WORDS)
_BARE = f"regexp_replace({{c}}, '{_M}', '', 'g')"
_UNITS = f"""{_W}, u AS (SELECT id, unnest(x) AS u, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT id, regexp_extract_all({_SHADDA.format(c='surface')}, '{_B}{_M}*') AS x FROM w)),
  ph AS (SELECT id, i, n, u, u[1] AS char, u[2:] AS marks, CASE WHEN u[1] IN ('ا', 'ى') OR (u[1] IN ('و', 'ي') AND NOT regexp_matches(u, '[ً-ِ]')) THEN 'VL' WHEN regexp_matches(u, '[ً-ِ]') THEN 'M' ELSE 'S' END AS role FROM u)"""
HOSTS = f"""{arabic_roots_sql([])}, {values('listed', 'word_id, host, letters', [(f"word {k}", h, x) for k, h, x in ALIGNED])},
  hw AS (SELECT root AS word_id, replace(replace(replace(translate({pick_sql(_PATTERN, _PATTERNS)}, 'فعل', '123'), '1', c1), '2', c2), '3', c3) || {pick_sql(_ENDING, _ENDS)} AS host, root AS letters FROM r UNION ALL SELECT * FROM listed)"""
_ALIGN = f"""{HOSTS}, {values('p', 'wazn_id, pattern, family, evidence_rank', morphology.PATTERNS)},
  f AS (SELECT *, {_HOST.format(c='host')} AS h, {_HOST.format(c="replace(replace(replace(translate(pattern, 'فعل', '123'), '1', letters[1]), '2', letters[2]), '3', letters[3])")} AS form FROM hw, p),
  a AS (SELECT *, h[length(form) + 1:] AS rest FROM f WHERE starts_with(h, form)),
  al AS (SELECT word_id, wazn_id, family, evidence_rank, CASE WHEN rest = '' THEN 'clean' WHEN regexp_full_match(rest, '(تْ)+') THEN 'inflectional' WHEN contains(rest, 'ة') THEN 'nominal' END AS ending FROM a)"""
_TENSE = f"""{_W}, s AS (SELECT id, surface, CASE WHEN regexp_matches(surface, '^[وف]َ.{{4}}') THEN surface[3:] ELSE surface END AS s, {_BARE.format(c='surface')} AS bare FROM w),
  t AS (SELECT *, CASE WHEN regexp_matches(s, '^[أء]َ.ْ.*وا$') THEN 'IMPERATIVE' WHEN regexp_matches(s, '^[يتن][َُ].ْ') OR regexp_matches(s, '^أ[َُ].ْ') THEN 'IMPERFECT'
    WHEN regexp_matches(s, '^ا[ُِ]?[^ل]ْ') AND NOT regexp_matches({_BARE.format(c='s')}, '^.{{3,}}ان$') THEN 'IMPERATIVE' ELSE 'PAST' END AS tense FROM s)"""
_ROOTV = arabic_roots_sql(ROOTS)
_CLASS = """CASE WHEN c2 = c3 AND c2 NOT IN ('و', 'ي', 'ا', 'ى') THEN 'GEMINATED' WHEN c1 IN ('و', 'ي') AND c3 IN ('و', 'ي') THEN 'LAFIF_MAFRUQ' WHEN c2 IN ('و', 'ي') AND c3 IN ('و', 'ي') THEN 'LAFIF_MAQRUN'
  WHEN c2 = 'و' THEN 'HOLLOW_WAW' WHEN c2 = 'ي' THEN 'HOLLOW_YAA' WHEN c3 = 'و' THEN 'DEFECTIVE_WAW' WHEN c3 IN ('ي', 'ى') THEN 'DEFECTIVE_YAA' WHEN c1 = 'و' THEN 'ASSIMILATED_WAW' WHEN c1 = 'ي' THEN 'ASSIMILATED_YAA'
  WHEN c1 = 'ء' THEN 'HAMZATED_C1' WHEN c2 = 'ء' THEN 'HAMZATED_C2' WHEN c3 = 'ء' THEN 'HAMZATED_C3' ELSE 'SOUND' END"""
_VERBS = f"""{arabic_roots_sql([])}, {values('extra', 'root, bab_id', [("".join(r), b) for r in ROOTS for b in BABS])},
  v AS (SELECT root, root[1] AS c1, root[2] AS c2, root[3] AS c3, bab_id FROM (SELECT root, {pick_sql(_BAB, BABS)} AS bab_id FROM r UNION SELECT * FROM extra)), {values('k', 'bab_id, pv, iv', morphology.CLASS_VOWELS)}, vk AS (SELECT v.*, pv, iv, {_CLASS} AS class FROM v LEFT JOIN k USING (bab_id))"""
_ENDINGS = values("e", "tense, mood, person, number, gender, mark, tail, prefix, special, kind, rest", morphology._forms())
_FILL = "replace(replace(replace(replace(replace(replace(replace(replace(template, '1', c1), '2', c2), '3', c3), 'p', coalesce(pv, '')), 'i', coalesce(iv, '')), 'P', coalesce(prefix, '')), 'm', mark), 't', tail)"
_SEATS = "regexp_replace(replace(regexp_replace(regexp_replace({c}, '(ِّ?)ء([َُ])', '\\1ئ\\2', 'g'), 'ء([َُ])', 'أ\\1', 'g'), 'ءِ', 'ئِ'), 'ء([^ْ])', 'أ\\1', 'g')"
_L = f"string_split({_BARE.format(c=_HOST.format(c='surface'))}, '')"
_V = "[\u064e\u064f\u0650]"
#: The analysis of roots of a table of words: ``a(id, directive, root, residual)``.
_ROOT_OF = f"""l AS (SELECT id, {_L} AS c FROM {{w}}), n AS (SELECT *, len(c) AS n, c[1] IN ('و', 'ي') AS f, c[2] IN ('ا', 'و') AS a, c[3] IN ('ا', 'ى', 'ي') AS l FROM l),
        rr AS (SELECT *, CASE WHEN n < 2 THEN 'block:root:insufficient_consonants' WHEN n = 2 THEN 'defer:root:two_consonant_form_unresolved' WHEN n = 4 THEN 'defer:root:quadriliteral_beyond_scope' WHEN n > 4 THEN 'defer:root:non_standard_consonant_count'
          WHEN f AND l AND NOT a THEN 'defer:root:lafif_mafruq_unresolved' WHEN a AND l THEN 'defer:root:lafif_maqrun_unresolved' WHEN a THEN 'defer:root:hollow_underlying_radical_unresolved' WHEN l THEN 'defer:root:defective_lam_unresolved'
          WHEN f THEN 'defer:root:assimilated_fa_unresolved' WHEN list_contains(c, 'ا') OR list_contains(c, 'ى') THEN 'defer:root:prohibited_or_ambiguous_radical' ELSE '' END AS residual FROM n),
        a AS (SELECT id, CASE WHEN residual = '' THEN 'ACCEPT' WHEN residual LIKE 'block%' THEN 'BLOCK' ELSE 'DEFER' END AS directive, CASE WHEN residual = '' THEN array_to_string(c, '') END AS root, residual FROM rr)"""
#: Skeletons of the augmented forms in order; {2} marks a letter that must be the one before it, which RE2 cannot say.
_FORMS = " ".join(
    f"WHEN regexp_matches(h, '^{p.format(v=_V, a='.', b='.')}$')" + (f" AND regexp_extract(h, '^{p.format(v=_V, a='(.)', b='.')}$', 1) = regexp_extract(h, '^{p.format(v=_V, a='.', b='(.)')}$', 1)" if "{a}" in p else "") + f" THEN '{form}'"
    for form, p in [
        ("FORM_X", "ا{v}?سْت{v}.ْ.{v}.{v}?"), ("FORM_VII", "ا{v}?نْ.{v}.{v}.{v}?"), ("FORM_VIII", "ا{v}?.ْت{v}.{v}.{v}?"), ("FORM_V", "ت{v}.{v}{a}ْ{b}{v}.{v}?"),
        ("FORM_VI", "ت{v}.{v}ا.{v}.{v}?"), ("FORM_IV", "ء{v}.ْ.{v}.{v}?"), ("FORM_II", ".{v}{a}ْ{b}{v}.{v}?"), ("FORM_III", ".{v}ا.{v}.{v}?"),
    ]
)
ORACLES = {
    "arabic_normal": f"WITH {_W} SELECT id, {_NORM.format(c='surface')} AS norm, {_HOST.format(c='surface')} AS host, {_BARE.format(c='surface')} AS bare, length(regexp_replace({_BARE.format(c='surface')}, '[^{_B[1:-1]}]', '', 'g'))::INT AS n, starts_with({_BARE.format(c='surface')}, 'ال') AS article FROM w",
    "arabic_article": f"""WITH {_W} SELECT id, CASE WHEN regexp_matches(surface, '^الْ.') THEN 'LUNAR' WHEN regexp_matches(surface, '^ال[تثدذرزسشصضطظلن]{_OM}*ّ') THEN 'SOLAR' ELSE 'NONE' END AS kind,
        CASE WHEN regexp_matches(surface, '^الْ.') THEN 'الْ' WHEN regexp_matches(surface, '^ال[تثدذرزسشصضطظلن]{_OM}*ّ') THEN 'ال' ELSE '' END AS article,
        CASE WHEN regexp_matches(surface, '^الْ.') THEN surface[4:] WHEN regexp_matches(surface, '^ال[تثدذرزسشصضطظلن]{_OM}*ّ') THEN regexp_replace(surface[3:], '^(.)({_OM}*)ّ', '\\1\\2') ELSE surface END AS rest FROM w""",
    "arabic_phones": f"WITH {_UNITS} SELECT id, (i - 1)::INT AS pos, char, marks, role, CASE WHEN regexp_matches(marks, '[ٓ-ٰٕ]') THEN 'BLOCK' WHEN role = 'VL' THEN 'V' WHEN role = 'M' THEN 'CV' ELSE 'C' END AS cell FROM ph",
    "arabic_syllables": f"""WITH RECURSIVE {_UNITS}, x AS (SELECT *, lead(role) OVER (PARTITION BY id ORDER BY i) = 'S' AS ns FROM ph),
        f(id, i, pat, done) AS (SELECT id, 0::BIGINT, '', []::VARCHAR[] FROM w UNION ALL
          SELECT f.id, x.i, CASE WHEN role = 'M' THEN 'CV' WHEN role = 'S' AND pat IN ('', 'CV', 'CVV', 'CVC', 'CVVC') THEN pat || 'C' WHEN role = 'S' THEN 'C' WHEN pat IN ('C', 'CV') THEN pat || 'V'
              WHEN pat = '' AND char = 'ا' AND coalesce(ns, false) THEN '' WHEN pat = 'CVV' AND char = 'ا' AND x.i = n THEN '' ELSE pat || '+V' END,
            CASE WHEN role = 'M' AND pat <> '' THEN list_append(done, pat) WHEN role = 'S' AND pat NOT IN ('', 'CV', 'CVV', 'CVC', 'CVVC') THEN list_append(done, pat)
              WHEN role = 'VL' AND pat = '' AND char = 'ا' AND coalesce(ns, false) THEN list_append(done, 'WASL') WHEN role = 'VL' AND pat = 'CVV' AND char = 'ا' AND x.i = n THEN list_concat(done, ['CVV', 'FARQA']) ELSE done END
          FROM f JOIN x ON x.id = f.id AND x.i = f.i + 1),
        z AS (SELECT f.id, CASE WHEN pat = '' THEN done ELSE list_append(done, pat) END AS s FROM f JOIN (SELECT id, max(i) AS n FROM ph GROUP BY id) m ON m.id = f.id AND f.i = m.n)
        SELECT w.id, coalesce(array_to_string(s, '.'), '') AS patterns, CASE WHEN s IS NULL THEN 'DEFER' WHEN len(list_filter(s, lambda p: p NOT IN ('WASL', 'FARQA', 'C', 'CV', 'CVV', 'CVC', 'CVVC', 'CVCC', 'CVVCC'))) > 0 THEN 'BLOCK' WHEN list_contains(s, 'C') THEN 'DEFER' ELSE 'ACCEPT' END AS verdict FROM w LEFT JOIN z ON z.id = w.id""",
    "root_analysis": f"""WITH {_W}, {_ROOT_OF.format(w='w')} SELECT * FROM a""",
    "root_classes": f"WITH {_ROOTV} SELECT root, {_CLASS} AS class FROM r",
    "verb_forms": f"""WITH {_VERBS}, {_ENDINGS}, vo AS (SELECT unnest(['ACTIVE', 'PASSIVE']) AS voice), {values("st", "stem, tense, voice, key, template", morphology.STEMS)},
        x AS (SELECT vk.*, CASE WHEN class LIKE 'HAMZATED%' THEN 'SOUND' ELSE class END AS stem, e.*, voice FROM vk, e, vo),
        y AS (SELECT x.*, CASE WHEN pv IS NULL OR (x.stem = 'DEFECTIVE_WAW' AND NOT (pv = 'َ' AND iv = 'ُ')) OR (x.stem = 'DEFECTIVE_YAA' AND NOT (pv = 'َ' AND iv = 'ِ')) THEN NULL ELSE coalesce(a.template, b.template, c.template) END AS template FROM x
          LEFT JOIN st a ON a.stem = x.stem AND a.tense = x.tense AND a.voice = x.voice AND a.key = x.special LEFT JOIN st b ON b.stem = x.stem AND b.tense = x.tense AND b.voice = x.voice AND b.key = x.kind
          LEFT JOIN st c ON c.stem = x.stem AND c.tense = x.tense AND c.voice = x.voice AND c.key = x.rest),
        z AS (SELECT *, {_SEATS.format(c=_FILL)} AS surface FROM y)
        SELECT root, bab_id, tense, mood, voice, person, number, gender, surface, CASE WHEN surface IS NULL THEN 'DEFER' ELSE 'HIGH' END AS status FROM z""",
    "imperatives": f"""WITH {_VERBS}, {values("st", "stem, template", morphology.IMPERATIVES)},
        y AS (SELECT root, bab_id, c1, c2, c3, iv, replace(template, 'W', CASE iv WHEN 'ُ' THEN 'اُ' ELSE 'اِ' END) AS template, '' AS pv, '' AS prefix, '' AS mark, '' AS tail
              FROM vk LEFT JOIN st ON stem = CASE WHEN class LIKE 'HAMZATED%' THEN 'SOUND' ELSE class END WHERE iv IS NOT NULL)
        SELECT root, bab_id, {_SEATS.format(c=_FILL)} AS surface FROM y""",
    "aligned_patterns": f"WITH {_ALIGN} SELECT * FROM al WHERE ending IS NOT NULL",
    "decided_patterns": f"""WITH {_ALIGN}, d AS (SELECT word_id, count(*) FILTER (ending IN ('clean', 'inflectional')) AS n, string_agg(wazn_id, ',' ORDER BY evidence_rank, wazn_id) AS candidates FROM al WHERE ending IS NOT NULL GROUP BY word_id)
        SELECT word_id, CASE WHEN n = 1 THEN 'ACCEPT' WHEN n IS NOT NULL THEN 'DEFER' ELSE 'BLOCK' END AS verdict, coalesce(candidates, '') AS candidates FROM hw LEFT JOIN d USING (word_id)""",
    "verb_class_candidates": f"""WITH v AS (SELECT p_partkey AS verb_id, {pick_sql('p_size', _PAST)} AS p, {pick_sql('length(p_name)', _IMPERFECT)} AS i FROM part), {values('k', 'bab_id, pv, iv', morphology.CLASS_VOWELS)}, j AS (SELECT verb_id, bab_id FROM v LEFT JOIN k ON pv = p AND (i IS NULL OR iv = i))
        SELECT verb_id, CASE count(bab_id) WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ACCEPT' ELSE 'DEFER' END AS directive, coalesce(string_agg(bab_id, ',' ORDER BY bab_id), '') AS babs FROM j GROUP BY verb_id""",
    "tenses": f"WITH {_TENSE} SELECT id, tense FROM t",
    "past_features": f"""WITH {_TENSE}, {values('e', 'rank, ending, vocal, png', [(k, text, int(vocal), png) for k, (text, vocal, png) in enumerate(morphology.past_endings())])},
        p AS (SELECT id, any_value(surface) AS surface, arg_min(png, rank) AS png FROM t LEFT JOIN e ON ends_with(CASE WHEN vocal = 1 THEN surface ELSE bare END, ending) WHERE tense = 'PAST' GROUP BY id),
        q AS (SELECT id, surface, coalesce(png, '3SGM') AS png FROM p)
        SELECT id, png[1] AS person, png[2:3] AS number, png[4] AS gender, CASE WHEN regexp_matches(surface, '^.\u064f.\u0650') THEN 'PASSIVE' ELSE 'ACTIVE' END AS voice FROM q""",
    "arabic_spans": f"""WITH {_W}, u AS (SELECT id, unnest(x) AS r, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(surface, '{_B}{_M}*|.') AS x FROM w)),
        n AS (SELECT id, i, length(r) AS a, length({_HOST.format(c='r')}) AS b FROM u),
        e AS (SELECT id, a, b, sum(a) OVER o AS r_end, sum(b) OVER o AS n_end FROM n WINDOW o AS (PARTITION BY id ORDER BY i)),
        m AS (SELECT id, CASE WHEN a = b THEN n_end - b + greatest(1 - (r_end - a), 0) ELSE n_end - b END AS s, CASE WHEN a = b THEN n_end - greatest(r_end - 4, 0) ELSE n_end END AS t FROM e WHERE r_end - a < 4 AND r_end > 1)
        SELECT w.id, (SELECT count(*) FROM e WHERE e.id = w.id)::INT AS entries, coalesce(min(s), 1)::INT AS start, coalesce(max(t), 4)::INT AS "end" FROM w LEFT JOIN m ON m.id = w.id GROUP BY w.id""",
    "arabic_mark_states": f"""WITH {_W}, u AS (SELECT unnest(regexp_extract_all(surface, '{_B}{_M}*')) AS u FROM w),
        c AS (SELECT len(regexp_extract_all(u, '[\u064e\u064f\u0650]')) AS v, len(regexp_extract_all(u, '[\u064b-\u064d]')) AS t, len(regexp_extract_all(u, '\u0652')) AS s, len(regexp_extract_all(u, '\u0651')) AS d FROM u)
        SELECT CASE WHEN v > 1 OR (v > 0 AND s > 0) OR (t > 0 AND s > 0) OR (v > 0 AND t > 0) OR (d > 0 AND s > 0) THEN 'CONFLICT' WHEN t > 0 THEN 'TANWIN' WHEN v > 0 THEN 'EXPLICIT_VOWEL' WHEN s > 0 THEN 'EXPLICIT_SUKUN' WHEN d > 0 THEN 'SHADDA_COMPOUND' ELSE 'ABSENT' END AS state, count(*) AS n FROM c GROUP BY 1""",
    "augmented_forms": f"""WITH {_W}, h AS (SELECT id, {_HOST.format(c='surface')} AS h FROM w), f AS (SELECT id, CASE {_FORMS} END AS form FROM h) SELECT * FROM f WHERE form IS NOT NULL""",
    "imperfect_readings": f"""WITH {_TENSE}, p AS (SELECT id, unnest(CASE WHEN bare[1] IN ('أ', 'ء') THEN ['1SGM'] WHEN bare[1] = 'ن' THEN ['1PLM'] WHEN regexp_matches(bare, '(ون|وا)$') AND length(bare) > 4 THEN [CASE bare[1] WHEN 'ت' THEN '2PLM' ELSE '3PLM' END]
          WHEN regexp_matches(bare, '(ين|ي)$') AND bare[1] = 'ت' AND length(bare) > 4 THEN ['2SGF'] WHEN bare LIKE '%ان' AND bare[1] = 'ت' THEN ['2DUM', '3DUF'] WHEN bare LIKE '%ان' THEN ['3DUM']
          WHEN surface LIKE '%ْنَ' THEN [CASE bare[1] WHEN 'ت' THEN '2PLF' ELSE '3PLF' END] WHEN bare[1] = 'ت' THEN ['2SGM', '3SGF'] ELSE ['3SGM'] END) AS png FROM t WHERE tense = 'IMPERFECT')
        SELECT id, png[1] AS person, png[2:3] AS number, png[4] AS gender FROM p""",
    "derived_nouns": f"""WITH v AS (SELECT p_partkey AS verb_id, {pick_sql('p_size', _FAMILY)} AS family, {pick_sql('length(p_name)', _TRANSITIVE)} AS transitivity FROM part), {values('e', 'kind, family, transitivity, verdict', morphology.ELIGIBLE)}, f AS (SELECT verb_id, kind, verdict, count(*) FILTER (verdict = 'ACCEPT') OVER (PARTITION BY verb_id) AS n_accepted FROM v JOIN e USING (family, transitivity))
        SELECT verb_id, kind, verdict, CASE WHEN n_accepted = 8 THEN 'ACCEPT' WHEN n_accepted > 0 THEN 'PARTIAL_ACCEPT' ELSE 'DEFER' END AS overall, n_accepted FROM f""",
    "accepted_strings": _AUTOMATON.format(text="VARCHAR"),
}
