"""Words taken apart and routed, glyph traces, capabilities, headings, over the words of documents in Arabic letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import boundary, clitics, entry_rules, glyphs
from tessella.operators import capabilities, lexicon
from tessella.plans.arabic_queries import _B, _M, _OM, _SHADDA, WORDS
from tessella.plans.inputs import arabic_roots, arabic_roots_sql, arabic_words, arabic_words_sql, pick, pick_sql, rows, table, values

#: Words with prefixes, articles and pronouns joined to them; the tests hold their parts.
JOINED = list(
    enumerate(
        "وَالْكِتَابُ فَلْيَكْتُبْ بِالْعَدْلِ كَاتِبٌ لِلنَّاسِ سَيَقُولُ سَفِيهًا كِتَابُهُ كِتَابُهَا مِنْهُ عَلَيْهِمْ وَاللَّهُ اللَّهُ بِهِ فَقِيرٌ وَعَدَ "
        "يَكُونَا كَتَبُوا يَكْتُبُونَ بَيْنَكُمْ فَاكْتُبُوهُ وَلِيُّهُ الشَّمْسُ الْكِتَابَ رَبَّهُ مِنْ وَمِنْ بِكُمْ سَمِعَ فُسُوقٌ وَسَيَعْلَمُ بِدَيْنٍ "
        "هَذَا كِتَابُنَا فَبِالْحَقِّ وَهُوَ أَوْ وَلَا لَنَا".split()
    )
)
#: What a part's numbers choose for each field of a word's record.
RECORD = {
    "surface": ("p_size", ["كَتَبَ", "الْكِتَابُ", "مِنْ", "إِذَا", "كَاتِبَانِ", "يَكْتُبُ", "كَلَام", "فَ", "يَا", "بَعْضُ"]),
    "word_class": ("p_size + length(p_name)", ["FI3L_MADI", "ISM", "HARF_JAR", "HARF_SHART", "ISM_FAIL", "FI3L_MUDARI", "UNKNOWN", None, "HARF_NIDA", "HARFX"]),
    "verdict": ("length(p_name)", ["ACCEPTED", "DEFERRED", "ACCEPT", None, "ACCEPTED"]),
    "error": ("length(p_type) + p_size", [None, None, None, "no host", None, ""]),
    "number": ("length(p_type)", ["SG", "SINGULAR", None, "2", "3", "7", "PL"]),
    "person": ("p_size + length(p_type)", [None, "3", "1", None]),
    "gender": ("p_size + 2 * length(p_name)", ["M", "MASC", None, "F", "COMMON", "X"]),
    "article": ("p_size", [False, True, None]),
    "definiteness": ("length(p_name) + 2 * length(p_type)", [None, "NAKED", "CONSTRUCT", "OTHER", None]),
    "state": ("length(p_name)", ["MURAB", None, "MABNI"]),
    "irab": ("p_size + 3 * length(p_type)", [None, "NOM", "NOMINATIVE", "ODD", "GEN"]),
    "derivation": ("p_size + 3 * length(p_name)", ["JAMID", None, "MUSHTAQ", "FROZEN", "ODD"]),
    "root": ("length(p_type)", ["كتب", "كلم", None]),
    "pattern": ("p_size", ["فَعَلَ", None, "فَاعِل", None, None]),
    "verbal_noun": ("p_size + length(p_name)", [None, None, None, "كِتَابَة", None]),
}
#: What follows the letters of a heading, and what the catalog has stored for its root, by numbers of the root's letters.
PHRASES = [" أصل واحد", " أصلان", " ثلاثة أصول", " كلمة تدل على", " والحرف المعتل أصول صحيحة", " ليس بأصل", " قد مضى ذكره", " كلمتان", " أصل صحيح يدل", " أصلٌ واحدٌ يدلّ", " بناء صحيح", ""]
STORED = ["root", "root", "concat('ب', substr(root, 2, 2))", "concat('ح', substr(root, 2, 2))", "concat(substr(root, 1, 2), 'ن')", "substr(root, 1, 1)", "''", "concat('x', root)", "concat(root, root)", "substr(root, 1, 2)", "concat('خ', substr(root, 2, 2))"]
_CODE, _OTHER = "ascii(substr(root, 1, 1)) + 2 * ascii(substr(root, 3, 1))", "ascii(substr(root, 2, 1)) + ascii(substr(root, 3, 1))"
_FIRST_NAMES = {letter: name for name, letter in reversed(entry_rules.LETTER_NAMES)}
_LAST_NAMES = {letter: name for name, letter in entry_rules.LETTER_NAMES}


def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents taken apart; the cascade has no SQL, its parts are held by the tests."""
    found = clitics.segment(arabic_words(spark, sf_dir, JOINED), "surface")
    whole = F.array_join(F.transform("segments", lambda x: x["surface"]), "")
    return found.select("surface", F.array_join("proclitics", "+").alias("proclitics"), "article", "host", "enclitic", "rule", (whole == F.col("surface")).alias("whole"))


def word_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("surface")
    words = arabic_words(spark, sf_dir, WORDS)
    out = boundary.pre_root(words, "surface", s.isin(clitics.OPERATORS), s.isin(clitics.PROTECTED), F.lit("ACCEPT"))
    return out.select("id", "host", "kind", boundary.directive_for(F.col("kind")).alias("directive"), "route", "path", "verdict", F.size("residuals").alias("n_residuals"))


def glyph_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arabic_words(spark, sf_dir, WORDS).select("id", F.posexplode(glyphs.traces(F.col("surface"))).alias("pos", "t"))
    return found.select("id", "pos", "t.base", "t.marks", "t.kind", "t.start", "t.stop", glyphs.judgment(F.col("t"))["verdict"].alias("verdict"), glyphs.is_vowelless(F.concat("t.base", "t.marks")).alias("vowelless"), glyphs.first_mark(F.col("t.marks")).alias("first_mark"))


def glyph_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return arabic_words(spark, sf_dir, WORDS).select("id", glyphs.traces(F.col("surface")).alias("t")).select("id", glyphs.last_base(t)["base"].alias("last"), glyphs.imperfect_shape(t).alias("imperfect"), glyphs.dual_host(t).alias("dual"))


def word_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of words."""
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(pick(number, items).alias(c) for c, (number, items) in RECORD.items()))
    return capabilities.capabilities(records, "id")


def _case_of(value: str, known: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items()) + " ELSE 'كذا' END"


#: A heading as SQL that both engines read: the root in brackets, its letters by name, and a phrase.
_HEADING = f"concat('(', root, ') ', {_case_of('substr(root, 1, 1)', _FIRST_NAMES)}, ' و', {_case_of('substr(root, 2, 1)', _LAST_NAMES)}, ' و', {_case_of('substr(root, 3, 1)', _FIRST_NAMES)}, phrase)"
_STORED = f"CASE ({_OTHER}) % {len(STORED)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(STORED)) + " END"


def heading_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading for each root of the words of documents, and what the rules read from it."""
    known = arabic_roots(spark, sf_dir, []).withColumn("phrase", pick(_CODE, PHRASES))
    h = known.select("root", F.expr(_HEADING).alias("heading"), F.expr(_STORED).alias("stored")).withColumn("spelled", entry_rules.spelled_root(F.col("heading")))
    r = entry_rules.repairs(h, "stored", "spelled")
    return r.select("root", "spelled", "repair", "reason", entry_rules.heading_kind(F.col("heading")).alias("type"), entry_rules.senses(F.col("heading"))["kind"].alias("senses"), entry_rules.chapter_in(F.col("heading")).alias("chapter"), entry_rules.root_in_brackets(F.col("heading")).alias("bracketed"))


def vocalised_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, their sukuns not written, among the words of documents as they are."""
    known = arabic_words(spark, sf_dir, WORDS)
    words = known.select("id", F.regexp_replace("surface", "\u0652", "").alias("surface"))
    return lexicon.lookup_vocalised(words, "id", "surface", known.select(F.col("surface").alias("entry")))


QUERIES = [vocalised_lookup, word_segments, word_boundaries, glyph_traces, glyph_shapes, word_capabilities, heading_rules]

_list = lambda words: ", ".join(f"'{w}'" for w in words)
_W = arabic_words_sql(WORDS)
_SOLAR = "تثدذرزسشصضطظلن"
_HOST = f"CASE WHEN regexp_matches(surface, '^الْ.') THEN surface[4:] WHEN regexp_matches(surface, '^ال[{_SOLAR}]{_OM}*ّ') THEN regexp_replace(surface[3:], '^(.)({_OM}*)ّ', '\\1\\2') ELSE surface END"
_BASE = "CASE base " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in glyphs.BASE_CLASSES.items()) + " ELSE CASE WHEN regexp_matches(base, '^[ب-غف-ه]$') THEN 'CONSONANT_PLAIN' ELSE 'UNKNOWN' END END"
_GLYPHS = f"""{_W}, g AS (SELECT id, unnest(x) AS u, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(surface, '[^{_M[1:-1]}]{_M}*') AS x FROM w)),
  t AS (SELECT id, i, u[1] AS base, u[2:] AS marks, length(u) AS n, sum(length(u)) OVER (PARTITION BY id ORDER BY i) AS stop FROM g), k AS (SELECT *, {_BASE} AS kind FROM t)"""
_VOWEL = "regexp_matches({m}, '[َُِ]') AND NOT regexp_matches({m}, '[ًٌٍْ]') AND length(regexp_replace({m}, '[^َُِ]', '', 'g')) = 1"
_FEATURES = values("ft", "feature, spelling, value, label_ar, label", capabilities.FEATURES)
_OPS = {w: kind for kind, words in reversed(capabilities.OPERATORS) for w in reversed(words)}


def _feature(capability: str, name: str, raw: str, status: str, residual: str, odd: str = "false") -> str:
    return f"""SELECT id, '{capability}' AS capability, CASE WHEN {odd} THEN 'AMBIGUOUS' WHEN coalesce(raw, '') = '' THEN '{status}' ELSE 'PROVIDED' END AS status, CASE WHEN {odd} THEN given WHEN raw <> '' THEN coalesce(value, up) END AS value,
      CASE WHEN NOT {odd} AND raw <> '' THEN coalesce(label_ar, up) END AS label_ar, CASE WHEN NOT {odd} AND raw <> '' THEN coalesce(label, up) END AS label, CASE WHEN {odd} THEN 'IRAB_CASE_UNRECOGNIZED' WHEN coalesce(raw, '') = '' THEN '{residual}' END AS residual
      FROM (SELECT id, {raw} AS raw, {raw} AS given, trim(upper({raw})) AS up FROM r) LEFT JOIN ft ON feature = '{name}' AND spelling = up"""


ORACLES = {
    "vocalised_lookup": f"""WITH {_W}, q AS (SELECT id, regexp_replace(surface, '\u0652', '', 'g') AS s FROM w), k AS (SELECT DISTINCT surface AS entry FROM w),
        met AS (SELECT id, s, entry, regexp_extract_all(s, '{_B}{_M}*') AS a, regexp_extract_all(entry, '{_B}{_M}*') AS b FROM q JOIN k ON regexp_replace(s, '{_M}', '', 'g') = regexp_replace(entry, '{_M}', '', 'g') WHERE regexp_replace(s, '{_M}', '', 'g') <> ''),
        fit AS (SELECT id, CASE WHEN len(a) = len(b) AND len(list_filter(list_zip(a, b), lambda x: NOT (x[1][1] = x[2][1] AND (length(x[1]) = 1 OR x[1] = x[2])))) = 0 THEN entry END AS e FROM met),
        n AS (SELECT id, count(DISTINCT e) AS n, min(e) AS one FROM fit GROUP BY id)
        SELECT w.id, CASE WHEN n = 1 THEN 'FOUND' WHEN n > 1 THEN 'COLLISION' WHEN n = 0 THEN 'CONTRADICTED' ELSE 'NOT_FOUND' END AS status, CASE WHEN n = 1 THEN one END AS entry, coalesce(n, 0) AS n_entries FROM w LEFT JOIN n USING (id)""",
    "word_boundaries": f"""WITH h AS (WITH {_W} SELECT id, surface AS given, {_HOST} AS surface FROM w), u AS (SELECT id, unnest(x) AS u, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT id, regexp_extract_all({_SHADDA.format(c='surface')}, '{_B}{_M}*') AS x FROM h)),
        ph AS (SELECT id, i, n, u[1] AS char, u[2:] AS marks, CASE WHEN u[1] IN ('ا', 'ى') OR (u[1] IN ('و', 'ي') AND NOT regexp_matches(u, '[ً-ِ]')) THEN 'VL' WHEN regexp_matches(u, '[ً-ِ]') THEN 'M' ELSE 'S' END AS role FROM u),
        a AS (SELECT id, max(n) AS n, bool_or(i = 1 AND role = 'M') AS m1, bool_or(i = 2 AND role = 'S') AS s2, bool_or(i = 1 AND char IN ('ي', 'ت', 'ن', 'ء') AND contains(marks, 'َ')) AS pre, bool_or(i = n AND role = 'VL') AS vl, count(*) FILTER (role <> 'VL') AS c FROM ph GROUP BY id),
        {values("fw", "word, cls, kind", boundary.FUNCTION_WORDS)}, {values("d", "kind, directive", list(boundary.DIRECTIVES.items()))}, {values("kp", "kind, path", list(boundary.KIND_PATHS.items()))},
        k AS (SELECT h.*, coalesce(fw.kind, CASE WHEN n = 2 AND m1 AND s2 THEN 'COMPRESSED_VERB_CANDIDATE' WHEN coalesce(n, 0) < 3 THEN 'UNDERLICENSED_SHORT_SURFACE' WHEN n = 3 AND pre AND vl THEN 'AMBIGUOUS' WHEN c >= 2 THEN 'ROOT_ELIGIBLE' ELSE 'NON_VERBAL_SURFACE' END) AS kind
              FROM h LEFT JOIN a USING (id) LEFT JOIN fw ON word = regexp_replace(replace(surface, 'آ', 'ءَا'), '[أإؤئ]', 'ء', 'g')),
        s AS (SELECT *, (length(surface) >= 5 AND regexp_matches(surface, '^[أإا]') AND contains(surface[4:], 'ا') AND regexp_matches(surface, '[ُِ]$')) OR regexp_matches(surface, '[ًٌٍ]$') AS noun,
              length(surface) >= 4 AND regexp_matches(surface, '^[يتنأ][َُ][^واي]') AND surface NOT LIKE '%ى' AND NOT (length(surface) >= 5 AND surface[1:2] IN ('أَ', 'إِ') AND surface[3] = 'ل' AND contains(surface[3:6], 'ّ')) AS verb,
              regexp_matches(surface, '({"|".join(boundary.NOMINAL_TAILS)})$') AS tail, (length(surface) >= 4 AND regexp_matches(surface, '[ُِ]$')) OR (length(surface) >= 3 AND regexp_matches(surface, '[ُِ]ّ$')) AS mark FROM k),
        p AS (SELECT s.*, directive, coalesce(kp.path, CASE WHEN noun OR (tail AND NOT verb) THEN 'nominal_morphology_path' WHEN verb OR surface LIKE '%تْ' OR s.kind = 'COMPRESSED_VERB_CANDIDATE' THEN 'verbal_root_path' WHEN mark THEN 'nominal_morphology_path' ELSE 'ambiguous_morphology_path' END) AS path,
              CASE WHEN given IN ({_list(clitics.OPERATORS)}) THEN 'CLOSED_OPERATOR_HOST' WHEN given IN ({_list(clitics.PROTECTED)}) THEN 'MABNI_HOST' ELSE 'MORPHOLOGY_PATH' END AS route FROM s JOIN d USING (kind) LEFT JOIN kp ON kp.kind = s.kind),
        v AS (SELECT *, CASE WHEN directive = 'BLOCK' OR route <> 'MORPHOLOGY_PATH' THEN 'BLOCK' WHEN directive = 'DEFER' OR path = 'ambiguous_morphology_path' THEN 'DEFER' ELSE 'ACCEPT' END AS verdict FROM p)
        SELECT id, surface AS host, kind, directive, route, path, verdict, CASE verdict WHEN 'ACCEPT' THEN 0 ELSE 1 END::INT AS n_residuals FROM v""",
    "glyph_traces": f"""WITH {_GLYPHS} SELECT id, (i - 1)::INT AS pos, base, marks, kind, (stop - n)::INT AS start, stop::INT AS stop, CASE WHEN kind IN ({_list(glyphs.LICENSED)}) THEN 'PASS' ELSE 'BLOCK' END AS verdict,
        contains(marks, 'ْ') OR NOT regexp_matches(marks, '[ً-ِ]') AS vowelless, nullif(marks[1], '') AS first_mark FROM k""",
    "glyph_shapes": f"""WITH {_GLYPHS}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS j, count(*) OVER (PARTITION BY id) AS c FROM k WHERE kind <> 'TATWEEL'),
        f AS (SELECT id, max(CASE WHEN j = c THEN base END) AS last, max(c) AS c, max(CASE WHEN j = 1 THEN base END) AS b1, max(CASE WHEN j = 2 THEN base END) AS b2, bool_or(j = 1 AND contains(marks, 'َ') AND {_VOWEL.format(m='marks')}) AS fatha, bool_or(j = 2 AND contains(marks, 'ْ') AND NOT regexp_matches(marks, '[\u064b-\u0651]')) AS sukun FROM b GROUP BY id)
        SELECT w.id, last, coalesce(c >= 4 AND b1 IN ('ي', 'ت') AND fatha AND sukun, false) AS imperfect, coalesce(c >= 3 AND b1 <> 'ي' AND fatha AND NOT (b1 = 'ء' AND b2 = 'ل'), false) AS dual FROM w LEFT JOIN f USING (id)""",
    "word_capabilities": f"""WITH r AS (SELECT p_partkey AS id, {", ".join(f"{pick_sql(number, items)} AS {c}" for c, (number, items) in RECORD.items())} FROM part), {_FEATURES}, {values('wc', 'cls, ar, en', capabilities.WORD_CLASSES)}, {values('op', 'word, kind', list(_OPS.items()))},
        known AS (SELECT *, nullif(word_class, 'UNKNOWN') AS cls, contains(upper(coalesce(verdict, '')), 'ACCEPT') AS ok FROM r),
        ops AS (SELECT r.id, surface, coalesce(a.kind, b.kind, CASE WHEN word_class LIKE 'HARF%' THEN 'PARTICLE:' || word_class END) AS kind FROM r LEFT JOIN op a ON a.word = surface LEFT JOIN op b ON b.word = regexp_replace(surface, '{_M}', '', 'g')),
        refs AS (SELECT id, CASE WHEN verbal_noun IS NOT NULL THEN verbal_noun WHEN root IS NOT NULL AND pattern IS NOT NULL THEN root || ' (' || pattern || ')' ELSE root END AS form, CASE WHEN verbal_noun IS NOT NULL THEN 'masdar:' || verbal_noun WHEN pattern IS NOT NULL THEN 'root:' || root || ' pattern:' || pattern ELSE 'root:' || root END AS label,
                 verbal_noun IS NULL AND pattern IS NULL AS alone FROM r)
        SELECT id, 'CAP_WORD_CLASS' AS capability, CASE WHEN known.cls IS NULL THEN 'DEFERRED' WHEN ok THEN 'PROVIDED' ELSE 'AMBIGUOUS' END AS status, known.cls AS value, CASE WHEN known.cls IS NOT NULL THEN coalesce(ar, 'مجهول') END AS label_ar, coalesce(en, known.cls) AS label,
          CASE WHEN known.cls IS NULL THEN 'WORD_CLASS_NOT_DETERMINED' WHEN NOT ok THEN 'WORD_CLASS_VERDICT_UNCLEAR' END AS residual FROM known LEFT JOIN wc ON wc.cls = known.cls
        UNION ALL SELECT id, capability, CASE WHEN raw NOT IN ('1', '3') AND regexp_matches(raw, '^[0-9]+$') THEN 'AMBIGUOUS' ELSE status END, CASE WHEN raw NOT IN ('1', '3') AND regexp_matches(raw, '^[0-9]+$') THEN raw ELSE value END, CASE WHEN raw NOT IN ('1', '3') AND regexp_matches(raw, '^[0-9]+$') THEN NULL ELSE label_ar END,
          CASE WHEN raw NOT IN ('1', '3') AND regexp_matches(raw, '^[0-9]+$') THEN NULL ELSE label END, CASE WHEN raw NOT IN ('1', '3') AND regexp_matches(raw, '^[0-9]+$') THEN 'NUMBER_AMBIGUOUS_WITH_PERSON_FIELD' ELSE residual END
          FROM ({_feature('CAP_NOMINAL_NUMBER', 'number', "CASE WHEN number = '2' AND person IS NULL THEN 'DU' ELSE number END", 'NOT_APPLICABLE', 'NUMBER_NOT_IN_MORPHOSYNTAX')}) JOIN (SELECT id, CASE WHEN number = '2' AND person IS NULL THEN 'DU' ELSE number END AS raw FROM r) USING (id)
        UNION ALL {_feature('CAP_FORMAL_GENDER', 'gender', 'gender', 'NOT_APPLICABLE', 'GENDER_NOT_IN_MORPHOSYNTAX')}
        UNION ALL {_feature('CAP_DEFINITENESS', 'definiteness', "coalesce(definiteness, CASE WHEN article THEN 'DEF' END)", 'DEFERRED', 'DEFINITENESS_UNDETERMINED')}
        UNION ALL {_feature('CAP_MABNI_MURAB_STATE', 'state', f"CASE WHEN regexp_matches(word_class, '{capabilities.INVARIABLE}') THEN 'MABNI' ELSE state END", 'DEFERRED', 'MABNI_MURAB_UNDETERMINED')}
        UNION ALL {_feature('CAP_INFLECTION_STATE', 'irab', 'irab', 'DEFERRED', 'IRAB_CASE_UNDETERMINED', "(raw <> '' AND label IS NULL)")}
        UNION ALL {_feature('CAP_DERIVATION_STATE', 'derivation', 'derivation', 'DEFERRED', 'DERIVATION_STATE_UNDETERMINED')}
        UNION ALL SELECT id, 'CAP_REFERENCE_FORM', CASE WHEN form IS NULL THEN 'DEFERRED' WHEN alone THEN 'AMBIGUOUS' ELSE 'PROVIDED' END, form, form, CASE WHEN form IS NOT NULL THEN label END, CASE WHEN form IS NULL THEN 'NO_ROOT_OR_MASDAR_FOR_REFERENCE_FORM' WHEN alone THEN 'WAZN_MISSING_REFERENCE_FORM_INCOMPLETE' END FROM refs
        UNION ALL SELECT id, 'CAP_OPERATOR_PROFILE', CASE WHEN kind IS NULL THEN 'NOT_APPLICABLE' ELSE 'PROVIDED' END, kind, CASE WHEN kind IS NOT NULL THEN surface END, kind, NULL FROM ops
        UNION ALL SELECT id, 'CAP_CLAUSE_BOUNDARY', CASE WHEN opens THEN 'PROVIDED' ELSE 'NOT_APPLICABLE' END, CASE WHEN opens THEN kind END, CASE WHEN opens THEN surface END, CASE WHEN opens THEN 'CLAUSE_BOUNDARY:' || kind END, NULL
          FROM (SELECT *, coalesce(kind NOT LIKE 'PARTICLE%' AND kind <> 'PREPOSITION', false) AS opens FROM ops)
        UNION ALL SELECT id, 'CAP_RELATION_READINESS', CASE WHEN error <> '' THEN 'BLOCKED' WHEN cls IS NOT NULL AND ok THEN 'PROVIDED' ELSE 'DEFERRED' END, CASE WHEN coalesce(error, '') = '' AND cls IS NOT NULL AND ok THEN 'true' ELSE 'false' END,
          CASE WHEN error <> '' THEN 'غير جاهز' WHEN cls IS NOT NULL AND ok THEN 'جاهز للعلاقة' ELSE 'مؤجل' END, CASE WHEN error <> '' THEN 'NOT_READY' WHEN cls IS NOT NULL AND ok THEN 'READY_FOR_RELATION' ELSE 'DEFERRED' END, CASE WHEN error <> '' THEN 'PIPELINE_ERROR:' || error WHEN cls IS NOT NULL AND ok THEN NULL ELSE 'WORD_CLASS_NOT_ACCEPTED' END FROM known
        UNION ALL SELECT id, 'CAP_DAL_ONLY_READINESS', CASE WHEN error <> '' THEN 'BLOCKED' WHEN cls IS NOT NULL THEN 'PROVIDED' ELSE 'DEFERRED' END, CASE WHEN coalesce(error, '') = '' AND cls IS NOT NULL THEN 'true' ELSE 'false' END,
          CASE WHEN error <> '' THEN 'مانع' WHEN cls IS NOT NULL THEN 'جاهز للدال' ELSE 'مؤجل' END, CASE WHEN error <> '' THEN 'BLOCKED' WHEN cls IS NOT NULL THEN 'READY_FOR_DAL_ONLY' ELSE 'DEFERRED' END, CASE WHEN error <> '' THEN 'PIPELINE_ERROR:' || error WHEN cls IS NOT NULL THEN NULL ELSE 'WORD_CLASS_MISSING' END FROM known""",
    "heading_rules": f"""WITH {arabic_roots_sql([])}, h AS (SELECT root, {_HEADING} AS heading, {_STORED} AS stored FROM (SELECT root, {pick_sql(_CODE, PHRASES)} AS phrase FROM r)),
        {values('nm', 'name, letter', entry_rules.LETTER_NAMES)}, {values('sn', 'i, phrase, kind', [(i, p, k) for i, (p, k, _) in enumerate(entry_rules.SENSES)])},
        {values('ty', 'i, phrase, kind', [(i, p.replace('(?!ان)', '($|[^ا]|ا($|[^ن]))'), k) for i, (k, ps) in enumerate(entry_rules.HEADINGS.items()) for p in ps])},
        tok AS (SELECT root, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT root, string_split(regexp_replace(regexp_replace(heading, '[\u064b-\u0670]', '', 'g'), 'و(ا[لنت])', ' \\1', 'g'), ' ') AS x FROM h)),
        stop AS (SELECT root, min(i) AS i FROM tok WHERE t IN ({_list(entry_rules.DESCRIPTIONS)}) GROUP BY root),
        sp AS (SELECT tok.root, left(string_agg(letter, '' ORDER BY tok.i), 4) AS spelled FROM tok JOIN nm ON name = t LEFT JOIN stop USING (root) WHERE stop.i IS NULL OR tok.i < stop.i GROUP BY tok.root),
        f AS (SELECT h.root, heading, stored AS s, CASE WHEN length(spelled) >= 2 THEN spelled END AS p FROM h LEFT JOIN sp USING (root)),
        j AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN length(s) = 1 THEN 'single_letter' WHEN regexp_matches(s, '[a-z]') THEN 'non_arabic' WHEN length(s) > 4 THEN 'too_long' END AS bad, s[1] IN ('ا', 'ب', 'ت', 'ث', 'ج') AS gap, length(s) = length(p) AS level,
              (s[1] = p[1])::INT + (length(s) >= 2 AND s[2] = p[2])::INT + (length(s) >= 3 AND s[3] = p[3])::INT AS same FROM f),
        v AS (SELECT *, CASE WHEN p IS NULL THEN 'parse_failed' WHEN bad IS NOT NULL THEN 'bad_quality:' || bad WHEN s = p THEN 'already_correct' WHEN gap AND s[1] <> p[1] THEN 'first_letter_corrected:' || s[1] || '→' || p[1]
              WHEN gap AND level AND length(s) = 3 AND same = 2 THEN 'one_radical_corrected:' || s || '→' || p WHEN level AND s[2:] = p[2:] AND s[1] || p[1] IN ('حخ', 'خح') THEN 'ha_kha_swap_pos0:' || s[1] || '→' || p[1] || ':' || s || '→' || p ELSE 'conflict:' || s || '≠' || p END AS reason FROM j)
        SELECT root, p AS spelled, NOT regexp_matches(reason, '^(parse_failed|already_correct|conflict)') AS repair, reason, (SELECT arg_min(kind, i) FROM ty WHERE regexp_matches(regexp_replace(heading, '[\u064b-\u0652\u0670]', '', 'g'), phrase)) AS type,
               coalesce((SELECT arg_min(kind, i) FROM sn WHERE regexp_matches(regexp_replace(heading, '[\u064b-\u065f]', '', 'g'), phrase)), 'NONE') AS senses,
               regexp_extract(heading, '({"|".join(sorted({*entry_rules.CHAPTERS.values(), "الهمزة"}))})', 1) AS chapter, root AS bracketed FROM v""",
}
