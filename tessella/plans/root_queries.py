"""Roots, patterns and derived words over the words of documents, with listed ones that the grammar decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import morphology, roots
from tessella.plans.arabic_queries import _BARE, _HOST, _ROOT_OF, HOSTS, WORDS, hosts
from tessella.plans.inputs import arabic_roots, arabic_roots_sql, arabic_words, arabic_words_sql, pick, pick_sql, rows, table, values

#: What a word's length, a root's letters or a part's numbers choose in queries that need some of each.
PATHS, DIRECTIVES = ["verbal_root_path", "nominal_morphology_path"], ["OPEN", "OPEN", "OPEN", "BLOCK", "DEFER"]
_PATH, _DIRECTIVE = "ascii(substr(id, 1, 1))", "length(id) + ascii(substr(id, 2, 1))"
FORMS = ["FORM_II", "FORM_III", "FORM_IV", "FORM_V", "FORM_VI", "FORM_VII", "FORM_VIII", "FORM_IX", "FORM_X"]
STEMS, TRANSITIVE, CLASSES, BABS = ["BARE", "BARE", "AUGMENTED"], ["TRANSITIVE", "INTRANSITIVE", None], ["SOUND", "HOLLOW", "DOUBLED", "DEFECTIVE", None], ["BAB_I_NASARA", "BAB_IV_SAMIA", "BAB_FORM_II", "BAB_FORM_IX", None]
NAMES, AYNS = ["FA_A_LA", "FA_I_LA", "FAAALA", "OTHER", "FA_U_LA", "ISTAF_A_LA"], ["يَفْعُلُ", "فَعِلَ", "فَعْل", "يَفْعَلُ", "فَ"]
STATED = ["x;imperfect_ayn:u", "paired:y:imperfect_ayn:i", "z", "paired_paradigm:imperfect_ayn=a", "imperfect_ayn:x"]
ASKED, TYPES = ["FORM_I", "FORM_II", "FORM_I", "FORM_IV", "FORM_X"], ["AUTO", "MASDAR", "ISM_FA3IL", "ISM_MAF3UL"]
SUPPLIED, ATTESTED = [None, None, "مُسْتَخْرِج", None, "كَاتِب"], ["FORM_I", "FORM_II", None]
_FIRST, _SECOND, _THIRD = "ascii(substr(root, 1, 1))", "ascii(substr(root, 2, 1))", "ascii(substr(root, 3, 1))"
#: Words that the grammar decides, whatever the tables hold.
COMPRESSED = ["قُلْ", "بِعْ", "كُلْ", "عَدْ", "كَتَبَ"]


def refined_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = arabic_words(spark, sf_dir, WORDS).select("id", F.col("surface").alias("host"), pick(_PATH, PATHS).alias("path"), pick(_DIRECTIVE, DIRECTIVES).alias("directive"))
    found = words.withColumn("r", roots.refine_host(F.col("host"), F.col("path"), F.col("directive"))).withColumn("a", roots.resolve_root(F.col("r.host"), F.col("directive")))
    return found.select("id", F.col("r.host").alias("refined"), "r.removed", F.col("a.directive").alias("verdict"), "a.root")


def compressed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arabic_words(spark, sf_dir, list(enumerate(COMPRESSED))).withColumn("c", roots.compressed_roots(F.col("surface")))
    return found.select("id", F.array_join(F.transform("c", lambda r: F.array_join(r, "")), ",").alias("roots"))


def slot_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = rows(spark, "wazn_id string, pattern string, family string, evidence_rank int", morphology.PATTERNS)
    return roots.align(hosts(spark, sf_dir), patterns, "word_id", "host", "root")


def host_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arabic_words(spark, sf_dir, WORDS).select("id", "surface", F.posexplode(roots.cells(F.col("surface"))).alias("pos", "c"))
    return found.select("id", "pos", "c.base", "c.vowel", "c.tanwin")


def augmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = arabic_roots(spark, sf_dir, []).select(F.split("root", "").alias("letters"), pick(_THIRD, FORMS).alias("form"))
    return roots.augmented_words(verbs.withColumnRenamed("letters", "root")).withColumn("root", F.concat_ws("", "root"))


def eligible_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as verbs, described by their size and the lengths of their name and type."""
    part = table(spark, sf_dir, "part")
    return roots.eligible_nouns(part.select(F.col("p_partkey").alias("verb_id"), pick("p_size", STEMS).alias("stem"), pick("length(p_name)", TRANSITIVE).alias("transitivity"), pick("p_size + length(p_type)", CLASSES).alias("root_class"), pick("length(p_type)", BABS).alias("bab_id")))


def class_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick("p_size", NAMES).alias("wazn_id"), pick("length(p_name)", AYNS).alias("pattern"), pick("p_size + length(p_type)", STATED).alias("evidence"))
    e = e.withColumn("v", roots.imperfect_vowel(F.split("evidence", ";")))
    return e.select("id", roots.ayn_vowel(F.col("pattern")).alias("ayn"), F.col("v").alias("stated"), roots.sufficiency(F.col("wazn_id"), F.col("v")).alias("sufficiency"))


def derived_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived words asked of each root, with a lexicon of verbal nouns for some of them."""
    known = arabic_roots(spark, sf_dir, [])
    asked = known.select(F.col("root").alias("request_id"), F.split("root", "").alias("letters"), pick(_FIRST, ASKED).alias("form"), pick(_SECOND, TYPES).alias("type"), pick(_THIRD, SUPPLIED).alias("supplied")).withColumnRenamed("letters", "root")
    lexicon = known.select("root", pick(_THIRD, ATTESTED).alias("form"), F.lit("MASDAR").alias("type"), F.concat(F.substring("root", 1, 1), F.lit("\u0650"), F.substring("root", 2, 1), F.lit("َا"), F.substring("root", 3, 1), F.lit("َة")).alias("surface")).where("form IS NOT NULL")
    return roots.derive(asked, lexicon)


QUERIES = [refined_roots, compressed_roots, slot_alignments, host_cells, augmented_words, eligible_nouns, class_evidence, derived_words]

_UNITS = "regexp_extract_all({c}, '[ء-غف-ي][ً-ٰٕ]*')"
_VERBS = f"{arabic_roots_sql([])}, v AS (SELECT DISTINCT root, {pick_sql(_THIRD, FORMS)} AS form FROM r)"
_FILLED = "replace(replace(replace(translate(pattern, 'فعل', '123'), '1', root[1]), '2', root[2]), '3', root[3])"
ORACLES = {
    "refined_roots": f"""WITH {arabic_words_sql(WORDS)}, h AS (SELECT id, surface AS host, {pick_sql(_PATH, PATHS)} AS path, {pick_sql(_DIRECTIVE, DIRECTIVES)} AS directive, {_UNITS.format(c='surface')} AS u FROM w),
        m AS (SELECT *, len(u) AS n, coalesce(u[-1], '') AS last, coalesce(u[-2], '') AS before FROM h),
        v AS (SELECT *, regexp_matches(before, '[\u064e\u064f\u0650]') AND NOT regexp_matches(last, '[\u064b-\u064d]') AND n >= 4 AS vowelled FROM m),
        x AS (SELECT *, CASE WHEN directive = 'BLOCK' THEN NULL WHEN path = 'verbal_root_path' AND vowelled AND regexp_matches(last, '^ت[\u064b-\u0655\u0670]*[\u0652\u0650]') THEN 'PAST_FEMININE_TA'
                WHEN path = 'nominal_morphology_path' AND ((last[1] = 'ة' AND n >= 3) OR (vowelled AND regexp_matches(last, '^ت[\u064b-\u0655\u0670]*[\u0652\u064e\u064f\u0650]'))) THEN 'NOMINAL_TA_MARBUTA' END AS removed FROM v),
        w2 AS (SELECT id, directive, removed, CASE WHEN removed IS NULL THEN host ELSE array_to_string(u[:-2], '') END AS surface FROM x), {_ROOT_OF.format(w='w2')}
        SELECT w2.id, w2.surface AS refined, removed, CASE WHEN w2.directive = 'BLOCK' THEN 'BLOCK' WHEN w2.directive = 'DEFER' AND a.directive = 'ACCEPT' THEN 'DEFER' ELSE a.directive END AS verdict, CASE WHEN w2.directive NOT IN ('BLOCK', 'DEFER') THEN a.root END AS root FROM w2 JOIN a USING (id)""",
    "compressed_roots": f"""WITH {arabic_words_sql(list(enumerate(COMPRESSED)))}, n AS (SELECT id, {_HOST.format(c='surface')} AS n FROM w),
        c AS (SELECT id, replace({_BARE.format(c='n')}, ' ', '') AS c, regexp_extract(n, '^[\u064b-\u0655\u0670]*[ء-غف-ي]([\u064b-\u0655\u0670])', 1) AS mark FROM n)
        SELECT id, CASE WHEN length(c) = 2 AND mark = '\u064f' THEN c[1] || 'و' || c[2] || ',' || c[1] || 'ي' || c[2] WHEN length(c) = 2 AND mark = '\u0650' THEN c[1] || 'ي' || c[2] || ',' || c[1] || 'و' || c[2] END AS roots FROM c""",
    "slot_alignments": f"""WITH {HOSTS}, {values('p', 'wazn_id, pattern, family, evidence_rank', morphology.PATTERNS)},
        wc AS (SELECT word_id, letters, u.i, base, vowel, n FROM (SELECT word_id, letters, unnest(x) AS t, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT word_id, letters, {_UNITS.format(c=_HOST.format(c='host'))} AS x FROM hw)) u,
               LATERAL (SELECT t[1] AS base, regexp_extract(t, '[َُِْ]') AS vowel)),
        pc AS (SELECT wazn_id, i, CASE t[1] WHEN 'ف' THEN 1 WHEN 'ع' THEN 2 WHEN 'ل' THEN 3 ELSE 0 END AS slot, t[1] AS base, regexp_extract(t, '[َُِْ]') AS vowel, n FROM (SELECT wazn_id, unnest(x) AS t, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT wazn_id, {_UNITS.format(c=_HOST.format(c='pattern'))} AS x FROM p))),
        j AS (SELECT word_id, wazn_id, pc.i, pc.n, slot, pc.base AS added, letters, wc.vowel AS have, pc.vowel AS want,
              CASE WHEN slot = 0 THEN pc.base = wc.base ELSE letters[slot] NOT IN ('ا', 'ى', 'أ', 'إ', 'ؤ', 'ئ') AND (letters[slot] = wc.base OR (letters[slot] = 'ء' AND wc.base IN ('أ', 'إ', 'ؤ', 'ئ', 'آ'))) END AS letter
              FROM wc JOIN pc ON pc.i = wc.i),
        ok AS (SELECT word_id, wazn_id, any_value(n) AS n, string_agg(added, '' ORDER BY i) FILTER (slot = 0) AS added, bool_or(slot = 2 AND have = 'ْ' AND want <> 'ْ' AND want <> '') AS merged FROM j GROUP BY word_id, wazn_id
               HAVING count(*) = any_value(n) AND bool_and(letter AND (want = '' OR i = n OR have = want OR (slot = 2 AND letters[2] = letters[3] AND have = 'ْ')))),
        e AS (SELECT ok.*, (SELECT count(*) FROM wc WHERE wc.word_id = ok.word_id AND wc.i > ok.n) AS extra, (SELECT count(*) FROM wc WHERE wc.word_id = ok.word_id AND wc.i > ok.n AND base = 'ت' AND vowel = 'ْ') AS ts, (SELECT count(*) FROM wc WHERE wc.word_id = ok.word_id AND wc.i > ok.n AND base = 'ة') AS ties FROM ok)
        SELECT word_id, wazn_id, CASE WHEN extra = 0 THEN 'clean' WHEN ts = extra THEN 'inflectional' ELSE 'nominal' END AS ending, coalesce(added, '') AS added, merged FROM e WHERE extra = 0 OR ts = extra OR ties > 0""",
    "host_cells": f"""WITH {arabic_words_sql(WORDS)}, u AS (SELECT id, unnest(x) AS u, generate_subscripts(x, 1) AS i FROM (SELECT id, {_UNITS.format(c=_HOST.format(c='surface'))} AS x FROM w))
        SELECT id, (i - 1)::INT AS pos, u[1] AS base, CASE regexp_extract(u, '[َُِْ]') WHEN 'َ' THEN 'FATHA' WHEN 'ُ' THEN 'DAMMA' WHEN 'ِ' THEN 'KASRA' WHEN 'ْ' THEN 'SUKUN' END AS vowel, regexp_matches(u, '[ًٌٍ]') AS tanwin FROM u""",
    "augmented_words": f"""WITH {_VERBS}, {values('p', 'form, slot, pattern', roots.AUGMENTED)}, {values('a', 'letter, begins', roots.FORM_VIII_FIRST)},
        x AS (SELECT v.root, v.form, slot, begins, replace(replace(replace(translate(pattern, 'فعل', '123'), '1', v.root[1]), '2', v.root[2]), '3', v.root[3]) AS made, v.form = 'FORM_VIII' AND slot = 'PAST' AS eighth, v.root[2] IN ('و', 'ي') AS w2, v.root[3] IN ('و', 'ي') AS w3
              FROM v JOIN p USING (form) LEFT JOIN a ON letter = v.root[1]),
        y AS (SELECT *, CASE WHEN eighth THEN contains('{roots.FORM_VIII_OPEN}', root[1]) ELSE w2 AND form NOT IN ('FORM_II', 'FORM_III') END AS open FROM x)
        SELECT root, form, slot, CASE WHEN open THEN NULL WHEN eighth AND begins IS NOT NULL THEN begins || root[2] || 'َ' || root[3] || 'َ' ELSE made END AS surface, CASE WHEN open THEN 'DEFER' WHEN eighth THEN 'HIGH' WHEN w2 OR w3 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM y""",
    "eligible_nouns": f"""WITH v AS (SELECT p_partkey AS verb_id, {pick_sql('p_size', STEMS)} AS stem, {pick_sql('length(p_name)', TRANSITIVE)} AS transitivity, {pick_sql('p_size + length(p_type)', CLASSES)} AS root_class, {pick_sql('length(p_type)', BABS)} AS bab_id FROM part), {values('e', 'i, type, stem, condition, value, verdict', [(i, *r) for i, r in enumerate(roots.ELIGIBILITY)])}
        SELECT verb_id, type, arg_min(verdict, i) AS verdict FROM v JOIN e USING (stem) WHERE value = CASE condition WHEN 'transitivity' THEN coalesce(transitivity, 'UNKNOWN') WHEN 'root_class' THEN coalesce(root_class, 'UNKNOWN') WHEN 'bab_id' THEN coalesce(bab_id, 'UNKNOWN') ELSE value END GROUP BY ALL""",
    "class_evidence": f"""WITH e AS (SELECT p_partkey AS id, {pick_sql('p_size', NAMES)} AS wazn_id, {pick_sql('length(p_name)', AYNS)} AS pattern, {pick_sql('p_size + length(p_type)', STATED)} AS evidence FROM part), s AS (SELECT *, nullif(regexp_extract(evidence, 'imperfect_ayn[:=]([aiu])', 1), '') AS stated FROM e)
        SELECT id, CASE regexp_extract(pattern, 'ع([َُِ])', 1) WHEN 'َ' THEN 'a' WHEN 'ِ' THEN 'i' WHEN 'ُ' THEN 'u' END AS ayn, stated,
          CASE WHEN wazn_id IN ({", ".join(f"'{x}'" for x in roots.AUGMENTED_PATTERNS)}) THEN 'MAZID_ACCEPT' WHEN wazn_id NOT IN ('FA_A_LA', 'FA_I_LA', 'FA_U_LA') THEN 'NO_CATALOG_MATCH' WHEN stated IS NOT NULL THEN 'UNIQUE_ACCEPT' ELSE 'MUJARRAD_AMBIGUOUS' END AS sufficiency FROM s""",
    "derived_words": f"""WITH {arabic_roots_sql([])}, q AS (SELECT root, {pick_sql(_FIRST, ASKED)} AS form, {pick_sql(_SECOND, TYPES)} AS type, {pick_sql(_THIRD, SUPPLIED)} AS supplied FROM r),
        one AS (SELECT root, form, supplied, unnest(CASE type WHEN 'AUTO' THEN ['ISM_FA3IL', 'ISM_MAF3UL'] ELSE [type] END) AS type FROM q),
        lex AS (SELECT root, {pick_sql(_THIRD, ATTESTED)} AS form, 'MASDAR' AS type, c1 || '\u0650' || c2 || 'َا' || c3 || 'َة' AS surface FROM r), {values('p', 'form, type, pattern', [*roots.AUGMENTED, *roots.BARE_DERIVED])},
        made AS (SELECT one.root, supplied, surface FROM one JOIN lex USING (root, form, type) UNION ALL SELECT root, supplied, {_FILLED} AS surface FROM one JOIN p USING (form, type) WHERE NOT regexp_matches(root, '[وي]')),
        f AS (SELECT root, count(DISTINCT surface) AS n, array_to_string(list_sort(list(DISTINCT surface)), ',') AS surfaces FROM made WHERE supplied IS NULL OR supplied = surface GROUP BY root)
        SELECT q.root AS request_id, CASE WHEN n > 0 THEN 'ACCEPT' ELSE 'DEFER' END AS verdict, CASE WHEN n = 1 THEN 'SINGLE' WHEN n > 1 THEN 'MULTIPLE' ELSE 'NONE' END AS outcome, coalesce(surfaces, '') AS surfaces FROM q LEFT JOIN f ON f.root = q.root""",
}
