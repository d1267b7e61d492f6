"""Compounds, generated forms, relicensing and letter accounts, over the words of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import accounting, compounds, inverse, lexicon, relicensing
from tessella.operators.inverse import Rule
from tessella.operators.relicensing import Hypothesis
from tessella.plans.inputs import distinct_words, table, values
from tessella.plans.lexicon_queries import _LEVEL

SUFFIXES = ["ing", "ed", "er", "s", "tion", "eux", "ung", "en", "ción"]
#: Endings of the tables' languages as a generator takes them; of a feature the first that fits.
RULES = [
    Rule("BASE", "", 0, ""),
    Rule("PLURAL", "y", 1, "ies"), Rule("PLURAL", "s", 0, "es"), Rule("PLURAL", "", 0, "s"),
    Rule("PAST", "e", 0, "d"), Rule("PAST", "y", 1, "ied"), Rule("PAST", "", 0, "ed"),
    Rule("PROGRESSIVE", "e", 1, "ing"), Rule("PROGRESSIVE", "", 0, "ing"),
    Rule("NOUN", "en", 2, "ung"), Rule("NOUN", "er", 2, "tion"), Rule("NOUN", "", 0, "tion"),
    Rule("AGENT", "e", 0, "r"), Rule("AGENT", "", 0, "er"),
    Rule("QUALITY", "ig", 0, "keit"), Rule("QUALITY", "lich", 0, "keit"), Rule("QUALITY", "", 0, "heit"),
    Rule("DIMINUTIVE", "a", 1, "ita"), Rule("DIMINUTIVE", "o", 1, "ito"),
]
#: What may stand between a word and a licensed one; restored vowels need the ending that weakened them.
HYPOTHESES = [
    Hypothesis("PLURAL_S", "suffix", "s"), Hypothesis("PLURAL_EN", "suffix", "en"), Hypothesis("PLURAL_ER", "suffix", "er"), Hypothesis("ENDING_E", "suffix", "e"),
    Hypothesis("NOUN_UNG", "suffix", "ung", "en"), Hypothesis("NOUN_TION", "suffix", "tion", "t"), Hypothesis("FEMININE", "suffix", "a", "o"),
    Hypothesis("PREFIX_VER", "prefix", "ver"), Hypothesis("PREFIX_RE", "prefix", "re"), Hypothesis("PREFIX_UN", "prefix", "un"),
    Hypothesis("UMLAUT", "weak", "äöü", "aou", ("PLURAL_ER", "ENDING_E")), Hypothesis("ACCENT", "weak", "éèê", "eee", ("PLURAL_S", "ENDING_E")),
]
VOWELS = "aeiouäöüáéíóúàèêç"
#: Prefix and suffix letters, consonants as root letters for nothing, vowels as augments for one.
COSTS = accounting.Costs(
    prefix={"g": 1, "e": 1, "v": 1, "r": 1, "u": 1, "n": 1},
    root={v: 2 for v in VOWELS},
    augment={v: 1 for v in VOWELS} | {"n": 2, "t": 2, "h": 2},
    suffix={"s": 1, "t": 1, "e": 1, "n": 1, "g": 1, "i": 1, "o": 1, "r": 1, "d": 1},
)


def _words(spark: SparkSession, sf_dir: str, name: str = "documents", c: Column | None = None) -> DataFrame:
    """Distinct words of a table's texts."""
    return distinct_words(table(spark, sf_dir, name), F.col("text") if c is None else c, text.SPACE, "word")


def _plain_words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Distinct words in lower case, of letters alone."""
    return distinct_words(table(spark, sf_dir, name), F.lower("text"), f"[^a-z{VOWELS}]+", "word")


def longest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _words(spark, sf_dir, "benchmark").select(F.col("word").alias("prefix"))
    return compounds.longest_prefix(_words(spark, sf_dir), "word", "word", known).select("word", "prefix", "rest")


def compound_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a benchmark word and a rest that is one too, in small letters without marks."""
    known = _words(spark, sf_dir, "benchmark")
    bare = lambda c: F.nullif(F.regexp_replace(F.lower(c), f"[^a-z{VOWELS}]", ""), F.lit(""))
    index = known.select(bare(F.col("word")).alias("key"), F.col("word").alias("entry")).where("key IS NOT NULL")
    return compounds.compound_lookup(_words(spark, sf_dir), "word", "word", known.select(F.col("word").alias("prefix")), index, bare)


def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, known = _words(spark, sf_dir), _words(spark, sf_dir, "benchmark")
    ways = lexicon.strip_suffixes(words, "word", "word", SUFFIXES)
    short = known.where("length(word) <= 4").select(F.col("word").alias("prefix"))
    return compounds.recognise(words, "word", "word", ways, short, known.select(F.col("word").alias("entry")), F.col("word").rlike("[0-9]"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.generate(_plain_words(spark, sf_dir, "benchmark"), "word", RULES)


def generated_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.generate(_plain_words(spark, sf_dir), "word", RULES).groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.length("surface")).alias("letters"), F.count_distinct("surface").alias("surfaces"))


def word_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents as forms of all words of documents."""
    words = _plain_words(spark, sf_dir)
    return inverse.analyse(words, "word", "word", inverse.generate(words, "word", RULES))


def relicensed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir, c=F.lower("text"))
    licensed = _plain_words(spark, sf_dir, "benchmark").select(F.col("word").alias("root"))
    return relicensing.relicense(words, "word", "word", licensed, HYPOTHESES, F.col("word").rlike(f"[^a-z{VOWELS}]"))


def letter_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _plain_words(spark, sf_dir).select("word", accounting.account(F.col("word"), COSTS).alias("a"))
    return found.select("word", "a.cost", accounting.roles(F.col("word"), F.col("a")).alias("roles"), F.array_join(F.transform("a.roots", lambda k: F.substring("word", k + 1, F.lit(1))), "").alias("root"))


QUERIES = [longest_prefixes, compound_lookup, recognised_words, generated_forms, word_readings, relicensed_roots, letter_accounts]

_SPLIT = r"unnest(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
_PLAIN = _SPLIT.format(c=f"regexp_replace(lower(text), '[^a-z{VOWELS}]+', ' ', 'g')")
_W = f"w AS (SELECT DISTINCT {_SPLIT.format(c='text')} AS word FROM documents), k AS (SELECT DISTINCT {_SPLIT.format(c='text')} AS word FROM benchmark)"
_BARE = f"regexp_replace(lower({{c}}), '[^a-z{VOWELS}]', '', 'g')"
_MET = "met AS (SELECT w.word, k.word AS prefix, substr(w.word, length(k.word) + 1) AS rest FROM w JOIN k ON starts_with(w.word, k.word) AND length(w.word) > length(k.word))"


def _generated(words: str) -> str:
    """Forms by a CASE for each feature, in place of the rules' fold."""
    out = []
    for feature in dict.fromkeys(r.feature for r in RULES):
        cases = " ".join(f"WHEN ends_with(word, '{r.ending}') AND length(word) > {r.strip} THEN left(word, length(word) - {r.strip}) || '{r.add}'" for r in RULES if r.feature == feature)
        out.append(f"SELECT word AS root, '{feature}' AS feature, CASE {cases} END AS surface FROM {words}")
    return f"g AS (SELECT * FROM ({' UNION ALL '.join(out)}) WHERE surface IS NOT NULL)"


def _hypothesis(k: int, h: Hypothesis) -> str:
    licence = sum(1 << j for j, x in enumerate(HYPOTHESES) if x.name in h.licence)
    ok = f"used & {1 << k} = 0" + (f" AND used & {licence} <> 0" if licence else "")
    n, m = len(h.pattern), len(h.becomes)
    if h.side == "weak":
        form, ok = f"translate(form, '{h.pattern}', '{h.becomes}')", ok + f" AND translate(form, '{h.pattern}', '{h.becomes}') <> form"
    elif h.side == "prefix":
        form, ok = f"'{h.becomes}' || substr(form, {n + 1})", ok + f" AND starts_with(form, '{h.pattern}') AND length(form) - {n} + {m} >= 2"
    else:
        form, ok = f"left(form, length(form) - {n}) || '{h.becomes}'", ok + f" AND ends_with(form, '{h.pattern}') AND length(form) - {n} + {m} >= 2"
    return f"CASE WHEN {ok} THEN {{'form': {form}, 'used': used | {1 << k}}} END"


def _case(column: str, costs: dict[str, int], other: int | None) -> str:
    by = " ".join(f"WHEN {column} IN ({', '.join(repr(x) for x, c in costs.items() if c == cost)}) THEN {cost}" for cost in sorted(set(costs.values())))
    return f"CASE {by} {'' if other is None else f'ELSE {other}'} END"


_ACCOUNTS = f"""WITH RECURSIVE w AS (SELECT DISTINCT {_PLAIN} AS word FROM documents),
  c AS (SELECT word, k, {_case('ch', COSTS.prefix, None)} AS p, {_case('ch', COSTS.root, 0)} AS r, {_case('ch', COSTS.augment, None)} AS a, {_case('ch', COSTS.suffix, None)} AS s
        FROM (SELECT word, unnest(range(length(word))) AS k, word[k + 1] AS ch FROM w)),
  -- a state: letters done, phase, root letters; its way: cost, prefix letters, places of root letters, where the suffix begins
  st(word, k, phase, n, way) AS (SELECT word, 0::BIGINT, 'P', 0, {{'cost': 0, 'prefix': 0, 'roots': []::BIGINT[], 'suffix': 0::BIGINT}} FROM w
    UNION ALL SELECT word, k, phase, n, min(way) FROM (
      SELECT c.word, c.k + 1 AS k, t.phase, t.n, t.way FROM st JOIN c ON c.word = st.word AND c.k = st.k, LATERAL (
        SELECT * FROM (VALUES
          ('P', st.n, CASE WHEN st.phase = 'P' AND c.p IS NOT NULL THEN {{'cost': st.way.cost + c.p, 'prefix': st.way.prefix + 1, 'roots': st.way.roots, 'suffix': st.way.suffix}} END),
          ('M', st.n, CASE WHEN st.phase IN ('P', 'M') AND c.a IS NOT NULL THEN {{'cost': st.way.cost + c.a, 'prefix': st.way.prefix, 'roots': st.way.roots, 'suffix': st.way.suffix}} END),
          ('M', st.n + 1, CASE WHEN st.phase IN ('P', 'M') AND st.n < 4 AND c.r IS NOT NULL THEN {{'cost': st.way.cost + c.r, 'prefix': st.way.prefix, 'roots': list_append(st.way.roots, c.k), 'suffix': st.way.suffix}} END),
          ('S', st.n, CASE WHEN st.phase IN ('M', 'S') AND c.s IS NOT NULL THEN {{'cost': st.way.cost + c.s, 'prefix': st.way.prefix, 'roots': st.way.roots, 'suffix': CASE st.phase WHEN 'M' THEN c.k ELSE st.way.suffix END}} END)
        ) AS v(phase, n, way) WHERE v.way IS NOT NULL) t) GROUP BY word, k, phase, n),
  best AS (SELECT word, min({{'cost': way.cost, 'prefix': way.prefix, 'roots': way.roots, 'suffix': CASE phase WHEN 'M' THEN length(word) ELSE way.suffix END}}) AS b
           FROM st WHERE k = length(word) AND phase <> 'P' AND n BETWEEN 2 AND 4 GROUP BY word)
  SELECT w.word, b.cost::INT AS cost, array_to_string(list_transform(range(CASE WHEN b IS NULL THEN NULL ELSE length(w.word) END), lambda k: CASE WHEN k < b.prefix THEN 'P' WHEN k >= b.suffix THEN 'S' WHEN list_contains(b.roots, k) THEN 'R' ELSE 'A' END), '') AS roles,
         array_to_string(list_transform(b.roots, lambda k: w.word[k + 1]), '') AS root FROM w LEFT JOIN best USING (word)"""

ORACLES = {
    "longest_prefixes": f"WITH {_W}, {_MET} SELECT word, arg_max(prefix, length(prefix)) AS prefix, arg_max(rest, length(prefix)) AS rest FROM met GROUP BY word",
    "compound_lookup": f"""WITH {_W}, {_MET}, i AS (SELECT {_BARE.format(c='word')} AS key, count(*) AS n, min(word) AS entry FROM k GROUP BY 1),
        f AS (SELECT met.*, CASE WHEN n = 1 THEN 3 WHEN n > 1 THEN 2 ELSE 1 END AS rank, CASE WHEN n = 1 THEN entry END AS entry FROM met LEFT JOIN i ON key = {_BARE.format(c='rest')} AND key <> ''),
        b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY word ORDER BY rank DESC, length(prefix) DESC) = 1)
        SELECT word, CASE rank WHEN 3 THEN 'COMPOUND' WHEN 2 THEN 'COLLISION' WHEN 1 THEN 'OPEN' ELSE 'NONE' END AS status, CASE WHEN rank > 1 THEN prefix END AS prefix, CASE WHEN rank > 1 THEN rest END AS rest, entry
        FROM w LEFT JOIN b USING (word)""",
    "recognised_words": f"""WITH {_W}, {values('s', 'suffix', [(x,) for x in SUFFIXES])}, l0 AS (SELECT word, word AS stem, '' AS taken FROM w), l1 AS ({_LEVEL.format(prev='l0')}), l2 AS ({_LEVEL.format(prev='l1')}), l3 AS ({_LEVEL.format(prev='l2')}),
        ways AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3), short AS (SELECT word FROM k WHERE length(word) <= 4),
        core AS (SELECT h.stem, arg_max(short.word, length(short.word)) AS prefix FROM (SELECT DISTINCT stem FROM ways) h JOIN short ON starts_with(h.stem, short.word) JOIN k ON k.word = substr(h.stem, length(short.word) + 1) GROUP BY h.stem),
        f AS (SELECT ways.*, prefix, CASE WHEN stem IN (SELECT word FROM k) AND taken = '' THEN 0 WHEN stem IN (SELECT word FROM short) THEN 1 WHEN stem IN (SELECT word FROM k) THEN 2 WHEN prefix IS NOT NULL THEN 3 ELSE 4 END AS rank
              FROM ways LEFT JOIN core USING (stem) WHERE NOT regexp_matches(ways.word, '[0-9]')),
        b AS (SELECT word, rank, count(*) AS n, min(stem) AS stem, min(taken) AS taken, min(CASE WHEN rank = 3 THEN prefix END) AS prefix FROM f GROUP BY word, rank, length(stem) QUALIFY row_number() OVER (PARTITION BY word ORDER BY rank, length(stem)) = 1)
        SELECT w.word, ['WHOLE', 'FUNCTION', 'KNOWN', 'PREFIX_AND_CORE', 'OPEN'][rank + 1] AS route, CASE WHEN n = 1 AND rank < 4 THEN stem END AS stem, CASE WHEN n = 1 AND rank < 4 THEN taken END AS taken, CASE WHEN n = 1 AND rank < 4 THEN prefix END AS prefix,
               coalesce(n, 0) AS n_ways, CASE WHEN rank IS NULL THEN 'BLOCKED' WHEN rank = 4 THEN 'DEFERRED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'CLOSED' END AS verdict FROM w LEFT JOIN b USING (word)""",
    "generated_forms": f"WITH p AS (SELECT DISTINCT {_PLAIN} AS word FROM documents), {_generated('p')} SELECT feature, count(*) AS n, sum(length(surface))::BIGINT AS letters, count(DISTINCT surface) AS surfaces FROM g GROUP BY feature",
    "word_readings": f"""WITH p AS (SELECT DISTINCT {_PLAIN} AS word FROM documents), {_generated('p')}, n AS (SELECT surface, count(DISTINCT root) AS n_roots FROM g GROUP BY surface)
        SELECT word, root, feature, coalesce(n_roots, 0) AS n_roots, CASE WHEN n_roots = 1 THEN 'ACCEPT' WHEN n_roots > 1 THEN 'DEFER' ELSE 'UNKNOWN' END AS verdict FROM p LEFT JOIN g ON g.surface = word LEFT JOIN n ON n.surface = word""",
    "relicensed_roots": f"""WITH RECURSIVE w AS (SELECT DISTINCT {_SPLIT.format(c='lower(text)')} AS word FROM documents), lic AS (SELECT DISTINCT {_PLAIN} AS root FROM benchmark),
        s(word, form, used, r, ok) AS (SELECT word, word, 0::BIGINT, 0, word IN (SELECT root FROM lic) FROM w WHERE NOT regexp_matches(word, '[^a-z{VOWELS}]')
          UNION SELECT word, h.form, h.used, r + 1, h.form IN (SELECT root FROM lic) FROM (SELECT word, r, unnest([{', '.join(_hypothesis(k, h) for k, h in enumerate(HYPOTHESES))}]) AS h FROM s WHERE NOT ok) WHERE h IS NOT NULL),
        first AS (SELECT word, min(r) AS r FROM s WHERE ok GROUP BY word), last AS (SELECT word, max(r) AS r FROM s GROUP BY word),
        hit AS (SELECT s.word, s.r, count(DISTINCT form) AS n, min(form) AS form, min(used) AS used FROM s JOIN first USING (word, r) WHERE ok GROUP BY ALL)
        SELECT w.word, CASE WHEN l.r IS NULL THEN 'BLOCK' WHEN n = 1 THEN 'ACCEPT' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'DEFER' END AS verdict, CASE WHEN n = 1 THEN form END AS root, coalesce(h.r, l.r, 0)::INT AS rounds,
               CASE WHEN n = 1 THEN array_to_string(list_filter([{', '.join(f"CASE WHEN used & {1 << k} <> 0 THEN '{h.name}' END" for k, h in enumerate(HYPOTHESES))}], lambda x: x IS NOT NULL), '+') ELSE '' END AS used
        FROM w LEFT JOIN last l USING (word) LEFT JOIN hit h USING (word)""",
    "letter_accounts": _ACCOUNTS,
}
