"""Tiered lookups, suffix stripping and merges on words, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import lexicon
from tessella.plans.inputs import rows, table, values

_SUFFIXES = [("ing",), ("ed",), ("er",), ("s",), ("tion",), ("eux",), ("ung",), ("en",), ("ción",)]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of documents with an id of their own."""
    w = table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    return w.select(F.col("word").alias("word_id"), "word")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as entries of a lexicon."""
    return table(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("entry")).distinct()


def _tiers(spark: SparkSession, sf_dir: str) -> list:
    entries, bare = _catalog(spark, sf_dir), lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    keyed = lambda key: entries.select(key.alias("key"), "entry").where("key <> ''")
    word = F.col("word")
    return [("EXACT", word, keyed(F.col("entry"))), ("NORMALISED", F.lower(word), keyed(F.lower("entry"))), ("BARE", F.nullif(bare(word), F.lit("")), keyed(bare(F.col("entry"))))]


def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.tiered_lookup(_words(spark, sf_dir), "word_id", [(*t, t[0] == "BARE") for t in _tiers(spark, sf_dir)])


def colliding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.lookup_or_collide(_words(spark, sf_dir), "word_id", _tiers(spark, sf_dir))


def suffix_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.strip_suffixes(_words(spark, sf_dir), "word_id", "word", [s for (s,) in _SUFFIXES])


def chosen_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = lexicon.strip_suffixes(_words(spark, sf_dir), "word_id", "word", [s for (s,) in _SUFFIXES])
    return lexicon.choose_segmentation(ways, "word_id", _catalog(spark, sf_dir).select(F.col("entry").alias("stem")))


def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as pages of an entry."""
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 40, "AUTO").when(F.col("value") > 10, "REVIEW").otherwise("RAW").alias("status"), F.when(F.col("event_type") == "view", "NONE").otherwise(F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").alias("source"))
    return lexicon.merge_group(pages, "user_id", "event_id", "status", "kind", "source")


def typed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("root"))
    registry = rows(spark, "root string, status string", [("Brand#11", "AUTO"), ("Brand#21", "REVIEW"), ("Brand#35", "AUTO")])
    covered = rows(spark, "first string", [("Brand#1",), ("Brand#2",), ("Brand#3",)])
    return lexicon.typed_lookup(parts, "root", registry, covered, F.substring("root", 1, 7), F.col("p_partkey") % 17 != 0)


def evidence_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates: orders propose, finished ones close, a segment lists, balances certify."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_totalprice")
    out = lexicon.evidence_chain(
        customers.select("key"), "key", orders.select("key"), orders.where("o_totalprice > 400000").select("key"), customers.where("c_mktsegment = 'BUILDING'").select("key"), customers.where("c_acctbal > 0").select("key")
    )
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def unique_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.unique_or_refuse(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


def form_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("position"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("letter"))
    return lexicon.consensus(forms, "l_orderkey", "position", "letter")


def ranked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("rule_id"))
    return lexicon.rank_rules(rules, ["family"])


QUERIES = [tiered_lookup, colliding_lookup, suffix_ways, chosen_segmentation, merged_entries, typed_lookup, evidence_outcomes, unique_proofs, form_consensus, ranked_rules]

_W = r"""words AS (SELECT DISTINCT w AS word FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents)),
  entries AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS entry FROM benchmark)"""
_TIERS = f"""{_W}, hits AS (SELECT word, 0 AS i, 'EXACT' AS tier, [entry] AS es FROM words JOIN entries ON entry = word
  UNION ALL SELECT word, 1, 'NORMALISED', list_sort(list(entry)) FROM words JOIN entries ON lower(entry) = lower(word) GROUP BY word
  UNION ALL SELECT word, 2, 'BARE', list_sort(list(entry)) FROM words JOIN entries ON regexp_replace(lower(entry), '[^a-z]', '', 'g') = regexp_replace(lower(word), '[^a-z]', '', 'g')
            AND regexp_replace(lower(word), '[^a-z]', '', 'g') <> '' GROUP BY word)"""
_LEVEL = "SELECT l.word, left(l.stem, length(l.stem) - length(s.suffix)) AS stem, s.suffix || CASE WHEN l.taken = '' THEN '' ELSE '+' || l.taken END AS taken FROM {prev} l JOIN s ON suffix(l.stem, s.suffix) AND length(l.stem) - length(s.suffix) >= 2"
_WAYS = f"""{_W}, {values('s', 'suffix', _SUFFIXES)}, l0 AS (SELECT word, word AS stem, '' AS taken FROM words), l1 AS ({_LEVEL.format(prev='l0')}), l2 AS ({_LEVEL.format(prev='l1')}), l3 AS ({_LEVEL.format(prev='l2')}),
  ways AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""
ORACLES = {
    "tiered_lookup": f"""WITH {_TIERS} SELECT word AS word_id, arg_min(tier, i) AS tier, array_to_string(arg_min(es, i), ',') AS entry, len(arg_min(es, i))::INT AS n_entries FROM hits WHERE tier <> 'BARE' OR len(es) = 1 GROUP BY word""",
    "colliding_lookup": f"""WITH {_TIERS}, f AS (SELECT word, arg_min(tier, i) AS tier, arg_min(es, i) AS es FROM hits GROUP BY word)
        SELECT word AS word_id, tier, CASE WHEN len(es) = 1 THEN es[1] END AS entry, CASE WHEN tier IS NULL THEN 'NOT_FOUND' WHEN len(es) > 1 THEN 'COLLISION' ELSE 'FOUND' END AS status FROM words LEFT JOIN f USING (word)""",
    "suffix_ways": f"WITH {_WAYS} SELECT word AS word_id, stem, taken FROM ways",
    "chosen_segmentation": f"""WITH {_WAYS}, k AS (SELECT word, count(*) AS n, min(stem) AS stem, min(taken) AS taken FROM ways WHERE stem IN (SELECT entry FROM entries) GROUP BY word)
        SELECT word AS word_id, CASE WHEN n = 1 THEN 'CLOSED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'OPEN' END AS verdict, CASE WHEN n = 1 THEN stem END AS stem, CASE WHEN n = 1 THEN taken END AS taken FROM words LEFT JOIN k USING (word)""",
    "merged_entries": """WITH p AS (SELECT user_id, event_id, CASE WHEN value > 40 THEN 'AUTO' WHEN value > 10 THEN 'REVIEW' ELSE 'RAW' END AS status, CASE WHEN event_type = 'view' THEN 'NONE' ELSE event_type END AS kind, props->>'$.k' AS source FROM events),
        s AS (SELECT user_id, string_agg(source, ',' ORDER BY f) AS sources FROM (SELECT user_id, source, min(event_id) AS f FROM p GROUP BY ALL) GROUP BY 1)
        SELECT user_id, CASE WHEN bool_or(status = 'AUTO') THEN 'AUTO' ELSE arg_min(status, event_id) END AS status, coalesce(arg_min(kind, event_id) FILTER (kind <> 'NONE'), 'NONE') AS kind, count(*) AS n_pages, any_value(sources) AS sources FROM p JOIN s USING (user_id) GROUP BY user_id""",
    "typed_lookup": """SELECT p_partkey, p_brand AS root, CASE WHEN p_partkey % 17 = 0 THEN 'INVALID' WHEN p_brand IN ('Brand#11', 'Brand#35') THEN 'FOUND_AUTO' WHEN p_brand = 'Brand#21' THEN 'FOUND_REVIEW'
        WHEN left(p_brand, 7) NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'COVERAGE_GAP' ELSE 'NOT_FOUND' END AS result FROM part""",
    "evidence_outcomes": """SELECT CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'NOT_PROPOSED' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'CLOSED_FORM'
        WHEN c_mktsegment <> 'BUILDING' THEN 'NOT_IN_LEXICON' WHEN c_acctbal <= 0 THEN 'NOT_CERTIFIED' ELSE 'LICENSED' END AS outcome, count(*) AS n FROM customer GROUP BY 1""",
    "unique_proofs": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS value, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'LICENSED' ELSE 'AMBIGUOUS' END AS verdict FROM orders GROUP BY 1",
    "form_consensus": """SELECT l_orderkey, (l_linenumber % 3)::INT AS position, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 'ACCEPT' ELSE 'DEFER' END AS verdict
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""",
    "ranked_rules": "SELECT p_brand AS family, p_size AS priority, p_partkey AS rule_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::INT AS rank FROM part",
}
