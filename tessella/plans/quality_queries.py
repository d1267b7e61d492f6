"""Aggregations, first-wins dedup, invariants and comparisons on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import quality
from tessella.plans.inputs import table


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return quality.first_wins(events, F.concat_ws(":", "user_id", "event_type"), ["ts", "event_id"])


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return quality.top_per_group(rows, ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.best_candidates(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(table(spark, sf_dir, "documents"), "lang", F.col("n_chars") > 1000, "source")


def below_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang <> 'en'")
    expected = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("expected"))
    return quality.below_ratio(docs, "source", expected, 0.4)


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "discount_over_8": F.col("l_discount") > 0.08,
        "returned_open": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
        "no_quantity": F.col("l_quantity") <= 0,
        "late_line": F.col("l_linenumber") > 6,
    }
    return quality.invariants(table(spark, sf_dir, "lineitem"), rules, F.col("l_orderkey"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored, against what their lines say; differences of urgent orders are declared."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    done = F.count_if(F.col("l_linestatus") == "F")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(done == F.count(F.lit(1)), "F").when(done == 0, "O").otherwise("P").alias("o_orderstatus"))
    new = lines.join(old.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    declared = old.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("o_orderstatus").alias("field"))
    return quality.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"], declared)


def check_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    guess = docs.select("doc_id", (F.col("n_chars") > 400).cast("int").alias("quality"), F.lower("text").contains("idiot").cast("int").alias("toxic"))
    return quality.check_gold(guess, table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def not_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_measured(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of histograms and conditional counts for each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(f"n_{x}") for x in ("en", "de", "fr", "es")], F.count_if(F.col("n_chars") < 100).alias("n_short"), F.max("n_chars").alias("longest"))


def null_class_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label in buckets, and whether the buckets add up to all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    bucket = F.when(F.col("quality") == 1, "GOOD").when(F.col("quality") == 0, "BAD").when(F.col("n_chars") < 200, "SHORT").otherwise("OPEN")
    counts = docs.join(labels, "doc_id", "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = docs.agg(F.count(F.lit(1)).alias("total"))
    sums = counts.agg(F.sum("n").alias("n"), F.lit("ALL").alias("bucket"))
    return counts.select("bucket", "n", F.lit(True).alias("balanced")).unionByName(sums.select("bucket", "n", (F.col("n") == every.scalar()).alias("balanced")))


QUERIES = [first_per_key, top_customers, best_candidates, coverage, below_ratio, invariants, snapshot_diff, check_gold, outcome_histogram, not_measured, latency_summary, token_profile, null_class_accounting]
ORACLES = {
    "first_per_key": "SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "top_customers": "SELECT c_mktsegment, c_custkey, c_acctbal, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3",
    "best_candidates": """SELECT user_id, event_type, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS rank FROM
        (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL)) WHERE rank <= 3""",
    "coverage": "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS hits, round_even(100.0 * count(*) FILTER (n_chars > 1000) / count(*), 1)::DOUBLE AS hit_rate, count(DISTINCT source) AS n_distinct FROM documents GROUP BY lang",
    "below_ratio": """SELECT source, expected, n FROM (SELECT source, count(*) AS expected, count(*) FILTER (lang <> 'en') AS n FROM documents GROUP BY source) WHERE n < 0.4 * expected""",
    "invariants": """WITH broken AS (SELECT l_orderkey AS k, unnest(list_filter([CASE WHEN l_discount > 0.08 THEN 'discount_over_8' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'returned_open' END,
          CASE WHEN l_quantity <= 0 THEN 'no_quantity' END, CASE WHEN l_linenumber > 6 THEN 'late_line' END], lambda r: r IS NOT NULL)) AS rule FROM lineitem),
        firsts AS (SELECT rule, string_agg(k, ',' ORDER BY k) AS f FROM (SELECT DISTINCT rule, k, dense_rank() OVER (PARTITION BY rule ORDER BY k) AS r FROM broken) WHERE r <= 25 GROUP BY rule)
        SELECT r.rule, coalesce(n, 0) AS n, coalesce(f, '') AS first_offenders FROM (VALUES ('discount_over_8'), ('returned_open'), ('no_quantity'), ('late_line')) r(rule)
        LEFT JOIN (SELECT rule, count(*) AS n FROM broken GROUP BY rule) c USING (rule) LEFT JOIN firsts USING (rule)""",
    "snapshot_diff": """WITH l AS (SELECT l_orderkey AS o_orderkey, CASE count(*) FILTER (l_linestatus = 'F') WHEN count(*) THEN 'F' WHEN 0 THEN 'O' ELSE 'P' END AS s FROM lineitem GROUP BY 1),
        new AS (SELECT o_orderkey, s, o_orderpriority AS p FROM l JOIN orders USING (o_orderkey)),
        pair AS (SELECT o.o_orderkey, 'o_orderstatus' AS field, o.o_orderstatus AS "old", n.s AS "new", o.o_orderpriority = '1-URGENT' AS declared FROM orders o LEFT JOIN new n USING (o_orderkey)
                 UNION ALL SELECT o.o_orderkey, 'o_orderpriority', o.o_orderpriority, n.p, false FROM orders o LEFT JOIN new n USING (o_orderkey))
        SELECT o_orderkey, field, "old", "new" FROM pair WHERE "old" IS DISTINCT FROM "new" AND NOT declared""",
    "check_gold": """WITH d AS (SELECT doc_id, (n_chars > 400)::INT AS quality, contains(lower(text), 'idiot')::INT AS toxic FROM documents)
        SELECT 'quality' AS field, count(*) AS checked, count(*) FILTER (d.quality IS DISTINCT FROM g.quality) AS wrong FROM labels g LEFT JOIN d USING (doc_id) WHERE g.quality IS NOT NULL
        UNION ALL SELECT 'toxic', count(*), count(*) FILTER (d.toxic IS DISTINCT FROM g.toxic) FROM labels g LEFT JOIN d USING (doc_id) WHERE g.toxic IS NOT NULL""",
    "outcome_histogram": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "not_measured": "SELECT DISTINCT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders",
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY event_type",
    "token_profile": """SELECT source, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'fr') AS n_fr, count(*) FILTER (lang = 'es') AS n_es,
        count(*) FILTER (n_chars < 100) AS n_short, max(n_chars) AS longest FROM documents GROUP BY source""",
    "null_class_accounting": """WITH b AS (SELECT CASE WHEN quality = 1 THEN 'GOOD' WHEN quality = 0 THEN 'BAD' WHEN n_chars < 200 THEN 'SHORT' ELSE 'OPEN' END AS bucket FROM documents LEFT JOIN labels USING (doc_id))
        SELECT bucket, count(*) AS n, true AS balanced FROM b GROUP BY bucket UNION ALL SELECT 'ALL', count(*), true FROM b""",
}
