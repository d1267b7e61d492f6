"""Dictionary, reader and stream operators on the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import dictionary
from tessella.plans.inputs import rows, table
from tessella.sources import readers


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents of a source as one book."""
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.length("line") < 40
    return dictionary.entries(_doc_lines(spark, sf_dir), "source", "doc_id", "k", heading, "line", "(License|licensed)")


def dictionary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = rows(spark, "letter string, expected int", [(c, 60) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    return dictionary.coverage_report(dictionary_entries(spark, sf_dir), expected)


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as observations of a page; the greedy grouping has no SQL."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("obs_id"), (F.col("event_id") % 97).cast("double").alias("x"), (F.col("value") / 100).alias("y"), F.col("event_type").alias("text"), (F.col("value") % 1).alias("confidence"))
    return dictionary.merge_lines(dictionary.group_lines(seen))


def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("line").cast("double")
    kind = dictionary.region(F.greatest(50 - size / 8, F.lit(0.0)), F.least(50 + size / 8, F.lit(100.0)), (F.col("k") % 20) / F.lit(20.0), F.lit(100.0), size < 40)
    return _doc_lines(spark, sf_dir).groupBy(kind.alias("region")).agg(F.count(F.lit(1)).alias("n"))


def repaired_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 1, 3).alias("stored"), F.substring(F.reverse("p_name"), 1, 3).alias("parsed"))
    return parts.select("p_partkey", dictionary.should_repair(F.col("stored"), F.col("parsed")).alias("r")).select("p_partkey", "r.*")


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a catalog keyed by type: keys that repeat."""
    return readers.catalog_violations(table(spark, sf_dir, "events"), "event_type")


def corpus_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).alias("case_id"), F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("c_name")).alias("surface"), F.col("c_mktsegment").alias("section"))
    return readers.corpus_violations(cases, "case_id", {"section": ["BUILDING", "AUTOMOBILE", "MACHINERY"]}, ["surface"], 7)


QUERIES = [dictionary_entries, dictionary_coverage, line_groups, line_regions, repaired_roots, catalog_problems, corpus_problems]

_LINES = """l AS (SELECT source, doc_id, (k - 1)::INT AS k, line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents))"""
_ENTRIES = f"""{_LINES}, e AS (SELECT *, length(line) < 40 AS h, sum((length(line) < 40)::INT) OVER (PARTITION BY source ORDER BY doc_id, k) AS entry FROM l),
  en AS (SELECT source, entry::BIGINT AS entry, arg_min(line, (doc_id, k)) AS heading, count(*) - 1 AS n_lines, arg_min(line, (doc_id, k)) FILTER (NOT h AND regexp_matches(line, 'License|licensed')) AS origin, min(doc_id) AS first_part, arg_min(k, (doc_id, k)) AS first_k, max(doc_id) AS last_part, arg_max(k, (doc_id, k)) AS last_k FROM e WHERE entry > 0 GROUP BY ALL),
  ent AS (SELECT *, CASE WHEN origin IS NULL THEN 'REVIEW' ELSE 'AUTO' END AS status FROM en)"""
ORACLES = {
    "dictionary_entries": f"WITH {_ENTRIES} SELECT * FROM ent",
    "dictionary_coverage": f"""WITH {_ENTRIES}, s AS (SELECT heading[1] AS letter, count(*) AS n, count(*) FILTER (status = 'AUTO') AS auto FROM ent GROUP BY 1), x AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS letter)
        SELECT letter, coalesce(n, 0) AS n, coalesce(auto, 0) AS auto, 60 AS expected, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round_even(100.0 * auto / n, 1) END::DOUBLE AS auto_rate, coalesce(n, 0) < 12 AS thin FROM x LEFT JOIN s USING (letter)""",
    "line_regions": f"""WITH {_LINES}, p AS (SELECT *, length(line)::DOUBLE AS s, (k % 20) / 20.0::DOUBLE AS y FROM l), q AS (SELECT *, greatest(50 - s / 8, 0) AS x0, least(50 + s / 8, 100) AS x1 FROM p)
        SELECT CASE WHEN y > 0.93 THEN 'HEADER' WHEN s < 40 THEN 'HEADING' WHEN y < 0.12 THEN 'FOOTNOTE' WHEN x1 - x0 < 100::DOUBLE * 0.55::DOUBLE AND abs((x0 + x1) / 2 - 50) < 10 THEN 'POETRY' ELSE 'BODY' END AS region, count(*) AS n FROM q GROUP BY 1""",
    "repaired_roots": """WITH p AS (SELECT p_partkey, left(p_name, 3) AS a, left(reverse(p_name), 3) AS b FROM part),
        r AS (SELECT *, CASE WHEN coalesce(b, '') = '' THEN 'NO_PARSE' WHEN coalesce(a, '') = '' THEN 'WAS_BLANK' WHEN a = b THEN 'SAME' WHEN length(b) NOT BETWEEN 2 AND 4 THEN 'BAD_LENGTH' WHEN list_sort(string_split(a, '')) = list_sort(string_split(b, '')) THEN 'SWAP'
          WHEN a[1] <> b[1] THEN 'FIRST_LETTER' WHEN (a[1] <> b[1])::INT + (a[2] <> b[2])::INT + (a[3] <> b[3])::INT = 1 THEN 'ONE_RADICAL' ELSE 'TOO_DIFFERENT' END AS reason FROM p)
        SELECT p_partkey, reason IN ('WAS_BLANK', 'ONE_RADICAL', 'SWAP') AS repair, reason FROM r""",
    "catalog_problems": "SELECT 'REPEATED_KEY' AS rule, event_type AS key FROM events GROUP BY event_type HAVING count(*) > 1",
    "corpus_problems": """WITH c AS (SELECT (c_custkey % 400)::VARCHAR AS case_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS surface, c_mktsegment AS section FROM customer)
        SELECT case_id, 'blank:surface' AS rule FROM c WHERE trim(surface) = '' UNION ALL SELECT case_id, 'domain:section' FROM c WHERE section NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')
        UNION ALL SELECT case_id, 'repeated' FROM c GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT NULL, 'count' FROM c HAVING count(*) <> 7""",
}
