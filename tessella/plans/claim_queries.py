"""Claim bundles over parts, whose names and types stand for words and their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import claims
from tessella.plans.inputs import table

_BLOCKING = ["defer:40"]
_NONE = "CAST(array() AS array<string>)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a word: the longer words of its name and type are patterns, its brand's digits are radicals."""
    # a file of few row groups would be few tasks, and a bundle is much work for its few bytes
    return table(spark, sf_dir, "part").repartition("p_partkey").selectExpr(
        "p_partkey AS token_id", "p_name AS original", "lower(p_name) AS normalized", "split(lower(p_name), ' ')[0] AS host",
        "filter(split(concat_ws(' ', p_name, p_type), ' '), w -> length(w) > p_size % 7) AS patterns", "if(p_size % 4 = 0, NULL, substring(p_brand, 7, 1)) AS r1", "substring(p_brand, 8, 1) AS r2", "p_brand AS root",
        "p_size % 5 = 0 AS closed", "if(p_size % 5 = 0, 'MABNI_BOUNDARY', 'OPEN_MORPHOLOGY') AS boundary", "CASE p_size % 7 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ACCEPT' WHEN 2 THEN 'ACCEPT' WHEN 3 THEN 'OTHER' ELSE 'DEFER' END AS directive",
        f"concat(if(p_size > 25, array(concat('Root:Catalog:', p_brand)), {_NONE}), if(contains(p_brand, '1'), array(concat('WAZN:', p_type)), {_NONE}), if(p_size % 3 = 0, array('negative:x'), {_NONE})) AS evidence",
        "if(p_size % 2 = 0, array('norm:lower', 'host:first'), array('norm:lower')) AS traces", "array(concat('defer:', p_size)) AS active", f"if(p_size = 13, array('defer:13'), {_NONE}) AS resolved",
    )


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name: F.array(F.col(name))
    fields = {
        "ORIGINAL_SURFACE": one("original"), "NORMALIZED_SURFACE": one("normalized"), "SEGMENT_HOST": one("host"), "BOUNDARY_TYPE_SLOT": one("boundary"),
        "PATH_DIRECTIVE_SLOT": one("directive"), "RADICAL_R1": one("r1"), "RADICAL_R2": one("r2"), "PATTERN_CANDIDATE_SET": F.col("patterns"),
    }
    slots = claims.typed_slots(fields, {"PATH_DIRECTIVE_SLOT": F.col("closed")})
    return claims.build_bundles(_parts(spark, sf_dir), "PATTERN", "PATTERN_CLAIM", slots, F.col("evidence"))


def claim_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that hold something, one row each."""
    rows = _bundles(spark, sf_dir).select("token_id", F.inline("slots"))
    return rows.where("state <> 'UNKNOWN'").select("token_id", "slot_id", "sort", "state", "value", F.size("candidates").alias("n_candidates"))


def claim_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, obstacles, residuals and what a bundle breaks of its profile, after a round trip through JSON."""
    made = _bundles(spark, sf_dir).select("token_id", "evidence", claims.to_document(F.col("original"), F.col("normalized")).alias("d")).select("token_id", "evidence", claims.from_document(F.col("d")).alias("b"))
    kinds = F.transform("evidence", lambda e: F.when(F.lower(e).startswith("wazn"), "WAZN_MATCH").otherwise("CONTEXTUAL"))
    return made.select(
        "token_id",
        "b.claim_key",
        F.array_join("b.obstacles", ",").alias("obstacles"),
        F.array_join(F.transform("b.residuals", lambda r: F.concat_ws(":", r["slot"], r["n"].cast("string"))), ",").alias("residuals"),
        F.array_join(claims.profile_problems(F.col("b.profile_id"), F.col("b.typed_slots"), kinds), ",").alias("problems"),
    )


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims.map_evidence(F.col("evidence"), F.col("root"), F.get("patterns", F.lit(0)), F.col("directive"), F.col("token_id").cast("string"))
    rows = _parts(spark, sf_dir).select("token_id", found.alias("e"))
    return rows.select("token_id", F.array_join(F.transform("e.records", lambda r: r["type"]), ",").alias("types"), F.size(F.filter("e.records", lambda r: r["negative"])).alias("n_negative"), F.array_join("e.missing", ",").alias("missing"), "e.verdict")


def admitted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["token_id", "original", "normalized", "host", "directive", "evidence", "traces", "active", "resolved"]
    columns = {n: F.col(n) for n in names} | {"claim_id": F.col("token_id").cast("string"), "root": F.when(F.col("token_id") % 10 != 0, F.col("root")), "pattern": F.get("patterns", F.lit(0)), "provider": F.col("original") != "cold widget"}
    found = claims.admit(_parts(spark, sf_dir).withColumnRenamed("evidence", "evidence_ids"), columns | {"evidence": F.col("evidence_ids")}, _BLOCKING)
    return found.select("token_id", "verdict", "stopped_at", "identity", "evidence")


QUERIES = [claim_slots, claim_bundles, claim_evidence, admitted_claims]

_W = """w AS (SELECT p_partkey AS token_id, p_name AS original, lower(p_name) AS normalized, string_split(lower(p_name), ' ')[1] AS host, list_distinct(list_filter(string_split(concat_ws(' ', p_name, p_type), ' '), lambda x: length(x) > p_size % 7)) AS patterns,
    list_filter(string_split(concat_ws(' ', p_name, p_type), ' '), lambda x: length(x) > p_size % 7)[1] AS pattern, CASE WHEN p_size % 4 <> 0 THEN substr(p_brand, 7, 1) END AS r1, substr(p_brand, 8, 1) AS r2, p_brand AS root, p_size % 5 = 0 AS closed,
    CASE WHEN p_size % 5 = 0 THEN 'MABNI_BOUNDARY' ELSE 'OPEN_MORPHOLOGY' END AS boundary, CASE p_size % 7 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ACCEPT' WHEN 2 THEN 'ACCEPT' WHEN 3 THEN 'OTHER' ELSE 'DEFER' END AS directive,
    p_size, p_size > 25 AS has_root, contains(p_brand, '1') AS has_pattern, p_size % 3 = 0 AS has_negative, p_brand, p_type FROM part)"""
_SLOTS = f"""{_W}, s AS (SELECT token_id, slot_id, sort, state, value, n FROM (
    SELECT token_id, unnest([
      {{'slot_id': 'ORIGINAL_SURFACE', 'sort': 0, 'state': 'FILLED', 'value': original, 'n': 1}}, {{'slot_id': 'NORMALIZED_SURFACE', 'sort': 10, 'state': 'FILLED', 'value': normalized, 'n': 1}},
      {{'slot_id': 'SEGMENT_HOST', 'sort': 30, 'state': 'FILLED', 'value': host, 'n': 1}}, {{'slot_id': 'BOUNDARY_TYPE_SLOT', 'sort': 40, 'state': 'FILLED', 'value': boundary, 'n': 1}},
      {{'slot_id': 'PATH_DIRECTIVE_SLOT', 'sort': 40, 'state': CASE WHEN closed THEN 'BLOCKED' ELSE 'FILLED' END, 'value': directive, 'n': 1}},
      {{'slot_id': 'RADICAL_R1', 'sort': 80, 'state': CASE WHEN r1 IS NULL THEN 'UNKNOWN' ELSE 'FILLED' END, 'value': r1, 'n': 1}}, {{'slot_id': 'RADICAL_R2', 'sort': 80, 'state': 'FILLED', 'value': r2, 'n': 1}},
      {{'slot_id': 'PATTERN_CANDIDATE_SET', 'sort': 90, 'state': CASE len(patterns) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'FILLED' ELSE 'AMBIGUOUS' END, 'value': CASE WHEN len(patterns) = 1 THEN patterns[1] END, 'n': len(patterns)}}], recursive := true) FROM w)
    WHERE state <> 'UNKNOWN')"""
ORACLES = {
    "claim_slots": f"WITH {_SLOTS} SELECT token_id, slot_id, sort::INT AS sort, state, value, n::INT AS n_candidates FROM s",
    "claim_bundles": f"""WITH {_SLOTS}, v AS (SELECT token_id, string_agg('"' || slot_id || '": "' || value || '"', ', ' ORDER BY slot_id) FILTER (value IS NOT NULL) AS vs FROM s GROUP BY 1),
        c AS (SELECT token_id, coalesce((SELECT string_agg('"' || x || '"', ', ' ORDER BY x) FROM (SELECT unnest(list_filter([CASE WHEN has_root THEN 'Root:Catalog:' || p_brand END, CASE WHEN has_pattern THEN 'WAZN:' || p_type END, CASE WHEN has_negative THEN 'negative:x' END], lambda y: y IS NOT NULL)) AS x)), '') AS es FROM w)
        SELECT token_id, sha256('{{"claim_kind": "PATTERN", "evidence_codes": [' || es || '], "profile_id": "PATTERN_CLAIM", "slot_values": {{' || vs || '}}}}') AS claim_key,
          CASE WHEN closed THEN 'CLOSED_BOUNDARY:' || boundary ELSE '' END AS obstacles, CASE WHEN len(patterns) > 1 THEN 'PATTERN_CANDIDATE_SET:' || len(patterns) ELSE '' END AS residuals,
          concat_ws(',', CASE WHEN len(patterns) <> 1 THEN 'UNFILLED:PATTERN_CANDIDATE_SET' END, CASE WHEN NOT has_pattern THEN 'NO_EVIDENCE' END) AS problems FROM w JOIN v USING (token_id) JOIN c USING (token_id)""",
    "claim_evidence": f"""WITH {_W} SELECT token_id, concat_ws(',', CASE WHEN has_root THEN 'root_catalog_evidence' END, CASE WHEN has_pattern THEN 'wazn_pattern_evidence' END, CASE WHEN has_negative THEN 'negative_contradiction_evidence' END, CASE WHEN directive = 'ACCEPT' THEN 'source_path_evidence' END) AS types,
          has_negative::INT AS n_negative, concat_ws(',', CASE WHEN NOT has_root THEN 'root_catalog_evidence' END, CASE WHEN pattern IS NOT NULL AND NOT has_pattern THEN 'wazn_pattern_evidence' END) AS missing,
          CASE WHEN NOT (has_root OR has_pattern OR has_negative OR directive = 'ACCEPT') THEN 'MISSING' WHEN NOT has_root OR (pattern IS NOT NULL AND NOT has_pattern) THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS verdict FROM w""",
    "admitted_claims": f"""WITH {_W}, x AS (SELECT *, token_id % 10 = 0 AS bare, CASE WHEN token_id % 10 = 0 AND pattern IS NOT NULL AND directive = 'ACCEPT' THEN 'BLOCK' WHEN host <> normalized AND p_size % 2 <> 0 THEN 'DEFER' ELSE 'ACCEPT' END AS identity FROM w),
        y AS (SELECT *, CASE WHEN NOT (has_root OR has_pattern OR has_negative OR directive = 'ACCEPT') THEN 'MISSING' WHEN (NOT bare AND NOT has_root) OR (pattern IS NOT NULL AND NOT has_pattern) THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS evidence,
              CASE WHEN directive = 'BLOCK' THEN 'directive' WHEN directive = 'OTHER' OR p_size = 13 THEN 'bundle' WHEN original = 'cold widget' THEN 'provider' WHEN identity = 'BLOCK' THEN 'identity' WHEN p_size = 40 THEN 'residuals' END AS stopped_at FROM x)
        SELECT token_id, CASE WHEN stopped_at IN ('bundle', 'provider') THEN 'REJECTED' WHEN stopped_at IS NOT NULL THEN 'BLOCKED' WHEN identity = 'ACCEPT' AND evidence = 'SUFFICIENT' THEN 'READY' ELSE 'DEFERRED' END AS verdict, stopped_at, identity, evidence FROM y""",
}
