"""Ledger, verdict and key operators on orders, lines, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import verdict
from tessella.operators import ledger
from tessella.plans.inputs import rows, table, values

_STATES = ["BLOCKED", "DEFER", "RESIDUAL", "ACCEPT", "licensed ", "COMPLETE", "NOT_APPLICABLE", "", None]
_GATES = ["BLOCKED", "REJECTED", "FORBIDDEN_LEAP", "LICENSED", "RESIDUAL", "DEFERRED", "", None]
_PAIRS = [(i * len(_GATES) + j, u, g) for i, u in enumerate(_STATES) for j, g in enumerate(_GATES)]


def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as stage records: line n is stage 2n + 1."""
    status = F.when(F.col("l_returnflag") == "R", "EXECUTED_STOPPED").when(F.col("l_returnflag") == "A", "EXECUTED_DEFERRED").otherwise("EXECUTED_APPROVED")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 2 + 1).alias("ordinal"), status.alias("status"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.densify(_executed(spark, sf_dir), "l_orderkey")


def ledger_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(_dense(spark, sf_dir), "l_orderkey", "EXECUTED_APPROVED", ["EXECUTED_STOPPED"])


def ledger_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an undensified ledger that lack stages."""
    return ledger.missing_stages(_executed(spark, sf_dir), "l_orderkey")


def ledger_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row: a dense ledger claims no execution that did not happen."""
    return ledger.impossible(_dense(spark, sf_dir))


def ledger_broken_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.broken_order(_executed(spark, sf_dir), "l_orderkey", "EXECUTED_APPROVED")


def ledger_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.layers(table(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


def certificate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.certificate_chain(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", "N")


def composed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rows(spark, "id int, upstream string, gate string", _PAIRS)
    return pairs.select("id", verdict.compose(F.col("upstream"), F.col("gate")).alias("verdict"))


def worst_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's worst order: the lattice as an aggregate."""
    v = F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "O", "ACCEPT").otherwise("OTHER")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(verdict.worst(v).alias("verdict"))


def worst_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's verdicts as an array."""
    v = F.array_compact(F.array(F.when(F.col("value") > 50, "BLOCK"), F.when(F.col("value") > 20, "DEFER"), F.when(F.col("value") > 5, "ACCEPT")))
    return table(spark, sf_dir, "events").select("event_id", verdict.worst_of(v).alias("verdict"))


def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", verdict.claim_key(F.col("text"), F.col("source"), F.col("lang"), F.lit("v1")).alias("claim_key"), verdict.evaluation_id(F.col("text"), F.lit("run-1")).alias("evaluation_id"))


def residual_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of order lines: active by flag, resolved by status."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("active"), F.collect_set(F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), F.col("l_returnflag"))).alias("resolved")
    )
    active = F.filter("active", lambda x: x != "N")
    return lines.select("l_orderkey", verdict.residual_verdict(active, F.col("resolved"), ["R"]).alias("verdict"))


def answer_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09), F.col("l_linenumber"))).alias("leaps"),
        F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("open"),
    )
    return lines.select("l_orderkey", ledger.answer_audit(F.col("leaps"), F.col("open")).alias("verdict"))


QUERIES = [ledger_dense, ledger_summary, ledger_missing, ledger_impossible, ledger_broken_order, ledger_layers, certificate_chain, composed_verdicts, worst_verdicts, worst_of_lists, claim_keys, residual_verdicts, answer_audits]

_E = """e AS (SELECT l_orderkey, (l_linenumber * 2 + 1)::INT AS ordinal, CASE l_returnflag WHEN 'R' THEN 'EXECUTED_STOPPED' WHEN 'A' THEN 'EXECUTED_DEFERRED' ELSE 'EXECUTED_APPROVED' END AS status FROM lineitem)"""
_DENSE = f"""{_E}, {values('st', 'ordinal, stage_id, scope', ledger.STAGES)}, d AS (SELECT o.l_orderkey, st.ordinal::INT AS ordinal, stage_id,
  CASE WHEN scope <> 'TOKEN' THEN 'NOT_APPLICABLE_AT_TOKEN_SCOPE' ELSE coalesce(e.status, 'NOT_OPENED') END AS status, scope = 'TOKEN' AND e.status IS NOT NULL AS executed
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN st LEFT JOIN (SELECT l_orderkey, ordinal, max(status) AS status FROM e GROUP BY ALL) e ON e.l_orderkey = o.l_orderkey AND e.ordinal = st.ordinal)"""
ORACLES = {
    "ledger_dense": f"WITH {_DENSE} SELECT * FROM d",
    "ledger_summary": f"""WITH {_DENSE} SELECT l_orderkey, count(*) FILTER (executed) AS n_executed, count(*) FILTER (status = 'NOT_OPENED') AS n_not_opened,
        arg_max(stage_id, ordinal) FILTER (status = 'EXECUTED_APPROVED') AS last_approved, arg_max(stage_id, ordinal) FILTER (status = 'EXECUTED_STOPPED') AS last_stop FROM d GROUP BY l_orderkey""",
    "ledger_missing": f"WITH {_E} SELECT l_orderkey, 19 - count(DISTINCT ordinal) AS n_missing FROM e GROUP BY l_orderkey HAVING count(DISTINCT ordinal) < 19",
    "ledger_impossible": f"WITH {_DENSE} SELECT * FROM d WHERE status LIKE 'EXECUTED_%' AND NOT executed",
    "ledger_broken_order": f"""WITH {_E} SELECT l_orderkey, ordinal, status, before FROM (SELECT *, lag(status) OVER (PARTITION BY l_orderkey ORDER BY ordinal, status) AS before FROM e)
        WHERE status = 'EXECUTED_APPROVED' AND before <> 'EXECUTED_APPROVED'""",
    "ledger_layers": """SELECT o_orderkey, 'o_custkey' AS layer, o_custkey::VARCHAR AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders""",
    "certificate_chain": """WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS v FROM lineitem GROUP BY 1),
        j AS (SELECT DISTINCT l_orderkey FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS b FROM lineitem) WHERE b <> 'N' AND l_returnflag = 'N')
        SELECT l_orderkey, len(v)::INT AS links, list_reduce(list_prepend('', v), lambda a, b: sha256(a || '|' || b)) AS head,
          CASE WHEN l_orderkey IN (SELECT l_orderkey FROM j) THEN 'NO_JUMP_VIOLATION' WHEN len(list_filter(v, lambda x: x <> 'N')) = 0 THEN 'ALL_CERTIFIED' WHEN list_contains(v, 'N') THEN 'HONEST_DEFER' ELSE 'CLOSED' END AS verdict FROM l""",
    "composed_verdicts": f"""WITH {values('p', 'id, upstream, gate', _PAIRS)}, u AS (SELECT id, upper(trim(coalesce(nullif(upstream, ''), 'DEFERRED'))) AS u, upper(trim(coalesce(nullif(gate, ''), 'DEFERRED'))) AS g FROM p)
        SELECT id, CASE WHEN u IN ('BLOCK', 'BLOCKED') THEN 'BLOCKED' WHEN g IN ('BLOCKED', 'BLOCK', 'REJECTED', 'FORBIDDEN_LEAP') THEN 'BLOCKED' WHEN u IN ('DEFER', 'DEFERRED') THEN 'DEFERRED' WHEN u = 'RESIDUAL' THEN 'RESIDUAL'
          WHEN u IN ('ACCEPTED', 'LICENSED', 'ACCEPT', 'COMPLETE') AND g IN ('LICENSED', 'RESIDUAL') THEN g ELSE 'DEFERRED' END AS verdict FROM u""",
    "worst_verdicts": "SELECT o_custkey, ['ACCEPT', 'DEFER', 'BLOCK'][max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 2 END)] AS verdict FROM orders GROUP BY 1",
    "worst_of_lists": "SELECT event_id, CASE WHEN value > 50 THEN 'BLOCK' WHEN value > 20 THEN 'DEFER' ELSE 'ACCEPT' END AS verdict FROM events",
    "claim_keys": """SELECT doc_id, 'CK-' || sha256(text || chr(0) || source || chr(0) || lang || chr(0) || 'v1')[:16] AS claim_key, 'EV-' || sha256(text || chr(0) || 'run-1')[:16] AS evaluation_id FROM documents""",
    "residual_verdicts": """WITH l AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45) AS hr,
          bool_or(l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 45) AS ha FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CASE WHEN hr OR ha THEN 'HIDDEN_FORBIDDEN' WHEN r THEN 'BLOCKING' WHEN a THEN 'DEFERRABLE' ELSE 'CLEAR' END AS verdict FROM l""",
    "answer_audits": """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_discount > 0.09) THEN 'BLOCKED' WHEN bool_or(l_returnflag = 'A') THEN 'DEFERRED' ELSE 'APPROVED' END AS verdict FROM lineitem GROUP BY 1""",
}
