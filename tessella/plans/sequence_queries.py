"""Ordered-row operators on conversation words and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ledger, sequence
from tessella.plans.inputs import CONJUNCTIONS, MARKERS, MOODS, PREPOSITIONS, TOKENS, rows, table, tokens, values

_PREP = ", ".join(f"'{p}'" for p in PREPOSITIONS)
_CONJ = ", ".join(f"'{c}'" for c in CONJUNCTIONS)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = rows(spark, "marker string, boundary string, priority int", MARKERS)
    return sequence.boundaries(tokens(spark, sf_dir), markers, bare=F.regexp_replace("surface", "[^\\p{L}]", ""))


def boundary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("boundary is not null")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.group_clauses(_marked(spark, sf_dir), "seq", "pos", predicate=F.col("surface").endswith("ing"))


def carried_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    governs = rows(spark, "marker string, mood string", MOODS)
    out = sequence.carry_mood(tokens(spark, sf_dir), governs, "seq", "pos", negators=["not", "no"], after=["or", "of"])
    return out.where("carried_mood is not null")


def subject_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    kind = F.col("event_type")
    out = sequence.agreement(events, "user_id", "event_id", kind == "click", kind.isin("view", "error"), F.col("value") > 20, F.col("value") < 3)
    return out.select("event_id", "agrees")


def _relations(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
    ranked = tokens(spark, sf_dir).withColumn("rank", F.least(F.length("surface"), F.lit(5)) - 1)
    return sequence.adjacent_relations(ranked, "seq", "pos", "rank", lambda s, t: sequence.relation_type(s, t, PREPOSITIONS, CONJUNCTIONS), closed)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir, False)


def closed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir, True)


def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.propositions(closed_relations(spark, sf_dir), "seq")
    return ledger.rulings(found, F.when(F.col("rank") >= 4, "CERTAIN").otherwise("LIKELY"))


def government(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.government(tokens(spark, sf_dir), "seq", "pos", PREPOSITIONS)


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.scopes(tokens(spark, sf_dir), "seq", "pos", F.col("surface").isin(PREPOSITIONS))


def scope_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    held = sequence.in_scope(t, sequence.scopes(t, "seq", "pos", F.col("surface").isin(PREPOSITIONS)), "seq", "pos")
    return held.groupBy("seq", "scope_start").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))


def span_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    held = sequence.in_scope(t, sequence.scopes(t, "seq", "pos", F.col("surface").isin(PREPOSITIONS)), "seq", "pos")
    return sequence.span_ends(held.where(F.length("surface") > 3), ["seq", "scope_start"], "pos")


def sentence_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause numbers of each sequence, simple or compound by their count."""
    numbered = sequence.number_groups(_marked(spark, sf_dir), "seq", "pos", F.col("boundary").isNotNull(), "clause")
    ids = F.array_sort(F.collect_set("clause"))
    return numbered.groupBy("seq").agg(F.array_join(ids.cast("array<string>"), ",").alias("clauses"), F.when(F.size(ids) >= 2, "COMPOUND").otherwise("SIMPLE").alias("kind"))


def opened_after_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sequence.nothing_after_stop(events, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


def guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").alias("v"))
    return ledger.guarded_writes(log, "user_id", "event_id", "v", "event_type", ["error"], F.col("v"))


QUERIES = [boundary_tokens, clauses, carried_mood, subject_agreement, relations, closed_relations, propositions, government, scopes, scope_members, span_ends, sentence_geometry, opened_after_stop, guarded_writes]

_MARKED = f"""{TOKENS}, {values('m', 'marker, boundary, priority', MARKERS)},
  marked AS (SELECT t.*, CASE WHEN coalesce(b.priority, 99) < coalesce(a.priority, 99) THEN b.boundary ELSE a.boundary END AS boundary FROM tokens t
             LEFT JOIN m a ON a.marker = surface LEFT JOIN m b ON b.marker = regexp_replace(surface, '[^\\p{{L}}]', '', 'g'))"""
_NUMBERED = f"""{_MARKED}, flagged AS (SELECT *, boundary IS NOT NULL AND pos > 0 AS o FROM marked),
  numbered AS (SELECT *, sum(o::INT) OVER (PARTITION BY seq ORDER BY pos) AS clause FROM flagged)"""
_RELATIONS = f"""{TOKENS}, ranked AS (SELECT *, least(length(surface), 5) - 1 AS rank FROM tokens),
  pairs AS (SELECT seq, pos AS source_pos, surface AS source, rank AS a, lead(surface) OVER w AS target, lead(pos) OVER w AS target_pos, lead(rank) OVER w AS b FROM ranked WINDOW w AS (PARTITION BY seq ORDER BY pos)),
  rel AS (SELECT seq, source_pos::INT AS source_pos, target_pos::INT AS target_pos, source, target, CASE WHEN source IN ({_PREP}) THEN 'PREPOSITIONAL' WHEN target IN ({_CONJ}) OR source IN ({_CONJ}) THEN 'COORDINATION' ELSE 'SYNTACTIC_DEPENDENCY' END AS relation,
          greatest(least(a, b), 1)::INT AS confidence, a, b FROM pairs WHERE target_pos IS NOT NULL)"""
_SCOPES = f"""{TOKENS}, sc AS (SELECT seq, pos AS scope_start, coalesce(lead(pos) OVER (PARTITION BY seq ORDER BY pos) - 1, last) AS scope_end FROM
  (SELECT *, max(pos) OVER (PARTITION BY seq) AS last FROM tokens) WHERE surface IN ({_PREP}))"""
ORACLES = {
    "boundary_tokens": f"WITH {_MARKED} SELECT seq, pos::INT AS pos, surface, boundary FROM marked WHERE boundary IS NOT NULL",
    "clauses": f"""WITH {_NUMBERED}, c AS (SELECT seq, clause, min(pos) + 1 AS token_start, max(pos) + 1 AS token_end, string_agg(surface, ' ' ORDER BY pos) AS surface,
          CASE WHEN arg_min(coalesce(boundary, ''), pos) <> '' THEN arg_min(surface, pos) END AS opened_by, arg_min(surface, pos) AS f, coalesce(string_agg(surface, ' ' ORDER BY pos) FILTER (surface LIKE '%ing'), '') AS predicates FROM numbered GROUP BY ALL)
        SELECT seq, clause::BIGINT AS clause, token_start::INT AS token_start, token_end::INT AS token_end, surface, opened_by, lead(f) OVER (PARTITION BY seq ORDER BY clause) AS operator, predicates FROM c""",
    "carried_mood": f"""WITH {TOKENS}, {values('g', 'marker, mood', MOODS)}, a AS (SELECT t.*, mood, lag(surface) OVER (PARTITION BY seq ORDER BY pos) AS prev FROM tokens t LEFT JOIN g ON marker = surface),
        b AS (SELECT *, CASE WHEN surface IN ('not', 'no') AND coalesce(prev IN ('or', 'of'), false) THEN NULL ELSE mood END AS own FROM a)
        SELECT * FROM (SELECT seq, pos::INT AS pos, surface, lag(own) OVER (PARTITION BY seq ORDER BY pos) AS carried_mood FROM b) WHERE carried_mood IS NOT NULL""",
    "subject_agreement": """WITH e AS (SELECT *, event_type = 'click' AS ev, event_type IN ('view', 'error') AS v, value < 3 AS f, event_type IN ('view', 'error') AND NOT value > 20 AS stop FROM events),
        l AS (SELECT *, coalesce(lead(ev, 1) OVER w, false) AS e1, coalesce(lead(ev, 2) OVER w, false) AS e2, coalesce(lead(ev, 3) OVER w, false) AS e3, coalesce(lead(stop, 1) OVER w, false) AS s1, coalesce(lead(stop, 2) OVER w, false) AS s2,
              coalesce(lead(stop, 3) OVER w, false) AS s3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        a AS (SELECT *, (e1 AND NOT s1) OR (e2 AND NOT s1 AND NOT s2) OR (e3 AND NOT s1 AND NOT s2 AND NOT s3) AS ahead FROM l),
        g AS (SELECT *, CASE WHEN v AND f THEN false WHEN v AND ahead THEN true END AS flag FROM a)
        SELECT event_id, v AND NOT f AND (ahead OR coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS agrees FROM g""",
    "relations": f"WITH {_RELATIONS} SELECT seq, source_pos, target_pos, source, target, relation, confidence FROM rel",
    "closed_relations": f"WITH {_RELATIONS} SELECT seq, source_pos, target_pos, source, target, relation, confidence, CASE WHEN a > 0 AND b > 0 THEN 'CLOSED' ELSE 'OPEN' END AS status FROM rel",
    "propositions": f"""WITH {_RELATIONS}, p AS (SELECT seq, count(*) FILTER (a > 0 AND b > 0) AS n_closed, coalesce(max(confidence) FILTER (a > 0 AND b > 0), 0) AS m,
          coalesce(array_to_string(list_sort(list(DISTINCT relation) FILTER (a > 0 AND b > 0)), '+'), '') AS shape FROM rel GROUP BY seq)
        SELECT seq, n_closed, CASE WHEN n_closed > 0 THEN 'APPROVED' ELSE 'DEFERRED' END AS verdict, shape, least(m, 4)::INT AS rank, CASE WHEN n_closed > 0 THEN CASE WHEN m >= 4 THEN 'CERTAIN' ELSE 'LIKELY' END END AS ruling FROM p""",
    "government": f"""WITH {TOKENS} SELECT seq, governor_pos::INT AS governor_pos, governor, governed FROM (SELECT seq, pos AS governor_pos, surface AS governor, lead(surface) OVER (PARTITION BY seq ORDER BY pos) AS governed FROM tokens)
        WHERE governor IN ({_PREP}) AND governed NOT IN ({_PREP})""",
    "scopes": f"WITH {_SCOPES} SELECT seq, scope_start::INT AS scope_start, scope_end::INT AS scope_end FROM sc",
    "scope_members": f"WITH {_SCOPES} SELECT sc.seq, scope_start::INT AS scope_start, count(*) AS n, max(pos)::INT AS last_pos FROM tokens t JOIN sc ON sc.seq = t.seq AND pos > scope_start AND pos <= scope_end GROUP BY ALL",
    "span_ends": f"""WITH {_SCOPES} SELECT sc.seq, scope_start::INT AS scope_start, count(*) AS n, arg_min(surface, pos) AS first, arg_max(surface, pos) AS last FROM tokens t
        JOIN sc ON sc.seq = t.seq AND pos > scope_start AND pos <= scope_end WHERE length(surface) > 3 GROUP BY ALL HAVING count(*) >= 2""",
    "sentence_geometry": f"WITH {_NUMBERED} SELECT seq, string_agg(DISTINCT clause::INT, ',' ORDER BY clause::INT) AS clauses, CASE WHEN count(DISTINCT clause) >= 2 THEN 'COMPOUND' ELSE 'SIMPLE' END AS kind FROM numbered GROUP BY seq",
    "opened_after_stop": "SELECT user_id, event_id, event_type FROM events e WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_id < e.event_id AND x.event_type = 'error')",
    "guarded_writes": """WITH RECURSIVE l AS (SELECT user_id, event_id, event_type, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        f AS (SELECT user_id, event_id, event_type, v, i, 'WRITTEN' AS outcome, v AS held, event_type AS was FROM l WHERE i = 1
          UNION ALL SELECT user_id, event_id, event_type, v, i, outcome, CASE outcome WHEN 'WRITTEN' THEN v ELSE held END, CASE outcome WHEN 'WRITTEN' THEN event_type ELSE was END
          FROM (SELECT l.*, held, was, CASE WHEN l.v IS NOT DISTINCT FROM held THEN 'IDEMPOTENT' WHEN was = 'error' THEN 'TERMINAL' WHEN l.v < held THEN 'DOWNGRADE' ELSE 'WRITTEN' END AS outcome
                FROM f JOIN l ON l.user_id = f.user_id AND l.i = f.i + 1))
        SELECT user_id, event_id, event_type, v, outcome FROM f""",
}
