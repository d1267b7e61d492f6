"""Verdicts over the star schema, agreed and disputed facts, word classes with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import judgments
from tessella.plans.inputs import MARKERS, TOKENS, rows, table, tokens, values

#: What a DEFER and a BLOCK of the source become, by the domain and scope of an edge.
POLICY = {
    ("SALES", "ADVISORY"): ("ACCEPT", "DEFER"),
    ("ORDER", "STRICT"): ("DEFER", "BLOCK"),
    ("ORDER", "NORMAL"): ("ACCEPT", "BLOCK"),
    ("SUPPLY", "STRICT"): ("DEFER", "BLOCK"),
    ("SUPPLY", "ADVISORY"): ("ACCEPT", "DEFER"),
}
#: Rules of word classes: name, priority, kind and value of evidence, excepting evidence, class, effect.
RULES = [
    ("DIGITS", 0, "SHAPE", "DIGITS", None, None, None, "BLOCKED"),
    ("CLOSED_CONJUNCTION", 1, "MARKER", "CONJUNCTION", None, None, "PARTICLE", "ACCEPTED"),
    ("CLOSED_PREPOSITION", 1, "MARKER", "PREPOSITION", None, None, "PARTICLE", "ACCEPTED"),
    ("RELATIVE_NAME", 2, "MARKER", "RELATIVE", None, None, "NOUN", "ACCEPTED"),
    ("NOUN_TION", 3, "ENDING", "tion", None, None, "NOUN", "ACCEPTED"),
    ("NOUN_UNG", 3, "ENDING", "ung", "MARKER", None, "NOUN", "ACCEPTED"),
    ("VERB_ED", 4, "ENDING", "ed", "AFTER", "PREPOSITION", "VERB", "ACCEPTED"),
    ("VERB_ING", 4, "ENDING", "ing", "AFTER", None, "VERB", "ACCEPTED"),
    ("NAMED_AFTER_PREPOSITION", 5, "AFTER", "PREPOSITION", "MARKER", None, "NOUN", "DEFERRED"),
    ("VERB_EN", 6, "ENDING", "en", "SHAPE", "SHORT", "VERB", "DEFERRED"),
    ("AFTER_ANY", 7, "AFTER", None, None, None, "NOUN", "DEFERRED"),
]
_RULE = "rule string, priority int, kind string, value string, unless_kind string, unless_value string, class string, effect string"
ENDINGS = sorted({r[3] for r in RULES if r[2] == "ENDING"})


def judged_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, lines and suppliers as stages; each edge carries what its policy lets through."""
    customer, orders, line, supplier = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    name = lambda letter, *c: F.concat(F.lit(letter), F.concat_ws("-", *c))
    verdict = lambda block, defer: F.when(block, "BLOCK").when(defer, "DEFER").otherwise("ACCEPT").alias("own")
    never = F.lit(False)
    nodes = [
        customer.select(name("C", "c_custkey").alias("node"), verdict(F.col("c_acctbal") < -900, F.col("c_acctbal") < 0)),
        orders.select(name("O", "o_orderkey").alias("node"), verdict(F.col("o_totalprice") > 450000, F.col("o_orderstatus") == "P")),
        line.select(name("L", "l_orderkey", "l_linenumber").alias("node"), verdict((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08), F.col("l_returnflag") == "R")),
        supplier.select(name("S", "s_suppkey").alias("node"), verdict(never, F.col("s_acctbal") < 0)),
    ]
    o_scope = F.when(F.col("o_orderpriority").startswith("1-"), "STRICT").otherwise("NORMAL")
    s_scope = F.when((F.col("l_quantity") >= 50) & (F.col("l_tax") == 0), "UNKNOWN").when(F.col("l_quantity") >= 48, "STRICT").otherwise("ADVISORY")
    of_order = line.select("l_orderkey", "l_linenumber").join(orders.select("o_orderkey", o_scope.alias("scope")), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = [
        orders.select(name("C", "o_custkey").alias("source"), name("O", "o_orderkey").alias("target"), F.lit("SALES").alias("domain"), F.lit("ADVISORY").alias("scope")),
        of_order.select(name("O", "l_orderkey").alias("source"), name("L", "l_orderkey", "l_linenumber").alias("target"), F.lit("ORDER").alias("domain"), "scope"),
        line.select(name("L", "l_orderkey", "l_linenumber").alias("source"), name("S", "l_suppkey").alias("target"), F.lit("SUPPLY").alias("domain"), s_scope.alias("scope")),
    ]
    return judgments.propagate_stages(list(zip(nodes, [None, *edges], strict=True)), POLICY)


def _part_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    halves = [line.where(c).select("l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("fact")) for c in ("l_tax < 0.04", "l_tax >= 0.04")]
    return judgments.merge_scopes(*(judgments.scope_state(h, "l_partkey", "l_suppkey", "fact") for h in halves))


def disputed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources on a part, flags of its lines as facts."""
    return judgments.disputed_facts(_part_claims(spark, sf_dir))


def dispute_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sources on a user, keys of their properties as facts; a type may speak and assert nothing."""
    events = table(spark, sf_dir, "events").withColumn("fact", F.when(F.col("value") > 5, F.get_json_object("props", "$.k")))
    return judgments.dispute_scope(judgments.scope_state(events, "user_id", "event_type", "fact"))


def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all words of conversations by endings, markers, shapes and neighbours."""
    found = tokens(spark, sf_dir)
    words = found.select("surface").distinct()
    marks = rows(spark, "m string, type string", [m[:2] for m in MARKERS])
    marked = found.join(F.broadcast(marks), F.col("surface") == F.col("m"), "left").withColumn("after", F.lag("type").over(Window.partitionBy("seq").orderBy("pos")))
    said = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    spoken = marked.select("surface", F.explode(F.array(said("MARKER", F.col("type")), said("AFTER", F.col("after")))).alias("e")).where("e.value IS NOT NULL").select("surface", "e.*").distinct()
    shape = [F.when(F.col("surface").endswith(x), said("ENDING", F.lit(x))) for x in ENDINGS]
    shape += [F.when(F.col("surface").rlike("[0-9]"), said("SHAPE", F.lit("DIGITS"))), F.when(F.length("surface") <= 3, said("SHAPE", F.lit("SHORT")))]
    shapes = words.select("surface", F.inline(F.array_compact(F.array(*shape))))
    return judgments.classify(words, "surface", spoken.unionByName(shapes), rows(spark, _RULE, RULES))


QUERIES = [judged_transitions, disputed_facts, dispute_scope, word_classes]

_NODES = """n AS (SELECT 'C' || c_custkey AS node, CASE WHEN c_acctbal < -900 THEN 2 WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS own FROM customer
    UNION ALL SELECT 'O' || o_orderkey, CASE WHEN o_totalprice > 450000 THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END FROM orders
    UNION ALL SELECT 'L' || l_orderkey || '-' || l_linenumber, CASE WHEN l_discount >= 0.1 AND l_tax >= 0.08 THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM lineitem
    UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END FROM supplier),
  nodes AS (SELECT node, max(own)::INT AS own FROM n GROUP BY node),
  e AS (SELECT DISTINCT * FROM (SELECT 'C' || o_custkey AS source, 'O' || o_orderkey AS target, 'SALES' AS domain, 'ADVISORY' AS scope FROM orders
    UNION ALL SELECT 'O' || l_orderkey, 'L' || l_orderkey || '-' || l_linenumber, 'ORDER', CASE WHEN o_orderpriority LIKE '1-%' THEN 'STRICT' ELSE 'NORMAL' END FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT 'L' || l_orderkey || '-' || l_linenumber, 'S' || l_suppkey, 'SUPPLY', CASE WHEN l_quantity >= 50 AND l_tax = 0 THEN 'UNKNOWN' WHEN l_quantity >= 48 THEN 'STRICT' ELSE 'ADVISORY' END FROM lineitem)
    WHERE source IN (SELECT node FROM nodes) AND target IN (SELECT node FROM nodes))"""
_CARRIED = (
    "CASE " + " ".join(f"WHEN domain = '{d}' AND scope = '{s}' THEN CASE sev WHEN 2 THEN {judgments.SEVERITY.index(b)} WHEN 1 THEN {judgments.SEVERITY.index(a)} ELSE 0 END" for (d, s), (a, b) in POLICY.items()) + " ELSE 2 END"
)
ORACLES = {
    "judged_transitions": f"""WITH RECURSIVE {_NODES}, reach(node, sev, level) AS (SELECT node, own, 0 FROM nodes UNION SELECT target, {_CARRIED}, level + 1 FROM reach JOIN e ON source = node),
        v AS (SELECT node, max(sev) AS sev, max(level) AS level FROM reach GROUP BY node), sent AS (SELECT target, source, {_CARRIED} AS s FROM e JOIN v ON node = source)
        SELECT n.node, v.level::INT AS level, ['ACCEPT', 'DEFER', 'BLOCK'][n.own + 1] AS own, ['ACCEPT', 'DEFER', 'BLOCK'][v.sev + 1] AS verdict,
               CASE WHEN v.sev > n.own THEN (SELECT min(source) FROM sent WHERE target = n.node AND s = v.sev) END AS decided_by FROM nodes n JOIN v USING (node)""",
    "disputed_facts": """WITH c AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS source, l_returnflag || l_linestatus AS fact FROM lineitem), s AS (SELECT key, count(DISTINCT source) AS n_sources FROM c GROUP BY key)
        SELECT key, fact, n_sources, count(DISTINCT source) AS n_asserting, CASE WHEN count(DISTINCT source) = n_sources THEN 'AGREED' ELSE 'DISPUTED' END AS status FROM c JOIN s USING (key) GROUP BY key, fact, n_sources""",
    "dispute_scope": """WITH c AS (SELECT DISTINCT user_id AS key, event_type AS source, CASE WHEN value > 5 THEN props->>'$.k' END AS fact FROM events), s AS (SELECT key, count(DISTINCT source) AS n_sources FROM c GROUP BY key),
        f AS (SELECT key, fact, count(DISTINCT source) = any_value(n_sources) AS agreed FROM c JOIN s USING (key) WHERE fact IS NOT NULL GROUP BY key, fact)
        SELECT s.key, any_value(n_sources) AS n_sources, count(*) FILTER (agreed) AS n_agreed, count(*) FILTER (NOT agreed) AS n_disputed, min(fact) FILTER (agreed) AS least_agreed, min(fact) FILTER (NOT agreed) AS least_disputed,
               count(*) FILTER (agreed) > 0 AS formed FROM s LEFT JOIN f USING (key) GROUP BY s.key""",
    "word_classes": f"""WITH {TOKENS}, {values('m', 'm, type', [x[:2] for x in MARKERS])}, {values('r', 'rule, priority, kind, value, unless_kind, unless_value, class, effect', RULES)},
        {values('x', 'ending, d', [(e, '') for e in ENDINGS])},
        t AS (SELECT surface, type, lag(type) OVER (PARTITION BY seq ORDER BY pos) AS after FROM tokens LEFT JOIN m ON m = surface), w AS (SELECT DISTINCT surface FROM tokens),
        ev AS (SELECT surface, 'MARKER' AS kind, type AS value FROM t WHERE type IS NOT NULL UNION SELECT surface, 'AFTER', after FROM t WHERE after IS NOT NULL UNION SELECT surface, 'ENDING', ending FROM w, x WHERE ends_with(surface, ending)
          UNION SELECT surface, 'SHAPE', 'DIGITS' FROM w WHERE regexp_matches(surface, '[0-9]') UNION SELECT surface, 'SHAPE', 'SHORT' FROM w WHERE length(surface) <= 3),
        f AS (SELECT ev.surface, r.rule, r.priority, r.class, r.effect, min(ev.value) AS by FROM ev JOIN r ON r.kind = ev.kind AND (r.value IS NULL OR r.value = ev.value)
              WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.surface = ev.surface AND o.kind = r.unless_kind AND (r.unless_value IS NULL OR r.unless_value = o.value)) GROUP BY ALL),
        d AS (SELECT surface, rule, class, effect FROM f QUALIFY row_number() OVER (PARTITION BY surface ORDER BY priority, rule) = 1)
        SELECT w.surface, CASE WHEN d.effect <> 'BLOCKED' THEN d.class END AS class, d.rule, coalesce(d.effect, 'DEFERRED') AS verdict,
               coalesce((SELECT string_agg(f.rule || ':' || coalesce(f.class, '-') || ':' || f.by, ' > ' ORDER BY f.priority, f.rule) FROM f WHERE f.surface = w.surface), '') AS trace,
               coalesce((SELECT string_agg(f.rule, ',' ORDER BY f.priority, f.rule) FROM f WHERE f.surface = w.surface AND f.class <> d.class), '') AS conflicts, (SELECT count(*) FROM f WHERE f.surface = w.surface)::INT AS n_fired
        FROM w LEFT JOIN d ON d.surface = w.surface""",
}
