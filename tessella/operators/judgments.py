"""Verdicts over a graph of stages, agreed and disputed facts, and classes by evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.lineage import checkpoint, stored

#: Verdicts in order of severity: a later one prevails.
SEVERITY = ["ACCEPT", "DEFER", "BLOCK"]


def severity(verdict: Column) -> Column:
    """0, 1 or 2; any other verdict, null too, blocks."""
    return F.when(verdict == "ACCEPT", 0).when(verdict == "DEFER", 1).otherwise(2)


def verdict_of(level: Column) -> Column:
    return F.element_at(F.lit(SEVERITY), level + 1)


def _carried(policy: dict[tuple[str, str], tuple[str, str]]) -> Column:
    """What an edge of ``domain`` and ``scope`` makes of the ``severity`` of its source."""
    carried = F.lit(2)
    for (domain, scope), (defer, block) in policy.items():
        at = (F.col("domain") == domain) & (F.col("scope") == scope)
        carried = F.when(at, F.when(F.col("severity") == 2, SEVERITY.index(block)).when(F.col("severity") == 1, SEVERITY.index(defer)).otherwise(0)).otherwise(carried)
    return carried


def propagate(nodes: DataFrame, edges: DataFrame, policy: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """``node, level, own, verdict, decided_by``: verdicts carried along a DAG, the worst of each node's prevailing.

    ``nodes`` hold (node, own), ``edges`` (source, target, domain, scope). ``policy`` says what a
    DEFER and a BLOCK of the source become on an edge of a domain and scope; an edge that it
    does not name is closed: it blocks whatever comes. ``decided_by`` is null where the node's
    own verdict is as bad as any that reaches it, else the least source of the worst edge.

    Nodes are judged in topological order, a level a round: a node opens when all edges into
    it are judged, so each edge is followed once, by the round that judged its source. What
    is carried on are counts and verdicts of nodes that still wait. Nodes on a cycle, or
    behind one, never open: their verdict and level are null. Edges of unknown ends are left
    out; repeated edges count once; an empty table of edges leaves each node its own.
    """
    known = nodes.select("node", severity(F.col("own")).alias("own")).groupBy("node").agg(F.max("own").alias("own"))
    edges = edges.select("source", "target", "domain", "scope").distinct()
    edges = edges.join(known.select(F.col("node").alias("source")), "source", "left_semi").join(known.select(F.col("node").alias("target")), "target", "left_semi")
    carried = _carried(policy)
    edges = checkpoint(edges)
    waits = edges.groupBy("target").agg(F.count("*").alias("waits")).withColumnRenamed("target", "node")
    state = checkpoint(known.join(waits, "node", "left").select("node", "own", F.coalesce("waits", F.lit(0).cast("long")).alias("waits"), F.lit(0).alias("worst"), F.lit(None).cast(dict(edges.dtypes)["source"]).alias("by")))
    done, level = [], 0
    while True:
        ready = state.where("waits = 0").select("node", F.lit(level).alias("level"), "own", F.greatest("own", "worst").alias("severity"), F.when(F.col("worst") > F.col("own"), F.col("by")).alias("by"))
        done.append(ready)
        waiting = state.where("waits > 0")
        met = edges.join(ready.select(F.col("node").alias("source"), "severity"), "source").select("target", "source", carried.alias("s"))
        # the worst edge, and of those as bad the least source
        news = met.groupBy("target").agg(F.count("*").alias("n"), F.max("s").alias("s"), *(F.min(F.when(F.col("s") == k, F.col("source"))).alias(f"by{k}") for k in (1, 2)))
        news = news.select(F.col("target").alias("node"), "n", "s", F.when(F.col("s") == 2, F.col("by2")).when(F.col("s") == 1, F.col("by1")).alias("new"))
        step = waiting.join(news, "node", "left")
        gain, s = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("s", F.lit(0))
        by = F.when(s > F.col("worst"), F.col("new")).when(s == F.col("worst"), F.least("by", "new")).otherwise(F.col("by"))
        state = checkpoint(step.select("node", "own", (F.col("waits") - gain).alias("waits"), F.greatest("worst", s).alias("worst"), by.alias("by")))
        level += 1
        if state.where("waits = 0").isEmpty():
            break
    done.append(state.select("node", F.lit(None).cast("int").alias("level"), "own", F.lit(None).cast("int").alias("severity"), F.lit(None).cast(dict(edges.dtypes)["source"]).alias("by")))
    out = reduce(DataFrame.unionByName, done)
    return out.select("node", "level", verdict_of(F.col("own")).alias("own"), verdict_of(F.col("severity")).alias("verdict"), F.col("by").alias("decided_by"))


def propagate_stages(stages: list[tuple[DataFrame, DataFrame | None]], policy: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """The rows of ``propagate``, for a graph whose nodes come in stages: each edge leads to a later stage.

    A stage holds its nodes and the edges into them (None: no edges). A node is of one stage;
    edges whose source is in no earlier stage, or whose target is not in their own, are of
    unknown ends and left out. As all that reaches a stage is judged before it, no node
    waits and no round goes over the edges of others: each edge meets its source's verdict
    once and is combined by target once, together with the nodes' own verdicts.
    """
    carried, judged = _carried(policy), []
    for k, (nodes, edges) in enumerate(stages):
        of_node = dict(nodes.dtypes)["node"]
        rows = nodes.select("node", severity(F.col("own")).alias("own"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("level"), F.lit(None).cast(of_node).alias("source"))
        if judged and edges is not None:
            before = reduce(DataFrame.unionByName, judged).select(F.col("node").alias("source"), "severity", "level")
            sent = edges.where("target IS NOT NULL").join(before, "source")
            rows = rows.unionByName(sent.select(F.col("target").alias("node"), F.lit(None).cast("int").alias("own"), carried.alias("s"), (F.col("level") + 1).alias("level"), "source"))
        # the worst edge, and of those as bad the least source
        least = (F.min(F.when(F.col("s") == w, F.col("source"))).alias(f"by{w}") for w in (1, 2))
        met = rows.groupBy("node").agg(F.max("own").alias("own"), F.coalesce(F.max("s"), F.lit(0)).alias("worst"), F.coalesce(F.max("level"), F.lit(0)).alias("level"), *least).where("own IS NOT NULL")
        by = F.when(F.col("worst") > F.col("own"), F.when(F.col("worst") == 2, F.col("by2")).otherwise(F.col("by1")))
        found = met.select("node", "level", "own", F.greatest("own", "worst").alias("severity"), by.alias("by"))
        judged.append(stored(found, "judged") if k < len(stages) - 1 else found)
    out = reduce(DataFrame.unionByName, judged)
    return out.select("node", "level", verdict_of(F.col("own")).alias("own"), verdict_of(F.col("severity")).alias("verdict"), F.col("by").alias("decided_by"))


def scope_state(claims: DataFrame, key: str, source: str, fact: str) -> DataFrame:
    """``key, source, fact``: who said what, each once; states of any number of tables merge by ``merge_scopes``."""
    return claims.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(fact).alias("fact")).distinct()


def merge_scopes(*states: DataFrame) -> DataFrame:
    """The join of the lattice: a union of sets, in any order and any number of times."""
    return reduce(DataFrame.unionByName, states).distinct()


def disputed_facts(state: DataFrame) -> DataFrame:
    """``key, fact, n_sources, n_asserting, status``: AGREED if all sources of the key say so, else DISPUTED.

    A source with a null fact is one that spoke of the key and asserted nothing; null
    sources do not count. Facts of a key are counted before they meet, and combine before
    the shuffle, so a hot key sends each of its facts once a task.
    """
    spoken = state.where("source IS NOT NULL")
    sources = spoken.groupBy("key").agg(F.count_distinct("source").alias("n_sources"))
    facts = spoken.where("fact IS NOT NULL").groupBy("key", "fact").agg(F.count_distinct("source").alias("n_asserting"))
    both = facts.join(sources, facts["key"].eqNullSafe(sources["key"])).drop(sources["key"])
    return both.select("key", "fact", "n_sources", "n_asserting", F.when(F.col("n_asserting") == F.col("n_sources"), "AGREED").otherwise("DISPUTED").alias("status"))


def dispute_scope(state: DataFrame) -> DataFrame:
    """``key, n_sources, n_agreed, n_disputed, least_agreed, least_disputed, formed`` of each key.

    A scope is formed if anything is agreed. A key whose sources assert nothing has no fact
    and is not formed.
    """
    facts = disputed_facts(state).groupBy("key").agg(
        F.count_if(F.col("status") == "AGREED").alias("n_agreed"), F.count_if(F.col("status") == "DISPUTED").alias("n_disputed"),
        F.min(F.when(F.col("status") == "AGREED", F.col("fact"))).alias("least_agreed"), F.min(F.when(F.col("status") == "DISPUTED", F.col("fact"))).alias("least_disputed"),
    )
    sources = state.where("source IS NOT NULL").groupBy(F.col("key").alias("__key")).agg(F.count_distinct("source").alias("n_sources"))
    both = sources.join(facts, F.col("__key").eqNullSafe(F.col("key")), "left")
    zero = F.lit(0).cast("long")
    return both.select(F.col("__key").alias("key"), "n_sources", F.coalesce("n_agreed", zero).alias("n_agreed"), F.coalesce("n_disputed", zero).alias("n_disputed"), "least_agreed", "least_disputed", (F.coalesce("n_agreed", zero) > 0).alias("formed"))


def classify(items: DataFrame, item: str, evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """``<item>, class, rule, verdict, trace, conflicts, n_fired``: classes by ordered rules, with all that spoke.

    ``evidence`` holds (item, kind, value); ``rules`` (rule, priority, kind, value, unless_kind,
    unless_value, class, effect). A rule fires on evidence of its kind and value (null: any)
    unless the item has the evidence that it excepts. The fired rule of the least priority
    decides (of equal ones the least name). Its ``effect`` is the verdict: ACCEPTED, DEFERRED,
    or BLOCKED, which names no class. ``trace`` lists every fired rule with the least value
    that fired it, in order of priority; ``conflicts`` the fired rules of another class. An
    item on which nothing fires is DEFERRED without class.

    Rules are a closed list: a trace has at most one entry for each, whatever the number
    of evidence rows, and evidence combines by rule before items are shuffled.
    """
    spoken = evidence.select(F.col(item).alias("__item"), "kind", "value").distinct()
    by_kind = spoken.join(rules, "kind").where(rules["value"].isNull() | (spoken["value"] == rules["value"]))
    fired = by_kind.groupBy("__item", "rule", "priority", "class", "effect", "unless_kind", "unless_value").agg(F.min(spoken["value"]).alias("by"))
    held = spoken.select(F.col("__item").alias("__has"), F.col("kind").alias("unless_kind"), F.col("value").alias("__value"))
    excepted = fired.where("unless_kind IS NOT NULL").join(held, "unless_kind").where("__item = __has AND (unless_value IS NULL OR unless_value = __value)").select("__item", "rule").distinct()
    left = fired.join(excepted, ["__item", "rule"], "left_anti")
    heard = left.groupBy("__item").agg(F.array_sort(F.collect_list(F.struct("priority", "rule", "class", "effect", "by"))).alias("f"))
    first = F.col("f")[0]
    shown = lambda x: F.concat_ws(":", x["rule"], F.coalesce(x["class"], F.lit("-")), x["by"])
    other = F.filter("f", lambda x: x["class"].isNotNull() & (x["class"] != first["class"]))
    return items.select(item).join(heard, F.col(item) == F.col("__item"), "left").select(
        item, F.when(first["effect"] != "BLOCKED", first["class"]).alias("class"), first["rule"].alias("rule"), F.coalesce(first["effect"], F.lit("DEFERRED")).alias("verdict"),
        F.coalesce(F.array_join(F.transform("f", shown), " > "), F.lit("")).alias("trace"), F.coalesce(F.array_join(F.transform(other, lambda x: x["rule"]), ","), F.lit("")).alias("conflicts"), F.coalesce(F.size("f"), F.lit(0)).alias("n_fired"),
    )
