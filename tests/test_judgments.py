"""Verdicts over graphs, facts in dispute, classes by evidence, digests of runs, streams and page files."""

from __future__ import annotations

import random
import time
from collections import defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from tessella.operators import judgments, sequence
from tessella.plans import judgment_queries
from tessella.sources import digests, page_files
from tessella.streaming import context

POLICY = {("d", "strict"): ("DEFER", "BLOCK"), ("d", "soft"): ("ACCEPT", "DEFER")}
PASS = {"strict": (0, 1, 2), "soft": (0, 0, 1), "odd": (2, 2, 2)}


def test_verdicts_of_random_graphs(spark):
    rng = random.Random(11)
    nodes = [(k, rng.choice(["ACCEPT"] * 6 + ["DEFER", "BLOCK", None])) for k in range(60)]
    edges = [(a, b, "d", rng.choice(["strict", "soft", "soft", "odd"] if rng.random() < 0.2 else ["strict", "soft"])) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.05]
    edges += edges[:5] + [(70, 3, "d", "strict"), (3, 70, "d", "strict")]
    rank = {"ACCEPT": 0, "DEFER": 1, "BLOCK": 2, None: 2}
    final, level = {}, {}
    for k, own in nodes:  # numbers ascend along edges
        into = [(PASS[scope][final[a]], a) for a, b, _, scope in set(edges) if b == k and a < 60]
        worst = max((s for s, _ in into), default=0)
        final[k], level[k] = max(rank[own], worst), 1 + max((level[a] for _, a in into), default=-1)
    found = judgments.propagate(spark.createDataFrame(nodes, "node int, own string"), spark.createDataFrame(edges, "source int, target int, domain string, scope string"), POLICY).collect()
    assert {r["node"]: (rank[r["verdict"]], r["level"]) for r in found} == {k: (final[k], level[k]) for k, _ in nodes}
    for r in found:
        into = [(PASS[scope][final[a]], a) for a, b, _, scope in edges if b == r["node"] and a < 60]
        want = min((a for s, a in into if s == final[r["node"]]), default=None) if final[r["node"]] > rank[dict(nodes)[r["node"]]] else None
        assert r["decided_by"] == want


def test_stages_are_judged_without_rounds(spark, monkeypatch):
    rng = random.Random(12)
    own = lambda: rng.choice(["ACCEPT"] * 6 + ["DEFER", "BLOCK", None])
    nodes = [[(f"{k}-{i}", own()) for i in range(30)] for k in range(4)]
    nodes[1] += [("1-3", "DEFER"), (None, "ACCEPT")]  # a repeated node, and one without a name
    scope = lambda: rng.choice(["strict", "soft", "odd", None])
    edges = [[(f"{rng.randrange(k)}-{rng.randrange(36)}", f"{k}-{rng.randrange(36)}", "d", scope()) for _ in range(40)] for k in range(1, 4)]  # also of unknown ends
    edges[1] += edges[1][:5] + [(None, "2-1", "d", "odd"), ("0-1", None, "d", "odd")]
    node = lambda rows: spark.createDataFrame(rows, "node string, own string")
    edge = lambda rows: spark.createDataFrame(rows, "source string, target string, domain string, scope string")
    want = judgments.propagate(node(sum(nodes, [])), edge(sum(edges, [])), POLICY)
    before = sorted(map(str, want.collect()))
    assert {r["level"] for r in want.collect()} == {0, 1, 2, 3} and want.where("decided_by IS NOT NULL").count() > 5
    monkeypatch.setattr(judgments, "checkpoint", None)  # no state is carried from round to round
    found = judgments.propagate_stages(list(zip(map(node, nodes), [None, *map(edge, edges)], strict=True)), POLICY)
    assert found.schema.names == want.schema.names and sorted(map(str, found.collect())) == before
    assert {r["node"]: r["verdict"] for r in judgments.propagate_stages([(node([("a", None)]), edge(edges[0]))], POLICY).collect()} == {"a": "BLOCK"}
    assert judgment_queries.judged_transitions(spark, DATA).count() > 0


def test_cycles_and_no_edges(spark):
    nodes = spark.createDataFrame([("a", "ACCEPT"), ("b", "ACCEPT"), ("c", "BLOCK"), ("d", "ACCEPT"), ("d", "DEFER")], "node string, own string")
    edges = spark.createDataFrame([("a", "b", "d", "strict"), ("b", "a", "d", "strict"), ("c", "d", "d", "soft")], "source string, target string, domain string, scope string")
    found = {r["node"]: (r["level"], r["verdict"], r["decided_by"]) for r in judgments.propagate(nodes, edges, POLICY).collect()}
    assert found == {"a": (None, None, None), "b": (None, None, None), "c": (0, "BLOCK", None), "d": (1, "DEFER", None)}
    alone = judgments.propagate(nodes, edges.where("false"), POLICY).collect()
    assert {r["node"]: r["verdict"] for r in alone} == {"a": "ACCEPT", "b": "ACCEPT", "c": "BLOCK", "d": "DEFER"}


def test_scopes_merge_in_any_order(spark):
    claims = [(k, s, f) for k in (1, 2, None) for s in ("x", "y", "z") for f in ("p", "q")] + [(1, "x", "only"), (4, "x", None), (4, "y", "f"), (5, None, "f"), (6, "x", None)]
    df = spark.createDataFrame(claims * 3, "k int, s string, f string")
    state = judgments.scope_state(df, "k", "s", "f")
    pieces = [judgments.scope_state(df.where(F.pmod(F.xxhash64("s", "f"), F.lit(3)) == k), "k", "s", "f") for k in range(3)]
    merged = judgments.merge_scopes(pieces[2], pieces[0], pieces[1], pieces[0])
    assert sorted(map(str, judgments.disputed_facts(state).collect())) == sorted(map(str, judgments.disputed_facts(merged).collect()))
    facts = {(r["key"], r["fact"]): (r["n_sources"], r["n_asserting"], r["status"]) for r in judgments.disputed_facts(state).collect()}
    assert facts[None, "p"] == (3, 3, "AGREED") and facts[1, "only"] == (3, 1, "DISPUTED") and facts[4, "f"] == (2, 1, "DISPUTED") and len(facts) == 8
    scopes = {r["key"]: tuple(r)[1:] for r in judgments.dispute_scope(state).collect()}
    assert scopes == {1: (3, 2, 1, "p", "only", True), 2: (3, 2, 0, "p", None, True), None: (3, 2, 0, "p", None, True), 4: (2, 0, 1, None, "f", False), 6: (1, 0, 0, None, None, False)}


RULE = "rule string, priority int, kind string, value string, unless_kind string, unless_value string, class string, effect string"


def test_evidence_leaves_its_trace(spark):
    rules = spark.createDataFrame([("stop", 0, "shape", "digits", None, None, None, "BLOCKED"), ("noun", 1, "end", "tion", "mark", None, "NOUN", "ACCEPTED"), ("verb", 2, "end", None, "after", "the", "VERB", "DEFERRED"), ("name", 2, "after", None, None, None, "NOUN", "DEFERRED")], RULE)
    said = spark.createDataFrame([("a", "end", "tion"), ("a", "end", "tion"), ("b", "end", "ed"), ("b", "after", "the"), ("b", "after", "a"), ("c", "shape", "digits"), ("c", "end", "tion"), ("d", "end", "tion"), ("d", "mark", "x"), ("d", "after", "a"), ("e", "other", "x"), (None, "end", "tion")], "item string, kind string, value string")
    items = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", None)], "item string")
    found = {r["item"]: tuple(r)[1:] for r in judgments.classify(items, "item", said, rules).collect()}
    assert found == {
        "a": ("NOUN", "noun", "ACCEPTED", "noun:NOUN:tion > verb:VERB:tion", "verb", 2),
        "b": ("NOUN", "name", "DEFERRED", "name:NOUN:a", "", 1),
        "c": (None, "stop", "BLOCKED", "stop:-:digits > noun:NOUN:tion > verb:VERB:tion", "", 3),
        "d": ("NOUN", "name", "DEFERRED", "name:NOUN:a > verb:VERB:tion", "verb", 2),
        "e": (None, None, "DEFERRED", "", "", 0),
        None: (None, None, "DEFERRED", "", "", 0),
    }


def test_digests_tell_bags_of_rows(spark):
    rows = [(1, "a", [1, 2], None), (1, "a", [1, 2], None), (2, None, [], 1.5)]
    df = spark.createDataFrame(rows, "b int, a string, c array<int>, d double")
    same = digests.multiset_digest(df.repartition(3).select("d", "c", "a", "b")).first()
    assert digests.multiset_digest(df).first() == same and same["n_rows"] == 3
    for other in ([*rows[1:]], [*rows, rows[2]], [(1, "a", [2, 1], None), *rows[1:]], [(1, "aN", [1, 2], None), *rows[1:]]):
        assert digests.multiset_digest(spark.createDataFrame(other, df.schema)).first() != same
    assert tuple(digests.multiset_digest(df.where("false")).first()) == (0, "0", 0)
    seen, metrics = digests.observed(df, "seen")
    assert seen.count() == 3 and metrics.get == same.asDict()


def test_planted_nondeterminism_is_caught(spark):
    df = spark.range(2000).select((F.col("id") % 20).alias("k"), "id")
    ways = {str(n): lambda d, n=n: d.repartition(n) for n in (1, 3, 8)}
    sound = digests.determinism(lambda d: d.groupBy("k").agg(F.min("id").alias("v")), df, ways).collect()
    assert [r["stable"] for r in sound] == [True] * 3 and len({r["digest_sum"] for r in sound}) == 1
    planted = digests.determinism(lambda d: d.groupBy("k").agg(F.first("id").alias("v")), df, ways).collect()
    assert [r["stable"] for r in planted] == [False] * 3


def test_streamed_context_ends(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", context.STORE)
    governs = spark.createDataFrame([("to", "SUBJUNCTIVE"), ("not", "JUSSIVE")], "marker string, mood string")

    def run(name, rows, ttl_ms):
        spark.createDataFrame(rows, "seq long, pos int, surface string").coalesce(1).write.mode("append").json(f"{tmp_path}/{name}/in")
        words = spark.readStream.schema("seq long, pos int, surface string").json(f"{tmp_path}/{name}/in")
        out = context.carry_mood(words, governs, "seq", "pos", negators=["not"], after=["or"], ttl_ms=ttl_ms)
        out.writeStream.format("json").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/log").trigger(once=True).start().awaitTermination()
        return {(r["seq"], r["pos"]): r["carried_mood"] for r in spark.read.schema(out.schema).json(f"{tmp_path}/{name}/out").collect()}

    first = [(1, 1, "go"), (1, 0, "to"), (1, 2, "to"), (2, 0, "or"), (2, 1, "not"), (2, 2, "x"), (3, 0, "not")]
    for name, ttl_ms in (("long", 3_600_000), ("short", 1)):
        assert run(name, first, ttl_ms) == {(1, 0): None, (1, 1): "SUBJUNCTIVE", (1, 2): None, (2, 0): None, (2, 1): None, (2, 2): None, (3, 0): None}
        time.sleep(0.1)
        later = run(name, [(1, 3, "see"), (3, 1, "see")], ttl_ms)
        carried = ("SUBJUNCTIVE", "JUSSIVE") if name == "long" else (None, None)
        assert (later[1, 3], later[3, 1]) == carried


def test_streamed_lists_carry_as_tables_do(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", context.STORE)
    governs = F.broadcast(spark.createDataFrame([("to", "SUBJUNCTIVE"), ("not", "JUSSIVE")], "marker string, mood string"))
    rng, rows, batches = random.Random(8), [], ([], [])
    for seq in range(40):
        words = [rng.choice(["to", "not", "or", "go", None]) for _ in range(rng.randint(1, 12))]
        rows += [(seq, k, w) for k, w in enumerate(words)]
        at = 0
        while at < len(words):  # in pieces of one word up, later ones in the second batch
            n = rng.randint(1, 4)
            batches[at > 5].append((seq, at, words[at : at + n]))
            at += n
    batches[0].extend([(50, 0, []), (51, 0, None)])
    schema, last = "seq long, pos int, list array<string>", None
    for batch in batches:
        spark.createDataFrame(rng.sample(batch, len(batch)), schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        found = context.carry_mood_lists(spark.readStream.schema(schema).json(f"{tmp_path}/in"), governs, "seq", "pos", "list", negators=["not"], after=["or"])
        query = found.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(once=True).start()
        query.awaitTermination()
        last = query.lastProgress
    want = sequence.carry_mood(spark.createDataFrame(rows, "seq long, pos int, surface string"), governs, "seq", "pos", negators=["not"], after=["or"])
    assert found.schema.names == ["seq", "pos", "surface", "carried_mood"] and [f.dataType for f in found.schema] == [f.dataType for f in want.schema]
    back = spark.read.schema(found.schema).json(f"{tmp_path}/out")
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect())) and back.where("carried_mood IS NOT NULL").count() > 20
    assert last["stateOperators"][0]["numRowsTotal"] == 40  # a word for each sequence


def test_streamed_state_is_dropped_without_timers(spark, tmp_path):
    assert "handleExpiredTimer" not in vars(context._Carry)  # each timer is a call of the state server
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", context.STORE)
    governs = spark.createDataFrame([("to", "SUBJUNCTIVE")], "marker string, mood string")
    for seqs in (range(30), range(30, 35)):
        spark.createDataFrame([(k, 0, "to") for k in seqs], "seq long, pos int, surface string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        words = spark.readStream.schema("seq long, pos int, surface string").json(f"{tmp_path}/in")
        query = context.carry_mood(words, governs, "seq", "pos", ttl_ms=2_000).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(once=True).start()
        query.awaitTermination()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        time.sleep(2.5)
    assert left <= 5


def test_page_files(spark, tmp_path):
    rows = [(f"b{k % 3}", k, f"page {k}\né" * (k % 50)) for k in range(600)] + [("b1", 7, "again"), ("b1", None, "no number"), (None, 5, None)]
    df = spark.createDataFrame(rows, "book string, page long, text string")
    page_files.write_pages(df.repartition(5), f"{tmp_path}/p", "book", "page", "text", file_bytes=20_000, range_bytes=4_000)
    summary = page_files.load_summary(f"{tmp_path}/p")
    assert sum(f["pages"] for f in summary) == len(rows) and max(f["bytes"] for f in summary) <= 20_000 and any(len(f["marks"]) > 1 for f in summary)
    back = page_files.read_pages(spark, f"{tmp_path}/p")
    parts = defaultdict(list)
    for r in back.select("*", F.spark_partition_id().alias("part")).collect():
        parts[r["part"]].append((r["book"], r["page"], r["text"]))
    found = [x for p in sorted(parts) for x in parts[p]]
    order = lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0)
    assert sorted(map(str, found)) == sorted(map(str, rows)) and [order(x) for x in found] == sorted(order(x) for x in rows)
    few = page_files.read_pages(spark, f"{tmp_path}/p", books=["b2"], first=100, last=130)
    assert {r["page"] for r in few.collect()} == {k for k in range(100, 131) if k % 3 == 2}
    assert few.rdd.getNumPartitions() < back.rdd.getNumPartitions() / 4 and back.count() == len(rows)
    assert page_files.read_pages(spark, f"{tmp_path}/p", books=["zz"]).count() == 0 and page_files.read_pages(spark, f"{tmp_path}/p", first=600).count() == 0
    assert page_files.read_pages(spark, f"{tmp_path}/p", first=7, last=7).count() == 2
    page_files.write_pages(df.where("false"), f"{tmp_path}/none", "book", "page", "text")
    assert page_files.read_pages(spark, f"{tmp_path}/none").count() == 0
