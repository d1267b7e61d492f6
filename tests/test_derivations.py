"""Prefix joins, generated forms, relicensing and letter accounts against plain searches."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import accounting, compounds, inverse, lexicon, relicensing
from tessella.operators.inverse import Rule
from tessella.operators.relicensing import Hypothesis


def _column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


WORDS = ["unter", "unterwegs", "un", "unwegs", "weg", "wegs", None, "", "x", "unterunter", "日本語", "日本", "w" * 5000 + "eg"]
PREFIXES = ["un", "unter", "unt", "日", "日本", "", None, "w" * 4000, "unterwegs"]


def test_prefixes_against_a_plain_search(spark):
    words, known = _column(spark, WORDS, "word"), _column(spark, PREFIXES + ["un"], "prefix")
    want = {(w, p, w[len(p) :]) for w in WORDS if w for p in PREFIXES if p and w != p and w.startswith(p)}
    found = compounds.prefix_matches(words, "word", "word", known)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    longest = {w: max((m for m in want if m[0] == w), key=lambda m: len(m[1])) for w in {m[0] for m in want}}
    assert {tuple(r) for r in compounds.longest_prefix(words, "word", "word", known).collect()} == set(longest.values())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert compounds.longest_prefix(words, "word", "word", known.where("false")).count() == 0


def test_compounds_never_pick_among_entries(spark):
    words, known = _column(spark, ["unterweg", "unweg", "unwegs", "unx", "y", None], "word"), _column(spark, ["un", "unter"], "prefix")
    index = spark.createDataFrame([("weg", "Weg"), ("weg", "weg"), ("wegs", "wegs"), ("wegs", "wegs"), ("terweg", "terweg")], "key string, entry string")
    found = {r[0]: tuple(r[1:]) for r in compounds.compound_lookup(words, "word", "word", known, index, F.lower).collect()}
    assert found == {"unterweg": ("COMPOUND", "un", "terweg", "terweg"), "unweg": ("COLLISION", "un", "weg", None), "unwegs": ("COMPOUND", "un", "wegs", "wegs"), "unx": ("OPEN", None, None, None), "y": ("NONE", None, None, None), None: ("NONE", None, None, None)}


def test_cascade_routes(spark):
    words = _column(spark, ["house", "houses", "in", "ins", "inhouse", "inhouses", "zzz", "stop1"], "word")
    ways = lexicon.strip_suffixes(words, "word", "word", ["s", "es"])
    found = {r[0]: tuple(r[1:]) for r in compounds.recognise(words, "word", "word", ways, _column(spark, ["in", "i"], "prefix"), _column(spark, ["house", "nhouse"], "entry"), F.col("word").endswith("1")).collect()}
    assert found["house"] == ("WHOLE", "house", "", None, 1, "CLOSED")
    assert found["houses"] == ("KNOWN", "house", "s", None, 1, "CLOSED")
    assert found["in"] == ("FUNCTION", "in", "", None, 1, "CLOSED") and found["ins"] == ("FUNCTION", "in", "s", None, 1, "CLOSED")
    assert found["inhouse"] == ("PREFIX_AND_CORE", "inhouse", "", "in", 1, "CLOSED")
    assert found["inhouses"] == ("PREFIX_AND_CORE", "inhouse", "s", "in", 1, "CLOSED")
    assert found["zzz"][0] == "OPEN" and found["zzz"][-1] == "DEFERRED"
    assert found["stop1"] == (None, None, None, None, 0, "BLOCKED")


RULES = [Rule("BASE", "", 0, ""), Rule("PLURAL", "y", 1, "ies"), Rule("PLURAL", "", 0, "s"), Rule("AGENT", "e", 0, "r"), Rule("DROP", "xy", 2, "")]


def test_inverse_index(spark):
    stems = _column(spark, ["spy", "spie", "bake", "baker", "spy", None, "", "xy", "axy"], "stem")
    forms = inverse.generate(stems, "stem", RULES)
    assert {tuple(r) for r in forms.where("root IN ('spy', 'xy', 'axy')").collect()} == {("spy", "BASE", "spy"), ("spy", "PLURAL", "spies"), ("xy", "BASE", "xy"), ("xy", "PLURAL", "xies"), ("axy", "BASE", "axy"), ("axy", "PLURAL", "axies"), ("axy", "DROP", "a")}
    found = {(r["word"], r["root"], r["feature"]): (r["n_roots"], r["verdict"]) for r in inverse.analyse(_column(spark, ["spies", "baker", "none", None], "word"), "word", "word", forms).collect()}
    assert found == {("spies", "spy", "PLURAL"): (2, "DEFER"), ("spies", "spie", "PLURAL"): (2, "DEFER"), ("baker", "bake", "AGENT"): (2, "DEFER"), ("baker", "baker", "BASE"): (2, "DEFER"), ("none", None, None): (0, "UNKNOWN"), (None, None, None): (0, "UNKNOWN")}
    inverse.write_index(forms, "inverse_forms", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = spark.table("inverse_forms")
        words = _column(spark, ["spies"], "word")
        joined = words.join(kept, words["word"] == kept["surface"])
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of the words alone
        assert joined.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE inverse_forms")


HYPOTHESES = [Hypothesis("S", "suffix", "s"), Hypothesis("EN", "suffix", "en"), Hypothesis("UNG", "suffix", "ung", "en"), Hypothesis("VER", "prefix", "ver"), Hypothesis("WEAK", "weak", "äö", "ao", ("EN",))]


def _plain_relicense(word, licensed):
    """All paths of hypotheses, each at most once, by their number."""
    if word is None or any(c.isdigit() for c in word):
        return "BLOCK", None, 0
    states = {(word, frozenset())}
    for k in itertools.count():
        hits = {f for f, _ in states if f in licensed}
        if hits:
            return ("ACCEPT", min(hits), k) if len(hits) == 1 else ("AMBIGUOUS", None, k)
        after = set()
        for form, used in states:
            for h in HYPOTHESES:
                if h.name in used or h.licence and not set(h.licence) & used:
                    continue
                if h.side == "weak":
                    new = form.translate(str.maketrans(h.pattern, h.becomes))
                    ok = new != form
                else:
                    ok = form.startswith(h.pattern) if h.side == "prefix" else form.endswith(h.pattern)
                    new = h.becomes + form[len(h.pattern) :] if h.side == "prefix" else form[: len(form) - len(h.pattern)] + h.becomes
                    ok = ok and len(new) >= 2
                if ok:
                    after.add((new, used | {h.name}))
        if not after:
            return "DEFER", None, k
        states = after


def test_relicensing_against_a_plain_search(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(["ver", "s", "en", "ung", "ä", "ö", "a", "l", "1"]) for _ in range(rng.randint(1, 5))) for _ in range(300)}) + [None, "", "sss" * 200, "verlus"]
    licensed = ["verlu", "lus", "al", "ol", "la", "lal", "len", "aa", "ss", "ale", "all"]
    found = relicensing.relicense(_column(spark, words, "word"), "word", "word", _column(spark, [*licensed, None], "root"), HYPOTHESES, F.col("word").rlike("[0-9]")).collect()
    assert len(found) == len(words)
    for r in found:
        assert tuple(r)[1:4] == _plain_relicense(r["word"], set(licensed)), r
        assert r["verdict"] == "ACCEPT" or not r["used"]
    assert {r["verdict"] for r in found} == {"ACCEPT", "AMBIGUOUS", "DEFER", "BLOCK"}


@pytest.mark.parametrize("bad", [[Hypothesis("A", "suffix", "s", "s")], [Hypothesis("A", "weak", "ao", "oa")], [Hypothesis("A", "suffix", "s"), Hypothesis("A", "suffix", "t")], [Hypothesis("A", "suffix", "s", licence=("B",))]])
def test_hypotheses_that_do_not_end_are_refused(spark, bad):
    with pytest.raises(ValueError):
        relicensing.relicense(_column(spark, ["a"], "word"), "word", "word", _column(spark, ["a"], "root"), bad, F.lit(False))


COSTS = accounting.Costs(prefix={"g": 1, "e": 1}, root={"e": 2, "a": 3}, augment={"e": 1, "a": 1}, suffix={"e": 1, "n": 1, "t": 1})


def _plain_account(word):
    best = None
    for p in range(len(word) + 1):
        for s in range(p, len(word) + 1):
            for middle in itertools.product("RA", repeat=s - p):
                roots = [p + k for k, x in enumerate(middle) if x == "R"]
                if s == p or not 2 <= len(roots) <= 3:
                    continue
                cost = [COSTS.prefix.get(c) for c in word[:p]] + [COSTS.root.get(c, 0) if x == "R" else COSTS.augment.get(c) for c, x in zip(word[p:s], middle, strict=True)] + [COSTS.suffix.get(c) for c in word[s:]]
                if None not in cost:
                    best = min(best or (10**9,), (sum(cost), p, roots, s))
    return best


def test_accounts_against_all_assignments(spark):
    words = ["".join(w) for n in range(6) for w in itertools.product("gean", repeat=n)] + ["gelaufen", "tätet", "xyz", "xyzxyz"]
    df = _column(spark, [*words, None], "word").select("word", accounting.account(F.col("word"), COSTS, 2, 3).alias("a")).select("word", "a", accounting.roles(F.col("word"), F.col("a")).alias("roles"))
    for r in df.collect():
        want = _plain_account(r["word"]) if r["word"] else None
        assert (r["a"] and tuple(r["a"])) == want, r
        if want:
            _, p, roots, s = want
            assert r["roles"] == "".join("P" if k < p else "S" if k >= s else "R" if k in roots else "A" for k in range(len(r["word"])))
        else:
            assert r["roles"] is None


def test_account_of_a_very_long_word(spark):
    df = spark.range(1).select(F.repeat(F.lit("a"), 100_000).alias("w")).select(accounting.account(F.concat(F.lit("xx"), "w"), COSTS).alias("a"))
    assert df.first()["a"]["cost"] == 100_000
