"""Plans and steps that keep a query's work in proportion to its tables."""

from __future__ import annotations

import random
import re
import string

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessella.functions import arabic
from tessella.functions import spans as maps
from tessella.operators import ledger, lexicon
from tessella.plans import arabic_queries, claim_queries, ledger_queries, root_queries, sequence_queries, span_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [arabic_queries.augmented_forms, arabic_queries.past_features, arabic_queries.imperfect_readings, arabic_queries.aligned_patterns, arabic_queries.decided_patterns, root_queries.derived_words], ids=lambda f: f.__name__)
def test_conditions_on_words_meet_distinct_words_alone(spark, query):
    assert "parquet" not in _plan(query(spark, DATA))  # no condition can move down to the texts


def test_vocalised_lookup_against_a_plain_search(spark):
    rng = random.Random(5)
    marks = ["", arabic.FATHA, arabic.KASRA, arabic.FATHA + arabic.SHADDA]
    made = lambda: "".join(rng.choice("بتـ ") + rng.choice(marks) for _ in range(rng.randint(0, 4)))
    words, entries = [(k, made()) for k in range(300)] + [(300, None)], sorted({made() for _ in range(300)}) + [None]

    def units(w):
        out = []
        for ch in w:
            if ch in "بت":
                out.append(ch)
            elif ch in "".join(marks) and out and w:
                out[-1] += ch
        return out

    def bare(w):
        return "".join(ch for ch in w if ch not in "".join(marks))

    # marks after a character that is no letter belong to none
    plain = lambda w: w is not None and not any(a in "ـ " and b in "".join(marks) for a, b in zip(w, w[1:], strict=False))
    words, entries = [x for x in words if x[1] is None or plain(x[1])], [e for e in entries if e is None or plain(e)]
    want = set()
    for k, w in words:
        met = [e for e in entries if e is not None and w is not None and bare(e) and bare(e) == bare(w)]
        fit = [e for e in met if all(len(a) == 1 or a == b for a, b in zip(units(w), units(e), strict=True))]
        want.add((k, "FOUND" if len(fit) == 1 else "COLLISION" if fit else "CONTRADICTED" if met else "NOT_FOUND", fit[0] if len(fit) == 1 else None, len(fit)))
    assert {x[1] for x in want} == {"FOUND", "COLLISION", "CONTRADICTED", "NOT_FOUND"}
    found = lexicon.lookup_vocalised(spark.createDataFrame(words, "id int, w string"), "id", "w", spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert {tuple(r) for r in found.collect()} == want
    assert "__mask" in _plan(found)  # words meet entries by what is marked, not all entries of their letters


HARD = ["", None, " ", "!!! a", "<a href> x", "foo<i b>bar", "a ... b. c .d", "İA b", "see https://a.b/c?d www.x.y <b>now</b>", "tab\tend\u0085next ", "\U0001f600 X\U0001f600, y", "A7 8b", "line\n\nend\n", "word " * 3000, "..."]


def _clean(t):
    """Characters that are left with their raw places, one by one; white space between words is one space."""
    keep = [(ch, i) for i, ch in enumerate(t)]
    for pattern in (r"<[^>]+>", r"https?://[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+"):
        gone = {i for m in re.finditer(pattern, "".join(ch for ch, _ in keep)) for i in range(*m.span())}
        keep = [x for k, x in enumerate(keep) if k not in gone]
    return [(low, i) for ch, i in keep if ch not in string.punctuation for low in ch.lower()]


def _clean_words(t):
    out, word = [], []
    for ch, i in [*_clean(t), (" ", -1)]:
        if not ch.isspace():
            word.append((ch, i))
        elif word:
            out.append(word)
            word = []
    return out


def test_alignment_against_a_plain_one(spark, tmp_path):
    spark.createDataFrame(list(enumerate(HARD)), "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spans, trips = {}, {}
    for k, t in enumerate(HARD):
        at = 0
        for n, w in enumerate(_clean_words(t or ""), 1):
            spans[k, n] = ("".join(ch for ch, _ in w), at, at + len(w), w[0][1], w[-1][1] + 1)
            at += len(w) + 1
        placed = [(spans[k, n][1] + j, i) for n, w in enumerate(_clean_words(t or ""), 1) for j, (_, i) in enumerate(w)]
        for n, m in enumerate(re.finditer(r"\S+", t or ""), 1):
            held = [x for x in placed if m.start() <= x[1] < m.end()]
            trips[k, n] = (*m.span(), *((held[0][0], held[-1][0] + 1, held[0][1], held[-1][1] + 1) if held else (None,) * 4))
    assert {tuple(r[:2]): tuple(r[2:]) for r in span_queries.clean_word_spans(spark, str(tmp_path)).collect()} == spans
    assert {tuple(r[:2]): tuple(r[2:]) for r in span_queries.raw_word_round_trip(spark, str(tmp_path)).collect()} == trips
    found = {r[0]: r for r in span_queries.clean_map_ops(spark, str(tmp_path)).collect()}
    assert set(found) == {k for k, t in enumerate(HARD) if t}
    for k, r in found.items():
        assert (r["raw_covered"], r["clean_covered"]) == (r["n_raw"], r["n_clean"]) == (len(HARD[k]), max([e for (d, _), (_, _, e, _, _) in spans.items() if d == k], default=0))
    old = {r[0]: r for r in _mapped(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert {k: (r["lowered"], r["removed"]) for k, r in found.items()} == {k: tuple(r)[1:] for k, r in old.items()}


def _mapped(docs):
    """Characters replaced and removed by the composed maps of ``spans``."""
    e = F.col("e")
    raw, norm, op = e["raw_end"] - e["raw_start"], e["norm_end"] - e["norm_start"], maps.op_of(e)
    rows = maps.with_clean_map(docs).select("doc_id", F.explode("map").alias("e"))
    return rows.groupBy("doc_id").agg(F.sum(F.when(op == "REPLACE", raw).otherwise(0)), F.sum(F.when(norm == 0, raw).otherwise(0) + F.when((op == "CONTRACT") & (norm > 0), raw - norm).otherwise(0)))


def test_no_maps_are_built_for_words(spark):
    for query in (span_queries.clean_map_ops, span_queries.clean_word_spans, span_queries.raw_word_round_trip, span_queries.page_word_spans, span_queries.text_token_spans):
        assert "regexp_extract_all" not in _plan(query(spark, DATA))  # lengths of all matches, step by step, cost most of the time


def _shuffled_sorts(df) -> tuple[int, int]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning"), len(re.findall(r"(?<![A-Za-z])Sort \[", plan))


def test_one_shuffle_and_one_sort(spark):
    """Each of these sorted or shuffled its rows more often."""
    assert _shuffled_sorts(ledger_queries.ledger_summary(spark, DATA)) == (1, 1)
    assert _shuffled_sorts(sequence_queries.closed_relations(spark, DATA)) == (1, 1)
    assert _shuffled_sorts(sequence_queries.propositions(spark, DATA)) == (1, 1)
    assert _shuffled_sorts(root_queries.eligible_nouns(spark, DATA)) == (0, 0)
    assert _shuffled_sorts(claim_queries.claim_bundles(spark, DATA)) == (1, 0)


def test_stages_that_an_item_never_reached(spark):
    log = spark.createDataFrame([(1, 1, "EXECUTED_STOPPED"), (1, 1, "EXECUTED_APPROVED"), (1, 3, "EXECUTED_APPROVED"), (2, 16, "EXECUTED_APPROVED"), (3, None, "EXECUTED_APPROVED")], "item int, ordinal int, status string")
    found = ledger.summary(ledger.densify(log, "item"), "item", "EXECUTED_APPROVED", ["EXECUTED_STOPPED"])
    assert {tuple(r) for r in found.collect()} == {(1, 2, 13, "P0_GLYPH_CLASSIFICATION", "P0_UNICODE_CANDIDATE"), (2, 0, 15, None, None), (3, 0, 15, None, None)}
