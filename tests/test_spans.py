"""Offset maps against plain ones, character by character."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessella.functions import spans, text

FIELDS = ("raw_start", "raw_end", "norm_start", "norm_end", "changed")


def _entries(pieces):
    """(raw length, norm length, changed) in order as a map."""
    raw = norm = 0
    out = []
    for r, n, changed in pieces:
        out.append((raw, raw + r, norm, norm + n, changed))
        raw, norm = raw + r, norm + n
    return out


def _pieces(rng, length, inserts):
    """Random pieces whose raw lengths add up to ``length``."""
    out = []
    while length:
        r = rng.randint(1, length)
        n = rng.choice([r, r, 0, rng.randint(0, r + 2)])
        out.append((r, n, n != r or rng.random() < 0.3))
        length -= r
        if inserts and rng.random() < 0.2:
            out.append((0, rng.randint(1, 2), True))
    return out


def _plain_compose(a, b):
    """Cut the middle where both maps can be cut; one place at a time."""
    length = a[-1][3] if a else 0
    inside = lambda m, p, s, e: next((x for x in m if x[s] < p < x[e]), None)
    linear = lambda x: x[1] - x[0] == x[3] - x[2]
    places = {0, length, *(x[2] for x in a), *(x[3] for x in a), *(x[0] for x in b), *(x[1] for x in b)}
    cuts = [p for p in sorted(places) if all(x is None or linear(x) for x in (inside(a, p, 2, 3), inside(b, p, 0, 1)))]

    def image(m, p, s, e, to, to_end):
        """Where a place goes, before and after what has no length there."""
        x = inside(m, p, s, e)
        if x:
            return (x[to] + p - x[s],) * 2
        at = [x for x in m if x[s] == x[e] == p]
        lower = max([x[to_end] for x in m if x[e] <= p and x not in at], default=0)
        return (at[0][to], at[-1][to_end]) if at else (lower, lower)

    out = []
    for k, p in enumerate(cuts):
        (r0, r1), (f0, f1) = image(a, p, 2, 3, 0, 1), image(b, p, 0, 1, 2, 3)
        if r1 > r0 or f1 > f0:
            out.append((r0, r1, f0, f1, True))
        if k + 1 < len(cuts):
            q = cuts[k + 1]
            s, t = image(a, q, 2, 3, 0, 1)[0], image(b, q, 0, 1, 2, 3)[0]
            over_a, over_b = [x for x in a if x[2] < q and x[3] > p], [x for x in b if x[0] < q and x[1] > p]
            out.append((r1, s, f1, t, len(over_a) > 1 or len(over_b) > 1 or over_a[0][4] or over_b[0][4]))
    return out


def _plain_project(m, s, e, frm, frm_end, to, to_end):
    hit = []
    for x in m:
        lo, hi = max(s, x[frm]), min(e, x[frm_end])
        if lo < hi:
            exact = x[1] - x[0] == x[3] - x[2]
            hit.append((x[to] + lo - x[frm], x[to] + hi - x[frm]) if exact else (x[to], x[to_end]))
    return (min(h[0] for h in hit), max(h[1] for h in hit))


def test_composition_and_projection_against_plain_ones(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        a = _entries(_pieces(rng, rng.randint(0, 12), True)) if k else []
        b = _entries(_pieces(rng, a[-1][3] if a else 0, True))
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, f"k int, a {spans.MAP.simpleString()}, b {spans.MAP.simpleString()}").coalesce(2)
    made = df.withColumn("m", spans.compose("a", "b")).collect()
    maps = []
    for r, (k, a, b) in zip(sorted(made), rows, strict=True):
        got = [tuple(x) for x in r["m"]]
        assert got == _plain_compose(a, b), (k, a, b)
        maps.append((k, got))
    asked = [(k, m, [(s, e) for s in range(len_n) for e in range(s + 1, len_n + 1)], [(s, e) for s in range(len_r) for e in range(s + 1, len_r + 1)]) for k, m in maps for len_n, len_r in [(m[-1][3], m[-1][1]) if m else (0, 0)]]
    df = spark.createDataFrame(asked, f"k int, m {spans.MAP.simpleString()}, n {spans.SPANS.simpleString()}, r {spans.SPANS.simpleString()}")
    for r in df.select("k", "m", "n", "r", spans.project_to_raw("m", "n").alias("to_raw"), spans.project_to_norm("m", "r").alias("to_norm")).collect():
        m = [tuple(x) for x in r["m"]]
        assert [tuple(x) for x in r["to_raw"]] == [_plain_project(m, s, e, 2, 3, 0, 1) for s, e in r["n"]]
        assert [tuple(x) for x in r["to_norm"]] == [_plain_project(m, s, e, 0, 1, 2, 3) for s, e in r["r"]]


def test_maps_that_do_not_meet(spark):
    df = spark.createDataFrame([(_entries([(2, 3, True)]), _entries([(2, 2, False)]))], f"a {spans.MAP.simpleString()}, b {spans.MAP.simpleString()}")
    with pytest.raises(PythonException, match="does not begin where"):
        df.select(spans.compose("a", "b")).collect()


TEXTS = ["", None, " ", "Plain", "  Two  WORDS. ", "<b>Bold</b> and <i>it", "see https://a.b/c?d www.x.y now", "a b  c", "\U0001f600 X\U0001f600, y", "ÀÉ İ ǅ Ⅷ Σας", "a . b", "...", "<x>", "1 < 2 > 0", "line\n\nend\n", "word " * 3000]


def test_clean_map_of_hard_texts(spark):
    df = spark.createDataFrame([(k, t, "c", "m") for k, t in enumerate(TEXTS)], "k int, text string, cleaned_ string, `map_` string").coalesce(1)
    found = spans.with_clean_map(df).withColumn("want", text.clean(F.col("text"))).withColumn("ops", F.transform("map", spans.op_of)).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        raw, clean = r["text"] or "", r["cleaned"] or ""
        assert r["cleaned"] == r["want"]
        at_raw = at_norm = 0
        for e, op in zip(r["map"], r["ops"], strict=True):
            assert (e["raw_start"], e["norm_start"]) == (at_raw, at_norm)
            at_raw, at_norm = e["raw_end"], e["norm_end"]
            if op == "IDENTITY":
                assert raw[e["raw_start"] : at_raw] == clean[e["norm_start"] : at_norm]
        assert (at_raw, at_norm) == (len(raw), len(clean))
    assert spans.with_clean_map(df.where("false")).count() == 0


def test_spans_of_words_and_lines(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").coalesce(1)
    rows = df.withColumn("w", spans.word_spans(F.col("text"))).withColumn("l", spans.line_spans(F.col("text"))).withColumn("n", spans.enclosing("w", "l"))
    for r in rows.collect():
        raw = r["text"] or ""
        assert [raw[s:e] for s, e in r["w"]] == raw.split()
        assert [raw[s : e - 1] for s, e in r["l"]] == raw.split("\n")
        assert r["n"] == [raw[:s].count("\n") + 1 for s, _ in r["w"]]
