"""Offset maps of texts: what each cleaned character was in the raw text, and back.

A map is an ordered list of entries that cover both texts. An entry takes a raw span to a
norm span; both are half-open, in code points. Where the two are as long as each other it is
linear: a part of it goes to the part at the same place. Where they are not, the whole goes to
the whole. Regular expressions run inside the JVM and hand over lengths; maps are merged as
flat Arrow arrays, all rows of a batch at once, so no text goes to Python and nothing is
shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

MAP = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("raw_start", "raw_end", "norm_start", "norm_end")), T.StructField("changed", T.BooleanType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Rows that are merged together.
ROWS = 256
UPPER = r"[\p{IsUppercase}\p{Lt}]+"


def op_of(entry: Column) -> Column:
    """EXPAND, CONTRACT, REPLACE or IDENTITY: by the lengths, then by what was done."""
    raw, norm = entry["raw_end"] - entry["raw_start"], entry["norm_end"] - entry["norm_start"]
    return F.when(norm > raw, "EXPAND").when(norm < raw, "CONTRACT").when(entry["changed"], "REPLACE").otherwise("IDENTITY")


def substitution(c: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """Lengths of what a pattern leaves and of what it matches and makes: all that a map needs."""
    c = F.coalesce(c, F.lit(""))
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.struct(
        F.transform(F.split(c, pattern, -1), lambda g: F.length(g)).alias("gaps"),
        F.transform(found, lambda m: F.length(m)).alias("matched"),
        F.transform(found, lambda m: F.length(made(m))).alias("made"),
        F.transform(found, lambda m: made(m) != m).alias("changed"),
    )


@dataclass
class _Entries:
    """Entries of a batch of maps, row after row, with positions that start at 0 in each row."""

    counts: np.ndarray
    raw: np.ndarray
    raw_end: np.ndarray
    norm: np.ndarray
    norm_end: np.ndarray
    changed: np.ndarray

    @staticmethod
    def of(maps: pa.ListArray) -> _Entries:
        counts = maps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, raw_end, norm, norm_end, changed = (f.to_numpy(zero_copy_only=False) for f in maps.flatten().flatten())
        return _Entries(counts, *(x.astype(np.int64) for x in (raw, raw_end, norm, norm_end)), changed.astype(bool))

    def list(self) -> pa.ListArray:
        parts = [pa.array(x, pa.int32()) for x in (self.raw, self.raw_end, self.norm, self.norm_end)]
        made = pa.StructArray.from_arrays([*parts, pa.array(self.changed, pa.bool_())], names=["raw_start", "raw_end", "norm_start", "norm_end", "changed"])
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(self.counts))).astype(np.int32), made)

    def turned(self) -> _Entries:
        return _Entries(self.counts, self.norm, self.norm_end, self.raw, self.raw_end, self.changed)

    def closed(self) -> _Entries:
        """Each row with one more character at its end, so that no two rows touch."""
        at = np.cumsum(self.counts)
        ends = [_last(x, self.counts) for x in (self.raw_end, self.norm_end)]
        put = lambda x, v: np.insert(x, at, v)
        return _Entries(self.counts + 1, put(self.raw, ends[0]), put(self.raw_end, ends[0] + 1), put(self.norm, ends[1]), put(self.norm_end, ends[1] + 1), put(self.changed, False))

    @property
    def linear(self) -> np.ndarray:
        return self.raw_end - self.raw == self.norm_end - self.norm


def _last(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The last value of each row, 0 for an empty one."""
    at = np.cumsum(counts) - 1
    return np.where(counts > 0, ends[np.maximum(at, 0)] if len(ends) else 0, 0)


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _span_map(lengths: pa.Array) -> pa.Array:
    """The map of one substitution: what stays is an entry, and so is each match."""
    gaps, matched, made, changed = lengths.flatten()
    n = matched.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = 2 * n + 1
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at_gap = np.repeat(_before(counts) - 2 * _before(n + 1), n + 1) + 2 * np.arange((n + 1).sum())
    at_match = np.repeat(_before(counts) - 2 * _before(n), n) + 2 * np.arange(n.sum()) + 1
    raw, norm, other = (np.zeros(counts.sum(), np.int64) for _ in range(3))
    raw[at_gap] = norm[at_gap] = flat(gaps)
    raw[at_match], norm[at_match], other[at_match] = flat(matched), flat(made), flat(changed)
    row = np.repeat(np.arange(len(n)), counts)
    relative = lambda size: np.cumsum(size) - np.repeat(_before(np.bincount(row, size, len(n)).astype(np.int64)), counts)
    raw_end, norm_end = relative(raw), relative(norm)
    kept = (raw > 0) | (norm > 0)
    return _Entries(np.bincount(row[kept], minlength=len(n)), (raw_end - raw)[kept], raw_end[kept], (norm_end - norm)[kept], norm_end[kept], other[kept].astype(bool)).list()


def _sides(starts: np.ndarray, to: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where places go: before and after what has no length there, and the entry that holds them."""
    holds = np.searchsorted(starts, p, "right") - 1
    after = to[holds] + p - starts[holds]
    first = np.minimum(np.searchsorted(starts, p, "left"), len(starts) - 1)
    return np.where(starts[first] == p, to[first], after), after, holds


def _compose(first: pa.Array, then: pa.Array) -> pa.Array:
    """raw -> mid and mid -> final as raw -> final: a merge of both lists along the middle text.

    The middle is cut wherever either map has a boundary and neither has an entry across it
    that may not be cut. Each piece goes from its raw span to its final one; so does what had
    no length in the middle: a deletion of the first map, an insertion of the second. A null
    map is that of an empty text; maps that do not meet are an error.
    """
    a, b = _Entries.of(first), _Entries.of(then)
    length = _last(a.norm_end, a.counts)
    if (length != _last(b.raw_end, b.counts)).any():
        raise ValueError("the second map does not begin where the first one ends")
    base = _before(length + 1)
    a, b = a.closed(), b.closed()
    a_mid, b_mid = a.norm + np.repeat(base, a.counts), b.raw + np.repeat(base, b.counts)
    places = np.union1d(a_mid, b_mid)
    raw_before, raw_after, in_a = _sides(a_mid, a.raw, places)
    end_before, end_after, in_b = _sides(b_mid, b.norm, places)
    may_cut = ((a_mid[in_a] == places) | a.linear[in_a]) & ((b_mid[in_b] == places) | b.linear[in_b])
    cut, raw_before, raw_after, in_a, end_before, end_after, in_b = (x[may_cut] for x in (places, raw_before, raw_after, in_a, end_before, end_after, in_b))
    row = np.searchsorted(base, cut, "right") - 1
    upto = np.append(cut[1:], cut[-1:] + 1)
    across = (a_mid + a.norm_end - a.norm)[in_a] < upto
    across |= (b_mid + b.raw_end - b.raw)[in_b] < upto
    inner = cut < (base + length)[row]  # not the character that closes a row
    # at each cut: first what has no length there, then the piece up to the next cut
    pairs = lambda x, y: np.stack((x, y), 1).ravel()
    follow = lambda x: np.append(x[1:], x[-1:])
    raw, raw_end = pairs(raw_before, raw_after), pairs(raw_after, follow(raw_before))
    norm, norm_end = pairs(end_before, end_after), pairs(end_after, follow(end_before))
    changed = pairs(np.ones(len(cut), bool), a.changed[in_a] | b.changed[in_b] | across)
    kept = pairs((raw_after > raw_before) | (end_after > end_before), inner)
    counts = np.bincount(np.repeat(row, 2)[kept], minlength=len(length))
    return _Entries(counts, raw[kept], raw_end[kept], norm[kept], norm_end[kept], changed[kept]).list()


def _project(maps: _Entries, spans: pa.Array) -> pa.Array:
    """Spans of the norm text to the raw one; of the raw to the norm one with maps turned round."""
    n = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in spans.flatten().flatten())
    length = _last(maps.norm_end, maps.counts)
    maps = maps.closed()
    base = _before(length + 1)
    of = np.repeat(np.arange(len(n)), n)
    start, end = np.clip(start, 0, length[of]), np.clip(end, 0, length[of])
    solid = maps.norm_end > maps.norm
    places = (maps.norm + np.repeat(base, maps.counts))[solid]
    raw, raw_end, linear = maps.raw[solid], maps.raw_end[solid], maps.linear[solid]
    left = np.searchsorted(places, base[of] + start, "right") - 1
    right = np.searchsorted(places, base[of] + end - 1, "right") - 1
    made_start = raw[left] + np.where(linear[left], base[of] + start - places[left], 0)
    size = (maps.norm_end - maps.norm)[solid]
    made_end = raw_end[right] - np.where(linear[right], places[right] + size[right] - base[of] - end, 0)
    made_end = np.where(end > start, made_end, made_start)
    made = pa.StructArray.from_arrays([pa.array(made_start, pa.int32()), pa.array(made_end, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), made)


def _project_to_raw(maps: pa.Array, asked: pa.Array) -> pa.Array:
    """Where spans of the norm text lie in the raw one.

    A part of a linear entry is exact; of any other the whole raw span is meant. A span that
    spans nothing goes to an empty one; spans are cut off at the text's ends.
    """
    return _project(_Entries.of(maps), asked)


def _project_to_norm(maps: pa.Array, asked: pa.Array) -> pa.Array:
    """Where spans of the raw text lie in the norm one; what is gone is an empty span in its place."""
    return _project(_Entries.of(maps).turned(), asked)


def _spans_between(lengths: pa.Array) -> pa.Array:
    """Spans of what a pattern leaves, empty ones aside: words between white space, say."""
    gaps, matched, _, _ = lengths.flatten()
    n = gaps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    size = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    after = np.zeros(len(size), np.int64)
    last = np.cumsum(n) - 1
    after[np.setdiff1d(np.arange(len(size)), last)] = matched.flatten().to_numpy(zero_copy_only=False)
    start = _before(size + after)
    start -= start[_before(n)][row]
    kept = size > 0
    made = pa.StructArray.from_arrays([pa.array(start[kept], pa.int32()), pa.array((start + size)[kept], pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=len(n))))).astype(np.int32), made)


def _enclosing(inner: pa.Array, outer: pa.Array) -> pa.Array:
    """For each span of ``inner`` the number, from 1, of the span of ``outer`` where it starts.

    ``outer`` ascends; a place before or between its spans belongs to the span before it.
    """
    n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (inner, outer))
    start, begin = (x.flatten().field(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (inner, outer))
    reach = 1 + max(start.max(initial=0), begin.max(initial=0))
    keys = begin + np.repeat(np.arange(len(m)), m) * reach
    found = np.searchsorted(keys, start + np.repeat(np.arange(len(n)), n) * reach, "right")
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(found - np.repeat(_before(m), n), pa.int32()))


def _composed(*lengths: pa.Array) -> pa.Array:
    """The map of several substitutions, one after the other."""
    return reduce(_compose, map(_span_map, lengths))


def _udf(f: Callable[..., pa.Array], kind: T.DataType) -> Callable[..., Column]:
    """``f`` on columns, a few rows at a time: what it makes meanwhile is bounded by them, however large a batch is."""

    def run(*columns: pa.Array) -> pa.Array:
        made = [f(*(c.slice(k, ROWS) for c in columns)) for k in range(0, max(1, len(columns[0])), ROWS)]
        return pa.concat_arrays(made)

    run.__doc__ = f.__doc__
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


_INTS = T.ArrayType(T.IntegerType())
span_map, compose, composed = _udf(_span_map, MAP), _udf(_compose, MAP), _udf(_composed, MAP)
project_to_raw, project_to_norm, spans_between = _udf(_project_to_raw, SPANS), _udf(_project_to_norm, SPANS), _udf(_spans_between, SPANS)
enclosing = _udf(_enclosing, _INTS)


def words_of(c: Column) -> Column:
    """Lengths of words and of the white space between them."""
    return substitution(c, r"(?U)\s+", lambda m: m)


def word_spans(c: Column) -> Column:
    """Spans of the words between white space."""
    return spans_between(words_of(c))


def lines_of(c: Column) -> Column:
    """Lengths of the lines, each with the end of line after it, so that none is empty."""
    lengths = substitution(c, "\n", lambda m: m)
    return F.struct(F.transform(lengths["gaps"], lambda g: g + 1), F.transform(lengths["matched"], lambda _: F.lit(0)), lengths["made"], lengths["changed"])


def line_spans(c: Column) -> Column:
    """Spans of the lines, each with the end of line after it."""
    return spans_between(lines_of(c))


def clean_steps(*, lowercase: bool = True, punctuation: bool = True, numbers: bool = False, urls: bool = True, html: bool = True) -> list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]]:
    """The steps of ``text.clean``: name, pattern, what a match becomes, and the step itself."""
    nothing = lambda m: F.lit("")
    steps = [
        (html, "tags", r"<[^>]+>", nothing, text.remove_tags),
        (urls, "urls", r"https?://\S+|www\.\S+", nothing, text.remove_urls),
        (lowercase, "lower", UPPER, F.lower, text.lower),
        (punctuation, "punctuation", r"\p{Punct}+", nothing, text.remove_punctuation),
        (numbers, "numbers", r"(?U)\d+", nothing, text.remove_numbers),
        (True, "space", r"(?U)\s+", lambda m: F.lit(" "), lambda c: F.regexp_replace(c, r"(?U)\s+", " ")),
        (True, "ends", r"\A +| +\z", nothing, F.trim),
    ]
    return [s[1:] for s in steps if s[0]]


def with_clean_steps(df: DataFrame, text_col: str = "text", cleaned: str = "cleaned", **flags: bool) -> tuple[DataFrame, list[str]]:
    """``df`` with its text as ``text.clean`` makes it, and columns with the lengths of each step, whose names come too.

    Each step is a projection of its own, so that its text is computed once; all is narrow.
    """
    out, steps = df.withColumn(cleaned, F.col(text_col)), []
    for name, pattern, made, step in clean_steps(**flags):
        out = out.withColumns({f"__{name}": substitution(F.col(cleaned), pattern, made), f"__{cleaned}": step(F.col(cleaned))})
        out = out.drop(cleaned).withColumnRenamed(f"__{cleaned}", cleaned)
        steps.append(f"__{name}")
    return out, steps


def with_clean_map(df: DataFrame, text_col: str = "text", cleaned: str = "cleaned", map_col: str = "map", **flags: bool) -> DataFrame:
    """``df`` with its text as ``text.clean`` makes it and the map from the raw text to it.

    A null text has a null cleaned text and an empty map.
    """
    out, steps = with_clean_steps(df, text_col, cleaned, **flags)
    return out.select(*df.columns, cleaned, composed(*steps).alias(map_col))
