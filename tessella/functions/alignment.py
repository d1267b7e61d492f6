"""Cleaned texts held against raw ones, character by character, for all rows of a batch at once.

What ``spans`` does for any map this does for ``text.clean`` alone, without a map: each
character that cleaning leaves knows the raw one it comes from. A text goes to Python once;
tags and addresses are found row by row, all else is arithmetic on flat arrays of code points.
What is held meanwhile is bounded by ``CHARS`` characters or one text, whichever is more.
"""

from __future__ import annotations

import re
import string
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: Characters that are aligned together.
CHARS = 1 << 20
#: No character from here on is white space, a digit or a letter with case.
_TABLE = 0x20000
_DOTTED = 0x130  # the one letter that two characters are in lower case
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_TAGS, _URLS = r"<[^>]+>", r"https?://\S+|www\.\S+"


@dataclass
class _Left:
    """What cleaning leaves of some rows: for each character its row, its raw place in all rows, and whether it is white space."""

    row: np.ndarray
    at: np.ndarray
    blank: np.ndarray


def _table(members: list[int] | Callable[[str], bool]) -> np.ndarray:
    out = np.zeros(_TABLE, bool)
    out[members if isinstance(members, list) else [k for k in range(_TABLE) if not 0xD800 <= k < 0xE000 and members(chr(k))]] = True
    return out


def _is(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table[np.minimum(points, _TABLE - 1)]


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Rows, empty for null, a bounded number of characters at a time."""
    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield [t or "" for t in texts.slice(a, b - a).to_pylist()]


def _points(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all rows, the row of each, and where each row begins."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.repeat(np.arange(len(rows)), size), np.cumsum(size) - size


def _outside(pattern: re.Pattern, rows: list[str], length: int) -> np.ndarray:
    """Which characters of all rows no match holds."""
    base, edges = 0, []
    for r in rows:
        edges += [(base + m.start(), base + m.end()) for m in pattern.finditer(r)]
        base += len(r)
    change = np.zeros(length + 1, np.int8)
    if edges:
        start, end = np.array(edges).T
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) == 0


def _cleaner(numbers: bool) -> Callable[[list[str], np.ndarray, np.ndarray], _Left]:
    """The steps of ``text.clean``; case alone changes no place but that of one letter."""
    tags, urls = re.compile(_TAGS), re.compile(_URLS, re.ASCII)
    space, gone = _table(_SPACES), _table([ord(ch) for ch in string.punctuation])
    if numbers:
        gone |= _table(str.isdecimal)

    def left(rows: list[str], points: np.ndarray, row: np.ndarray) -> _Left:
        at = np.flatnonzero(_outside(tags, rows, len(points)))
        untagged = [tags.sub("", r) for r in rows] if len(at) < len(points) else rows
        at = at[_outside(urls, untagged, len(at))]
        at = at[~_is(gone, points[at])]
        dotted = points[at] == _DOTTED
        if dotted.any():
            at = np.repeat(at, 1 + dotted)
        return _Left(row[at], at, _is(space, points[at]))

    return left


def _words(left: _Left) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last character of each word."""
    solid = ~left.blank
    edge = np.ones(len(solid) + 1, bool)  # a new row, or white space on either side
    edge[1:-1] = (left.row[1:] != left.row[:-1]) | left.blank[1:] | left.blank[:-1]
    return np.flatnonzero(solid & edge[:-1]), np.flatnonzero(solid & edge[1:])


def _placed(left: _Left, first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in cleaned texts, one space after each, and how many a row has."""
    count = np.bincount(left.row[first], minlength=n)
    size = last - first + 2
    start = np.cumsum(size) - size
    begin = np.cumsum(count) - count
    return start - np.repeat(start[begin[count > 0]], count[count > 0]), count


def _lists(count: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
    made = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(count))).astype(np.int32), made)


def _clean_words(numbers: bool) -> Callable[[list[str]], pa.Array]:
    clean = _cleaner(numbers)

    def run(rows: list[str]) -> pa.Array:
        points, row, base = _points(rows)
        left = clean(rows, points, row)
        first, last = _words(left)
        start, count = _placed(left, first, last, len(rows))
        begin = base[left.row[first]]
        return _lists(count, start=start, end=start + last - first + 1, raw_start=left.at[first] - begin, raw_end=left.at[last] + 1 - begin)

    return run


def _raw_words() -> Callable[[list[str], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    space = _table(_SPACES)
    return lambda points, row: _words(_Left(row, np.arange(len(points)), _is(space, points)))


def _round_trip() -> Callable[[list[str]], pa.Array]:
    clean, words = _cleaner(False), _raw_words()

    def run(rows: list[str]) -> pa.Array:
        points, row, base = _points(rows)
        own, own_last = words(points, row)
        left = clean(rows, points, row)
        first, last = _words(left)
        start, _ = _placed(left, first, last, len(rows))
        # the raw word, if any, of each character that is left, and its place in the cleaned text
        solid = np.flatnonzero(~left.blank)
        of = np.searchsorted(own, left.at[solid], "right") - 1
        word = np.searchsorted(first, solid, "right") - 1
        place = start[word] + solid - first[word]
        edge = np.ones(len(of) + 1, bool)
        edge[1:-1] = of[1:] != of[:-1]
        head, tail = np.flatnonzero(edge[:-1]) if len(of) else np.array([], int), np.flatnonzero(edge[1:]) if len(of) else np.array([], int)
        begin, none = base[row[own]], np.ones(len(own), bool)
        none[of[head]] = False

        def put(values: np.ndarray) -> np.ma.MaskedArray:
            out = np.zeros(len(own), np.int64)
            out[of[head]] = values
            return np.ma.array(out, mask=none)

        at = left.at[solid]
        back = base[row[own[of[head]]]] if len(head) else np.array([], int)
        return _lists(
            np.bincount(row[own], minlength=len(rows)), start=own - begin, end=own_last + 1 - begin,
            clean_start=put(place[head]), clean_end=put(place[tail] + 1), back_start=put(at[head] - back), back_end=put(at[tail] + 1 - back),
        )

    return run


def _totals() -> Callable[[list[str]], pa.Array]:
    clean = _cleaner(False)
    cased, upper = _table(lambda ch: ch.lower() != ch), _table(lambda ch: ch.isupper() or ch.istitle())

    def run(rows: list[str]) -> pa.Array:
        points, row, base = _points(rows)
        left = clean(rows, points, row)
        first, last = _words(left)
        per_row = lambda r, w=None: np.bincount(r, w, len(rows)).astype(np.int64)
        # white space between two words of a row is one space; what else of it there was is removed
        inner = np.flatnonzero(left.row[first[1:]] == left.row[first[:-1]])
        gap, begun = left.row[first[1:]][inner], last[:-1][inner] + 1
        ended = first[1:][inner] - 1
        width = left.at[ended] + 1 - left.at[begun]
        solid = ~left.blank
        changed = solid & _is(cased, points[left.at])
        twice = np.zeros(len(solid), bool)
        twice[1:] = left.at[1:] == left.at[:-1]  # the second character of one that became two
        if twice.any():  # a run of capitals with such a letter is longer than it was, and no replacement
            capital = _is(upper, points[left.at]) & solid
            run_of = np.cumsum(~capital | np.append(True, left.row[1:] != left.row[:-1]))
            changed &= ~np.isin(run_of, run_of[twice])
        kept = per_row(left.row[solid & ~twice])
        size = per_row(row)
        lowered = per_row(left.row[changed]) + per_row(gap[(width == 1) & (points[left.at[begun]] != 32)])
        made = per_row(left.row[solid]) + per_row(gap)
        removed = size - kept - per_row(gap)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (kept + per_row(gap) + removed, made, lowered, removed)], names=["raw_covered", "clean_covered", "lowered", "removed"])

    return run


def _word_lines() -> Callable[[list[str]], pa.Array]:
    words = _raw_words()

    def run(rows: list[str]) -> pa.Array:
        points, row, base = _points(rows)
        first, last = words(points, row)
        line = np.cumsum(points == 10)
        before = np.append(0, line)[base[row[first]]]
        return _lists(np.bincount(row[first], minlength=len(rows)), start=first - base[row[first]], end=last + 1 - base[row[first]], line=line[first] - before + 1)

    return run


def _udf(make: Callable[[], Callable[[list[str]], pa.Array]], kind: T.DataType) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        made = make()  # tables are built once for a batch
        return pa.concat_arrays([made(rows) for rows in _chunks(texts)])

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)


def _ints(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names]))


def clean_words(c: Column, *, numbers: bool = False) -> Column:
    """``start, end, raw_start, raw_end`` of each word of a cleaned text, there and in the raw one."""
    return _udf(lambda: _clean_words(numbers), _ints("start", "end", "raw_start", "raw_end"))(c)


def round_trip(c: Column) -> Column:
    """Each raw word's span, that of what cleaning leaves of it, and where this lies in the raw text; null if nothing is left."""
    return _udf(_round_trip, _ints("start", "end", "clean_start", "clean_end", "back_start", "back_end"))(c)


def clean_totals(c: Column) -> Column:
    """Characters that cleaning covers in both texts, replaces one for one, and removes or contracts."""
    return _udf(_totals, T.StructType([T.StructField(n, T.LongType()) for n in ("raw_covered", "clean_covered", "lowered", "removed")]))(c)


def word_lines(c: Column) -> Column:
    """``start, end, line`` of each word of a text; lines count from 1."""
    return _udf(_word_lines, _ints("start", "end", "line"))(c)
