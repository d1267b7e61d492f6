"""Byte-level BPE with a public rank file: recursive DuckDB queries inside Spark tasks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, with_workers

#: Bytes of text that are encoded together; their distinct words go through DuckDB once.
TOGETHER = 16 << 20
#: Words, and bytes of words, that one recursive query merges at a time; bounds DuckDB's memory.
WORDS_A_QUERY, BYTES_A_QUERY = 50_000, 4 << 20
#: A longer word is merged in windows of so many bytes, each half in the next.
WINDOW = 256
DUCKDB_MEMORY = "300MB"
#: White space, of ``str.split`` or of patterns, besides single spaces and newlines.
OTHER_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Each step joins all token-position rows to the merge table, takes each word's leftmost
#: pair of least rank and contracts it; a word without a pair is done. Only a word's latest
#: row is held.
MERGE = """
WITH RECURSIVE step(w, ids, done) USING KEY (w) AS (
  SELECT w, ids, false FROM words
  UNION ALL
  SELECT s.w,
         CASE WHEN b.k IS NULL THEN s.ids
              ELSE list_concat(list_append(s.ids[:(b.k & 4294967295) - 1], (b.k >> 32)::INT), s.ids[(b.k & 4294967295) + 2:]) END,
         b.k IS NULL
  FROM step s LEFT JOIN (
    SELECT p.w, min((m.merged::BIGINT << 32) | p.pos) AS k
    FROM (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids[2:], 1) AS pos FROM step WHERE NOT done) p
    JOIN merges m ON m.l = p.l AND m.r = p.r
    GROUP BY p.w) b ON b.w = s.w
  WHERE NOT s.done)
SELECT w, ids FROM step WHERE done ORDER BY w
"""

DECODE = """
SELECT s, unhex(coalesce(string_agg(hx, '' ORDER BY pos), '')) AS bytes
FROM tokens JOIN vocab USING (id) GROUP BY s ORDER BY s
"""


def _offsets(a: pa.Array) -> np.ndarray:
    """Where each value of a binary or string array begins and ends in its data."""
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)


def _binary(offsets: np.ndarray, data: pa.Buffer | np.ndarray) -> pa.BinaryArray:
    buffer = data if isinstance(data, pa.Buffer) else pa.py_buffer(data)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), buffer])


def _joined(parts: pa.Array, ends: np.ndarray) -> pa.BinaryArray:
    """Runs of neighbouring parts, from one of ``ends`` to the next, as one value each."""
    return _binary(_offsets(parts)[ends], parts.buffers()[2] or pa.py_buffer(b""))


def _data(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)


def _union(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Both lists of places in one, sorted, each once; ``ends`` is sorted and holds the outermost."""
    mark = np.zeros(int(ends[-1] - ends[0]) + 1, bool)
    mark[ends - ends[0]] = mark[others - ends[0]] = True
    return np.flatnonzero(mark) + int(ends[0])


class Cutter:
    """Cuts texts where the pattern surely starts a new match."""

    #: Texts that are matched whole. In any other, each space and newline is single, between
    #: words: it starts a new match, and a newline ends one.
    WHOLE = rf"[\x00{OTHER_SPACES}]|[ \n][ \n]|\A[ \n]|[ \n]\z"

    def __init__(self, pattern: str) -> None:
        self.find = regex.compile(pattern).findall

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, each of whole matches of the pattern, and the first of each text.

        The pieces of a text make up the text.
        """
        whole = pc.match_substring_regex(texts, self.WHOLE)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(whole)), " ", "\0 "), "\n", "\0\n\0")
        lists = [pc.split_pattern(marked, "\0"), pa.array([self.find(x) for x in texts.filter(whole).to_pylist()], pa.list_(pa.string()))]
        order = np.argsort(np.argsort(whole.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        back = pa.concat_arrays(lists).take(pa.array(order))
        return back.flatten(), back.offsets.to_numpy() - back.offsets[0].as_py()


class Codec:
    """Encodes and decodes; one in each Python worker for a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.cutter = Cutter(pattern)
        l, r, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    l.append(a), r.append(b), merged.append(rank)
        self.ranks, self.tokens, self.ids = ranks, pa.array(ranks.keys(), pa.binary()), np.fromiter(ranks.values(), np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self.db.register("m", pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "merged": pa.array(merged, pa.int32())}))
        self.db.register("v", pa.table({"id": pa.array(self.ids), "token": self.tokens}))
        self.db.execute("CREATE TABLE merges AS FROM m")
        self.db.execute("CREATE TABLE vocab AS SELECT id, hex(token) AS hx FROM v")
        self.db.unregister("m"), self.db.unregister("v")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[self.ids] = [len(t) for t in ranks]
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids that start with a space
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.meet = np.zeros(1 << 16, bool)  # pairs of bytes that some token holds
        self.meet[[t[k] << 8 | t[k + 1] for t in ranks for k in range(len(t) - 1)]] = True

    def encode(self, texts: pa.Array) -> pa.BinaryArray:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        pieces, first = self.cutter.cut(texts)
        code = pieces.dictionary_encode()
        found = [self.cutter.find(p) for p in code.dictionary.to_pylist()]
        words = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
        ids = self._words(words.dictionary.cast(pa.binary())).take(words.indices)
        ids = _joined(ids, np.cumsum([0, *map(len, found)])).take(code.indices)
        return _joined(ids, first)

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of words: a token's own, or else by merging.

        A word is cut between two bytes that no token holds side by side: no merge joins
        them, so each part is merged on its own.
        """
        known = pc.index_in(words, self.tokens)
        new = words.filter(known.is_null())
        data, ends = _data(new), _offsets(new)
        apart = np.flatnonzero(~self.meet[data[:-1].astype(np.int32) << 8 | data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
        cuts = _union(ends, apart[(apart > ends[0]) & (apart < ends[-1])])
        parts = _binary(cuts, new.buffers()[2] or pa.py_buffer(b"")).dictionary_encode()
        merged = _joined(self._merge(parts.dictionary).take(parts.indices), np.searchsorted(cuts, ends))
        whole = _binary(np.arange(len(self.ids) + 1) * 4, self.ids.astype("<u4")).take(known.drop_null())
        is_new = known.is_null().to_numpy(zero_copy_only=False)
        return pa.concat_arrays([whole, merged]).take(pa.array(np.argsort(np.argsort(is_new, kind="stable"), kind="stable")))

    def _merge(self, parts: pa.Array) -> pa.Array:
        """Ids of strings of bytes; long ones are put together from windows."""
        long = np.diff(_offsets(parts)) > WINDOW
        if not long.any():
            return self._fixpoint(parts)
        short = self._fixpoint(parts.filter(pa.array(~long)))
        stitched = pa.array([self._stitch(x) for x in parts.filter(pa.array(long)).to_pylist()], pa.binary())
        return pa.concat_arrays([short, stitched]).take(pa.array(np.argsort(np.argsort(long, kind="stable"), kind="stable")))

    def _stitch(self, word: bytes) -> bytes:
        """Ids of one long word.

        A list of tokens is the encoding of its bytes if each two neighbours are that of
        theirs. So where two windows have a token in common, the list goes over from one
        to the next; should they have none, the word is merged as a whole.
        """
        step = WINDOW // 2
        starts = range(0, len(word) - step, step)
        code = pa.array([word[k : k + WINDOW] for k in starts], pa.binary()).dictionary_encode()
        distinct = [np.frombuffer(x, "<u4") for x in self._fixpoint(code.dictionary).to_pylist()]
        out: list[np.ndarray] = []
        ids, at = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for k, d in zip(starts, code.indices.to_pylist(), strict=True):
            new = distinct[d]
            new_at = k + np.cumsum(self.size[new]) - self.size[new]
            if k:
                _, i, j = np.intersect1d(at << 32 | ids, new_at << 32 | new, return_indices=True)
                if not len(i):
                    return self._fixpoint(pa.array([word], pa.binary()))[0].as_py()
                out.append(ids[: i[-1]])
                new, new_at = new[j[-1] :], new_at[j[-1] :]
            ids, at = new, new_at
        return np.concatenate([*out, ids]).astype("<u4").tobytes()

    def _fixpoint(self, parts: pa.Array) -> pa.Array:
        """Ids of strings of bytes, merged by DuckDB."""
        size, k, out = np.cumsum(np.diff(_offsets(parts))), 0, [pa.array([], pa.binary())]
        while k < len(parts):
            most = int(np.searchsorted(size, (size[k - 1] if k else 0) + BYTES_A_QUERY, "right"))
            part = parts.slice(k, min(max(1, most - k), WORDS_A_QUERY))
            k += len(part)
            at = _offsets(part)
            lists = pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(self.of_byte[_data(part)[at[0] : at[-1]]]))
            self.db.register("words", pa.table({"w": pa.array(np.arange(len(part), dtype=np.int32)), "ids": lists}))
            got = self.db.sql(MERGE).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("words")
            out.append(_binary((got.offsets.to_numpy() - got.offsets[0].as_py()) * 4, got.flatten().to_numpy().astype("<u4")))
        return pa.concat_arrays(out)

    def decode(self, ids: pa.BinaryArray) -> pa.BinaryArray:
        """Bytes of each list of ids. Decoding is a homomorphism, so any cut will do."""
        flat, ends = np.frombuffer(ids.buffers()[2] or b"", "<u4"), _offsets(ids) // 4
        cuts = _union(ends, ends[0] + np.flatnonzero(self.opens[flat[ends[0] : ends[-1]]]))
        code = _binary(cuts * 4, ids.buffers()[2] or pa.py_buffer(b"")).dictionary_encode()
        n = np.diff(_offsets(code.dictionary)) // 4
        out = [pa.array([], pa.binary())]
        for k in range(0, len(n), WORDS_A_QUERY):
            part = code.dictionary.slice(k, WORDS_A_QUERY)
            m, at = n[k : k + WORDS_A_QUERY], _offsets(part) // 4
            own = np.frombuffer(part.buffers()[2], "<u4")[at[0] : at[-1]].astype(np.int32)
            pos = (np.arange(len(own)) - np.repeat(at[:-1] - at[0], m)).astype(np.int32)
            self.db.register("tokens", pa.table({"s": np.repeat(np.arange(len(m), dtype=np.int32), m), "pos": pos, "id": own}))
            out.append(self.db.sql(DECODE).to_arrow_table().column("bytes").combine_chunks().cast(pa.binary()))
            self.db.unregister("tokens")
        return _joined(pa.concat_arrays(out).take(code.indices), np.searchsorted(cuts, ends))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; built at first use, then reused by later tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut batches where a column passes so many bytes, to bound what a step holds."""
    for batch in batches:
        sizes = np.fromiter((x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes in their second column, whatever size they come in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, most):
        if held and size + batch.column(1).nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.column(1).nbytes
    if held:
        yield pa.concat_batches(held)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, ids``: whole texts (null: empty) as binary little-endian 32-bit ids. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            yield pa.record_batch([batch.column(0), codec(path, pattern).encode(batch.column(1))], names=[id_col, "ids"])

    return with_workers(docs).select(F.col(id_col), text_of(docs, text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``<id>, text``: the bytes (null: empty) that binary ids stand for. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            yield pa.record_batch([batch.column(0), codec(path, pattern).decode(batch.column(1))], names=[id_col, "text"])

    return with_workers(encoded).select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b""))).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, ids, decoded``: encode whole texts, then decode the ids, in one pass.

    Null text counts as empty (no ids); texts and words of any length, ties, repeated rows,
    null ids and extra columns go through row by row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            c = codec(path, pattern)
            ids = c.encode(batch.column(1))
            yield pa.record_batch([batch.column(0), ids, c.decode(ids)], names=[id_col, "ids", "decoded"])

    return with_workers(docs).select(F.col(id_col), text_of(docs, text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")
