"""Packing of token pieces into sequences, balanced by estimated attention cost."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import text_of, with_workers

LENGTH = 1024
#: Estimated cost of a piece of n tokens: n + QUADRATIC * n^2 (attention within a document).
QUADRATIC = 1 / 256
#: Tokens that are packed together: a task holds about four bytes of each.
BUFFER = 4 << 20

SCHEMA = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """A compiled encoder with the vocabulary of a ``tokenizers`` file of byte-level BPE.

    Such a file numbers its tokens in order of their merges, so ranks can be read from it.
    The ids are those of the file's own tokenizer (the tests hold both against each other),
    at about five times its speed.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token is not matched as it stands")
    special = {x["content"]: x["id"] for x in added}
    # the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def encode(texts: list[str], path: str, pattern: str, special: bool = False) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers; the encoder is kept by the worker.

    With ``special``, a special string in a text is its one id, as the file's own tokenizer
    has it unless told otherwise; without, it is ordinary text.
    """
    if (path, pattern) not in _encodings:
        _encodings[path, pattern] = encoding(path, pattern)
    enc = _encodings[path, pattern]
    allowed = enc.special_tokens_set if special else set()
    return [enc.encode_to_numpy(x, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes() for x in texts]


def pack(sizes: np.ndarray, length: int = LENGTH, quadratic: float = QUADRATIC) -> np.ndarray:
    """Rows of (document, start, length, sequence, offset) for documents of ``sizes`` tokens.

    Full sequences are cut off first. The rest go, in descending order, each to the
    lowest-cost sequence with room for it; when none has room, it is cut to fill the
    lowest-cost sequence with any room. Capacities add up to the tokens exactly: sequences
    of ``length`` and the remainder's powers of two, so nothing is padded.
    """
    out: list[tuple[int, int, int, int, int]] = []
    whole, rest = sizes // length, sizes % length
    seq = 0
    for d in np.flatnonzero(whole):
        out += [(d, length * k, length, seq + k, 0) for k in range(whole[d])]
        seq += int(whole[d])
    total = int(rest.sum())
    capacity = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    room, cost, used = np.array(capacity, np.int64), np.zeros(len(capacity)), np.zeros(len(capacity), np.int64)
    for d in np.argsort(-rest, kind="stable"):
        at, left = int(whole[d]) * length, int(rest[d])
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room)
            s = int(fits[np.argmin(cost[fits])])
            n = min(left, int(room[s]))
            out.append((int(d), at, n, seq + s, int(used[s])))
            room[s] -= n
            used[s] += n
            cost[s] += n + quadratic * n * n
            at, left = at + n, left - n
    return np.array(out, np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, buffer: int = BUFFER, special: bool = False) -> DataFrame:
    """One row per piece: ``<id>, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A narrow job: each task packs what it reads, ``buffer`` tokens at a time, so no shuffle
    and no global state; ``sequence_id`` holds the partition in its upper bits and a lost
    task packs its rows anew. A document is its ids and then ``end_id``; null and empty
    texts are that one id. Texts of any length, ties and repeated rows are packed row by
    row; null ids pass through; an empty table gives an empty result. A text longer than
    the buffer is packed in a buffer of its own. ``length`` must be a power of two; for
    ``special`` see ``encode``.
    """
    if length & (length - 1):
        raise ValueError("length is a power of two")
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_seq = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal next_seq
            rows = pack(np.array([len(x) // 4 for x in held], np.int64), length)
            d, start, size, seq, offset = rows.T
            crc = [zlib.crc32(held[i][4 * a : 4 * (a + n)]) for i, a, n in zip(d.tolist(), start.tolist(), size.tolist(), strict=True)]
            tokens = np.array([len(x) // 4 for x in held], np.int64)[d]
            ids = pa.chunked_array(keys).combine_chunks().take(pa.array(d))
            out = pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in (start, size, crc, tokens, seq + next_seq, offset))], names=[id_col, *(n for n, _ in SCHEMA)])
            next_seq += int(seq.max()) + 1
            keys.clear(), held.clear()
            return out

        n = 0
        for batch in slices(batches):
            keys.append(batch.column(0))
            held += [x + end for x in encode(batch.column(1).to_pylist(), path, pattern, special)]
            n += sum(map(len, held[-batch.num_rows :])) // 4
            if n >= buffer:
                yield flush()
                n = 0
        if held:
            yield flush()

    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n, _ in SCHEMA)])
    return with_workers(docs).select(F.col(id_col), text_of(docs, text_col)).mapInArrow(run, schema)
