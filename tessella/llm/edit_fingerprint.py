"""Document fingerprints by a randomised edit embedding (Chakraborty, Goldenberg, Koucky 2016).

A shared random walk reads a text: at step j it emits the class of the character under its
pointer and moves on or stays, by a random bit shared by all texts for (j, class). Texts a
few edits apart fall into step again soon after each edit, so edit distance becomes Hamming
distance of what was emitted. A walk has 3n steps and so reads a text to its end; a
fingerprint samples it at shared places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import BLOCK, cell_links
from .common import checkpoint, text_of, with_workers
from .components import connected_components

#: Sampled places; each gives one hexadecimal digit.
SAMPLES = 256
#: Classes of characters, and that of a text's end, which no random bit moves on from.
CLASSES, END = 30, 32
#: Digits of classes, of which 0 is the end's.
DIGITS = 15
#: Steps of a walk for each character.
PACE = 3
#: Bytes of text that are walked together, which bounds what a task holds.
TOGETHER = 8 << 20
#: Steps that are walked before samples are taken and texts that have ended leave.
STRIDE = 256
#: With fewer texts still walking, each is walked on its own.
FEW = 40
SEED = 0x5EED
#: Bit-sampled banding: so many bands, each of so many of the fingerprint's digits.
BANDS, BAND = 20, 10
#: Likeness from which two texts are near duplicates.
LIKE = 0.8


def _records() -> list[np.ndarray]:
    """For each sample the places that are taken over as the walk gets longer.

    Place p is sampled from a walk of L steps if it is the last record below L of a
    sequence of random ranks. Records are drawn one from another, so that each place of
    a walk is as likely, and walks of nearly equal length sample mostly the same places.
    """
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(SAMPLES):
        at, low, places = 0, rng.random(), [0]
        while at < 1 << 40:
            at += max(1, int(np.ceil(np.log(rng.random()) / np.log1p(-low))))
            low *= rng.random()
            places.append(at)
        out.append(np.array(places, np.int64))
    return out


_RECORDS = _records()


def _noise(start: int, stop: int) -> np.ndarray:
    """Shared random words of steps ``start`` to ``stop``; bit c moves class c on."""
    x = np.arange(start, stop, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def _classes(text: str) -> np.ndarray:
    """The class of each code point, then the end."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.append((codes * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(CLASSES), np.uint32(END)).astype(np.uint32)


def _digit(classes: np.ndarray) -> np.ndarray:
    return np.where(classes == END, 0, 1 + classes % DIGITS).astype(np.uint8)


def places(sizes: np.ndarray) -> np.ndarray:
    """Sampled steps of walks through texts of so many characters, a row for each."""
    return np.stack([r[np.maximum(np.searchsorted(r, PACE * sizes, "left") - 1, 0)] for r in _RECORDS], axis=1)


def _alone(classes: np.ndarray, at: int, step: int, where: np.ndarray) -> np.ndarray:
    """Classes that one text's walk emits at the sorted steps ``where``, going on from ``step``."""
    out, k, n = np.full(len(where), END, np.uint32), 0, len(classes) - 1
    while k < len(where) and at < n:
        stop = min(step + (1 << 16), int(where[-1]) + 1)
        near = classes[at : at + stop - step + 1].tolist()
        walked, i = [], 0
        for r in _noise(step, stop).tolist():
            walked.append(c := near[i])
            i += r >> c & 1
        end = int(np.searchsorted(where, stop))
        out[k:end] = np.array(walked, np.uint32)[where[k:end] - step]
        at, step, k = at + i, stop, end
    return out


def _fingerprints(texts: list[str]) -> np.ndarray:
    """Digits of each text, one row of SAMPLES; 0 stands for no character."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *(_classes(texts[i]) for i in order)])
    begin = np.cumsum(sizes + 1) - sizes - 1
    at, where = begin.copy(), places(sizes) if len(sizes) else np.zeros((0, SAMPLES), np.int64)
    found = np.full(where.size, END, np.uint32)
    by_place = np.argsort(where, axis=None, kind="stable")
    sorted_places = where.ravel()[by_place]
    step, lanes = 0, int(np.count_nonzero(sizes))
    one = np.uint32(1)
    while lanes > FEW:
        walked, p = np.empty((STRIDE, lanes), np.uint32), at[:lanes]
        for out, r in zip(walked, _noise(step, step + STRIDE), strict=True):
            np.take(flat, p, out=out, mode="clip")
            p += (r >> out) & one
        some = by_place[slice(*np.searchsorted(sorted_places, (step, step + STRIDE)))]
        some = some[some < lanes * SAMPLES]
        found[some] = walked[where.ravel()[some] - step, some // SAMPLES]
        step += STRIDE
        reading = np.flatnonzero(flat[p] != END)
        lanes = int(reading[-1]) + 1 if len(reading) else 0
    for d in range(lanes):
        own = np.argsort(where[d], kind="stable")
        own = own[where[d][own] >= step]
        found[d * SAMPLES + own] = _alone(flat[begin[d] : begin[d] + sizes[d] + 1], int(at[d] - begin[d]), step, where[d][own])
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    out[order] = _digit(found).reshape(-1, SAMPLES)
    return out


def _hex(digits: np.ndarray) -> str:
    return (digits[0::2] << 4 | digits[1::2]).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits of rows of fingerprints, where either text goes on, less chance; 0 to 1."""
    reads = (a | b) > 0
    n = reads.sum(axis=-1)
    share = np.where(n > 0, ((a == b) & reads).sum(axis=-1) / np.maximum(n, 1), 1.0)
    return np.maximum(0.0, (share - 1 / DIGITS) / (1 - 1 / DIGITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, fingerprint``: 256 hexadecimal digits for each row's whole text; narrow.

    Null text counts as empty, whose digits are all 0. Equal texts have equal
    fingerprints. Texts of any length, ties, repeated rows, null ids and extra columns
    are taken row by row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for part in _parts(batch.column(1).to_pylist()):
                found += map(_hex, _fingerprints(part))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType())])
    return with_workers(docs).select(F.col(id_col), text_of(docs, text_col)).mapInArrow(run, schema)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def with_next(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """Rows dealt by ranges of descending id, each range with the row that follows its last.

    Columns ``bucket, halo, id, text``, sorted; a halo row is only the next one of the row
    before it. The driver gets one id for each range (from the ids alone), no text; texts are
    shuffled once, and no task needs more than its range. After the last row comes the
    first. Equal ids follow each other by text; null ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    cuts = sorted(set(rows.approxQuantile("id", [k / partitions for k in range(1, partitions)], 0.2 / partitions)), reverse=True)
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(bounds, lambda c: c > F.col("id"))))
    rows = rows.withColumn("bucket", bucket)
    heads = [tuple(r) for r in rows.groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()]  # a row for each range
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    spark = docs.sparkSession
    lead = F.broadcast(spark.createDataFrame(before, "head long, before int"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("halo"))
    both = F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo")))
    dealt = rows.join(lead, F.col("id").eqNullSafe(F.col("head")), "left").select(F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(both)).alias("to"), "id", "text").select("to.*", "id", "text")
    return dealt.repartitionById(max(1, len(cuts) + 1), F.col("bucket")).sortWithinPartitions("bucket", "halo", F.desc_nulls_last("id"), "text")


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of each row and of its edited text, and their likenesses.

    Columns ``<id>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; the following text is that of the next lower id, after the last the first
    (see ``with_next``; a single row follows itself). Null text counts as empty; texts of
    any length, ties, repeated rows, null ids and extra columns are allowed; an empty
    table gives an empty result.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, texts: list[str], prints: np.ndarray) -> pa.RecordBatch:
            new = [edited(a, b) for a, b in pairwise(texts)]
            other = np.concatenate([np.zeros((0, SAMPLES), np.uint8), *map(_fingerprints, _parts(new))])
            return pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(x) for x in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                    pa.array(list(map(_hex, prints[:-1]))),
                    pa.array(list(map(_hex, other))),
                    pa.array(likeness(prints[:-1], other)),
                    pa.array(likeness(prints[:-1], prints[1:])),
                ],
                names=schema.names,
            )

        ids: list = []
        texts: list[str] = []
        prints = np.zeros((0, SAMPLES), np.uint8)
        ended = -1  # the range whose following row has come; ties of that row are not needed
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            held: list[str] = []
            for bucket, halo, key, text in rows:
                if halo and bucket == ended:
                    continue
                held.append(text)
                if halo:
                    ended = bucket
                    prints = np.concatenate([prints, *map(_fingerprints, _parts(held))])
                    held = []
                    yield emit(ids, [*texts, text], prints)
                    ids, texts, prints = [], [], prints[:0]
                else:
                    ids.append(key), texts.append(text)
            prints = np.concatenate([prints, *map(_fingerprints, _parts(held))])
            if len(texts) > 1:  # the last row waits for the one that follows
                yield emit(ids[:-1], texts, prints)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]

    schema = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )
    return with_next(with_workers(docs), id_col, text_col, partitions).mapInArrow(run, schema)


def _digits(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(bytes.fromhex(x) for x in column.to_pylist()), np.uint8).reshape(-1, SAMPLES // 2)
    return np.stack((raw >> 4, raw & 15), axis=2).reshape(-1, SAMPLES)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE, bands: int = BANDS, digits: int = BAND, block: int = BLOCK) -> DataFrame:
    """``<id>, fingerprint, component_id``: banding of fingerprints, verified by likeness.

    A band is ``digits`` sampled digits, shared by all; fingerprints that agree on a whole
    band are compared in full. About a third of the sampled steps lie past the texts' ends
    and agree anyhow, so two of likeness 0.8 miss all bands with a chance of about 0.003
    by these defaults. Equal fingerprints are one node, so copies cost nothing; cells of
    one fingerprint are dropped before fingerprints are fetched. Nulls, ties and empty
    tables as in ``fingerprints``. The smallest id of a component names it; a component
    of null ids only has none.
    """
    rng = np.random.default_rng(SEED)
    chosen = [sorted(rng.choice(SAMPLES, digits, replace=False).tolist()) for _ in range(bands)]
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    nodes = checkpoint(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")).withColumn("node", F.xxhash64("fingerprint")))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(*[F.substring("fingerprint", p + 1, 1) for p in band]).alias("cell")) for i, band in enumerate(chosen)])
    cells = nodes.select("node", F.explode(keys).alias("c")).select("c.choice", "c.cell", "node")
    shared = cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = cells.join(shared, ["choice", "cell"], "left_semi").join(nodes.select("node", F.col("fingerprint").alias("value")), "node").select("choice", "cell", "value")
    found = cell_links(cells, lambda a, b: likeness(a, b) >= like, _digits, block)
    parts = connected_components(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))).withColumnRenamed("node", "n")
    named = nodes.join(parts, F.col("node") == F.col("n"), "left").select("fingerprint", "least", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "part").select("fingerprint", "component_id"), "fingerprint").select(id_col, "fingerprint", "component_id")
