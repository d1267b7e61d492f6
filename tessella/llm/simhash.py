"""SimHash near-duplicates: fingerprints, popcount grid join, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import BLOCK, cell_links
from .common import checkpoint, text_of, with_workers
from .components import connected_components

#: Shingle length in words, largest linked distance in bits.
SHINGLE, DISTANCE = 4, 4
#: Bits of one segment; 64 / SEGMENT counts make the embedding of a fingerprint.
SEGMENT = 2
#: Segments are dealt to so many groups at least; a cell of the grid fixes all but DISTANCE of them.
GROUPS = 7
#: A component's smallest id goes back to its fingerprints in so many shares.
SHARES = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text in UTF-8; 0 where there is no word."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [xxh(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounds the bit matrix of a long text
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.record_batch([batch.column(0), pa.array([fingerprint(x) for x in texts], pa.int64())], names=["key", "fp"])


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows apart and orders them: ids, null last, then texts."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(docs, text_col)).alias("tie"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, fp`` for each row (null text: empty); a narrow job, one pass over the texts."""
    rows = with_workers(docs).select(_key(docs, id_col, text_col).alias("key"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_sign, "key struct<none: boolean, id: long, tie: long>, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding: counts of set bits of all 2-bit segments, packed as 2-bit fields."""
    low, high = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (fp, F.shiftrightunsigned(fp, 1)))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(groups: int = GROUPS, distance: int = DISTANCE) -> list[int]:
    """Masks on the embedding: every choice of ``groups - distance`` whole groups.

    Two embeddings within Manhattan distance ``distance`` differ in that many groups at
    most, so they share the cell of one choice at least: no link is lost.
    """
    fields = 64 // SEGMENT
    own = [sum(3 << (2 * s) for s in range(fields) if s % groups == g) for g in range(groups)]
    return [_signed(sum(own[g] for g in chosen)) for chosen in combinations(range(groups), groups - distance)]


def groups_for(n: int, distance: int = DISTANCE) -> int:
    """Groups for so many fingerprints: more make more cells and fewer pairs in each.

    All find the same links. A row of a cell costs about 50 comparisons; the counts of 32
    segments carry 1.5 bits each.
    """
    cost = lambda g: comb(g, distance) * (n + n * n / 2 ** (48 * (g - distance) / g) / 50)
    return min(range(GROUPS, 21), key=cost)


_LOW = np.uint64(0x5555555555555555)


def _near(fp_a: np.ndarray, fp_b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs link: the Manhattan distance of the embeddings is a lower bound, then exactly."""
    one = np.uint64(1)
    x = (fp_a - ((fp_a >> one) & _LOW)) ^ (fp_b - ((fp_b >> one) & _LOW))
    low, high = x & _LOW, (x >> one) & _LOW  # fields: 01 and 11 are one apart, 10 is two apart
    near = np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low) <= distance
    near[near] = np.bitwise_count((fp_a ^ fp_b)[near]) <= distance
    return near


def links(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``), enough to span each component.

    A fingerprint goes to the cell of each choice of whole segment groups. Of two within
    the Manhattan distance, some choice has the same counts in all its segments, so the
    range join becomes an equality of cells that loses no link; the rows of a cell are
    compared (see ``cells``).
    """
    emb = popcounts(F.col("fp"))
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), emb.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grid_masks(groups, distance))])
    cells = fps.select("fp", F.explode(choices).alias("c")).select("c.choice", "c.cell", F.col("fp").alias("value"))
    return cell_links(cells, lambda a, b: _near(a, b, distance), lambda column: column.to_numpy().view(np.uint64), block)


def _firsts(fps: DataFrame, distance: int, groups: int | None, block: int) -> DataFrame:
    """``fp, first`` for each of ``fps(fp, least)``: the least key reachable over links.

    The keys of a component are aggregated, which combines before its shuffle, and go
    back to its members in shares, so no task meets a large component as a whole.
    """
    groups = groups or groups_for(fps.count(), distance)
    parts = connected_components(links(fps.select("fp"), distance, groups, block))
    linked = checkpoint(fps.join(parts, F.col("fp") == F.col("node")).select("fp", "least", "component"))
    share = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    first = linked.groupBy("component").agg(F.min("least").alias("first")).select("component", "first", share.alias("share"))
    members = linked.withColumn("share", F.pmod(F.xxhash64("fp"), F.lit(SHARES)).cast("int")).join(first, ["component", "share"]).select("fp", "first")
    return fps.join(members, "fp", "left").select("fp", F.coalesce("first", "least").alias("first"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """``<id>, fp, component_id`` for each row: the smallest id reachable over linked fingerprints.

    Equal fingerprints are one node, so a group of copies of any size costs one row in the
    join. Null and blank texts have fingerprint 0 and link like any other; a null id takes
    part with its fingerprint but is the smallest only of a component without ids;
    repeated rows are kept; extra columns are ignored; an empty table gives an empty result.
    """
    signed = checkpoint(fingerprints(docs, id_col, text_col))
    fps = checkpoint(signed.groupBy("fp").agg(F.min("key").alias("least")))
    return signed.join(_firsts(fps, distance, groups, block), "fp").select(F.col("key.id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def simhash_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component of linked fingerprints.

    That is the row of the smallest id; a null id stays only in a component without ids,
    a tie goes to the smaller hash of the text, and of rows that repeat id and text the least
    stays, column by column, however the table is dealt out (rows with map columns compare
    as JSON). Columns may have any names; an empty table gives an empty result.
    """
    signed = checkpoint(fingerprints(docs, id_col, text_col))
    fps = checkpoint(signed.groupBy("fp").agg(F.min("key").alias("least")))
    stay = _firsts(fps, distance, groups, block).select(F.col("first.none").alias("n"), F.coalesce("first.id", F.lit(0)).alias("i"), F.col("first.tie").alias("t")).distinct()
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    own_type = docs.schema.simpleString()
    key = _key(docs, id_col, text_col)
    rows = docs.select(key["none"].alias("n"), F.coalesce(key["id"], F.lit(0)).alias("i"), key["tie"].alias("t"), own.alias("row"))
    kept = rows.join(stay, ["n", "i", "t"], "left_semi").groupBy("n", "i", "t").agg((F.min_by("row", F.to_json("row")) if "map<" in own_type else F.min("row")).alias("row"))
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
