"""Line dedup by an exact set-similarity join, with DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free, shared_folder, text_of

#: Jaccard similarity from which two lines match.
SIMILAR = 0.8
#: Buckets of the word counts that rarity is read from; bits of the set of lines that may match
#: another. A full set lets more lines through and loses none.
RARITY_BUCKETS, MATCH_BITS = 1 << 18, 1 << 20
#: Repeated ids up to so many are broadcast.
LISTED = 100_000
#: What parts the words of a line.
BLANKS = " \t\r\f\x0b"
#: Lines of more distinct words have twice as many parities.
LONG = 64


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, text``, and where an id is null or repeated also ``tie``, a hash of the text of such rows.

    These columns tell documents apart; rows that share all are one document. Most tables
    have no such ids, and then nothing is carried along for them. Repeated ids are
    joined, by a broadcast up to LISTED of them.
    """
    ids = docs.groupBy(F.col(id_col).cast("long").alias("doc")).count().where("doc IS NULL OR count > 1")
    ids = checkpoint(ids.select("doc", F.lit(True).alias("twice")))
    n, rows = ids.count(), docs.select(F.col(id_col).cast("long").alias("doc"), text_of(docs, text_col).alias("text"))
    if not n:
        return rows
    marked = rows.join(F.broadcast(ids) if n <= LISTED else ids, "doc", "left")
    tie = F.when(F.col("doc").isNull() | F.col("twice").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return marked.select("doc", tie.alias("tie"), "text")


def _document(df: DataFrame) -> list[str]:
    return [c for c in ("doc", "tie") if c in df.columns]


def _lines(rows: DataFrame) -> DataFrame:
    """``doc, [tie,] line_no, line`` of all lines; numbers start at 1, as in the document."""
    own = _document(rows)
    return rows.select(*own, F.posexplode(F.split("text", "\n")).alias("k", "line")).select(*own, (F.col("k") + 1).alias("line_no"), "line")


def _split(line: Column, whole: bool = False) -> Column:
    """A line, or a ``whole`` text of lines, between its blanks, empty strings included; most have spaces only.

    Line ends are replaced after the search, as a generator would do it anew for each blank that is searched.
    """
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\x0b"))
    plain = F.replace(line, F.lit("\n"), F.lit(" ")) if whole else line
    return F.split(F.when(other, F.translate(plain, "\t\r\f\x0b", "    ")).otherwise(plain), " ")


def _worded(line: Column) -> Column:
    """Whether a line has a word: seen at its first characters, without decoding the line."""
    return F.ltrim(line, F.lit(BLANKS)) != ""


def _words(line: Column) -> Column:
    """A line's distinct words."""
    return F.array_remove(F.array_distinct(_split(line)), "")


def _rarity(rows: DataFrame) -> list[int]:
    """Counts of all texts' words by hash bucket, as logarithms: a table of fixed size."""
    words = rows.select(F.explode(_split(F.col("text"), whole=True)).alias("w")).select(F.xxhash64("w").bitwiseAND(RARITY_BUCKETS - 1).alias("b"))
    levels = [0] * RARITY_BUCKETS
    for b, n in words.groupBy("b").count().collect():
        levels[b] = min(127, int(3 * math.log2(n)))
    return levels


def _numbers(values: list[int], kind: str) -> Column:
    """An array of numbers that is folded to one literal of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _ordered(line: Column, levels: list[int]) -> Column:
    """Each distinct word as a number, sorted: rarer words come first; equal words are equal.

    Words are told apart by 64-bit hashes here; verification compares the words themselves.
    Nothing in the array can be null, so it is sorted as plain numbers.
    """
    table = _numbers(levels, "bigint")
    hashes = F.array_remove(F.array_distinct(F.transform(_split(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.coalesce(F.get(table, h.bitwiseAND(RARITY_BUCKETS - 1).cast("int")), F.lit(0).cast("long")), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _bitmap(keys: Column, odd: bool = False) -> Column:
    """Parities of the words by 64 buckets: a word that one line only has flips one bit.

    ``odd``: of the words alone whose number has bit 6; together these are 128 buckets.
    """
    bit = lambda k: F.shiftright(k, 6).bitwiseAND(1) if odd else F.lit(1).cast("long")
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(63).cast("int"))))


def _place(df: DataFrame) -> list[str]:
    """Columns of a line's place, which also order lines."""
    return [*_document(df), "line_no"]


def _postings(lines: DataFrame, levels: list[int], similar: float) -> DataFrame:
    """``doc, [tie,] line_no, bits, odd, size, key``: a row for each word of the prefix of each distinct text.

    The place is the text's first; ``size`` holds the number of words, and in its lower half
    the word's position. Two sets of at least this similarity share one of the first
    n - ceil(similar * n) + 1 of their words in any common order. Texts are told apart
    by a hash, their number of words and their parities; copies are combined before the
    shuffle, and no text is shuffled. Rows are flat and narrow, since there are many.
    """
    rows = lines.select(F.struct(*_place(lines)).alias("at"), F.xxhash64("line").alias("text"), _ordered(F.col("line"), levels).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", F.lit(1), n - F.ceil(n * F.lit(similar) - F.lit(1e-9)).cast("int") + 1)
    odd = F.when(n > LONG, _bitmap(F.col("keys"), odd=True)).otherwise(F.lit(0).cast("long"))
    rows = rows.select("at", "text", n.alias("n"), _bitmap(F.col("keys")).alias("bits"), odd.alias("odd"), prefix.alias("prefix"))
    once = rows.groupBy("text", "n", "bits", "odd").agg(F.min("at").alias("at"), F.min("prefix").alias("prefix"))
    spread = once.select("at", "n", "bits", "odd", F.posexplode("prefix").alias("i", "key"))
    return spread.select("at.*", "bits", "odd", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i")).alias("size"), "key")


def _n(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.size"), 32).cast("int")


def _i(side: str) -> Column:
    return F.col(f"{side}.size").bitwiseAND(0xFFFFFFFF).cast("int")


def _differ() -> Column:
    """The least number of words that only one of two lines has: 128 buckets if both are long."""
    every, odd = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("bits", "odd"))
    return F.when((_n("a") > LONG) & (_n("b") > LONG), F.bit_count(odd) + F.bit_count(every.bitwiseXOR(odd))).otherwise(F.bit_count(every))


def _may_match(similar: float) -> Column:
    """Length, positional and bitmap filters on two postings, a and b, of one word."""
    n_a, n_b = _n("a"), _n("b")
    need = F.lit(similar / (1 + similar)) * (n_a + n_b) - F.lit(1e-9)
    most = F.least(n_a - _i("a"), n_b - _i("b"))
    return (F.least(n_a, n_b) >= F.lit(similar) * F.greatest(n_a, n_b) - F.lit(1e-9)) & (most >= need) & ((n_a + n_b - _differ()) / 2 >= need)


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Of pairs (x, y) of places, the x whose Jaccard similarity is high enough."""
    x, y = (texts.select(F.col("at").alias(side), F.col("line").alias(f"l{side}")) for side in "xy")
    both = pairs.join(x, "x").join(y, "y").select("x", _words(F.col("lx")).alias("wx"), _words(F.col("ly")).alias("wy"))
    shared = F.size(F.array_intersect("wx", "wy"))
    return both.where(F.lit(1 + similar) * shared >= F.lit(similar) * (F.size("wx") + F.size("wy")) - F.lit(1e-9)).select("x").distinct()


def _spot(at: Column) -> Column:
    return F.pmod(F.xxhash64(at), F.lit(MATCH_BITS))


def _bit_set(places: DataFrame) -> list[int]:
    """Bits of the hashes of the places, of fixed size: a set with false positives only."""
    one = F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.col("p").bitwiseAND(31).cast("int"))
    found = places.select(_spot(F.col("at")).alias("p")).groupBy(F.shiftright("p", 5).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = [0] * (MATCH_BITS >> 5)
    for word, bits in found.collect():
        out[word] = bits
    return out


def _in_set(members: list[int], at: Column) -> Column:
    """Whether a place may be in the set."""
    word = F.get(_numbers(members, "bigint"), F.shiftright(_spot(at), 5).cast("int"))
    return F.getbit(word, _spot(at).bitwiseAND(31).cast("int")) == 1


def similar_lines(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc, [tie,] line_no`` of each line of ``rows(doc, [tie,] text)`` that is the first of its text yet matches an earlier line.

    1. Each text is one class, so copies cost nothing in what follows.
    2. Postings of all prefixes meet by word; a semi-join with the filters keeps those that
       may match another, at most one row for each posting. Both sides are one shuffle.
    3. Texts of those classes only are fetched. Each class is verified against one first
       class of its words' lists, that of the nearest bitmap. In a large group of near
       copies nearly all are settled here by one pair each.
    4. Those still open are verified against all earlier classes in their lists.
    No list is cut and no pair is left out: what step 3 settles has an earlier match.
    """
    lines, spark = _lines(rows), rows.sparkSession
    postings = _postings(lines, _rarity(rows), similar)
    earlier = F.col("b.at") < F.col("a.at")
    a, b = postings.alias("a"), postings.alias("b")
    place = _place(lines)
    other = reduce(or_, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place])
    hits = checkpoint(a.join(b, (F.col("a.key") == F.col("b.key")) & _may_match(similar) & other, "left_semi")).withColumn("at", F.struct(*place))
    held = _in_set(_bit_set(hits.select("at")), F.col("at"))
    folder = shared_folder(spark, "line_texts")
    lines.select(F.struct(*place).alias("at"), "line").where(held).write.parquet(folder)
    texts = spark.read.parquet(folder)

    first = hits.groupBy("key").agg(F.min(F.struct("at", "size", "bits", "odd")).alias("f")).select("key", "f.*")
    a, b = hits.alias("a"), first.alias("b")
    found = a.join(b, F.col("a.key") == F.col("b.key")).where(earlier & _may_match(similar))
    near = found.select(F.col("a.at").alias("x"), F.struct(_differ().alias("differ"), F.col("b.at").alias("y")).alias("to"))
    tried = checkpoint(near.groupBy("x").agg(F.min("to").alias("to")).select("x", "to.y"))
    settled = checkpoint(_verified(tried, texts, similar))
    still = hits.join(settled, F.col("at") == F.col("x"), "left_anti")
    a, b = still.alias("a"), hits.alias("b")
    rest = a.join(b, F.col("a.key") == F.col("b.key")).where(earlier & _may_match(similar)).select(F.col("a.at").alias("x"), F.col("b.at").alias("y")).distinct()
    rest = rest.join(tried, ["x", "y"], "left_anti")
    return settled.unionByName(_verified(rest, texts, similar)).select("x.*")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``<id>, n_lines, n_removed, removed, text_hash``: numbers of the lines that match an earlier line.

    Lines are sets of words between ASCII white space, in the order of (id, line number);
    a line goes if the Jaccard similarity with any earlier line is ``similar`` or more, its
    own document's included. Lines without a word stay. Null and empty texts are one
    empty line; lines of any length and words of any frequency are compared. Rows of a
    null id come first; those and rows that repeat an id are told apart by their texts, in
    the order of a hash. Rows that repeat id and text are one document, and each has its
    result. Extra columns are ignored; an empty table gives an empty result.
    """
    every = _rows(docs, id_col, text_col)
    own = _document(every)
    kept = _lines(every).where(_worded(F.col("line"))).groupBy(F.unhex(F.md5("line")).alias("h")).agg(F.min(F.struct(*own, "line_no")).alias("at")).select("at.*")
    later = similar_lines(every, similar).withColumn("later", F.lit(1))
    same = reduce(and_, [F.col(f"k.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*own, "line_no")])
    kept = kept.alias("k").join(later.alias("l"), same, "left_anti").groupBy(*own).agg(F.collect_list("line_no").alias("kept"))
    rows = every.select(*own, F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("ls"))
    rows = rows.select(*own, "text_hash", F.size("ls").alias("n_lines"), F.filter(F.transform("ls", lambda x, i: F.when(_worded(x), i + 1)), lambda x: x.isNotNull()).alias("worded"))
    out = rows.alias("k").join(kept.alias("l"), reduce(and_, [F.col(f"k.{c}").eqNullSafe(F.col(f"l.{c}")) for c in own]), "left")
    removed = F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>")))
    return out.select(F.col("k.doc").alias(id_col), "n_lines", removed.alias("removed"), "text_hash").select(id_col, "n_lines", F.size("removed").alias("n_removed"), "removed", "text_hash")


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``line_dedup`` found taken out of their texts."""
    key, digest, gone = free(docs.columns, "key", "digest", "gone")
    found = removed.groupBy(F.col(id_col).alias(key), F.col("text_hash").alias(digest)).agg(F.min("removed").alias(gone))
    own = F.xxhash64(text_of(docs, text_col))
    left = F.filter(F.split(text_of(docs, text_col), "\n"), lambda x, i: ~F.array_contains(F.coalesce(gone, F.array().cast("array<int>")), i + 1))
    return docs.join(found, docs[id_col].eqNullSafe(F.col(key)) & (own == F.col(digest)), "left").withColumn(text_col, F.array_join(left, "\n")).drop(key, digest, gone)


#: The same for DuckDB: exact word frequencies, prefixes, then all their pairs verified.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
worded AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM l WHERE regexp_matches(line, '[^ \t\r\f\x0B]')),
cls AS (SELECT line, min(pos) AS pos FROM worded GROUP BY line),
w AS (SELECT pos, unnest(list_distinct(list_filter(regexp_split_to_array(line, '[ \t\r\f\x0B]+'), lambda x: x <> ''))) AS w FROM cls),
sizes AS (SELECT pos, count(*) AS n FROM w GROUP BY pos),
rare AS (SELECT w, count(*) AS df FROM w GROUP BY w),
ranked AS (SELECT pos, w, n, row_number() OVER (PARTITION BY pos ORDER BY df, w) AS i FROM w JOIN rare USING (w) JOIN sizes USING (pos)),
prefix AS (SELECT * FROM ranked WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.pos AS x, a.n AS nx, b.pos AS y, b.n AS ny FROM prefix a JOIN prefix b USING (w)
          WHERE b.pos < a.pos AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
later AS (SELECT DISTINCT x FROM (SELECT x, y, nx, ny, count(*) AS o FROM pairs JOIN w a ON a.pos = x JOIN w b ON b.pos = y AND b.w = a.w GROUP BY ALL)
          WHERE o >= 0.8 * (nx + ny - o) - 1e-9),
gone AS (SELECT doc_id, line_no FROM worded JOIN cls USING (line) WHERE worded.pos > cls.pos OR cls.pos IN (SELECT x FROM later)),
lists AS (SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN lists USING (doc_id)"""
