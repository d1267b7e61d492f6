"""Inputs that several queries share, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators.lineage import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """A small table that the library itself holds."""
    return spark.createDataFrame(values, schema)


def values(alias: str, columns: str, items: list[tuple]) -> str:
    """The same table for the oracle."""
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{alias}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, i)) + ")" for i in items) + ")"


def seq_of(conv: Column, turn: Column) -> Column:
    """A turn's name, told apart from all others however many turns there are."""
    return F.concat(conv.cast("string"), F.lit(":"), turn.cast("string"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words of all conversation turns: ``seq, pos, surface``."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(seq_of(F.col("conv_id"), F.col("turn")).alias("seq"), F.posexplode(text.words(F.lower("text"))).alias("pos", "surface"))


TOKENS = r"""tokens AS (SELECT seq, unnest(ws) AS surface, generate_subscripts(ws, 1) - 1 AS pos FROM
  (SELECT conv_id || ':' || turn AS seq, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM conversations))"""

#: Marker words of the tables' languages, as a clause segmenter takes them.
MARKERS = [
    ("and", "CONJUNCTION", 1), ("und", "CONJUNCTION", 1), ("et", "CONJUNCTION", 1), ("y", "CONJUNCTION", 1),
    ("that", "RELATIVE", 2), ("que", "RELATIVE", 2), ("die", "RELATIVE", 2), ("qui", "RELATIVE", 2),
    ("of", "PREPOSITION", 3), ("de", "PREPOSITION", 3), ("in", "PREPOSITION", 3), ("en", "PREPOSITION", 3), ("zu", "PREPOSITION", 3),
]
PREPOSITIONS = ["of", "de", "in", "en", "zu"]
CONJUNCTIONS = ["and", "und", "et", "y"]
#: Words that put a mood on the word after them.
MOODS = [("to", "SUBJUNCTIVE"), ("pour", "SUBJUNCTIVE"), ("que", "SUBJUNCTIVE"), ("not", "JUSSIVE"), ("nicht", "JUSSIVE"), ("no", "JUSSIVE"), ("is", "JUSSIVE")]

#: Latin letters of the tables' words, and the Arabic letters and marks that stand for them in queries on Arabic.
LATIN = "btdrsfqklmnhwyjzvcgpxßàaeiouéèêçäöüáíóúñ"
ARABIC = "بتدرسفقكلمنهويجزعحغطخشضَْ\u0650ّ\u064fاىآةأؤإئءـ\u064c\u064b"
_LETTERS = f"[^{LATIN}]+"


def distinct_words(df: DataFrame, c: Column, other: str, name: str) -> DataFrame:
    """``name``: the distinct words of a column's texts, parted by a pattern of what is no word.

    They are checkpointed: Spark moves a condition on a word below the distinct, where it
    would be tested anew at each place where the word stands, and a query that names the
    words twice would read all texts twice.
    """
    return checkpoint(df.select(F.explode(F.split(c, other)).alias(name)).where(F.col(name) != "").distinct())


def arabic_words(spark: SparkSession, sf_dir: str, more: list[tuple[int, str]]) -> DataFrame:
    """``id, surface``: distinct words of documents in Arabic letters, and ``more`` vocalised ones of the grammar."""
    words = distinct_words(table(spark, sf_dir, "documents"), F.lower("text"), _LETTERS, "id")
    own = words.select("id", F.translate("id", LATIN, ARABIC).alias("surface"))
    if not more:
        return own
    return own.unionByName(rows(spark, "id string, surface string", [(f"word {k}", w) for k, w in more]))


def arabic_words_sql(more: list[tuple[int, str]]) -> str:
    """The same for the oracle, as a table ``w``."""
    own = values("own", "id, surface", [(f"word {k}", w) for k, w in more]) if more else "own AS (SELECT '' AS id, '' AS surface WHERE false)"
    return (
        own
        + f""", w AS (SELECT id, translate(id, '{LATIN}', '{ARABIC}') AS surface FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '{_LETTERS}', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS id FROM documents)
    UNION ALL SELECT * FROM own)"""
    )


#: Letters that are no radical as they stand.
_NO_RADICAL = "[^ء-غف-ي]|[اىآأإؤئةـ]"
_RADICALS = f"left(regexp_replace(surface, '{_NO_RADICAL}', ''{{g}}), 3)"


def arabic_roots(spark: SparkSession, sf_dir: str, more: list[tuple[str, str, str]]) -> DataFrame:
    """``root``: the first three radicals of each word of ``arabic_words``, as a string; and ``more``."""
    own = arabic_words(spark, sf_dir, []).select(F.expr(_RADICALS.format(g="")).alias("root")).where("length(root) = 3")
    return checkpoint(own.union(rows(spark, "root string", [("".join(r),) for r in more])).distinct())


def arabic_roots_sql(more: list[tuple[str, str, str]]) -> str:
    """The same for the oracle: tables ``w`` and ``r``, this with the radicals as c1, c2 and c3."""
    known = values("known", "root", [("".join(r),) for r in more]) if more else "known AS (SELECT '' AS root WHERE false)"
    return (
        arabic_words_sql([])
        + f""", {known}, r AS (SELECT root, root[1] AS c1, root[2] AS c2, root[3] AS c3 FROM
    (SELECT {_RADICALS.format(g=", 'g'")} AS root FROM w UNION SELECT root FROM known) WHERE length(root) = 3)"""
    )


def pick(number: str, items: list) -> Column:
    """One of some values by a whole number, an expression that both engines read alike."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.expr(number) % len(items) + 1).cast("int"))


def pick_sql(number: str, items: list) -> str:
    quoted = ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in items)
    return f"([{quoted}])[({number}) % {len(items)} + 1]"
