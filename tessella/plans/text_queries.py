"""Text operators on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.inputs import table

_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_CLEAN = (
    "trim(regexp_replace(translate(lower(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g')), " + _PUNCT + ", ''), '\\s+', ' ', 'g'))"
)


def _on(sql: str, column: str) -> str:
    return sql.replace("{c}", column)


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


def text_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    steps = {"lower": text.lower(c), "punctuation": text.remove_punctuation(c), "space": text.squeeze_space(c), "urls": text.remove_urls(c), "tags": text.remove_tags(c), "numbers": text.remove_numbers(c)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(v).alias(k) for k, v in steps.items()])


def text_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean(F.col("html"), numbers=True)
    return table(spark, sf_dir, "pages").select("page_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).alias("longest"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = text.token_rows(docs, ["doc_id"], F.lower("text"), '.,;:!?"()', ["un", "re"], lambda w: w, ["unter", "reich", "un", "und"])
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("surface")).alias("letters"))


def text_token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their offsets: a running sum of lengths; only numbers are shuffled, no text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    sizes = lines.select("doc_id", (F.col("k") + 1).alias("line_no"), (F.length("line") + 1).alias("n"), F.size(text.words(F.col("line"))).alias("n_words"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("doc_id", "line_no", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("start"), "n_words")


def text_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_words(table(spark, sf_dir, "documents"))


def text_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.tidy_spacing(F.regexp_replace("text", r"\|", " , "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("digest"))


QUERIES = [text_clean, text_steps, text_clean_pages, text_words, text_sentences, text_tokens, text_token_lines, text_top_words, text_tidy]
_WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
ORACLES = {
    "text_clean": f"SELECT doc_id, length(c)::INT AS n, md5(c) AS digest FROM (SELECT doc_id, {_on(_CLEAN, 'text')} AS c FROM documents)",
    "text_steps": f"""SELECT doc_id, md5(lower(text)) AS "lower", md5(translate(text, {_PUNCT}, '')) AS punctuation, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS space,
        md5(regexp_replace(text, 'https?://\\S+|www\\.\\S+', '', 'g')) AS urls, md5(regexp_replace(text, '<[^>]+>', '', 'g')) AS tags, md5(regexp_replace(text, '\\d+', '', 'g')) AS numbers FROM documents""",
    "text_clean_pages": "SELECT page_id, length(c)::INT AS n, md5(c) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace("
    + _on(_CLEAN, 'html')
    + ", '\\d+', '', 'g'), '\\s+', ' ', 'g')) AS c FROM pages)",
    "text_words": f"SELECT doc_id, len({_on(_WORDS, 'text')})::INT AS n_words, len(list_distinct({_on(_WORDS, 'text')}))::INT AS n_distinct FROM documents",
    "text_sentences": r"""SELECT doc_id, len(s)::INT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM
        (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""",
    "text_tokens": r"""WITH raw AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents),
        cut AS (SELECT doc_id, regexp_extract(w, '^[.,;:!?"()]*') AS l, regexp_replace(regexp_replace(w, '^[.,;:!?"()]+', ''), '[.,;:!?"()]+$', '') AS m,
                       regexp_extract(regexp_replace(w, '^[.,;:!?"()]+', ''), '[.,;:!?"()]*$') AS r FROM raw),
        pre AS (SELECT *, CASE WHEN m IN ('unter', 'reich', 'un', 'und') THEN '' WHEN m LIKE 'un_%' THEN 'un' WHEN m LIKE 're_%' THEN 're' ELSE '' END AS p FROM cut),
        t AS (SELECT doc_id, 'punct' AS kind, l AS s FROM pre UNION ALL SELECT doc_id, 'punct', r FROM pre UNION ALL SELECT doc_id, 'clitic', p FROM pre UNION ALL SELECT doc_id, 'word', substr(m, length(p) + 1) FROM pre)
        SELECT doc_id, kind, count(*) AS n, sum(length(s))::BIGINT AS letters FROM t WHERE s <> '' GROUP BY ALL""",
    "text_token_lines": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM l)
        SELECT doc_id, line_no::INT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start,
               len({_on(_WORDS, 'line')})::INT AS n_words FROM x""",
    "text_top_words": f"""WITH w AS (SELECT lang, unnest({_on(_WORDS, _on(_CLEAN, 'text'))}) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT lang, rank::INT AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 10""",
    "text_tidy": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '|', ' , '), '\s+', ' ', 'g'), ' +([.,:;!?)\]»،؛؟])', '\1', 'g'), '([(\[«]) +', '\1', 'g'))) AS digest FROM documents""",
}
