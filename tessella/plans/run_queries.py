"""Runs held against each other, streamed context, and pages as files in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.inputs import MOODS, rows, seq_of, table
from tessella.plans.sequence_queries import ORACLES as SEQUENCES
from tessella.sources import digests, page_files
from tessella.streaming import context


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session shares; below the warehouse if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def repartitioned_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up of events, run over three ways to deal them out: its digest must not change."""
    ways = {
        "round robin": lambda df: df.repartition(3),
        "by user": lambda df: df.repartition(7, "user_id"),
        "by time": lambda df: df.repartitionByRange(5, "ts"),
    }
    cents = F.round(F.col("value") * 100).cast("long")
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    roll_up = lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), first.alias("first_id"))
    return digests.determinism(roll_up, table(spark, sf_dir, "events"), ways)


def streamed_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream: the mood that each word hands to the next, by state that ends."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != context.STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", context.STORE)
    path = f"{sf_dir}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    words = turns.select(seq_of(F.col("conv_id"), F.col("turn")).alias("seq"), F.lit(0).alias("pos"), text.words(F.lower("text")).alias("words"))
    found = context.carry_mood_lists(words, F.broadcast(rows(spark, "marker string, mood string", MOODS)), "seq", "pos", "words", negators=["not", "no"], after=["or", "of"])
    folder = _folder(spark, "streamed_mood")
    # one batch and out: state that ends by processing time would keep a stream of all available data running
    found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(once=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows").where("carried_mood IS NOT NULL")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host as a book, written to files in order and read back."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("book"), "page_id", "html")
    folder = _folder(spark, "book_pages")
    page_files.write_pages(pages, folder, "book", "page_id", "html", file_bytes=64 << 20, range_bytes=4 << 20)
    return page_files.read_pages(spark, folder).select("book", "page", F.length("text").alias("n"), F.md5("text").alias("digest"))


QUERIES = [repartitioned_digests, streamed_mood, book_pages]

_RUN = """r AS (SELECT user_id, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY ALL),
  s AS (SELECT concat_ws('|', """ + ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'N')" for c in ("cents", "event_type", "first_id", "n", "user_id")) + """) AS t FROM r),
  d AS (SELECT count(*) AS n_rows, sum(('0x' || substr(md5(t), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest_sum, bit_xor(('0x' || substr(md5(t), 16, 15))::BIGINT) AS digest_xor FROM s)"""
ORACLES = {
    "repartitioned_digests": f"WITH {_RUN} SELECT way, n_rows, digest_sum, digest_xor, true AS stable FROM d, (VALUES ('round robin'), ('by user'), ('by time')) AS w(way)",
    "streamed_mood": SEQUENCES["carried_mood"],
    "book_pages": r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS book, page_id AS page, length(html)::INT AS n, md5(html) AS digest FROM pages",
}
