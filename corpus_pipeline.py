"""Cleans and packs a corpus: toxicity, language, exact and near copies, then sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, toxicity
from tessella.llm.common import free, shared_folder, table
from tessella.llm.exact_dedup import exact_distinct
from tessella.llm.packing import pack_documents
from tessella.llm.simhash import simhash_distinct


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from labelled rows outside the held-out fold."""
    net = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~langid.held_out("doc_id", 4, 2)))
    (score,) = free(docs.columns, "score")
    scored = toxicity.toxicity(docs, net, keep=tuple(docs.columns), name=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; learned from rows outside the held-out fold."""
    content = langid.learn(docs.where(~langid.held_out("doc_id", 3, 1)))
    names = free(docs.columns, *langid.NAMES)
    return langid.classify(docs, content, keep=tuple(docs.columns), names=tuple(names)).where(~F.col(names[-1])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id."""
    return exact_distinct(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints, that of the smallest id.

    A document without an id stays only where its component has no id, and then one alone;
    of documents that share an id, one text stays.
    """
    return simhash_distinct(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, balanced by attention cost."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack),
]

#: A trained network and compressed sizes are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
