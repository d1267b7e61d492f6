"""Queries of the document operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import table
from .edit_fingerprint import compare_edited, near_duplicates
from .exact_dedup import exact_dedup
from .langid import classify, held_out, learn
from .licenses import oracle as license_oracle
from .licenses import scan_licenses
from .line_dedup import ORACLE as LINE_ORACLE
from .line_dedup import line_dedup
from .packing import pack_documents
from .simhash import fp_hex, simhash_components
from .token_parquet import document_tokens
from .token_scan import document_token_counts
from .toxicity import THRESHOLD, toxicity
from .toxicity import learn as learn_toxicity
from .turn_repair import damage, repair_report
from .whitening import whiten

BPE_RANKS = "byte_bpe_50k.tiktoken"
BPE_VOCABULARY = "byte_bpe_50k.json"
END_OF_TEXT = 50256
END_OF_DOCUMENT = 2


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ",")).drop("text_hash")


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


def edit_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4's banding and verification, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = learn_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    scored = toxicity(docs, net)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = learn(docs.where(~held_out("doc_id", 3, 1)))
    return classify(docs, content).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY), public_tokenizers.PATTERN, special=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY), public_tokenizers.PATTERN, END_OF_TEXT)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_report(damage(turns), ids=turns.select("conv_id"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY), public_tokenizers.PATTERN, END_OF_DOCUMENT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"edit_near_duplicates": edit_near_duplicates}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": LINE_ORACLE,
        "op7_licenses": license_oracle(),
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
