"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on everything its
predecessor kept. All stages but the last return the columns of documents,
and those beside them, with their values, whatever their names. Stages take
nulls in any column, empty and very long texts, ties and repeated rows; what
they make of these is said below. An empty table stays empty throughout.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, minhash, mixing, quality, secrets
from granary.scratch import scratch_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are common on their host.

    Null and empty texts fail; a null source is a host of its own; repeated
    rows are judged alike.
    """
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 80 % alike (see ``minhash.keep_one``).

    The smallest doc_id stays, nulls last. Of rows repeated as a whole one
    stays. Rows without words are alike to none and stay.
    """
    return minhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by the kind found; null texts stay null."""
    return secrets.redact_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; rows without words are never taken, a null source is a source."""
    return mixing.mix_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit), and whether the ids decode to the text."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = docs.select("doc_id", "source", "lang", "text")
    coded = bpe.encode_documents(docs, tokenizer, decoded="decoded")
    return coded.select(
        "doc_id",
        "source",
        "lang",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("bpe tokens", bpe_tokens),
]

#: SQL has no MinHash, redaction by linked spans, or BPE; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
