"""From raw documents to token ids: the stages of the corpus pipeline, in their order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as a
table in the shared folder and read again as the documents of the next stage. All stages
but the last return the columns of the documents they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.llm import bpe, decontaminate, langid, lines, simhash
from pagemark.llm.common import free_name, settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, that is null texts and those without a letter, go.

    Languages are learned from the labelled documents themselves.
    """
    profiles = langid.learn(docs)
    pred, score = (free_name(docs.columns, c) for c in ("lang_pred", "lang_score"))
    found = langid.identify(docs, profiles, pred=pred, score=score)
    return found.filter(F.col(pred) != langid.UNKNOWN).drop(pred, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; documents with nothing left but white space go."""
    return lines.dedupe_lines(docs).filter(F.col("text").rlike("\\S"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (little-endian unsigned 32-bit numbers), decoded once to check.

    Columns of theirs called ids, n_tokens or decodes give way.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decodes")))
    encoded = bpe.round_trip(docs, ranks, pattern)
    return encoded.select(
        *docs.columns, "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "decodes")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL cannot express the stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
