"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages but the last keep the columns of documents, whatever further ones there are; an empty table stays empty; texts are
taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgeway.llm import linedup, mixing, rules, spm, store, supermin


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the strict policy rejects.  A null or empty text has too few words and goes; repeated rows are judged alike."""
    return rules.keep_passing(docs, "strict-1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share.  Null texts stay null, rows without an id keep all; repeated rows lose the same lines."""
    return linedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest id; repeated rows shrink to one.  Rows without an id or without words stay."""
    return supermin.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, perhaps never.  A null source is one of its own; repeated rows are taken equally often."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.  A null text is empty: no ids."""
    return spm.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]
#: SentencePiece has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
