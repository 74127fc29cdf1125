"""Training-data pipeline: five stages, each an operator of ``logweave.llm`` over all rows.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame; it is written as Parquet under
the shared folder and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``; the last returns the encoded documents.

Defined results: a null text counts as empty in every stage (scored as a text without words, equal to
other empty texts, linked with nothing, without tokens); very long texts go through whole; of repeated
rows with a doc_id one stays after the exact dedup; rows with a null doc_id are never dropped as near
copies; ties go to the smallest doc_id; further columns, of whatever names, are kept up to
the last stage; an empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from logweave.llm.common import shared_table, table
from logweave.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that are predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of linked documents the smallest doc_id stays."""
    return ngram_join.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents drawn by their calibrated probabilities stay."""
    return mixing.draw(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids of every document, with the digests of ids and decoded text."""
    return bpe.round_trip(docs, tokenizer_path(), with_ids=True)


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing sources to target weights", mixed), ("BPE encoding and decoding", encoded)]

#: SQL can express neither the classifier nor the encoder; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
