"""Registered queries of the training-data operators and their DuckDB SQL.

Every query applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, conversation_repair, exact_dedup, html_text, language_id, license_scan, merkle, mixing, ngram_join, sharding,
               token_records, topk_search, toxicity)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Public vocabulary file; ``LOGWEAVE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LOGWEAVE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents (held-out accuracy is tested instead of SQL)."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), d AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents through the sharded cuckoo index."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


@register("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of all documents and the text decoded from them, as digests (tested against the library)."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies over all documents (tested against brute force)."""
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


@register("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by the site style tree (tested on pages with known text)."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@register("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents by balanced label propagation (its law and cuts are tested)."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@register("op6_top_k", """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector against all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


@register("op3_mixing", mixing.oracle_sql())
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling probabilities and draws of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@register("op10_license_scan", license_scan.oracle_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages from fused evidence (held-out agreement is tested)."""
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@register("op11_token_records")
def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as framed records and read back (tested against the library)."""
    return token_records.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@register("op12_merkle_manifest", merkle.oracle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle tree over all documents with every row's proof."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


@register("op13_conversation_repair", conversation_repair.oracle_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))
