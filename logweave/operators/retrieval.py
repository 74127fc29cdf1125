"""Vector retrieval (G-1 ... G-5); the search itself is in ``metric_topk``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .metric_topk import MetricTopK, numbered


def l2_normalize(vec: Column) -> Column:
    """G-1: unit-norm vector (zero vectors stay zero)."""
    def norm(v: Column) -> Column:
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.element_at(F.transform(F.array(vec), norm), 1)


def with_embeddings(chunks: DataFrame, vectors: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """G-1: attach unit-norm vectors to chunks by key (equi-join; null where a chunk has none)."""
    return chunks.join(vectors.select(key, l2_normalize(F.col(vec_col)).alias("embedding")), key, "left")


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, query_id: str = "query_id",
                vec_id: str = "vec_id", query_vec: str = "embedding", vec_col: str = "embedding",
                exclude_self: bool = False, max_block_vectors: int = 2048,
                max_block_queries: int = 2048) -> DataFrame:
    """G-2: ``(query_id, rank, vec_id, distance)`` with cosine distance = 1 - cos.

    Exact; cells of vectors that can't hold a better one are skipped (see ``metric_topk``).
    Empty (all-zero / null) query vectors get no results.  ``exclude_self`` drops a vector whose
    id equals the query id.  Ties break on the vector id.
    """
    run = MetricTopK(numbered(queries, query_id, query_vec), numbered(vectors, vec_id, vec_col), k, exclude_self,
                     max_block_vectors, max_block_queries)
    return run.result.select(F.col("qid").alias(query_id), "rank", F.col("vid").alias(vec_id), "distance")


def format_context(results: DataFrame, key: str = "query_id", source_col: str = "source",
                   text_col: str = "text", skip_empty: bool = False) -> DataFrame:
    """G-3: ``Source: s\\ntext`` blocks in rank order joined by a blank line.

    ``skip_empty=True`` is the docs-agent variant (blocks with blank text
    left out).  The per-key list holds at most ``k`` items.
    """
    txt = py_strip(F.coalesce(F.col(text_col), F.lit("")))
    src = F.coalesce(F.col(source_col), F.lit("unknown"))
    item = F.struct(F.col("rank"), F.concat(F.lit("Source: "), src, F.lit("\n"), txt).alias("b"), (txt != "").alias("ok"))
    grouped = results.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    items = F.col("_items")
    if skip_empty:
        items = F.filter(items, lambda x: x["ok"])
    return grouped.select(key, F.array_join(F.transform(items, lambda x: x["b"]), "\n\n").alias("context"))


def index_stats(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """G-4: documents indexed (non-empty text with at least one chunk) and chunks indexed."""
    per_doc = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ok = docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(key).join(per_doc, key)
    return ok.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def rag_query(rag_query_col: Column, query_col: Column, summary_col: Column) -> Column:
    """G-5: rag_query | query | summary (first non-empty)."""
    return F.coalesce(F.nullif(rag_query_col, F.lit("")), F.nullif(query_col, F.lit("")),
                      F.nullif(summary_col, F.lit("")))
