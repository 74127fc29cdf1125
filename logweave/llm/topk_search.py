"""Operator 6, exact top-k search by inner product with norm buckets.

Components become ``floor(64 * x)``.  Vectors are grouped by length into buckets and, inside
a bucket, into chunks of about ``CHUNK`` rows; queries are packed in blocks.  A first pass
over the chunk of the longest vectors gives each query a lower bound of its k-th score.
With that bound a (block, chunk) pair survives only if some query could still reach it by
length, so the others are never shipped.  For a query and a chunk, bound / (own length *
longest length) is the local cosine threshold: above 1 the chunk is skipped, from
``COORDINATE_FROM`` on candidates come from the feasible ranges of the query's largest
coordinates, below it from the vectors that are long enough.  Their exact integer products
decide.  A task sees one query block and ``CHUNKS_PER_TASK`` chunks, longest first, and
raises the bounds as it goes; a last top-k merges at most k rows per query and task.

Defined results: a null vec_id, a null vector and one with null or non-finite components
take no part; of rows with equal vec_id the smallest vector counts; shorter vectors are
padded with zeros; ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

K = 20
SCALE = 64
BUCKETS = 16
CHUNK = 2048
QUERY_BLOCK = 1024
CHUNKS_PER_TASK = 8
#: local cosine threshold from which coordinates prune better than lengths
COORDINATE_FROM = 0.6
FOCUS = 3
#: products stay exact in doubles below this bound
EXACT = float(2**52)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of long) and length of the vectors that take part."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(SCALE * e.cast("double")))
    rows = embeddings.select("vec_id", F.when(ok, whole).alias("v")).where("v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.sqrt(square).alias("length"))


_PACK = "pack int, longest double, rows int, ids binary, matrix binary"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per pack: ids and vectors, longest first."""
    rows = rows.sort_values(["length", "vec_id"], ascending=[False, True])
    width = max((len(v) for v in rows["v"]), default=0)
    matrix = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows["v"]):
        matrix[i, :len(v)] = v
    return pd.DataFrame({"pack": rows["pack"].iloc[:1], "longest": rows["length"].iloc[:1], "rows": [len(rows)],
                         "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]})


def _unpack(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(matrix, np.int64).reshape(len(ids), -1)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


class _Chunk:
    def __init__(self, ids: bytes, matrix: bytes):
        self.ids, self.matrix = _unpack(ids, matrix)
        self.real = self.matrix.astype(np.float64)
        self.length = np.sqrt((self.real**2).sum(1))
        self.unit = self.real / np.maximum(self.length, 1e-300)[:, None]


def _products(queries: np.ndarray, vectors: np.ndarray, largest: float) -> np.ndarray:
    if largest < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _search(query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, chunk: _Chunk, k: int):
    """Rows (query, vec_id, score) of each query's k best in the chunk, and what may be pruned is."""
    queries, matrix = _same_width(queries, chunk.matrix)
    real = queries.astype(np.float64)
    length = np.sqrt((real**2).sum(1))
    longest = chunk.length[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(bound == -np.inf, -1.0, np.where(length * longest > 0, bound / (length * longest), np.where(bound > 0, 2.0, -1.0)))
    live = np.flatnonzero(cosine <= 1 + 1e-9)
    by_coordinate = live[(cosine[live] >= COORDINATE_FROM) & (longest > 0)]
    by_length = live[~np.isin(live, by_coordinate)]
    largest = longest * length.max(initial=0)
    out = []

    def keep(q: int, at: np.ndarray, score: np.ndarray) -> None:
        own = (chunk.ids[at] != query_ids[q]) & (score >= bound[q])
        at, score = at[own], score[own]
        if len(score) > k:
            own = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[own], score[own]
        best = np.lexsort((chunk.ids[at], -score))[:k]
        if len(best):
            out.append((np.full(len(best), q), chunk.ids[at[best]], score[best]))

    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(length[by_length] > 0, bound[by_length] / length[by_length], -np.inf) - 1e-9
        counts = np.searchsorted(-chunk.length, -least, "right")  # lengths fall
        part = max(1, int(counts.max(initial=0)))
        score = _products(queries[by_length], matrix[:part], largest)
        for i, q in enumerate(by_length):
            keep(q, np.arange(counts[i]), score[i, :counts[i]])
    for q in by_coordinate:
        unit = real[q] / length[q]
        possible = chunk.length >= bound[q] / length[q] - 1e-9
        spread = np.arccos(min(1.0, cosine[q]))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + spread)) - 1e-9, np.cos(max(0.0, angle - spread)) + 1e-9
            if f < chunk.unit.shape[1]:
                possible &= (chunk.unit[:, f] >= low) & (chunk.unit[:, f] <= high)
            elif not low <= 0 <= high:
                possible[:] = False
        at = np.flatnonzero(possible)
        if len(at):
            keep(q, at, _products(queries[q:q + 1], matrix[at], largest)[0])
    return out


def _bounds(query_ids, queries, chunk, k) -> np.ndarray:
    bound = np.full(len(query_ids), -np.inf)
    for q, _, score in _search(query_ids, queries, bound, chunk, k):
        if len(score) == k:
            bound[q[0]] = score[-1]
    return bound


def _first_bounds(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Lower bound of each query's k-th score from the chunk of the longest vectors."""
    out = []
    for r in rows.itertuples():
        ids, queries = _unpack(r.ids, r.matrix)
        bound = _bounds(ids, queries, _Chunk(r.c_ids, r.c_matrix), k)
        length = np.sqrt((queries.astype(np.float64)**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(bound > 0, np.where(length > 0, bound / length, np.inf), -np.inf)
        out.append((r.pack, float(need.min(initial=np.inf)), bound.tobytes()))
    return pd.DataFrame(out, columns=["pack", "need", "bounds"])


def _block_task(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best rows of one query block over its chunks, longest first."""
    first = rows.iloc[0]
    ids, queries = _unpack(first["ids"], first["matrix"])
    bound = np.frombuffer(first["bounds"], np.float64).copy()
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.sort_values(["c_longest", "c_pack"], ascending=[False, True]).itertuples():
        for q, found, score in _search(ids, queries, bound, _Chunk(r.c_ids, r.c_matrix), k):
            q = int(q[0])
            if q in best:
                found, score = np.concatenate([best[q][0], found]), np.concatenate([best[q][1], score])
            order = np.lexsort((found, -score))[:k]
            best[q] = found[order], score[order]
            if len(order) == k:
                bound[q] = max(bound[q], score[order[-1]])
    if not best:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    return pd.DataFrame({"query_id": np.repeat([ids[q] for q in best], [len(v[0]) for v in best.values()]),
                         "vec_id": np.concatenate([v[0] for v in best.values()]), "score": np.concatenate([v[1] for v in best.values()])})


def top_k(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors of every query (vec_id divisible by ``every``)."""
    rows = shared_table(quantised(embeddings), "vectors")
    edges = rows.agg(F.percentile_approx("length", [i / BUCKETS for i in range(1, BUCKETS)])).first()[0] or []
    bucket = F.lit(0)
    for edge in sorted(set(edges)):  # 0: the longest
        bucket = bucket + (F.col("length") < F.lit(edge)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sizes = dict(sorted((r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().collect()))  # at most BUCKETS numbers
    first, packs, offset, share = 0, 0, F.lit(0), F.lit(1)
    for b, n in sizes.items():
        parts = -(-n // CHUNK)
        offset, share = F.when(F.col("bucket") == b, first).otherwise(offset), F.when(F.col("bucket") == b, parts).otherwise(share)
        first += parts
    packs = first
    chunks = shared_table(rows.withColumn("pack", (offset + F.pmod(F.xxhash64("vec_id"), share)).cast("int")).select("pack", "vec_id", "v", "length")
                          .groupBy("pack").applyInPandas(_pack, _PACK), "chunks")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-sum(sizes.values()) // (every * QUERY_BLOCK)))
    queries = shared_table(asked.withColumn("pack", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).select("pack", "vec_id", "v", "length")
                           .groupBy("pack").applyInPandas(_pack, _PACK), "queries")
    chunk = chunks.select(*[F.col(c).alias(f"c_{c}") for c in ("pack", "longest", "ids", "matrix")])
    seeds = (queries.select("pack", "ids", "matrix", F.lit(0).alias("c_pack")).join(chunk.where("c_pack = 0"), "c_pack")
             .repartition(blocks, "pack").select("pack", "ids", "matrix", "c_ids", "c_matrix")
             .mapInPandas(lambda it: (_first_bounds(x, k) for x in it), "pack int, need double, bounds binary"))
    seeds = shared_table(seeds, "bounds")
    pairs = (seeds.select("pack", "need", F.explode(F.sequence(F.lit(0), F.lit(max(0, packs - 1)))).alias("c_pack"))
             .join(chunks.select(F.col("pack").alias("c_pack"), F.col("longest").alias("reach")), "c_pack")
             .where(F.col("reach") >= F.col("need") - 1e-6).select("pack", "c_pack"))
    work = (pairs.join(chunk, "c_pack").join(queries.select("pack", "ids", "matrix"), "pack").join(seeds.select("pack", "bounds"), "pack")
            .withColumn("part", F.floor(F.col("c_pack") / CHUNKS_PER_TASK)))
    best = work.groupBy("pack", "part").applyInPandas(lambda pdf: _block_task(pdf, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
