"""Exact cosine top-k that skips cells by the triangle inequality of angles (G-2).

* ``pivots``: vectors drawn by the hash of their id, at most ``MAX_PIVOTS``, so their size is bounded.
* Every vector belongs to the cell of its nearest pivot; a cell's radius is its largest angle to the
  pivot.  Cells are cut into blocks of bounded size by the hash of the id, so a cell with any
  share of the vectors is spread.
* A query first meets the blocks of its home cell; its k-th best angle there bounds what it
  still looks for.  A cell whose pivot is farther than that bound plus its radius can't hold a
  better vector, so the query goes only to the blocks of the cells that are left.
* Blocks of vectors and of queries (those of one home cell) are rows, stored once each.  A task reads some
  blocks of queries and one share of the blocks of vectors (``SHARE_BYTES``), compares each pair that is left
  and hands on the best k of a query in the share: nothing is copied into a shuffle for a pair.
* Python holds two blocks at a time and compares ``SLICE_ROWS`` queries at once.

Nothing is approximate: a cell is skipped only if all its angles exceed the bound, and 32-bit products only
sort out what is farther than the best so far by more than their error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

MAX_PIVOTS = 1024
FLOATS = T.ArrayType(T.FloatType())
#: with so few blocks every query meets all of them
FEW_BLOCKS = 4
#: slack of an angle comparison, above rounding
EPS = 1e-7
#: rows compared at once, with all pivots or a block of vectors
SLICE_ROWS = 512
#: vectors that a task of the JVM holds, and the size of a file of blocks
SHARE_BYTES = 64 << 20
FILE_BYTES = 8 << 20
#: vectors gathered at once to compute what 32-bit products left
TIES_BYTES = 8 << 20
HIT = "qid long, vid long, distance double"
BLOCK = "cell int, vids binary, vs binary"
#: a block of queries and the cells in which some of them still look
WORK = "work long, qids binary, qs binary, bounds binary, cells array<int>, pairs long"


def _unit(rows) -> np.ndarray:
    m = np.asarray(rows, np.float64) if len(rows) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1)
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def _rows(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix, without a Python object per component."""
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (column.value_lengths().to_numpy(zero_copy_only=False) * len(column) != len(flat)).any():
        raise ValueError("all vectors must have the same length")
    return flat.reshape(len(column), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an Arrow list column."""
    return _unit(_rows(column))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``SLICE_ROWS`` rows, views of the same memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def numbered(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows that have both; 32-bit components stay 32-bit, half the bytes wherever they are stored."""
    v = F.col(vec_col)
    v = v if df.schema[vec_col].dataType == FLOATS else v.cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")


def _component(df: DataFrame) -> str:
    return "float" if df.schema["v"].dataType == FLOATS else "double"


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of ``count`` ids by the order of their hash (bounded by ``MAX_PIVOTS``)."""
    some = vectors.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(min(count, MAX_PIVOTS)).collect()
    return _unit([r.v for r in some])


def assign_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, v, cell, angle``: nearest pivot of each vector; zero vectors are in no cell's radius (angle 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            m = _matrix(batch.column("v"))
            a = _angles(m, pivots)
            cell = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(a[np.arange(len(m)), cell], pa.float64())],
                                             ["id", "v", "cell", "angle"])
    return df.mapInArrow(run, f"id long, v array<{_component(df)}>, cell int, angle double")


def _sorted(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's rows by id, their ids and their vectors."""
    group = group.take(np.argsort(group["id"].to_numpy(), kind="stable")).combine_chunks()
    return group, group["id"].to_numpy(), _rows(group["v"].chunk(0))


def _stored(rows: DataFrame, n_blocks: list[int], pack, schema: str, path: str, row_bytes: int) -> DataFrame:
    """The rows as blocks (a row each; ``n_blocks`` holds each cell's number of them), written once."""
    block = F.pmod(F.xxhash64("id"), F.get(F.lit(n_blocks), F.col("cell"))).cast("int")
    packed = rows.withColumn("block", block).groupBy("cell", "block").applyInArrow(pack, schema)
    packed.write.option("maxRecordsPerFile", max(1, FILE_BYTES // row_bytes)).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _pack_vectors(group: pa.Table) -> pa.Table:
    group, ids, m = _sorted(group)
    return pa.table({"cell": group["cell"][:1], "vids": [ids.tobytes()], "vs": [np.ascontiguousarray(m).tobytes()]},
                    pa.schema([("cell", pa.int32()), ("vids", pa.binary()), ("vs", pa.binary())]))


def _pack_queries(wanted, sizes: np.ndarray):
    """``wanted(unit vectors, bounds, cell)`` tells in which cells each query of a block looks."""
    def pack(group: pa.Table) -> pa.Table:
        group, ids, m = _sorted(group)
        cell, block = group["cell"][0].as_py(), group["block"][0].as_py()
        bounds = group["bound"].to_numpy().astype(np.float64)
        bounds[np.isnan(bounds)] = np.inf
        go = wanted(_unit(m), bounds, cell)
        return pa.table({"work": [(cell << 32) + block], "qids": [ids.tobytes()], "qs": [np.ascontiguousarray(m).tobytes()], "bounds": [bounds.tobytes()],
                         "cells": [np.flatnonzero(go.any(axis=0)).tolist()], "pairs": [int((go @ sizes).sum())]},
                        pa.schema([("work", pa.int64()), ("qids", pa.binary()), ("qs", pa.binary()), ("bounds", pa.binary()),
                                   ("cells", pa.list_(pa.int32())), ("pairs", pa.int64())]))
    return pack


class _Best:
    """The best ``k`` so far of each query of a block, by distance and id, none beyond the query's bound."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, exclude_self: bool):
        self.qids, self.q, self.q32, self.bounds, self.k, self.exclude_self = qids, q, q.astype(np.float32), bounds, k, exclude_self
        self.dist, self.vids, self.last = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), bounds.copy()
        #: error of a product of 32-bit unit vectors, at most
        self.slack = (q.shape[1] + 16) * 2.0 ** -23

    def meet(self, rows: np.ndarray, vids: np.ndarray, v: np.ndarray) -> None:
        """Compare the queries at ``rows`` with a block of vectors in the order of their ids."""
        v32 = np.nan_to_num(v).astype(np.float32)  # what isn't a number goes when distances are computed
        for at in range(0, len(rows), SLICE_ROWS):
            some = rows[at:at + SLICE_ROWS]
            free = np.isinf(self.last[some])
            if free.any():  # fewer than k so far and no bound: all distances count
                self._dense(some[free], vids, v)
                some = some[~free]
            near, least = self.q32[some] @ v32.T, (1.0 - self.last[some] - self.slack).astype(np.float32)
            hit = np.flatnonzero(near.max(axis=1) >= least)
            some = some[hit]
            row, col = np.divmod(np.flatnonzero(near[hit] >= least[hit][:, None]), len(v))
            if len(row) * self.q[0].nbytes > TIES_BYTES:  # so many ties that their vectors would not fit
                self._dense(some, vids, v)
                continue
            row = some[row]
            dist = np.round(1.0 - np.einsum("ij,ij->i", self.q[row], v[col]), 12)
            ok = dist <= self.last[row]
            if self.exclude_self:
                ok &= self.qids[row] != vids[col]
            self._merge(row[ok], vids[col[ok]], dist[ok])

    def _dense(self, some: np.ndarray, vids: np.ndarray, v: np.ndarray) -> None:
        # the last digits of a product vary with the shape of the block: rounded, equal angles tie everywhere
        dist = np.round(1.0 - self.q[some] @ v.T, 12)
        if self.exclude_self:
            dist[self.qids[some][:, None] == vids] = np.inf
        dist[np.isnan(dist)] = np.inf
        most = min(self.k, len(vids))
        last = np.fmin(np.partition(dist, most - 1, axis=1)[:, most - 1], self.last[some])[:, None]
        nearer, ties = dist < last, (dist == last) & np.isfinite(dist)
        ties &= np.cumsum(ties, axis=1) <= self.k - nearer.sum(axis=1)[:, None]  # ids ascend, so ties go to the smaller
        row, col = np.nonzero(nearer | ties)
        self._merge(some[row], vids[col], dist[row, col])

    def _merge(self, row: np.ndarray, vids: np.ndarray, dist: np.ndarray) -> None:
        own = np.unique(row)
        row = np.concatenate([row, np.repeat(own, self.k)])
        vids, dist = np.concatenate([vids, self.vids[own].ravel()]), np.concatenate([dist, self.dist[own].ravel()])
        order = np.lexsort((vids, dist, row))
        first = np.searchsorted(row[order], own)
        best = order[first[:, None] + np.arange(self.k)]  # a query has k entries at least: those it had
        self.vids[own], self.dist[own] = vids[best], dist[best]
        self.last[own] = np.minimum(self.bounds[own], dist[best[:, -1]])

    def hits(self) -> pa.RecordBatch:
        row, at = np.nonzero(np.isfinite(self.dist))
        return pa.RecordBatch.from_arrays([pa.array(self.qids[row]), pa.array(self.vids[row, at]), pa.array(self.dist[row, at])], ["qid", "vid", "distance"])


def _products(work: DataFrame, blocks: DataFrame, shares: int, k: int, exclude_self: bool, kinds: tuple[str, str], wanted=None) -> DataFrame:
    """Top k of each query in each share of the blocks of vectors, but for what is beyond its bound.

    Both sides are read from their files for a pair of partitions (no shuffle), a block of queries with all
    blocks of a share one after the other.  ``wanted`` picks the queries of a block that look in a cell (null: all).
    """
    count, parts = work.count(), int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.drop("pairs").repartition(max(1, min(count, max(2 * parts, count // 8))))
    pairs = dealt.hint("shuffle_replicate_nl").join(blocks.coalesce(shares), F.array_contains("cells", F.col("cell")))
    q_kind, v_kind = (np.dtype("<f4" if x == "float" else "<f8") for x in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, go = None, None, None
        for batch in batches:
            at = {name: batch.column(name) for name in ("work", "qids", "qs", "bounds", "cell", "vids", "vs")}
            for i in range(batch.num_rows):
                if now != (now := at["work"][i].as_py()):
                    if best is not None:
                        yield best.hits()
                    qids, bounds = (np.frombuffer(at[name][i].as_buffer(), kind).copy() for name, kind in (("qids", "<i8"), ("bounds", "<f8")))
                    q = _unit(np.frombuffer(at["qs"][i].as_buffer(), q_kind).reshape(len(qids), -1))
                    best = _Best(qids, q, bounds, k, exclude_self)
                    go = wanted(q, bounds, now >> 32) if wanted else None
                rows = np.arange(len(best.q)) if go is None else np.flatnonzero(go[:, at["cell"][i].as_py()])
                vids = np.frombuffer(at["vids"][i].as_buffer(), "<i8")
                best.meet(rows, vids, _unit(np.frombuffer(at["vs"][i].as_buffer(), v_kind).reshape(len(vids), -1)))
        if best is not None:
            yield best.hits()

    return pairs.select("work", "qids", "qs", "bounds", "cell", "vids", "vs").mapInArrow(run, HIT)


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "vid")  # per query at most k rows a share it met
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class MetricTopK:
    """One run of the search; ``pairs`` and ``all_pairs`` tell how many (query, block) pairs were left (null: not pruned)."""

    def __init__(self, queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False,
                 max_block_vectors: int = 2048, max_block_queries: int = 2048):
        spark = vectors.sparkSession
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-topk/{uuid.uuid4().hex}"
        count = vectors.count()
        asked = queries.where(F.exists("v", lambda x: x != 0)).select("id", "v")
        self.pairs = self.all_pairs = None
        if not count:
            self.result = spark.createDataFrame([], f"{HIT}, rank int")
            return
        kinds = _component(queries), _component(vectors)
        width = (vectors.select(F.max(F.size("v"))).first()[0] + 1) * 8
        shares = -(-count * width // SHARE_BYTES)
        v_bytes, q_bytes = min(count, max_block_vectors) * width, max_block_queries * width
        parts_of = lambda n, most: -(-n // most) or 1
        if count <= FEW_BLOCKS * max_block_vectors:  # so few blocks that skipping some costs more than it saves
            one = lambda q, bounds, cell: np.ones((len(q), 1), bool)
            blocks = _stored(vectors.select("id", "v", F.lit(0).alias("cell")), [parts_of(count, max_block_vectors)],
                             _pack_vectors, BLOCK, f"{root}/blocks", v_bytes)
            work = _stored(asked.select("id", "v", F.lit(None).cast("double").alias("bound"), F.lit(0).alias("cell")),
                           [parts_of(asked.count(), max_block_queries)], _pack_queries(one, np.ones(1, np.int64)), WORK, f"{root}/work", q_bytes)
            self.result = _top(_products(work, blocks, shares, k, exclude_self, kinds), k)
            return
        # about a block a cell, and cells enough for the home cell to give a bound
        self.pivots = choose_pivots(vectors, max(1, -(-2 * count // max_block_vectors)))
        if not len(self.pivots):
            self.result, self.pairs, self.all_pairs = spark.createDataFrame([], f"{HIT}, rank int"), 0, 0
            return
        assigned = assign_cells(vectors, self.pivots)
        assigned.write.parquet(f"{root}/cells")
        cells = spark.read.schema(assigned.schema).parquet(f"{root}/cells")
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        radius = np.full(len(self.pivots), -np.inf)
        blocks_of = np.zeros(len(self.pivots), np.int64)
        for r in sizes.collect():  # a row per pivot, MAX_PIVOTS at most
            radius[r.cell], blocks_of[r.cell] = r.radius, -(-r.n // max_block_vectors)
        pivots, sizes_at = self.pivots, blocks_of
        n_blocks = [int(n) for n in blocks_of]
        # a cell of the frame has a vector, so its number of blocks isn't 0
        blocks = _stored(cells.select("id", "v", "cell"), n_blocks, _pack_vectors, BLOCK, f"{root}/blocks", v_bytes)

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                a = _angles(_matrix(batch.column("v")), pivots)
                a[:, sizes_at == 0] = np.inf
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(axis=1), pa.int32())], ["id", "v", "bound", "cell"])

        def at_home(q: np.ndarray, bounds: np.ndarray, cell: int) -> np.ndarray:
            return np.arange(len(pivots))[None, :] == np.full(len(q), cell)[:, None]

        def left(q: np.ndarray, bounds: np.ndarray, cell: int) -> np.ndarray:
            a = _angles(q, pivots)
            most = np.where(np.isinf(bounds), np.pi, np.arccos(np.clip(1.0 - bounds, -1.0, 1.0)))
            go = (a - radius <= most[:, None] + EPS) & (sizes_at > 0)
            go[:, cell] = False
            return go

        def stored_work(rows: DataFrame, name: str, wanted) -> DataFrame:
            return _stored(rows.mapInArrow(home, f"id long, v array<{kinds[0]}>, bound double, cell int"), parts,
                           _pack_queries(wanted, sizes_at), WORK, f"{root}/{name}", q_bytes)

        unbound = asked.select("id", "v", F.lit(None).cast("double").alias("bound"))
        at = {r.cell: r["count"] for r in unbound.mapInArrow(home, f"id long, v array<{kinds[0]}>, bound double, cell int").groupBy("cell").count().collect()}
        parts = [parts_of(at.get(c, 0), max_block_queries) for c in range(len(pivots))]  # MAX_PIVOTS at most
        first = _products(stored_work(unbound, "asked", at_home), blocks, shares, k, exclude_self, kinds)
        _top(first, k).select("qid", "vid", "distance", "rank").write.parquet(f"{root}/home")
        first = spark.read.schema(f"{HIT}, rank int").parquet(f"{root}/home")
        bound = first.where(F.col("rank") == k).select("qid", F.col("distance").alias("bound"))
        work = stored_work(asked.join(bound, asked.id == bound.qid, "left").select("id", "v", "bound"), "work", left)
        n_asked = sum(at.values())
        self.all_pairs = n_asked * sum(n_blocks)
        self.pairs = (work.select(F.sum("pairs")).first()[0] or 0) + n_asked
        more = _products(work, blocks, shares, k, exclude_self, kinds, left)
        self.result = _top(first.select("qid", "vid", "distance").unionByName(more), k)
