"""The search over stored blocks: what it keeps is right, and nothing is copied into a shuffle for a pair of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import metric_topk as mt
from logweave.operators import retrieval
from logweave.plans.queries import QUERIES


def unit(m):
    n = np.linalg.norm(m, axis=1)
    return np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)


def brute(qids, q, vids, v, k, bounds=None):
    """Best k rows by (distance, id) of each query row, as a list per query row."""
    dist = np.round(1.0 - unit(q) @ unit(v).T, 12)
    out = []
    for i, row in enumerate(dist):
        most = np.inf if bounds is None else bounds[i]
        found = sorted((d, int(x)) for d, x in zip(row, vids, strict=True) if x != qids[i] and d <= most)
        out.append([(round(float(d), 6), x) for d, x in found[:k]])
    return out


@pytest.mark.parametrize("ties_bytes", [8 << 20, 1000])
def test_best_of_blocks_against_brute_force(monkeypatch, ties_bytes):
    monkeypatch.setattr(mt, "TIES_BYTES", ties_bytes)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 12))
    v[100:400] = v[100]  # ties over blocks
    v[500:520] *= 7.5
    v[600], v[601, 3] = 0, np.nan
    vids = rng.permutation(900).astype(np.int64)
    vids[10] = vids[11]  # a repeated id
    bounds = np.where(np.arange(900) % 3 == 0, 0.4, np.inf)
    best = mt._Best(vids, unit(v), bounds, 4, True)
    for at in np.array_split(rng.permutation(900), 9):
        at = at[np.argsort(vids[at], kind="stable")]
        best.meet(np.arange(900), vids[at], unit(v[at]))
    got = best.hits().to_pydict()
    by = {}
    row = np.nonzero(np.isfinite(best.dist))[0]
    for i, x, d in zip(row, got["vid"], got["distance"], strict=True):
        by.setdefault(int(i), []).append((round(d, 6), x))
    assert [by.get(i, []) for i in range(900)] == brute(vids, v, vids, v, 4, bounds)


def hits_of(frame):
    by = {}
    for r in frame.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((round(r.distance, 6), r.vec_id))
    return by


def test_float_vectors_in_many_shares(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 8)).astype(np.float32)
    m[50:90] = m[50]
    ids = np.arange(200)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<float>")
    twice = df.union(df.where("vec_id < 3"))
    monkeypatch.setattr(mt, "SHARE_BYTES", 4000)
    monkeypatch.setattr(mt, "FILE_BYTES", 1)
    want = brute(ids, m.astype(np.float64), ids, m.astype(np.float64), 5)
    queries = df.select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (20, 200):  # with cells, and few blocks without
        got = hits_of(retrieval.cosine_topk(queries, df, k=5, exclude_self=True, max_block_vectors=block, max_block_queries=30))
        assert got == dict(enumerate(want))
        more = hits_of(retrieval.cosine_topk(queries, twice, k=5, exclude_self=True, max_block_vectors=block))
        v = np.concatenate([m, m[:3]]).astype(np.float64)
        assert more == dict(enumerate(brute(ids, m.astype(np.float64), np.concatenate([ids, ids[:3]]), v, 5)))


def test_nothing_is_shuffled_for_a_pair(spark, tmp_path, monkeypatch):
    """Unclustered vectors meet all blocks: some 50 of vectors by as many of queries, with one copy of each."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(800, 16))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    monkeypatch.setattr(mt, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    run = mt.MetricTopK(df, df, 4, exclude_self=True, max_block_vectors=32, max_block_queries=32)
    plan = run.result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapGroupsInPandas" not in plan
    assert run.pairs > run.all_pairs / 2 and run.result.count() == 3200
    root, = (tmp_path / "logweave-topk").iterdir()
    work, blocks = spark.read.schema(mt.WORK).parquet(f"{root}/work"), spark.read.schema(mt.BLOCK).parquet(f"{root}/blocks")
    assert work.agg(F.sum(F.length("qs"))).first()[0] == blocks.agg(F.sum(F.length("vs"))).first()[0] == m.nbytes


@pytest.mark.parametrize("name", ["j8_docs_agent", "k6_docs_recall", "g2_cosine_topk", "g3_format_context"])
def test_queries_shuffle_only_what_was_found(spark, name):
    """The search below a query hands on its best; vectors are neither exploded nor grouped by pairs of blocks."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInPandas" not in plan and "explode(sequence" not in plan
