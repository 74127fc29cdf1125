"""Operator 4: the law holds and copies gather, also beside a text on a third of all rows."""

from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from logweave.llm import sharding

SCHEMA = "doc_id long, text string, key int, shard int, size string, label int"


def run(spark, texts, shards=8):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in texts], SCHEMA)
    rows = sharding.shard(docs, shards)
    pdf = rows.toPandas()
    assert len(pdf) == len(texts) and sorted(pdf.doc_id.dropna()) == sorted(i for i, _ in texts if i is not None)
    counts = pdf.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in pdf.groupby("shard"))
    return rows, pdf


def small_groups_cut(pdf, kind):
    groups = pdf[pdf.doc_id.isin(kind)].groupby(["text_crc32", "size"]).shard.nunique()
    return int((groups > 1).sum()), len(groups)


def test_small_groups_stay_whole_beside_a_hot_text(spark):
    texts = [(i, "hot text" if i % 3 == 0 else f"group {i // 8}" if i % 3 == 1 else f"own {i}") for i in range(9000)]
    rows, pdf = run(spark, texts)
    cut, groups = small_groups_cut(pdf, [i for i, _ in texts if i % 3 == 1])
    assert groups > 1000 and cut <= groups / 100
    hot = pdf[pdf.doc_id % 3 == 0].groupby("shard").size()
    assert len(hot) <= 5, "3,000 rows need three shards of 1,125"
    found = sharding.cuts(rows).first()
    assert found.cut < found.linked


def test_all_rows_in_groups(spark):
    """No room to spare: every shard is filled by whole texts but for a few."""
    texts = [(i, f"group {i // 7}") for i in range(7000)]
    _, pdf = run(spark, texts)
    cut, groups = small_groups_cut(pdf, [i for i, _ in texts])
    assert groups == 1000 and cut <= 16


def test_cut_edges_against_brute_force(spark):
    """On a small graph the cut is that of the best placement in equal shards."""
    sizes = [3, 3, 2, 2, 1, 1]
    texts = [(10 * g + k, f"text {g}") for g, n in enumerate(sizes) for k in range(n)]
    rows, _ = run(spark, texts, 2)
    names = [t for _, t in texts]
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2) if names[i] == names[j]]
    best = min(sum(p[i] != p[j] for i, j in pairs) for p in product((0, 1), repeat=len(names)) if sum(p) == len(names) // 2)
    found = sharding.cuts(rows).first()
    assert found.linked == len(pairs) and best == 0 and found.cut <= best + 2


@pytest.mark.parametrize("n", [0, 1, 7])
def test_odd_rows(spark, n):
    odd = [(None, None), (None, "a"), (5, "a"), (5, "a"), (6, ""), (7, ""), (8, "long " * 50_000)][:n]
    rows = sharding.shard(spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in odd], SCHEMA))
    got = rows.collect()
    assert len(got) == n and sorted(r["size"] for r in got) == sorted(len(t or "") + 1 for _, t in odd)
    assert rows.where(F.col("grown_shard").isNotNull()).count() == 0
