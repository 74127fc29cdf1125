"""Operator 3: targets are reached though cells are cut, or what is missing is told."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from logweave.llm import mixing


def cells_of(spark, table):
    return spark.createDataFrame([(s, la, t, n) for (s, la, t), n in table.items()], "source string, lang string, topic string, tokens long")


def test_tempered_targets_are_reached_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).toPandas()
    rows["expected"] = rows.n_tokens * rows.probability
    for side in mixing.SIDES:
        got = rows.groupby(side).expected.sum()
        want = rows[rows.n_tokens > 0].groupby(side).n_tokens.sum() ** mixing.POWER
        assert ((got / got.sum()) - (want / want.sum())).abs().max() < 0.01
    assert rows.probability.between(0, 1).all() and (rows.probability == 1).any(), "some cells give all they hold"


def test_bounded_fit_against_brute_force(spark):
    """The weights are products of one factor per value, and cut cells are made up for."""
    rng = np.random.default_rng(5)
    table = {(f"s{i}", f"l{j}", f"t{k}"): int(rng.integers(1, 1000) ** 1.5) for i in range(4) for j in range(3) for k in range(3)}
    own = {"source": [("s0", 0.1), ("s1", 0.2), ("s2", 0.3), ("s3", 0.4)]}
    targets = {s: spark.createDataFrame(v, "value string, share double") for s, v in own.items()}
    cells = cells_of(spark, table)
    raked = mixing.rake(cells, targets, 0.6)
    gap = {(r.side, r.value): r.gap for r in mixing.gaps(raked).collect()}
    assert max(gap.values()) < 1e-4
    # dual ascent, value by value, by bisection
    keys, held = list(table), np.array(list(table.values()), float)
    want, share = {}, 0.6
    for n, side in enumerate(mixing.SIDES):
        values = sorted({k[n] for k in keys})
        total = np.array([sum(h for k, h in zip(keys, held) if k[n] == v) for v in values])
        goal = np.array([dict(own["source"])[v] for v in values]) if side == "source" else total ** mixing.POWER / (total ** mixing.POWER).sum()
        want[n] = dict(zip(values, goal))
        share = min(share, (total / goal).min() / held.sum())
    weight = held.copy()
    for _ in range(200):
        for n in range(3):
            for v, goal in want[n].items():
                at = np.array([k[n] == v for k in keys])
                low, high = 0.0, 1e6
                for _ in range(100):
                    mid = (low + high) / 2
                    if np.minimum(held[at], mid * weight[at]).sum() < goal * share * held.sum():
                        low = mid
                    else:
                        high = mid
                weight[at] *= high
    got = {(r.source, r.lang, r.topic): min(r.weight, r.tokens) for r in raked.collect()}
    assert max(abs(got[k] - min(w, h)) / h for k, w, h in zip(keys, weight, held)) < 1e-3


def test_targets_beyond_what_is_held(spark):
    """Less is drawn where a value holds too little; where values exclude each other the gap is told."""
    cells = cells_of(spark, {("a", "x", "t"): 900, ("b", "x", "t"): 100})
    half = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")}
    got = {r.source: min(r.weight, r.tokens) for r in mixing.rake(cells, half, 0.5).collect()}
    assert abs(got["a"] - 100) < 1e-6 and abs(got["b"] - 100) < 1e-6
    cells = cells_of(spark, {("a", "x", "t"): 500, ("b", "y", "t"): 500})
    odd = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"),
           "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "value string, share double")}
    assert mixing.gaps(mixing.rake(cells, odd, 0.5)).agg(F.max("gap")).first()[0] > 0.3


def test_odd_rows_and_sql(spark):
    rows = [(i % 50, "long " * 30_000 if i == 7 else "w " * (i % 9), None if i % 5 == 0 else f"l{i % 3}", None if i % 7 == 0 else f"s{i % 4}", "x", 1) for i in range(300)]
    rows += [(None, None, None, None, None, None), (None, "a b", "l1", "s1", None, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, probability int")
    got = mixing.mix(docs)
    assert got.count() == len(rows) and mixing.draw(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        want = sorted(map(str, db.sql(mixing.oracle_sql()).fetchall()))
    assert sorted(map(str, map(tuple, got.collect()))) == want
