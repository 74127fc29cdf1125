"""Positions and quantiles in parts equal those of one window, hot keys and ties included."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators import kpi, ranking, store


def hot_rows(spark):
    """A third of the rows have one key; one key is null."""
    key = "case when id % 3 = 0 then 7 when id % 50 = 1 then null else id % 11 end"
    return spark.range(3000).selectExpr(f"{key} as k", "(id * 7919) % 101 as o", "id", "'x' as _w")


@pytest.mark.parametrize("bound", [40, 10**6])
def test_ranked(spark, bound):
    rows = hot_rows(spark)
    order = [F.col("o").desc(), F.col("id")]
    want = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    got = ranking.ranked(rows.drop("_w"), ["k"], order, whole_key_rows=bound)
    assert sorted(map(str, got.select("k", "o", "id", "pos").collect())) == sorted(map(str, want.select("k", "o", "id", "pos").collect()))
    assert ranking.ranked(rows.where("false").drop("_w"), ["k"], order, whole_key_rows=bound).count() == 0


@pytest.mark.parametrize("bound", [8, 10**6])
def test_percentile(spark, bound):
    rows = hot_rows(spark).select("k", F.when(F.col("id") % 13 > 0, F.sqrt("o")).alias("v"))
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: (r.q, r.n) for r in ranking.percentile(rows, ["k"], "v", p, "q", whole_key_rows=bound).collect()}
        values = {}
        for r in rows.where("v is not null").collect():
            values.setdefault(r.k, []).append(r.v)
        assert got.keys() == values.keys()
        for k, v in values.items():
            assert got[k][1] == len(v) and abs(got[k][0] - np.quantile(v, p)) < 1e-9


def test_trend_spans_calendar_days(spark):
    days = [1, 2, 3, 12, 13]
    events = spark.createDataFrame([(f"2024-01-{d:02d} 10:00:00", "error", 1.0) for d in days for _ in range(d)],
                                   "t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.day.day: r.errors_rolling for r in kpi.error_latency_trend(events).collect()}
    assert got == {1: 1.0, 2: 1.5, 3: 2.0, 12: 12.0, 13: 12.5}


def test_queries_rank_alike_beyond_the_bound(spark, monkeypatch):
    jobs = spark.range(500).selectExpr("id", "case when id % 2 = 0 then 1 else id % 5 end as incident_id", "'failed' as status",
                                       "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 17 as int), 0, 0, 0) as created_at")
    want = sorted(map(tuple, store.jobs_by_incident(jobs).collect()))
    monkeypatch.setattr(ranking.ranked, "__defaults__", ("pos", 10))
    assert sorted(map(tuple, store.jobs_by_incident(jobs).collect())) == want
