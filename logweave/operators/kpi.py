"""Operational KPIs (K-1 ... K-6): real aggregates where the reference shows constants.

All are grouped aggregations with map-side partial aggregation; the only
windows run over per-day aggregates (one row per day), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import percentile


def mttr(incidents: DataFrame, by: str = "service_name") -> DataFrame:
    """K-1: mean time to resolve (seconds) per group; rows with both ends and end >= start."""
    ok = incidents.where(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull()
                         & (F.col("ended_at") >= F.col("started_at")))
    secs = F.expr("timestampdiff(SECOND, started_at, ended_at)")
    return ok.groupBy(by).agg(F.count(F.lit(1)).alias("n_resolved"),
                              F.avg(secs.cast("double")).alias("mttr_seconds"))


def pipeline_health(jobs: DataFrame, period: str = "day") -> DataFrame:
    """K-2: share of succeeded jobs per period (the reference showed a constant for 24h)."""
    day = F.date_trunc(period, F.col("created_at"))
    return jobs.groupBy(day.alias("period")).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.col("status") == "succeeded").alias("n_succeeded"),
        F.avg((F.col("status") == "succeeded").cast("double")).alias("health"))


def pipeline_health_last_24h(jobs: DataFrame) -> DataFrame:
    """K-2: success share over the 24 hours before the newest job (as-of = max created_at).

    The as-of time is a scalar subquery, so no join is needed.
    """
    asof = jobs.select(F.max("created_at")).scalar()
    recent = jobs.where(F.col("created_at") > asof - F.expr("INTERVAL 24 HOURS"))
    return recent.agg(F.count(F.lit(1)).alias("n_jobs"),
                      F.avg((F.col("status") == "succeeded").cast("double")).alias("health"))


def error_latency_trend(events: DataFrame, ts: str = "ts", is_error=None, latency: str = "value",
                        days: int = 7) -> DataFrame:
    """K-3: per day errors and mean latency, plus a ``days``-day rolling mean of errors.

    The rolling window spans calendar days (a day without events has no row and counts for
    nothing) and runs over the per-day aggregate (one row per day).
    """
    err = is_error if is_error is not None else (F.col("event_type") == "error")
    daily = events.groupBy(F.to_date(F.col(ts)).alias("day")).agg(
        F.count_if(err).alias("errors"), F.avg(F.col(latency)).alias("avg_latency"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.withColumn("errors_rolling", F.avg("errors").over(w))


def latency_p95(events: DataFrame, by: str = "event_type", latency: str = "value", exact: bool = False,
                accuracy: int = 10000) -> DataFrame:
    """K-4: 95th percentile of latency per group.

    ``exact=True`` (``ranking.percentile``, linear interpolation) ranks distinct values with their
    counts in ranges where a group has more than a buffer may hold; the default ``percentile_approx`` is a
    bounded-memory sketch.
    """
    if exact:
        return percentile(events, [by], latency, 0.95, "p95")
    return events.groupBy(by).agg(F.percentile_approx(F.col(latency), 0.95, accuracy).alias("p95"), F.count(F.lit(1)).alias("n"))


def error_rate(events: DataFrame, by: str | None = None, is_error=None) -> DataFrame:
    """K-4: share of error events (overall or per group)."""
    err = is_error if is_error is not None else (F.col("event_type") == "error")
    agg = [F.avg(err.cast("double")).alias("error_rate"), F.count(F.lit(1)).alias("n")]
    return events.groupBy(by).agg(*agg) if by else events.agg(*agg)


def integration_rollup(status: DataFrame, service: str = "service", state: str = "status") -> DataFrame:
    """K-5: total integrations, the sorted list of those not healthy, overall status."""
    bad = F.when(F.col(state) != "healthy", F.col(service))
    return status.agg(
        F.count(F.lit(1)).alias("total_integrations"),
        F.array_sort(F.collect_set(bad)).alias("degraded"),
    ).withColumn("status", F.when(F.size("degraded") > 0, F.lit("degraded")).otherwise(F.lit("healthy")))


def integration_services(status: DataFrame, service: str = "service", state: str = "status") -> DataFrame:
    """K-5, a row per service: its state, and the number of services and overall state beside it."""
    overall = status.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(state) != "healthy").alias("bad"))
    return status.select(
        F.col(service).alias("service"), F.col(state).alias("status"),
        overall.select("n").scalar().alias("total_integrations"),
        F.when(overall.select("bad").scalar() > 0, F.lit("degraded")).otherwise(F.lit("healthy")).alias("overall"))


def service_status(jobs: DataFrame, service: str = "source_type", max_failure_rate: float = 0.25) -> DataFrame:
    """Per-service health from job outcomes (input for K-5)."""
    return jobs.groupBy(F.col(service).alias("service")).agg(
        F.avg((F.col("status") == "failed").cast("double")).alias("failure_rate")
    ).withColumn("status", F.when(F.col("failure_rate") > max_failure_rate, F.lit("degraded")).otherwise(F.lit("healthy")))


def docs_recall(topk: DataFrame, labels: DataFrame, query_id: str = "query_id", vec_id: str = "vec_id",
                key: str = "vec_id", label: str = "label") -> DataFrame:
    """K-6: share of queries whose top-k holds at least one item with the query's label."""
    lab = labels.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    j = (topk.join(lab.withColumnRenamed("_k", query_id).withColumnRenamed("_l", "q_label"), query_id)
         .join(lab.withColumnRenamed("_k", vec_id).withColumnRenamed("_l", "v_label"), vec_id))
    per_q = j.groupBy(query_id, "q_label").agg(F.max((F.col("q_label") == F.col("v_label")).cast("int")).alias("hit"))
    return per_q.groupBy("q_label").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit").alias("recall"))
