"""Incident analysis (J), timeline (I), relational quirks (H)."""

import datetime as dt

from pyspark.sql import functions as F

from logweave.operators import incidents as inc
from logweave.operators import store
from logweave.operators import timeline as tl


def _analyze(spark, rows, schema):
    return {r.incident_id: r for r in inc.analyze_incidents(spark.createDataFrame(rows, schema)).collect()}


def test_root_cause_missing_database_url(spark):
    res = _analyze(spark, [("i1", "KeyError: missing DATABASE_URL in settings")], "incident_id string, message string")
    rc = res["i1"].root_cause
    assert rc.severity == "Critical"
    assert rc.findings[0] == "Probable cause: Missing DATABASE_URL environment variable"
    assert res["i1"].agents == ["log_analysis"]  # "error" in the text


def test_routing_substrings_q15(spark):
    res = _analyze(spark, [("a", "a decision was made"), ("b", "room is cold"), ("c", None)],
                   "incident_id string, summary string")
    assert "cicd" in res["a"].agents            # "ci" inside "decision"
    assert res["c"].agents == ["docs_retrieval", "log_analysis"]
    assert res["b"].root_cause.severity == "Critical"  # "oom" inside "room" -> out of memory cause


def test_agents_confidence_and_fixes(spark):
    rows = [("k", ["pod api CrashLoopBackOff", "OOMKilled", "timeout error talking to db"], ["kubernetes"])]
    res = _analyze(spark, rows, "incident_id string, logs array<string>, tags array<string>")
    r = res["k"]
    by = {a.agent: a for a in r.agent_results}
    assert by["kubernetes"].confidence == 0.75
    assert "Detected k8s condition: crashloopbackoff" in by["kubernetes"].findings
    assert by["log_analysis"].findings == ["Matched log signal: timeout"]
    assert r.agents == ["kubernetes", "log_analysis"]
    assert r.summary == "kubernetes: kubernetes analysis complete | log_analysis: log analysis complete"
    assert r.recommendations[0].startswith("Increase pod/container memory")
    # mean of (0.75, 0.7) = 0.725, stored as 0.72499999... -> Python round gives 0.72
    assert r.root_cause.confidence == round((0.75 + 0.7) / 2, 2) == 0.72
    assert r.root_cause.severity == "Critical"


def test_py_round_half_even_on_binary(spark):
    vals = [0.725, 0.575, 0.5833333333333334, 0.345, 0.99]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.r for r in df.select(inc.py_round(F.col("x"), 2).alias("r")).collect()]
    assert got == [round(v, 2) for v in vals]


def test_timeline_time_only_q8(spark):
    text = "2024-05-09 12:03:44 deployment started\nnoise\n12:05 pod api crash loop\n13:00 DB timeout\n13:00 timed out again"
    df = spark.createDataFrame([(1, text, dt.datetime(2020, 1, 2))], "file_id long, text string, base_ts timestamp_ntz")
    ev = tl.generate_timeline(df, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).orderBy("pos").collect()
    titles = [(e.occurred_at, e.title) for e in ev]
    assert titles[0] == (dt.datetime(2020, 1, 2, 12, 3, 44), "Deployment Started")  # line date ignored
    assert (dt.datetime(2020, 1, 2, 12, 5), "Pod Crash Detected") in titles
    assert sum(1 for _, t in titles if t == "DB Timeout Observed") == 1  # same second -> first line wins
    ev2 = tl.generate_timeline(df, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), use_line_date=True).collect()
    assert any(e.occurred_at == dt.datetime(2024, 5, 9, 12, 3, 44) for e in ev2)


def test_severity_text_order_q1(spark):
    df = spark.createDataFrame([(1, 1, "critical", dt.datetime(2024, 1, 1)), (2, 1, "high", dt.datetime(2024, 1, 1))],
                               "id long, incident_id long, severity string, created_at timestamp_ntz")
    assert [r.severity for r in store.critical_findings(df, limit=2).collect()] == ["high", "critical"]
    assert [r.severity for r in store.critical_findings(df, limit=2, rank_severity=True).collect()] == ["critical", "high"]


def test_incident_id_zero_filters_q22(spark):
    df = spark.createDataFrame([(1, 0, "queued", dt.datetime(2024, 1, 1)), (2, 5, "queued", dt.datetime(2024, 1, 1))],
                               "id long, incident_id long, status string, created_at timestamp_ntz")
    assert [r.id for r in store.jobs_by_incident(df, incident_id=0).collect()] == [1]


def test_ingestion_stats_single_total_row(spark):
    jobs = spark.createDataFrame([(1, 10, "queued"), (2, 10, "failed"), (3, 11, "succeeded")],
                                 "id long, incident_id long, status string")
    chunks = spark.createDataFrame([(1, 10), (2, 12)], "id long, incident_id long")
    findings = spark.createDataFrame([(1, 10, "high", "DNSFailure"), (2, 11, "low", "CPUSpike")],
                                     "id long, incident_id long, severity string, category string")
    rows = {r.incident_id: r for r in store.ingestion_stats(jobs, chunks, findings).collect()}
    assert set(rows) == {None, 10, 11, 12}          # one total row, not one per input table
    total = rows[None]
    assert (total.total_jobs, total.total_chunks, total.total_findings) == (3, 2, 2)
    assert total.findings_by_category == {"CPUSpike": 1, "DNSFailure": 1}
    assert rows[10].failed_jobs == 1 and rows[12].total_jobs == 0 and rows[12].total_chunks == 1
    assert rows[11].findings_by_severity == {"critical": 0, "high": 0, "medium": 0, "low": 1}
