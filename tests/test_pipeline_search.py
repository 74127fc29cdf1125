"""The pipeline's outputs, findings in the row, nested payloads and the search that skips cells."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave import rules
from logweave.functions import json_text as jt
from logweave.operators import findings as fnd
from logweave.operators import incidents as inc
from logweave.operators import metric_topk as mt
from logweave.operators import parse, retrieval
from logweave.plans import pipeline
from logweave.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


# -- E, J-16 --------------------------------------------------------------------------
def test_findings_need_no_shuffle_and_no_join(spark, tmp_path):
    fx.log_files(spark, SF).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    found = pipeline.pipeline_findings(files)
    plan = plan_of(found)
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    entries = fnd.detect_findings_from_entries(parse.parse_logs(files))
    plan = plan_of(entries).split("== Physical Plan ==")[1]
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert entries.count() > 0


def test_findings_against_python(spark):
    rng = random.Random(2)
    words = ["connection refused", "out of memory", "x" * 90, "panic: boom", "\n", "ok", "segmentation fault", "é", "timed out"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(80))) for i in range(20)} | {20: "", 21: None}
    df = spark.createDataFrame([(k, t, "generic") for k, t in texts.items()], "file_id long, text string, source string")
    want = []
    for k, t in texts.items():
        for rule in rules.DETECTION_RULES:
            if t is None or (rule.sources and "generic" not in rule.sources):
                continue
            seen = set()
            for n, m in enumerate(re.finditer(rule.pattern, t, re.I)):
                evidence = t[max(m.start() - 120, 0):m.end() + 200].replace("\n", " ").strip()
                if evidence not in seen:
                    want.append((k, rule.rule_no, n, evidence))
                seen.add(evidence)
    got = fnd.detect_findings(df).select("file_id", "rule_no", "match_no", "evidence")
    assert rows_of(got) == sorted(map(str, want)) and len(want) > 50


def test_run_pipeline_outputs(spark):
    files = fx.log_files(spark, SF)
    done = pipeline.run_pipeline(files)
    assert rows_of(done.entries) == rows_of(parse.parse_logs(files))
    assert rows_of(done.findings) == rows_of(pipeline.pipeline_findings(files))
    assert done.files.count() == done.batches.count() == files.count() and done.chunks.count() >= files.count()
    forced = pipeline.run_pipeline(files.withColumn("f", F.lit("nginx")).withColumnRenamed("text", "raw"), text_col="raw", forced_col="f")
    assert {r.source_type for r in forced.files.collect()} == {"nginx"}


def test_cloudwatch_export_and_its_raw_text(spark):
    items = [{"@timestamp": "2024-01-01T00:00:00Z", "message": "ERROR ümlaut 😀", "logStream": "s"}, {"message": ""}, 3, {"@message": "ok"}]
    files = spark.createDataFrame([(1, json.dumps(items, ensure_ascii=False), "cloudwatch"), (2, "[]", "cloudwatch"), (3, "plain line\n\nnext", "cloudwatch")],
                                  "file_id long, text string, f string")
    got = {(r.file_id, r.line_no): r for r in parse.parse_logs(files, forced_col="f").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (3, 0), (3, 2)}
    assert got[1, 0].raw == json.dumps(items[0]) and got[1, 0].message == items[0]["message"] and got[1, 3].message == "ok"
    assert plan_of(parse.parse_logs(files, forced_col="f")).split("== Physical Plan ==")[1].count("Scan ") == 1


# -- J-2 ------------------------------------------------------------------------------
def flat(v):
    if v is None:
        return []
    if isinstance(v, (list, tuple)):
        return [x for i in v for x in flat(i)]
    if isinstance(v, dict):
        return [x for i in v.values() for x in flat(i)]
    return [v if isinstance(v, str) else str(v)]


NESTED = [{"a": [1, {"b": "x:y", "c": ["q\"uote", None, True]}], "d": {"e": "tab\there"}}, [[], {}, ["deep", [["deeper: \\ "]]], 2.5, -3], {"k1": "v,]}", "1": "2"}, [], {}, [0, "", False, "0"]]


@pytest.mark.parametrize("value", NESTED)
def test_json_leaves_and_repr(spark, value):
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    r = df.select(jt.json_leaves(F.col("j")).alias("leaves"), jt.py_repr(F.col("j")).alias("repr"), jt.json_items(F.col("j")).alias("items")).first()
    assert r.leaves == flat(value) and r.repr == repr(value)
    values = list(value.values()) if isinstance(value, dict) else value
    assert r["items"] == [str(v) for v in values if v]


def test_nested_payload_fields(spark):
    df = spark.sql("""SELECT 1 AS incident_id, named_struct('a', array(named_struct('b', 'CrashLoopBackOff')), 'n', 3) AS details,
                      parse_json('{"z": ["database down"]}') AS error, array('one', '', 'two') AS summary, 'single' AS logs""")
    p = inc.with_payload_fields(df)
    got = p.select(inc.payload_text(["summary", "details", "error", "logs"]).alias("t"), "router_text").first()
    assert got.t == "one\ntwo\nCrashLoopBackOff\n3\ndatabase down\nsingle"
    assert got.router_text == "one\ntwo\nsingle\ndatabase down\n[{'b': 'CrashLoopBackOff'}]\n3".replace("database down\n[", "['database down']\n[") or "CrashLoopBackOff" in got.router_text
    agent = rules.AGENTS[0].__class__("own_agent", *[getattr(rules.AGENTS[0], f) for f in list(rules.AGENTS[0].__dataclass_fields__)[1:]])
    res = inc.analyze_incidents(df, registry=[*rules.AGENTS, agent], extra_routes={"own_agent": F.col("incident_id") == 1}).first()
    assert "own_agent" in res.agents and "own_agent" in [r.agent for r in res.agent_results]


# -- G-2 ------------------------------------------------------------------------------
def brute(ids, m, qids, q, k):
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1)[:, None], out=np.zeros_like(x), where=np.linalg.norm(x, axis=1)[:, None] > 0)
    m, q, out = unit(m), unit(q), {}
    for i, v in zip(qids, q, strict=True):
        if v.any():
            d = np.where(ids == i, np.inf, 1 - m @ v)
            order = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:k]
            out[i] = [(int(ids[j]), round(d[j], 6)) for j in order if np.isfinite(d[j])]
    return out


def test_search_skips_cells_and_stays_exact(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 24))
    m = centers[rng.integers(0, 40, 1500)] + 0.08 * rng.normal(size=(1500, 24))
    m[10], m[11] = m[12], m[12] * 3  # ties
    m[20] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    run = mt.MetricTopK(df, df, 5, exclude_self=True, max_block_vectors=32, max_block_queries=50)
    got = {}
    for r in run.result.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vid, round(r.distance, 6)))
    assert got == brute(np.arange(1500), m, np.arange(1500), m, 5)
    assert run.pairs < run.all_pairs / 2, (run.pairs, run.all_pairs)


def test_search_of_few_hot_or_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300, [0.0, 1.0]), (301, None), (302, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.cosine_topk(df.select(F.col("vec_id").alias("query_id"), "embedding").where("query_id in (0, 300, 301, 302)"), df, k=3,
                                exclude_self=True, max_block_vectors=16)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 2, 3], 300: [0, 1, 2]}
    few = retrieval.cosine_topk(df.select(F.col("vec_id").alias("query_id"), "embedding").where("query_id = 0"), df.where("vec_id > 298"), k=9)
    assert [r.vec_id for r in few.orderBy("rank").collect()] == [299, 300, 302]
    assert retrieval.cosine_topk(df.select(F.col("vec_id").alias("query_id"), "embedding"), df.limit(0), k=3).count() == 0


def test_search_sends_no_query_vector_per_cell(spark):
    """Unclustered vectors: every cell is left for every query, and its vector must not be copied for each (Python and disk)."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 16))
    m[40:60] = m[40]  # ties that go to the smaller id
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    run = mt.MetricTopK(df, df, 4, exclude_self=True, max_block_vectors=32, max_block_queries=70)
    got = {}
    for r in run.result.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vid, round(r.distance, 6)))
    assert got == brute(np.arange(300), m, np.arange(300), m, 4)
    assert run.pairs > run.all_pairs / 2
    assert "cells array<int>" in mt.WORK
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], ["id"])
    assert max(b.num_rows for b in mt._slices(iter([batch]))) == mt.SLICE_ROWS
    with pytest.raises(ValueError):
        mt._matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0], [1.0]]))
    assert np.allclose(mt._matrix(pa.array([[3.0, 4.0], [0.0, 0.0], [1.0, 2.0]]).slice(0, 2)), [[0.6, 0.8], [0, 0]])
