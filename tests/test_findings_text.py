"""Cleaning (B), finding rules (E): offsets equal re.finditer, evidence, dedup."""

import json
import random
import re

from pyspark.sql import functions as F

from logweave import rules
from logweave.functions import text as tx
from logweave.operators import findings as fnd
from logweave.sources import files as fls
from logweave.sources import sinks
from logweave.plans.pipeline import pipeline_findings


def test_clean_text(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m  \r\nnul\x00here \t\rend\x0b",)], "t string")
    got = df.select(tx.clean_text(F.col("t")).alias("c")).collect()[0].c
    assert got == "red\nnulhere\nend"


def test_normalize_and_strip(spark):
    df = spark.createDataFrame([("  a\x00b \t c\r\n\n\n\nd 　",)], "t string")
    got = df.select(tx.normalize_text(F.col("t")).alias("c")).collect()[0].c
    assert got == "a b c\n\nd"


def test_split_lines_matches_python(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc\x0bd\x1ce f\n\n", "x\n\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.l for r in df.select(tx.split_lines(F.col("t")).alias("l")).collect()]
    assert got == [t.splitlines() for t in texts]


def _py_offsets(text, rule):
    return [(m.start(), m.end()) for m in re.finditer(rule.pattern, text, re.I)]


def test_match_offsets_equal_finditer(spark):
    rnd = random.Random(7)
    words = ["timed out", "ETIMEDOUT", "ok", "panic:", "x", "\n", "connection refused", "  ", "ümlaut", "DNS lookup failed"]
    texts = {i: "".join(rnd.choice(words) + " " for _ in range(rnd.randint(0, 60))) for i in range(30)}
    df = spark.createDataFrame([(k, v, "generic") for k, v in texts.items()], "file_id long, text string, source string")
    got = {}
    for r in fnd.match_offsets(df).collect():
        got.setdefault((r.file_id, r.rule_no), []).append((r.match_no, r.start, r.end))
    for fid, t in texts.items():
        for rule in rules.DETECTION_RULES:
            exp = _py_offsets(t, rule)
            have = [(s, e) for _, s, e in sorted(got.get((fid, rule.rule_no), []))]
            assert have == exp, (fid, rule.category)


def test_single_line_findings(files_df):
    cases = {
        1: ("Temporary failure in name resolution", "DNSFailure"),
        2: ("read tcp 10.0.0.1: i/o timeout; context deadline exceeded", "ConnectionTimeout"),
        3: ("x509: certificate has expired", "SSLFailure"),
        4: ("java.lang.OutOfMemoryError: GC overhead limit exceeded", "MemoryLeak"),
        5: ("panic: nil map", "PanicError"),
    }
    f = pipeline_findings(files_df({k: v[0] for k, v in cases.items()}))
    got = {(r.file_id, r.category) for r in f.collect()}
    for k, (_, cat) in cases.items():
        assert (k, cat) in got


def test_every_distinct_evidence_is_kept(files_df):
    distinct = "\n".join(f"worker {i:03d} segmentation fault" for i in range(12))
    alike = "\n".join("p" * 400 + f"\nsegmentation fault {i}" for i in range(3))  # same first 100 characters
    late = "filler line\n" * 60_000 + "segmentation fault at the end"
    f = pipeline_findings(files_df({1: "segmentation fault", 2: distinct, 3: alike, 4: late})).where(F.col("category") == "SegfaultError")
    counts = {r.file_id: r.n for r in f.groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 1, 2: 12, 3: 3, 4: 1}
    ev = f.where("file_id = 2").orderBy("match_no").collect()[0].evidence
    assert "\n" not in ev and ev == ev.strip()


def test_source_filter(files_df):
    # a build failure inside an nginx text must not get the CI-only rules
    text = '1.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 500 1\nBUILD FAILED'
    cats = {r.category for r in pipeline_findings(files_df({1: text})).collect()}
    assert "BuildFailure" not in cats and "TestFailure" not in cats and "HTTPError5xx" in cats


def test_clean_files_have_a_row(files_df):
    files = files_df({1: "segmentation fault", 2: "all is well"})
    found = pipeline_findings(files)
    got = fnd.brief_message(fnd.finding_summary(found, files=files)).select("file_id", "total", "message").collect()
    assert {r.file_id: r.message for r in got}[2] == "No issues detected" and {r.file_id: r.total for r in got}[2] == 0
    assert {r.file_id: r.critical_list for r in fnd.brief_findings(found, files=files).collect()}[2] == []
    assert {r.file_id: r.has_critical_issues for r in fnd.severity_flags(found, files=files).collect()}[2] is False


def test_attachment_manifest(spark):
    rows = [(" Log\t", " a b.log ", 26_214_401, None), ("yaml", "x/y.yml", 1, "TEXT/YAML"), ("screenshot", "s.png", 1, "text/plain"), ("exe", "", 1, None)]
    df = spark.createDataFrame(rows, "kind string, filename string, size_bytes long, content_type string")
    got = {r.kind_norm: (r.safe_name, r.reject_reason, r.oversize) for r in fls.attachment_manifest(df, content_type_col="content_type").collect()}
    assert got == {"log": ("a_b.log", None, True), "yaml": ("y.yml", None, False),
                   "screenshot": ("s.png", "unsupported content type", False), "exe": ("file", "invalid kind", False)}


def test_export_metadata_as_python_shows_it(spark):
    values = [{"a": True, "b": None, "c": False, "n": 3}, {"s": "x", "q": "it's", "d": 'say "hi"', "m": "a'b\"c", "w": "a\\b\tc"}, {}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = dict(df.select("i", sinks.py_dict_repr(F.col("j"))).collect())
    assert got == {i: repr(v) for i, v in enumerate(values)}


def test_written_chunks_carry_the_keys_of_their_job(spark, tmp_path):
    jobs = spark.sql("SELECT id, 10 * id AS incident_id, 'succeeded' AS status, TIMESTAMP_NTZ '2024-02-28 23:59:59' + MAKE_DT_INTERVAL(0, id) AS created_at FROM VALUES (0L), (1L) t(id)")
    chunks = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (1, 1, "c")], "file_id long, chunk_index int, text string")
    found = spark.createDataFrame([(1, "x")], "file_id long, title string")
    paths = sinks.write_ingest(jobs, chunks, found, str(tmp_path))
    got = spark.read.parquet(paths["chunks"]).selectExpr("text", "job_id", "incident_id", "string(day)").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, "2024-02-28"), ("b", 1, 10, "2024-02-29"), ("c", 1, 10, "2024-02-29")]
    assert [r.incident_id for r in spark.read.parquet(paths["findings"]).collect()] == [10]


def test_brief_message(spark):
    df = spark.createDataFrame([(1, 2, 1, 0, 0, 3), (2, 0, 2, 1, 0, 3), (3, 0, 0, 1, 1, 2), (4, 0, 0, 0, 0, 0)],
                               "file_id long, critical long, high long, medium long, low long, total long")
    got = dict(fnd.brief_message(df).select("file_id", "message").collect())
    assert got[1] == "Critical issues detected: 2 critical findings"
    assert got[2] == "High severity issues detected: 2 high findings"
    assert got[3] == "2 issues detected" and got[4] == "No issues detected"
