"""Source detection and parsing (C, D) on hand-written samples, plus quirks Q-2 ... Q-7."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.operators import detect, parse
from tests import samples as S

EXPECTED_SOURCE = {
    1: ("kubernetes", S.KUBERNETES), 2: ("docker", S.DOCKER), 3: ("nginx", S.NGINX),
    4: ("nginx", S.NGINX_ERROR), 5: ("apache", S.APACHE), 6: ("jenkins", S.JENKINS),
    7: ("github_actions", S.GITHUB_ACTIONS), 8: ("terraform", S.TERRAFORM),
    9: ("cloudwatch", S.CLOUDWATCH), 10: ("generic", S.GENERIC),
}


def test_detect_source_per_sample(files_df):
    df = files_df({k: v[1] for k, v in EXPECTED_SOURCE.items()})
    got = dict(df.select("file_id", detect.detect_source(F.col("text")).alias("s")).collect())
    assert got == {k: v[0] for k, v in EXPECTED_SOURCE.items()}


def test_quirks_q2_q3_q4(files_df):
    df = files_df({
        1: "2024-01-01T00:00:00 something happened",       # Q-2: leading ISO stamp -> docker
        2: "deploy step\nerror: cannot open file",           # Q-3: "Error:" in any case -> terraform
        3: '1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET / HTTP/1.1" 200 1',  # Q-4 -> nginx
    })
    got = dict(df.select("file_id", detect.detect_source(F.col("text")).alias("s")).collect())
    assert got == {1: "docker", 2: "terraform", 3: "nginx"}


def test_classify_scored(files_df):
    df = files_df({1: "kubectl apply\npod/x\nGET\n", 2: "plain words only"})
    rows = {r.file_id: r for r in df.select("file_id", detect.classify_source_scored(F.col("text")).alias("c")).collect()}
    assert rows[1].c.source == "kubernetes" and rows[1].c.confidence == 1.0
    assert rows[2].c.source == "generic" and rows[2].c.confidence == 0.5


def _entries(files_df, text):
    e = parse.parse_logs(files_df({1: text}))
    return [r.asDict() for r in e.orderBy("line_no").collect()]


def test_parse_kubernetes(files_df):
    rows = _entries(files_df, S.KUBERNETES)
    assert len(rows) == 5
    assert rows[0]["ts"] == dt.datetime(2024, 3, 1, 10, 0, 0)
    assert rows[0]["message"].startswith("[kubelet] Pulling")
    assert rows[2]["level"] == "WARN"  # WARNING folded
    assert all(r["source"] == "kubernetes" for r in rows)


def test_parse_nginx_access_and_error(files_df):
    rows = _entries(files_df, S.NGINX)
    assert rows[1]["level"] == "ERROR" and rows[1]["message"] == "POST /api/pay - 502"
    assert rows[0]["metadata"]["size"] == "512" and rows[2]["metadata"]["size"] is None
    err = _entries(files_df, S.NGINX_ERROR)
    assert [r["level"] for r in err] == ["ERROR", "WARN", "CRITICAL"]
    assert err[0]["ts"] == dt.datetime(2024, 3, 1, 12, 5, 0)
    assert err[0]["metadata"]["pid"] == "1234"


def test_parse_jenkins_q6(files_df):
    rows = _entries(files_df, S.JENKINS)
    assert rows[0]["ts"] == dt.datetime(2024, 3, 1, 14, 0, 0, 123000)
    assert rows[0]["message"].startswith("[id=42]")
    # Q-6: no space before the zone -> no stamp, message uncut
    sev = [r for r in rows if "SEVERE" in r["raw"]][0]
    assert sev["ts"] is None and sev["message"] == sev["raw"] and sev["level"] == "ERROR"
    stage = [r for r in rows if r["raw"].startswith("[Pipeline] {")][0]
    assert stage["metadata"]["pipeline_action"] == "{ (Build)"


def test_parse_github_actions(files_df):
    rows = _entries(files_df, S.GITHUB_ACTIONS)
    ann = [r for r in rows if r["raw"].startswith("error::")][0]
    assert ann["level"] == "ERROR" and ann["message"] == ":Type error"
    assert ann["metadata"] == {"file": "src/app.ts", "line": "10", "col": "5"}
    warn = [r for r in rows if r["raw"].startswith("warning::")][0]
    assert warn["level"] == "WARNING" and warn["metadata"] == {"title": "Deprecated"}
    assert warn["message"] == "node 16 is deprecated"
    # Q-5: ##[error] lines get no level
    assert [r for r in rows if r["raw"].startswith("##[error]")][0]["level"] is None


def test_parse_terraform_and_cloudwatch(files_df):
    tf = _entries(files_df, S.TERRAFORM)
    dbg = [r for r in tf if r["raw"].startswith("[DEBUG]")][0]
    assert dbg["level"] == "DEBUG" and dbg["message"] == "provider: starting plugin"
    assert dbg["ts"] == dt.datetime(2024, 3, 1, 15, 0, 0)
    cw = _entries(files_df, S.CLOUDWATCH)
    assert cw[0]["level"] == "ERROR" and cw[0]["raw"] == ""  # no "message" key -> raw ""
    assert cw[1]["ts"] == dt.datetime(2024, 3, 1, 16, 0, 1)  # epoch milliseconds
    assert cw[1]["raw"] == '{"@timestamp": 1709308801000, "message": "INFO request served", "logGroup": "/ecs/app"}'
    assert cw[2]["level"] == "WARN" and cw[2]["metadata"] == {"logStream": "app/1"}


def test_parse_generic_q7(files_df):
    rows = _entries(files_df, S.GENERIC)
    assert rows[1]["level"] == "WARN"
    syslog = rows[3]
    assert syslog["ts"] == dt.datetime(1900, 3, 1, 17, 0, 3)   # year 1900
    assert syslog["message"].startswith("host app[1]")
    naive = _entries(files_df, "2024-01-01T10:30:00 ERROR boom")
    # generic? no: a leading ISO stamp makes it docker (Q-2); force the generic parser instead
    e = parse.parse_logs(files_df({1: "x\n2024-01-01T10:30:00 ERROR boom"}).withColumn("forced", F.lit("generic")),
                         forced_col="forced").orderBy("line_no").collect()
    assert e[1]["ts"] is None and e[1]["message"] == "ERROR boom" and e[1]["level"] == "ERROR"
    assert naive[0]["source"] == "docker"


def test_batch_counts(files_df):
    df = files_df({1: "a\n\n  \nb\n"})
    r = parse.batch_counts(df).collect()[0]
    assert (r.total_lines, r.parsed_lines, r.failed_lines) == (4, 2, 0)


def test_forced_unknown_is_generic(files_df):
    df = files_df({1: S.NGINX}).withColumn("forced", F.lit("nope"))
    got = parse.with_parser_source(df, forced_col="forced").collect()[0]["source"]
    assert got == "generic"


def test_cloudwatch_json_export_d11(files_df):
    text = ('[{"@timestamp": "2024-03-01T16:00:00Z", "message": "ERROR disk full", "logStream": "a"}, '
            '"not an object", {"@timestamp": 1709308801000, "@message": "WARNING slow"}]')
    df = files_df({1: text}).withColumn("forced", F.lit("cloudwatch"))
    rows = parse.parse_logs(df, forced_col="forced").orderBy("line_no").collect()
    assert len(rows) == 2                              # the non-object item is skipped
    assert rows[0].level == "ERROR" and rows[0].message == "ERROR disk full"
    assert rows[0].metadata == {"logStream": "a"} and rows[0].ts == dt.datetime(2024, 3, 1, 16, 0, 0)
    assert rows[1].level == "WARN" and rows[1].ts == dt.datetime(2024, 3, 1, 16, 0, 1) and rows[1].raw == ""
