"""Derived views over the driver tables (FIXTURES.md §3).

The driver tables hold no log text, so log lines are rendered from
``events`` with one template per (file kind, event type).  Every view is a
projection/join/aggregation of the given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules

LINES_PER_FILE = 50

# ---------------------------------------------------------------------------
# FIXED VALUES: log line templates by file kind (file_id % 9) and event type.
# Placeholders: {iso} {clf} {jts} {sp} {ngx} {uid} {eid}; "\t" is a tab.
# ---------------------------------------------------------------------------
KIND_PREFIX = {
    0: "{iso} [kubelet] ",
    4: "{jts} ",
    8: "{sp} ",
}
LINE_TEMPLATES: dict[int, dict[str, str]] = {
    0: {  # kubernetes
        "click": "ErrImagePull for image app:{eid}",
        "error": "ERROR Back-off restarting failed container pod/app-{uid}",
        "purchase": "Container app-{uid} OOMKilled - out of memory",
        "signup": "WARNING readiness probe failed: dial timeout",
        "view": "INFO pod/app-{uid} Running",
    },
    1: {  # docker
        "click": "{iso} containerd: segmentation fault {eid}",
        "error": "{iso} docker[{uid}]: level=ERROR no space left on device",
        "purchase": '{"log":"INFO paid {eid}","stream":"stdout","time":"{iso}"}',
        "signup": "{iso} container app{uid} started",
        "view": "{iso} WARNING load average {uid}",
    },
    2: {  # nginx
        "click": '10.0.0.{uid} - - [{clf}] "GET /click HTTP/1.1" 200 {eid}',
        "error": '10.0.0.{uid} - - [{clf}] "POST /api HTTP/1.1" 500 -',
        "purchase": '10.0.0.{uid} - - [{clf}] "GET /missing HTTP/1.1" 404 {eid} "-" "curl/8"',
        "signup": "{ngx} [error] {uid}#7: *{eid} connect() failed (111: Connection refused)",
        "view": "{ngx} [warn] {uid}#7: upstream disabled",
    },
    3: {  # apache
        "click": '10.0.0.{uid} - admin [{clf}] "GET /click HTTP/1.1" 200 {eid} "-" "curl/8"',
        "error": "[{clf}] [core] [crit] database query error {eid}",
        "purchase": '10.0.0.{uid} - admin [{clf}] "GET /missing HTTP/1.1" 404 {eid}',
        "signup": "[{clf}] [ssl] [warn] certificate expired {uid}",
        "view": '10.0.0.{uid} x bob [{clf}] "HEAD / HTTP/1.1" 503 -',
    },
    4: {  # jenkins
        "click": "Finished: FAILURE",
        "error": "SEVERE: Build failed with exception",
        "purchase": "[Pipeline] stage deploy {eid}",
        "signup": "INFO hudson.model.Run ok",
        "view": "warning: 3 tests failed",
    },
    5: {  # github_actions
        "click": "Run actions/checkout@v4",
        "error": "##[error]Process completed with exit code 1",
        "purchase": "error::file=app.js,line={uid}:boom {eid}",
        "signup": "GITHUB_RUN_ID={eid}",
        "view": "##[warning]deprecated {uid}",
    },
    6: {  # terraform
        "click": "Apply complete",
        "error": "[ERROR] {iso} Error: Invalid configuration {eid}",
        "purchase": "Plan: {uid} to add, 0 to change, 0 to destroy.",
        "signup": "[WARN] provider slow {eid}",
        "view": "[DEBUG] {iso} refresh {eid}",
    },
    7: {  # cloudwatch
        "click": "{iso}\tGET ok {eid}\ts{uid}",
        "error": '{"@timestamp":"{iso}","@message":"ERROR connection refused {eid}","logStream":"s{uid}"}',
        "purchase": '{"@timestamp":"{iso}","message":"WARNING TLS handshake {eid}","logGroup":"g"}',
        "signup": '{"@timestamp":"{iso}","@message":"getaddrinfo failed","logStream":"s{uid}"}',
        "view": '{"@timestamp":"{iso}","@message":"ok","logStream":"s{uid}"}',
    },
    8: {  # generic
        "click": "DEBUG heap size {eid}",
        "error": "ERROR Failed to connect to database: connection refused",
        "purchase": "CRITICAL panic: runtime error {eid}",
        "signup": "INFO deployment started {uid}",
        "view": "WARN request timed out after {uid}s",
    },
}

# FIXED VALUES: incident severity by order priority.
PRIORITY_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
# FIXED VALUES: job status by (returnflag, linestatus).
ATTACHMENT_KIND_BY_MOD3 = {0: "log", 1: "yaml", 2: "screenshot"}


def full_templates() -> dict[str, str]:
    """Template text keyed ``"<kind>:<event_type>"`` with the kind prefix applied."""
    out = {}
    for kind, by_type in LINE_TEMPLATES.items():
        for etype, tmpl in by_type.items():
            out[f"{kind}:{etype}"] = KIND_PREFIX.get(kind, "") + tmpl
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _map_literal(d: dict) -> F.Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def render_log_lines(events: DataFrame) -> DataFrame:
    """``log_lines(file_id, line_no, event_id, ts, line)`` from events.

    A pure projection: one output row per event, no shuffle.
    """
    ts = F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clf = F.concat(F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    jts = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".000 +0000"))
    sp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    ngx = F.date_format(ts, "yyyy/MM/dd HH:mm:ss")
    file_id = F.floor(F.col("event_id") / LINES_PER_FILE).cast("long")
    kind = F.pmod(file_id, F.lit(9))
    tmpl = F.try_element_at(_map_literal(full_templates()),
                        F.concat(kind.cast("string"), F.lit(":"), F.col("event_type")))
    line = tmpl
    for key, val in (("{iso}", iso), ("{clf}", clf), ("{jts}", jts), ("{sp}", sp),
                     ("{ngx}", ngx), ("{uid}", F.col("user_id").cast("string")),
                     ("{eid}", F.col("event_id").cast("string"))):
        line = F.replace(line, F.lit(key), val)
    return events.select(
        file_id.alias("file_id"),
        F.pmod(F.col("event_id"), F.lit(LINES_PER_FILE)).cast("int").alias("line_no"),
        "event_id",
        "ts",
        line.alias("line"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_log_lines(table(spark, sf_dir, "events"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_files(file_id, text)``: lines joined by LF in line order.

    ``file_id = event_id div 50`` and ``event_id`` is the events key, so a
    file holds at most 50 template lines: the group is bounded by
    construction and one ``groupBy`` suffices.  Line tables without such a
    bound go through ``files.assemble_files``.
    """
    from ..sources.files import simple_assemble_files
    return simple_assemble_files(log_lines(spark, sf_dir))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents from orders; ``ended_at`` = last ship date of the order's lines.

    The per-order max is a partial (map-side) aggregate before the shuffle;
    the join to orders is a plain equi-join on the order key.
    """
    orders = table(spark, sf_dir, "orders")
    ends = (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended_at")))
    sev = F.coalesce(F.try_element_at(_map_literal(PRIORITY_SEVERITY), F.col("o_orderpriority")),
                     F.lit("low"))
    return (orders.join(ends, orders.o_orderkey == ends.l_orderkey, "left")
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_custkey").alias("owner_user_id"),
                F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
                F.lit(None).cast("string").alias("description"),
                sev.alias("severity"),
                F.col("o_orderstatus").alias("environment"),
                F.concat(F.lit("svc-"), F.pmod(F.col("o_custkey"), F.lit(10)).cast("string")).alias("service_name"),
                F.lit(None).cast("string").alias("deployment_version"),
                F.col("o_orderdate").alias("started_at"),
                F.col("ended_at"),
                F.col("o_orderdate").alias("created_at"),
                F.col("o_orderdate").alias("updated_at"),
            ))


ATTACHMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
ID_STRIDE = 1_000_000


def _lineitem_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with a unique deterministic id.

    ``id = l_orderkey * 1e6 + row_number() within the order`` — the window is
    partitioned by order key (no global single-partition row_number).
    """
    w = Window.partitionBy("l_orderkey").orderBy(*ATTACHMENT_ORDER)
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("id", F.col("l_orderkey") * ID_STRIDE + F.row_number().over(w))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_with_id(spark, sf_dir)
    kind = F.try_element_at(_map_literal(ATTACHMENT_KIND_BY_MOD3), F.pmod(F.col("l_linenumber"), F.lit(3)))
    return li.select(
        "id",
        F.col("l_orderkey").alias("incident_id"),
        F.col("l_suppkey").alias("uploaded_by_user_id"),
        kind.alias("kind"),
        F.concat(F.lit("file-"), F.col("id").cast("string"), F.lit(".log")).alias("filename"),
        F.lit("text/plain").alias("content_type"),
        F.concat(F.lit("/uploads/"), F.col("l_orderkey").cast("string"), F.lit("/"),
                 F.col("id").cast("string")).alias("storage_path"),
        (F.col("l_quantity") * 1024).cast("long").alias("size_bytes"),
        F.col("l_shipdate").alias("created_at"),
    )


def attachment_file(incident_id: F.Column, attachment_id: F.Column) -> F.Column:
    """Log file that an attachment stands for: its incident's number plus its line number."""
    return incident_id + F.pmod(attachment_id, F.lit(ID_STRIDE))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_with_id(spark, sf_dir)
    status = (F.when(F.col("l_returnflag") == "R", "failed")
              .when(F.col("l_returnflag") == "A", "succeeded")
              .when(F.col("l_linestatus") == "O", "queued")
              .otherwise("running"))
    src = F.element_at(F.array(*[F.lit(s) for s in rules.SOURCES]),
                       (F.pmod(F.col("l_partkey"), F.lit(9)) + 1).cast("int"))
    started = F.when(status != "queued", F.col("l_shipdate"))
    finished = F.when(status.isin("succeeded", "failed"),
                      F.col("l_shipdate") + F.make_dt_interval(
                          F.lit(0), F.lit(0), F.col("l_linenumber").cast("int") * 5, F.lit(0)))
    return li.select(
        "id",
        F.col("l_orderkey").alias("incident_id"),
        F.col("id").alias("attachment_id"),
        status.alias("status"),
        src.alias("source_type"),
        F.when(status == "failed", F.lit("ingestion failed")).alias("error"),
        F.col("l_shipdate").alias("created_at"),
        started.alias("started_at"),
        finished.alias("finished_at"),
    )


def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational findings rows (FIXTURES.md §3.2, pure form): one per lineitem."""
    li = _lineitem_with_id(spark, sf_dir)
    cats = F.array(*[F.lit(r.category) for r in rules.DETECTION_RULES])
    titles = F.array(*[F.lit(r.title) for r in rules.DETECTION_RULES])
    idx = (F.pmod(F.col("l_suppkey"), F.lit(20)) + 1).cast("int")
    sev = F.element_at(F.array(*[F.lit(s) for s in rules.SEVERITIES]),
                       (F.pmod(F.col("l_linenumber"), F.lit(4)) + 1).cast("int"))
    return li.select(
        "id",
        F.col("l_orderkey").alias("incident_id"),
        F.col("id").alias("attachment_id"),
        F.col("id").alias("job_id"),
        F.element_at(cats, idx).alias("category"),
        sev.alias("severity"),
        F.element_at(titles, idx).alias("title"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("evidence"),
        F.element_at(F.array(*[F.lit(s) for s in rules.SOURCES]),
                     (F.pmod(F.col("l_partkey"), F.lit(9)) + 1).cast("int")).alias("source_type"),
        F.col("l_shipdate").alias("created_at"),
    )


def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incident_events`` from log lines: one event per line of an incident's file."""
    ll = log_lines(spark, sf_dir)
    return ll.select(
        F.col("event_id").alias("id"),
        F.col("file_id").alias("incident_id"),
        F.col("ts").alias("occurred_at"),
        F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("title"),
        F.col("line").alias("detail"),
        F.lit("auto").alias("source"),
        F.col("ts").alias("created_at"),
    )


def analysis_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads (FIXTURES.md §3.2): one per log file and one per conversation.

    Log files: summary = first line, logs = [text], incident_type = detected
    source, tags = [auto-analysis, source].  Conversations: message = text
    of turn 0 (prose without incident signals).
    """
    from ..functions.text import first_nonblank_lines
    from ..operators.detect import detect_source
    files = log_files(spark, sf_dir)
    src = detect_source(F.col("text"))
    logs = files.select(
        F.concat(F.lit("log-"), F.col("file_id").cast("string")).alias("incident_id"),
        F.element_at(first_nonblank_lines(F.col("text"), 1), 1).alias("summary"),
        F.array(F.col("text")).alias("logs"),
        src.alias("incident_type"),
        F.array(F.lit("auto-analysis"), src).alias("tags"),
        F.lit(None).cast("string").alias("message"),
    )
    conv = (messages(spark, sf_dir)
            .select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("incident_id"),
                    F.lit(None).cast("string").alias("summary"),
                    F.lit(None).cast("array<string>").alias("logs"),
                    F.lit(None).cast("string").alias("incident_type"),
                    F.lit(None).cast("array<string>").alias("tags"),
                    "message"))
    return logs.unionByName(conv)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and message: all turns of a conversation in order, one line break between."""
    turns = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("turn", "text"))))
    return (table(spark, sf_dir, "conversations").groupBy("conv_id")
            .agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("message")))
