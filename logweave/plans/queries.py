"""The registered query set: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or views Spark derives from them) in
full; none runs on fixed inputs.  Column names equal those of the DuckDB
oracle in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as fnd
from ..operators import parse as prs
from ..sources import fixtures as fx
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def finalize(df: DataFrame) -> DataFrame:
    """Stable output types: integers -> bigint, timestamps -> 'yyyy-MM-dd HH:mm:ss' text."""
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.pipeline_findings(fx.log_files(spark, sf_dir))


@register("finding_counts")
def q_finding_counts(spark, sf_dir):
    """Minimum slice: events -> log files -> detect/clean/classify -> rules -> counts."""
    return fnd.finding_counts(log_findings(spark, sf_dir))


def ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@register("parse_logs")
def q_parse_logs(spark, sf_dir):
    """D-14 (D-1 ... D-13 by source): every entry of every log file."""
    return entry_rows(prs.parse_logs(fx.log_files(spark, sf_dir)))


def entry_rows(e):
    return e.select("file_id", "line_no", "ts", "level", "message", "source",
                    prs.metadata_text(F.col("metadata")).alias("meta"), "raw")


@register("batch_counts")
def q_batch_counts(spark, sf_dir):
    """D-15: total / parsed / failed line counts per file."""
    return prs.batch_counts(fx.log_files(spark, sf_dir))


@register("k8s_batch_flags")
def q_k8s_flags(spark, sf_dir):
    """D-2: Kubernetes flags over each whole text."""
    return prs.k8s_batch_flags(fx.log_files(spark, sf_dir))


# ---------------------------------------------------------------------------
# B: line handling and cleaning
# ---------------------------------------------------------------------------
from ..functions import text as tx  # noqa: E402
from ..operators import detect as dt  # noqa: E402


def dirty_files(spark, sf_dir):
    """Log files with ANSI colour codes, CR/CRLF line ends, NUL bytes and trailing blanks added."""
    f = fx.log_files(spark, sf_dir)
    t = F.concat(F.lit("\x1b[31m"), F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\r\n")),
                 F.lit("\x1b[0m\x00  \r"))
    return f.select("file_id", t.alias("text"))


@register("b1_explode_lines")
def q_b1(spark, sf_dir):
    """B-1: non-blank stripped lines with their splitlines() index."""
    return prs.explode_lines(fx.log_files(spark, sf_dir).select("file_id", "text"))


@register("b2_clean_text")
def q_b2(spark, sf_dir):
    """B-2: cleaning of texts carrying ANSI codes, CR line ends, NUL and trailing blanks."""
    d = dirty_files(spark, sf_dir)
    return d.select("file_id", tx.clean_text(F.col("text")).alias("clean_text"))


@register("b3_normalize_text")
def q_b3(spark, sf_dir):
    """B-3: document normalisation, reported as digest and length of the whole result."""
    n = tx.normalize_text(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(n, 256).alias("digest"), F.length(n).alias("n_chars"))


@register("b4_first_nonblank_lines")
def q_b4(spark, sf_dir):
    """B-4: first three stripped non-blank lines of each file (LF-joined)."""
    return fx.log_files(spark, sf_dir).select(
        "file_id", F.array_join(tx.first_nonblank_lines(F.col("text"), 3), "\n").alias("evidence"))


# ---------------------------------------------------------------------------
# C: source detection
# ---------------------------------------------------------------------------
def _files_clean(spark, sf_dir):
    return fx.log_files(spark, sf_dir).select("file_id", "text", tx.clean_text(F.col("text")).alias("clean_text"))


@register("c1_detect_source")
def q_c1(spark, sf_dir):
    return fx.log_files(spark, sf_dir).select("file_id", dt.detect_source(F.col("text")).alias("source"))


@register("c2_classify_source")
def q_c2(spark, sf_dir):
    return _files_clean(spark, sf_dir).select("file_id", dt.classify_source(F.col("clean_text")).alias("source"))


@register("c3_classify_source_scored")
def q_c3(spark, sf_dir):
    s = dt.classify_source_scored(F.col("clean_text"))
    return _files_clean(spark, sf_dir).select("file_id", s["source"].alias("source"),
                                              F.round(s["confidence"], 6).alias("confidence"))


@register("c4_source_match_counts")
def q_c4(spark, sf_dir):
    m = dt.source_match_counts(F.col("clean_text"))
    return (_files_clean(spark, sf_dir).select("file_id", F.explode(m).alias("source", "n"))
            .select("file_id", "source", F.col("n").cast("long").alias("n")))


@register("c5_resolve_source")
def q_c5(spark, sf_dir):
    p = pipeline.prepare_files(fx.log_files(spark, sf_dir))
    return p.select("file_id", "parser_source", "classification_source",
                    F.round("classification_confidence", 6).alias("classification_confidence"), "source")


@register("c6_forced_source")
def q_c6(spark, sf_dir):
    """C-6: a forced name per file (valid, unknown or none) overrides detection."""
    f = fx.log_files(spark, sf_dir)
    forced = (F.when(F.pmod(F.col("file_id"), F.lit(3)) == 0, F.lit("Nginx"))
              .when(F.pmod(F.col("file_id"), F.lit(3)) == 1, F.lit("syslog")))
    return f.select("file_id", dt.forced_source(forced, dt.detect_source(F.col("text"))).alias("source"))


# ---------------------------------------------------------------------------
# E: findings
# ---------------------------------------------------------------------------
@register("e2_rule_applicability")
def q_e2(spark, sf_dir):
    """E-2: (file, rule) pairs whose source filter admits the file's resolved source."""
    p = pipeline.resolve_files(fx.log_files(spark, sf_dir))
    from .. import rules as R
    ok = F.array(*[F.when(fnd.rule_applies(r, F.col("source")), F.lit(r.rule_no)) for r in R.DETECTION_RULES])
    return p.select("file_id", "source", F.explode(F.array_compact(ok)).alias("rule_no"))


@register("e3_find_matches")
def q_e3(spark, sf_dir):
    """E-3: offsets of every match of every applicable rule (before dedup)."""
    p = pipeline.resolve_files(fx.log_files(spark, sf_dir))
    return fnd.match_offsets(p, text_col="clean_text", source_col="source")


@register("e7_detect_findings")
def q_e7(spark, sf_dir):
    """E-4 ... E-7: full finding rows (evidence windows, dedup)."""
    return log_findings(spark, sf_dir)


@register("e8_detect_findings_from_entries")
def q_e8(spark, sf_dir):
    """E-8: rules per parsed entry message, carrying the entry's timestamp."""
    e = prs.parse_logs(fx.log_files(spark, sf_dir))
    return fnd.detect_findings_from_entries(e)


@register("e9_finding_summary")
def q_e9(spark, sf_dir):
    return fnd.finding_summary(log_findings(spark, sf_dir), files=fx.log_files(spark, sf_dir))


@register("e10_brief_findings")
def q_e10(spark, sf_dir):
    b = fnd.brief_findings(log_findings(spark, sf_dir), files=fx.log_files(spark, sf_dir))
    return b.select("file_id", F.array_join("critical_list", "|").alias("critical_list"),
                    F.array_join("high_list", "|").alias("high_list"))


@register("e10_brief_titles")
def q_e10t(spark, sf_dir):
    """E-10 with a row per title instead of lists."""
    return fnd.brief_titles(log_findings(spark, sf_dir))


@register("e11_brief_message")
def q_e11(spark, sf_dir):
    s = fnd.brief_message(fnd.finding_summary(log_findings(spark, sf_dir), files=fx.log_files(spark, sf_dir)))
    return s.select("file_id", "message")


@register("e12_severity_flags")
def q_e12(spark, sf_dir):
    return fnd.severity_flags(log_findings(spark, sf_dir), files=fx.log_files(spark, sf_dir))


# ---------------------------------------------------------------------------
# H: relational queries
# ---------------------------------------------------------------------------
from ..operators import store  # noqa: E402


@register("h1_jobs_by_incident")
def q_h1(spark, sf_dir):
    return store.jobs_by_incident(fx.jobs(spark, sf_dir)).select("incident_id", "id", "status", "created_at", "pos")


@register("h3_findings_by_job")
def q_h3(spark, sf_dir):
    return store.findings_by_job(fx.findings_table(spark, sf_dir)).select("job_id", "id", "severity", "category", "pos")


@register("h4_findings_by_incident")
def q_h4(spark, sf_dir):
    return store.findings_by_incident(fx.findings_table(spark, sf_dir)).select(
        "incident_id", "id", "severity", "created_at", "pos")


@register("h5_critical_findings")
def q_h5(spark, sf_dir):
    """H-5: top ten critical/high findings (a top-k report: the limit is the feature)."""
    return store.critical_findings(fx.findings_table(spark, sf_dir), limit=10).select(
        "id", "incident_id", "severity", "category", "created_at")


@register("h5_critical_findings_ranked")
def q_h5r(spark, sf_dir):
    """H-5 with ``rank_severity=True``: critical before high."""
    return store.critical_findings(fx.findings_table(spark, sf_dir), limit=10, rank_severity=True).select(
        "id", "incident_id", "severity", "category", "created_at")


@register("h6_job_status_counts")
def q_h6(spark, sf_dir):
    return store.job_status_counts(fx.jobs(spark, sf_dir))


@register("h8_severity_counts")
def q_h8s(spark, sf_dir):
    return store.severity_counts(fx.findings_table(spark, sf_dir))


@register("h8_category_counts")
def q_h8c(spark, sf_dir):
    return store.category_counts(fx.findings_table(spark, sf_dir))


@register("h10_jobs_for_owner")
def q_h10(spark, sf_dir):
    return store.jobs_for_owner(fx.jobs(spark, sf_dir), fx.incidents(spark, sf_dir)).select(
        "owner_user_id", "incident_id", "id", "created_at", "pos")


@register("h11_owned_by")
def q_h11(spark, sf_dir):
    """H-11: findings visible to the customers of one market segment."""
    users = fx.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("user_id"))
    return store.owned_by(fx.findings_table(spark, sf_dir), fx.incidents(spark, sf_dir), users).select(
        "id", "incident_id", "category")


@register("h12_incidents_by_owner")
def q_h12(spark, sf_dir):
    return store.incidents_by_owner(fx.incidents(spark, sf_dir)).select("owner_user_id", "id", "created_at", "pos")


@register("h13_lookup_by_id")
def q_h13(spark, sf_dir):
    """H-13: the incidents of every failed job (a keyed lookup as a semi join)."""
    ids = fx.jobs(spark, sf_dir).where(F.col("status") == "failed").select("incident_id")
    return store.lookup_by_id(fx.incidents(spark, sf_dir), ids).select("id", "title", "severity")


@register("h14_latest_log_attachment")
def q_h14(spark, sf_dir):
    return store.latest_log_attachment(fx.attachments(spark, sf_dir))


@register("h15_incident_timeline")
def q_h15(spark, sf_dir):
    return store.incident_timeline(fx.incident_events(spark, sf_dir)).select("incident_id", "id", "occurred_at", "pos")


@register("h16_job_state")
def q_h16(spark, sf_dir):
    return store.job_state(store.job_transitions(fx.jobs(spark, sf_dir)))


@register("h17_touch_incident")
def q_h17(spark, sf_dir):
    return store.touch_incident(fx.incidents(spark, sf_dir), fx.attachments(spark, sf_dir)).select("id", "updated_at")


@register("h18_incident_defaults")
def q_h18(spark, sf_dir):
    return store.incident_defaults(fx.incidents(spark, sf_dir)).select(
        "id", "severity_eff", "environment_eff", "title_valid")


# ---------------------------------------------------------------------------
# I: timeline, J: incident analysis
# ---------------------------------------------------------------------------
from ..operators import incidents as inc  # noqa: E402
from ..operators import timeline as tl  # noqa: E402

RUN_TS = "2025-01-01 00:00:00"


@register("i4_generate_timeline")
def q_i4(spark, sf_dir):
    """I-1 ... I-4: timeline events of every log file, base date from its incident."""
    t = tl.timeline_for_incidents(fx.log_files(spark, sf_dir), fx.incidents(spark, sf_dir),
                                  F.lit(RUN_TS).cast("timestamp_ntz"))
    return t.select("file_id", "occurred_at", "title", "detail", "source", "line_no", "pos")


@register("i4_generate_timeline_line_date")
def q_i4d(spark, sf_dir):
    """I-4 with ``use_line_date=True`` (the dated pattern is tried first)."""
    t = tl.timeline_for_incidents(fx.log_files(spark, sf_dir), fx.incidents(spark, sf_dir),
                                  F.lit(RUN_TS).cast("timestamp_ntz"), use_line_date=True)
    return t.select("file_id", "occurred_at", "title", "detail", "line_no", "pos")


def _analysis(spark, sf_dir):
    return inc.analyze_incidents(fx.analysis_payloads(spark, sf_dir))


def _j(c):
    return F.array_join(F.col(c), "|")


@register("j13_analyze_incidents")
def q_j13(spark, sf_dir):
    """J-2 ... J-13: routing, agents, merge, root cause and fixes for every payload."""
    a = _analysis(spark, sf_dir)
    return a.select(
        "incident_id", F.array_join("agents", ",").alias("agents"), "summary",
        _j("findings").alias("findings"), _j("evidence").alias("evidence"),
        F.col("root_cause.summary").alias("rc_summary"),
        F.array_join("root_cause.findings", "|").alias("rc_findings"),
        F.col("root_cause.confidence").alias("rc_confidence"),
        F.array_join("root_cause.evidence", "|").alias("rc_evidence"),
        F.col("root_cause.severity").alias("rc_severity"),
        F.array_join("root_cause.dependency_chain", "|").alias("rc_dependency_chain"),
        _j("recommendations").alias("recommendations"))


@register("j3_route_agents")
def q_j3(spark, sf_dir):
    p = inc.with_payload_fields(fx.analysis_payloads(spark, sf_dir))
    return p.select("incident_id", F.explode(inc.route_agents()).alias("agent"))


@register("j2_payload_text")
def q_j2(spark, sf_dir):
    """J-2: payloads with nested fields (objects and lists in a struct, a variant), as the agents and the router see them."""
    files = fx.log_files(spark, sf_dir).select("file_id", tx.split_lines(F.col("text")).alias("ls"))
    meta = F.struct(F.slice("ls", 1, 2).alias("head"), F.size("ls").alias("n"))
    details = F.struct(meta.alias("meta"), F.array(F.array(F.element_at("ls", -1))).alias("tail"))
    alerts = F.parse_json(F.concat(F.lit('{"a": null, "b": ['), F.col("file_id").cast("string"), F.lit(', {"c": ["alert '),
                                   F.col("file_id").cast("string"), F.lit('", true]}]}')))
    p = inc.with_payload_fields(files.select("file_id", F.element_at("ls", 1).alias("summary"), details.alias("details"), alerts.alias("alerts")))
    return p.select("file_id", inc.payload_text(["summary", "details", "alerts", "error"]).alias("text"), "router_text")


@register("j11_root_cause")
def q_j11(spark, sf_dir):
    """J-11: affected systems and remediation steps of every payload."""
    return _analysis(spark, sf_dir).select(
        "incident_id", F.array_join("root_cause.affected_systems", "|").alias("affected_systems"),
        F.array_join("root_cause.remediation_steps", "|").alias("remediation_steps"))


@register("j10_agent_results")
def q_j10(spark, sf_dir):
    """J-4 ... J-9: one row per (incident, agent) with summary, findings, confidence, evidence."""
    r = inc.agent_results_long(fx.analysis_payloads(spark, sf_dir))
    return r.select("incident_id", "agent", "summary", F.array_join("findings", "|").alias("findings"),
                    "confidence", F.array_join("evidence", "|").alias("evidence"))


@register("j14_ai_events")
def q_j14(spark, sf_dir):
    return inc.ai_event(_analysis(spark, sf_dir)).select("incident_id", "title", "detail", "source")


@register("j15_auto_analyze")
def q_j15(spark, sf_dir):
    """J-15 / J-16: the upload hook — pipeline source per file, then the analysis and its event."""
    files = pipeline.settled(pipeline.resolve_files(fx.log_files(spark, sf_dir)), "file_id", "text", "source")
    payloads = inc.auto_analyze_payloads(files)
    res = inc.analyze_incidents(payloads)
    ev = inc.ai_event(res, auto=True)
    return ev.select(F.col("incident_id").alias("file_id"), "title", "detail")


# ---------------------------------------------------------------------------
# F: chunking
# ---------------------------------------------------------------------------
from ..operators import chunking as ch  # noqa: E402


def log_chunks(spark, sf_dir):
    """F-1 over the cleaned text of every log file (as the pipeline does)."""
    files = fx.log_files(spark, sf_dir).select("file_id", tx.clean_text(F.col("text")).alias("text"))
    return ch.chunk_log_lines(files)


def doc_chunks(spark, sf_dir):
    """F-4 over normalised documents."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", tx.normalize_text(F.col("text")).alias("text"))
    return ch.chunk_documents(docs, keep=["source"])


@register("f1_chunk_log_lines")
def q_f1(spark, sf_dir):
    """F-1 / F-8: log chunks (2200/200, line mode) with checksums."""
    return chunk_rows(log_chunks(spark, sf_dir))


def chunk_rows(c):
    return c.select("file_id", "chunk_index", "start_line", "end_line", "checksum", F.length("text").alias("n_chars"))


@register("f2_chunk_non_line_mode")
def q_f2(spark, sf_dir):
    """F-2: the same fold with respect_lines=False and a small budget (300/40)."""
    files = fx.log_files(spark, sf_dir).select("file_id", tx.clean_text(F.col("text")).alias("text"))
    c = ch.chunk_log_lines(files, max_chars=300, overlap_chars=40, respect_lines=False)
    return c.select("file_id", "chunk_index", "start_line", "end_line", "checksum")


@register("f3_single_chunk")
def q_f3(spark, sf_dir):
    """F-3: max_chars <= 0 gives one chunk with the whole text."""
    files = fx.log_files(spark, sf_dir).select("file_id", tx.clean_text(F.col("text")).alias("text"))
    c = ch.chunk_log_lines(files, max_chars=0)
    return c.select("file_id", "chunk_index", "start_line", "end_line", "checksum")


@register("f4_chunk_documents")
def q_f4(spark, sf_dir):
    """F-4: document chunks (1200/150)."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("text"))
    c = ch.chunk_documents(docs)
    return c.select("doc_id", "chunk_index", ch.checksum(F.col("text")).alias("checksum"), F.length("text").alias("n_chars"))


@register("f5_split_sentences")
def q_f5(spark, sf_dir):
    """F-5: paragraphs and sentences of every normalised document."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("t"))
    p = d.select("doc_id", F.posexplode(ch.split_paragraphs(F.col("t"))).alias("para_no", "para"))
    s = p.select("doc_id", "para_no", F.posexplode(ch.split_sentences(F.col("para"))).alias("sent_no", "sentence"))
    return s.select("doc_id", "para_no", "sent_no", ch.checksum(F.col("sentence")).alias("checksum"),
                    F.length("sentence").alias("n_chars"))


@register("f6_split_long")
def q_f6(spark, sf_dir):
    """F-6: fixed windows (1200, overlap 150) over every whole document text."""
    d = fx.table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.posexplode(ch.split_long(F.col("text"), 1200, 150)).alias("part_no", "part"))
    return w.select("doc_id", "part_no", ch.checksum(F.col("part")).alias("checksum"), F.length("part").alias("n_chars"))


@register("f7_chunk_ids")
def q_f7(spark, sf_dir):
    """F-7: content ids of document chunks with chunk_total."""
    return ch.chunk_ids(doc_chunks(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_id", "chunk_total")


@register("f9_dedup_chunks")
def q_f9(spark, sf_dir):
    """F-9: one log chunk per checksum (smallest file, index)."""
    return ch.dedup_chunks(log_chunks(spark, sf_dir)).select("checksum", "file_id", "chunk_index")


@register("f10_embedding_records")
def q_f10(spark, sf_dir):
    """F-10: embedding records of log chunks with the file id as extra metadata."""
    r = ch.embedding_records(log_chunks(spark, sf_dir), {"file_id": F.col("file_id")})
    return r.select("file_id", "chunk_index", prs.metadata_text(F.col("metadata")).alias("meta"))


# ---------------------------------------------------------------------------
# G: retrieval, K: KPIs
# ---------------------------------------------------------------------------
from ..operators import kpi  # noqa: E402
from ..operators import retrieval as rt  # noqa: E402


def topk_all(spark, sf_dir, k=5):
    e = fx.table(spark, sf_dir, "embeddings")
    return rt.cosine_topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, k=k, exclude_self=True)


@register("g2_cosine_topk")
def q_g2(spark, sf_dir):
    """G-2: the five nearest other vectors of every vector (exact cosine)."""
    return topk_all(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@register("g1_with_embeddings")
def q_g1(spark, sf_dir):
    """G-1: unit-norm vectors attached to documents by id (norm reported)."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    j = rt.with_embeddings(d, fx.table(spark, sf_dir, "embeddings"), "vec_id")
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return j.select("vec_id", "source", F.round(n, 6).alias("norm"), F.round(F.element_at("embedding", 1), 6).alias("x1"))


@register("g3_format_context")
def q_g3(spark, sf_dir):
    """G-3: context text of each vector's top five, with documents as the texts."""
    hits = topk_all(spark, sf_dir)
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    ctx = rt.format_context(hits.join(docs, "vec_id", "left"))
    return ctx.select("query_id", F.sha2("context", 256).alias("digest"), F.length("context").alias("n_chars"))


@register("g4_index_stats")
def q_g4(spark, sf_dir):
    """G-4: documents and chunks indexed."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("text"))
    return rt.index_stats(docs, ch.chunk_documents(docs))


@register("k1_mttr")
def q_k1(spark, sf_dir):
    return kpi.mttr(fx.incidents(spark, sf_dir)).select("service_name", "n_resolved",
                                                       F.round("mttr_seconds", 6).alias("mttr_seconds"))


@register("k2_pipeline_health")
def q_k2(spark, sf_dir):
    return kpi.pipeline_health(fx.jobs(spark, sf_dir)).select("period", "n_jobs", "n_succeeded",
                                                              F.round("health", 6).alias("health"))


@register("k2_pipeline_health_last_24h")
def q_k2b(spark, sf_dir):
    return kpi.pipeline_health_last_24h(fx.jobs(spark, sf_dir)).select("n_jobs", F.round("health", 6).alias("health"))


@register("k3_error_latency_trend")
def q_k3(spark, sf_dir):
    t = kpi.error_latency_trend(fx.table(spark, sf_dir, "events"))
    return t.select(F.col("day").cast("string").alias("day"), "errors", F.round("avg_latency", 6).alias("avg_latency"),
                    F.round("errors_rolling", 6).alias("errors_rolling"))


@register("k4_latency_p95")
def q_k4(spark, sf_dir):
    """K-4: exact 95th percentile of event values per event type."""
    return kpi.latency_p95(fx.table(spark, sf_dir, "events"), exact=True).select(
        "event_type", F.round("p95", 6).alias("p95"), "n")


@register("k4_error_rate")
def q_k4e(spark, sf_dir):
    return kpi.error_rate(fx.table(spark, sf_dir, "events"), by="user_id").select(
        "user_id", F.round("error_rate", 6).alias("error_rate"), "n")


@register("k5_integration_rollup")
def q_k5(spark, sf_dir):
    """K-5: services (job source types) with a failure rate over 25 % make the rollup degraded."""
    r = kpi.integration_rollup(kpi.service_status(fx.jobs(spark, sf_dir)))
    return r.select("total_integrations", F.array_join("degraded", ",").alias("degraded"), "status")


@register("k5_integration_services")
def q_k5s(spark, sf_dir):
    """K-5 with a row per service instead of a list."""
    return kpi.integration_services(kpi.service_status(fx.jobs(spark, sf_dir)))


@register("k6_docs_recall")
def q_k6(spark, sf_dir):
    """K-6: recall@5 of the exact top-k against the embedding labels, per label."""
    e = fx.table(spark, sf_dir, "embeddings")
    r = kpi.docs_recall(topk_all(spark, sf_dir), e.select("vec_id", "label"))
    return r.select(F.col("q_label").alias("label"), "n_queries", F.round("recall", 6).alias("recall"))


# ---------------------------------------------------------------------------
# S: streaming (availableNow over the driver tables; sinks in the checkpoint folder)
# ---------------------------------------------------------------------------
from ..streaming import ingest as st  # noqa: E402


def _ingested(spark, sf_dir):
    return st.stream_ingest(spark, st.log_line_stream(spark, sf_dir))


@register("s1_stream_ingest")
def q_s1(spark, sf_dir):
    """S-1: streamed findings, counted like ``finding_counts``."""
    return fnd.finding_counts(_ingested(spark, sf_dir).read("findings"))


@register("s1_stream_findings")
def q_s1f(spark, sf_dir):
    """S-1: the finding rows themselves."""
    return _ingested(spark, sf_dir).read("findings")


@register("s1_stream_entries")
def q_s1e(spark, sf_dir):
    """S-1: the entries of every streamed file."""
    return entry_rows(_ingested(spark, sf_dir).read("entries"))


@register("s1_stream_chunks")
def q_s1c(spark, sf_dir):
    """S-1: the chunks of every streamed file."""
    return chunk_rows(_ingested(spark, sf_dir).read("chunks"))


@register("s2_stream_finding_counts")
def q_s2(spark, sf_dir):
    return st.stream_finding_counts(spark, st.log_line_stream(spark, sf_dir))


@register("s2_stream_window_counts")
def q_s2w(spark, sf_dir):
    """S-2: counts by category and severity in windows of two days that slide by one."""
    return st.stream_window_counts(spark, st.log_line_stream(spark, sf_dir), "2 days", "1 day").counts


@register("s3_stream_incident_sessions")
def q_s3(spark, sf_dir):
    return st.stream_incident_sessions(spark, st.table_stream(spark, sf_dir, "events"))


@register("s4_stream_dedup")
def q_s4(spark, sf_dir):
    d = st.stream_dedup_lines(spark, st.log_line_stream(spark, sf_dir))
    return d.select("checksum")


@register("s4_stream_dedup_chunks")
def q_s4c(spark, sf_dir):
    """S-4: a stream of log chunks, each file uploaded twice; one chunk per text comes out."""
    root = st.stream_root(spark, "chunk-uploads")
    twice = F.explode(F.array(F.lit(0), F.lit(1))).alias("upload")
    at = F.lit(RUN_TS).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("upload"), F.lit(0))
    uploads = log_chunks(spark, sf_dir).select("*", twice).select("file_id", "chunk_index", "text", at.alias("ts"))
    uploads.write.parquet(root)
    stream = spark.readStream.schema(uploads.schema).parquet(root)
    return st.stream_dedup_chunks(spark, stream).select("checksum")


@register("s5_stream_job_state")
def q_s5(spark, sf_dir):
    """S-5: job states folded from a stream of lineitem-derived transitions."""
    li = st.table_stream(spark, sf_dir, "lineitem")
    return st.stream_job_state(spark, stream_job_transitions(li))


def stream_job_transitions(li):
    """Transitions keyed by the five lineitem columns that are unique (no window in a stream)."""
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.date_format("l_shipdate", "yyyyMMdd"))
    status = (F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "succeeded")
              .when(F.col("l_linestatus") == "O", "queued").otherwise("running"))
    base = li.select(key.alias("job_id"), status.alias("final"), F.col("l_shipdate").alias("at0"), "l_linenumber")
    q = base.select("job_id", F.lit("queued").alias("status"), F.col("at0").alias("at"))
    r = base.where(F.col("final") != "queued").select("job_id", F.lit("running").alias("status"), F.col("at0").alias("at"))
    d = base.where(F.col("final").isin("succeeded", "failed")).select(
        "job_id", F.col("final").alias("status"),
        (F.col("at0") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_linenumber") * 5, F.lit(0))).alias("at"))
    return q.unionByName(r).unionByName(d)


@register("s6_stream_auto_analysis")
def q_s6(spark, sf_dir):
    """S-6: the upload hook on each micro-batch, events appended per batch."""
    return st.stream_auto_analysis(spark, st.log_line_stream(spark, sf_dir)).select(
        F.col("incident_id").alias("file_id"), "title", "detail")


@register("s7_stream_static_enrich")
def q_s7(spark, sf_dir):
    return st.stream_static_enrich(spark, st.log_line_stream(spark, sf_dir), fx.incidents(spark, sf_dir))


# ---------------------------------------------------------------------------
# A: scans and sinks; H over real chunks
# ---------------------------------------------------------------------------
from ..sources import files as fls  # noqa: E402
from ..sources import blocks as bl  # noqa: E402
from ..sources import sinks  # noqa: E402


@register("a3_infer_doc_type")
def q_a3(spark, sf_dir):
    """A-3: document type from a content type (derived from the language) and the source name."""
    d = fx.table(spark, sf_dir, "documents")
    ct = (F.when(F.col("lang") == "en", F.lit("text/markdown")).when(F.col("lang") == "de", F.lit("application/pdf"))
          .when(F.col("lang") == "fr", F.lit("application/x-yaml")))
    path = F.concat(F.col("source"), F.when(F.col("lang") == "es", F.lit(".docx")).otherwise(F.lit(".txt")))
    return d.select("doc_id", fls.infer_doc_type(path, ct).alias("doc_type"))


@register("a5_attachment_manifest")
def q_a5(spark, sf_dir):
    """A-5: normalised kind, safe file name and reject reason of every attachment."""
    a = fx.attachments(spark, sf_dir).withColumn("kind", F.upper(F.concat(F.lit(" "), F.col("kind"), F.lit(" "))))
    a = a.withColumn("storage_path", F.concat(F.lit(" "), F.col("storage_path"), F.lit("\t")))
    m = fls.attachment_manifest(a, name_col="storage_path")
    return m.select("id", "kind_norm", "safe_name", "reject_reason", "oversize")


@register("a9_export_log_lines")
def q_a9(spark, sf_dir):
    """A-9: event export lines."""
    return sinks.export_log_lines(fx.table(spark, sf_dir, "events")).select("event_id", "line")


def _chunk_index(spark, sf_dir):
    """Index of the English documents' chunks, then of all documents': only the rest is written."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", tx.normalize_text(F.col("text")).alias("text"))
    chunks = ch.chunk_ids(ch.chunk_documents(docs, keep=["source", "lang"])).select("chunk_id", "doc_id", "chunk_index", "text", "lang")
    chunks = _written(spark, chunks, "index-chunks")  # cut once for both upserts
    index = sinks.ChunkIndex(spark, st.stream_root(spark, "chunk-index"), "chunk_id string, doc_id long, chunk_index int, text string")
    index.upsert(chunks.where("lang = 'en'").drop("lang"), "english")
    index.upsert(chunks.drop("lang"), "all")
    return index.read()


@register("a8_upsert_doc_chunks")
def q_a8(spark, sf_dir):
    """A-8: chunks of all documents upserted into a frame holding the English ones."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", tx.normalize_text(F.col("text")).alias("text"))
    chunks = ch.chunk_ids(ch.chunk_documents(docs, keep=["source", "lang"])).select("chunk_id", "doc_id", "chunk_index", "text", "lang")
    merged = sinks.upsert_doc_chunks(chunks.drop("lang"), chunks.where("lang = 'en'").drop("lang"))
    return merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@register("a8_chunk_index")
def q_a8i(spark, sf_dir):
    """A-8: the index itself, each chunk with the upsert that wrote it and the digest of its text."""
    return _chunk_index(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "ingest", F.sha2("text", 256).alias("digest"))


def upload_of(file_id):
    """Number of the uploaded file that holds a log: a hundred logs of one kind."""
    return F.pmod(file_id, F.lit(9)) + F.lit(9) * F.floor(file_id / F.lit(900))


def _uploads(spark, sf_dir):
    """Logs of a kind written as text files of a hundred, read back in blocks; ``file_id`` is the upload's number."""
    root = st.stream_root(spark, "uploads")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = fx.log_lines(spark, sf_dir).select(upload_of(F.col("file_id")).alias("upload"), "file_id", "line_no", "line")
    (lines.repartition(parts, "upload").sortWithinPartitions("upload", "file_id", "line_no").select("upload", "line")
     .write.partitionBy("upload").text(root))
    back = bl.read_lines(spark, root).withColumn("file_id", F.regexp_extract("path", r"upload=(\d+)", 1).cast("long"))
    blocks = bl.file_blocks(back, block_chars=20_000, overlap=2_000)
    return _written(spark, blocks, "upload-blocks")


def _written(spark, df, name):
    """``df`` written to a folder of its own and read back."""
    kept = st.stream_root(spark, name)
    df.write.parquet(kept)
    return spark.read.schema(df.schema).parquet(kept)


@register("a1_block_sources")
def q_a1s(spark, sf_dir):
    """A-1: sources of uploaded files from their blocks."""
    return bl.block_sources(_uploads(spark, sf_dir)).withColumn("classification_confidence", F.round("classification_confidence", 6))


@register("a1_block_findings")
def q_a1f(spark, sf_dir):
    """A-1: findings of uploaded files of many blocks."""
    blocks = _uploads(spark, sf_dir)
    return bl.block_findings(blocks, bl.block_sources(blocks))


@register("a7_write_ingest")
def q_a7(spark, sf_dir):
    """A-1 / A-7: uploaded files read in blocks, ingested, written under their ingest and day, written again, counted."""
    blocks = _uploads(spark, sf_dir)
    sources = bl.block_sources(blocks)
    sources = _written(spark, sources, "upload-sources")  # the retry repeats the writes, not the search
    found, chunks = _written(spark, bl.block_findings(blocks, sources), "upload-findings"), _written(spark, bl.block_chunks(blocks), "upload-chunks")
    jobs = sources.select(F.col("file_id").alias("id"), F.lit("succeeded").alias("status"), "source",
                          F.lit(datetime.now(UTC).replace(tzinfo=None)).alias("created_at"),
                          (F.col("file_id") + 1).alias("incident_id"), (F.col("file_id") * 10).alias("attachment_id"))
    root = st.stream_root(spark, "ingest-batch")
    for _ in range(2):  # the second run is a retry: it must leave the rows of one
        paths = sinks.write_ingest(jobs, chunks, found, root, ingest_id="first")
    out = None
    for k, p in paths.items():
        rows = spark.read.parquet(p)
        own = F.col("incident_id") == (F.col("id") if k == "jobs" else F.col("job_id")) + 1
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(own & (F.col("attachment_id") == (F.col("incident_id") - 1) * 10)).alias("n_keyed"))
        n = n.select(F.lit(k).alias("table"), "n", "n_keyed")
        out = n if out is None else out.unionByName(n)
    return out


def chunk_table(spark, sf_dir):
    c = log_chunks(spark, sf_dir)
    return c.select(F.monotonically_increasing_id().alias("id"), F.col("file_id").alias("incident_id"),
                    F.col("file_id").alias("job_id"), "chunk_index", "text", "checksum")


@register("h2_chunks_by_job")
def q_h2(spark, sf_dir):
    return store.chunks_by_job(chunk_table(spark, sf_dir).withColumn("id", F.col("chunk_index").cast("long"))).select(
        "job_id", "chunk_index", "pos")


@register("h7_chunk_counts")
def q_h7(spark, sf_dir):
    return store.chunk_counts(chunk_table(spark, sf_dir))


@register("h9_ingestion_stats")
def q_h9(spark, sf_dir):
    """H-9 for every incident plus the all-incident total row."""
    s = store.ingestion_stats(fx.jobs(spark, sf_dir), chunk_table(spark, sf_dir), fx.findings_table(spark, sf_dir))
    return s.select(F.coalesce(F.col("incident_id").cast("string"), F.lit("all")).alias("incident_id"),
                    "total_jobs", "pending_jobs", "running_jobs", "completed_jobs", "failed_jobs",
                    "total_chunks", "total_findings",
                    prs.metadata_text(F.col("findings_by_severity").cast("map<string,string>")).alias("by_severity"),
                    prs.metadata_text(F.col("findings_by_category").cast("map<string,string>")).alias("by_category"))


@register("j8_docs_agent")
def q_j8(spark, sf_dir):
    """J-8 / G-2 / G-5: the docs agent fed by the exact top-5 of each document's vector.

    Payload per embedded document: rag_query = its text (G-5 picks rag_query |
    query | summary); hits = the sources of the five nearest other documents.
    """
    docs = fx.table(spark, sf_dir, "documents")
    hits = (topk_all(spark, sf_dir).join(docs.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id", "left")
            .withColumn("source", F.coalesce("source", F.lit("unknown"))))
    emb = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    payloads = docs.join(emb, "doc_id", "left_semi").select(
        F.col("doc_id").alias("incident_id"),
        rt.rag_query(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("rag_query"),
        F.lit("runbook doc lookup").alias("summary"))
    res = inc.analyze_incidents(payloads, doc_hits=hits.select(F.col("query_id").alias("incident_id"), "rank", "source"))
    r = res.select("incident_id", F.inline("agent_results")).where(F.col("agent") == "docs_retrieval")
    return r.select("incident_id", "summary", F.array_join("findings", "|").alias("findings"), "confidence")


# ---------------------------------------------------------------------------
# D-1 ... D-13 one query per parser (files detected as that source), A-4, J-16
# ---------------------------------------------------------------------------
PARSER_QUERY_IDS = {
    "kubernetes": "d1_parse_kubernetes", "docker": "d3_parse_docker", "nginx": "d4_parse_nginx",
    "apache": "d6_parse_apache", "jenkins": "d8_parse_jenkins", "github_actions": "d9_parse_github_actions",
    "terraform": "d10_parse_terraform", "cloudwatch": "d12_parse_cloudwatch", "generic": "d13_parse_generic",
}


def _parser_query(source: str):
    def q(spark, sf_dir):
        files = prs.with_parser_source(fx.log_files(spark, sf_dir)).where(F.col("source") == source)
        e = prs.parse_logs(files.select("file_id", "text"))
        return e.select("file_id", "line_no", "ts", "level", "message", "source",
                        prs.metadata_text(F.col("metadata")).alias("meta"), "raw")
    q.__doc__ = f"Entries of the files detected as {source}."
    return q


for _src, _name in PARSER_QUERY_IDS.items():
    register(_name)(_parser_query(_src))


@register("d11_parse_cloudwatch_export")
def q_d11(spark, sf_dir):
    """D-11: each CloudWatch file's JSON lines as one JSON array, an entry per item."""
    lines = fx.log_lines(spark, sf_dir).where((F.pmod("file_id", F.lit(9)) == 7) & F.startswith("line", F.lit("{")))
    files = fls.simple_assemble_files(lines)
    text = F.concat(F.lit("["), F.replace(F.col("text"), F.lit("\n"), F.lit(", ")), F.lit("]"))
    return entry_rows(prs.parse_logs(files.select("file_id", text.alias("text"), F.lit("cloudwatch").alias("forced")), forced_col="forced"))


@register("a4_split_oversize")
def q_a4(spark, sf_dir):
    """A-4: every document with a flag for a size over 20,000,000 bytes."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size_bytes"))
    return fls.flag_oversize(d).select("doc_id", "oversize")


@register("j16_run_pipeline")
def q_j16(spark, sf_dir):
    """J-16: per-file pipeline result metadata (sources, confidence, line counts, findings)."""
    done = pipeline.run_pipeline(fx.log_files(spark, sf_dir))
    counts = done.batches.select("file_id", "total_lines", "parsed_lines", "failed_lines")
    per = done.findings.groupBy("file_id").agg(F.count(F.lit(1)).alias("findings_count"))
    return (done.files.withColumn("classification_confidence", F.round("classification_confidence", 6))
            .join(counts, "file_id").join(per, "file_id", "left")
            .select("*", F.coalesce(F.col("findings_count"), F.lit(0)).alias("n_findings")).drop("findings_count"))


@register("j16_pipeline_entries")
def q_j16e(spark, sf_dir):
    """J-16: the pipeline's entries (first output)."""
    return entry_rows(pipeline.run_pipeline(fx.log_files(spark, sf_dir)).entries)


@register("j16_pipeline_chunks")
def q_j16c(spark, sf_dir):
    """J-16: the pipeline's chunks (second output)."""
    return chunk_rows(pipeline.run_pipeline(fx.log_files(spark, sf_dir)).chunks)


@register("j16_pipeline_findings")
def q_j16f(spark, sf_dir):
    """J-16: the pipeline's findings (third output)."""
    return pipeline.run_pipeline(fx.log_files(spark, sf_dir)).findings


@register("j16_pipeline_batches")
def q_j16b(spark, sf_dir):
    """J-16: the parsed batch's counts and Kubernetes flags (fourth output)."""
    return pipeline.run_pipeline(fx.log_files(spark, sf_dir)).batches


@register("j1_analysis_payload")
def q_j1(spark, sf_dir):
    """J-1: payloads of every incident (title as summary; a request message when one was
    sent — the whole conversation of the same id; the text of its latest log attachment, H-14), then analysed."""
    incs = fx.incidents(spark, sf_dir)
    reqs = fx.messages(spark, sf_dir).withColumnRenamed("conv_id", "incident_id")
    latest = store.latest_log_attachment(fx.attachments(spark, sf_dir)).select(
        "incident_id", fx.attachment_file(F.col("incident_id"), F.col("attachment_id")).alias("file_id"))
    logs = latest.join(fx.log_files(spark, sf_dir), "file_id").select("incident_id", F.col("text").alias("log_text"))
    payloads = inc.analysis_payload(incs, reqs, logs)
    res = inc.analyze_incidents(payloads.select("incident_id", *inc.PAYLOAD_FIELDS))
    return res.select("incident_id", F.array_join("agents", ",").alias("agents"), "summary",
                      F.col("root_cause.severity").alias("rc_severity"),
                      F.col("root_cause.confidence").alias("rc_confidence"),
                      F.array_join("recommendations", "|").alias("recommendations"))


@register("a2_read_documents")
def q_a2(spark, sf_dir):
    """A-2 / A-3: documents written as files of one folder (number and text), read back with binaryFile, typed and measured."""
    root = st.stream_root(spark, "documents")
    docs = fx.table(spark, sf_dir, "documents")
    fls.write_documents(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("value")), root)
    # Spark reads some thirty files a task, however small
    back = fls.read_documents(spark, root).coalesce(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    doc_id = F.substring_index("text", "\n", 1).cast("long")
    # the text writer ends every row with a newline
    text = F.regexp_replace(F.substr("text", F.instr("text", F.lit("\n")) + 1), r"\n\z", "")
    return back.where("size_bytes > 0").select(doc_id.alias("doc_id"), "doc_type", F.length(text).alias("n_chars"),
                                               F.sha2(text, 256).alias("digest"))


@register("a2_document_source")
def q_a2s(spark, sf_dir):
    """A-2: source label of documents that come with a path, a file name, a metadata source or none."""
    d = fx.table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    path = F.when(F.col("lang") == "en", F.concat(F.lit("/docs/"), number, F.lit(".md")))
    name = F.when(F.col("lang").isin("en", "de"), F.concat(number, F.lit(".md")))
    return d.select("doc_id", fls.document_source(path, name, F.when(F.col("lang") != "es", F.col("source"))).alias("label"))


@register("g5_rag_query")
def q_g5(spark, sf_dir):
    """G-5: the first non-empty of rag_query, query and summary, each missing or empty in some rows."""
    d = fx.table(spark, sf_dir, "documents")
    rag = F.when(F.col("lang") == "en", F.substring("text", 1, 40)).when(F.col("lang") == "de", F.lit(""))
    query = F.when(F.col("lang") == "de", F.col("source")).when(F.col("lang") == "fr", F.lit(""))
    summary = F.when(F.col("lang") != "es", F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return d.select("doc_id", rt.rag_query(rag, query, summary).alias("q"))
