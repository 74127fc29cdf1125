"""Rule-based incident analysis (J-1 ... J-16) as column expressions.

A payload is one row with typed fields (``PAYLOAD_FIELDS``); a field may also be a variant, struct,
map or nested array, whose values count at any depth.  Everything
below is a projection over that row: routing is an array of names, each
agent's result is a struct, the merge, root cause and recommendations are
array functions over those structs.  No shuffle is needed except the
optional join with document hits for the docs agent (a join on the
incident key).

Agent results are ordered by agent name (quirk Q-13 fixed: the reference
merged them in thread completion order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.json_text import json_items, json_leaves
from ..functions.text import first_nonblank_lines, let, py_strip

STRING_FIELDS = ["message", "summary", "description", "log_text", "error", "details", "trace",
                 "kubernetes", "events", "pipeline", "ci", "cd", "security", "alerts",
                 "incident_type", "rag_query", "query"]
LIST_FIELDS = ["logs", "tags"]
PAYLOAD_FIELDS = STRING_FIELDS + LIST_FIELDS

AGENT_RESULT = "struct<agent:string,summary:string,findings:array<string>,confidence:double,evidence:array<string>>"


def with_payload_fields(df: DataFrame) -> DataFrame:
    """Payload fields as strings and lists of strings: missing ones null, nested ones flattened (J-2).

    A nested field becomes the text of its leaves.  The router sees nested fields only one
    level deep, as ``str`` shows them, so its text is kept beside them in ``router_text``.
    """
    if "router_text" in df.columns:
        return df
    fields, router = {}, {}
    for f in PAYLOAD_FIELDS:
        kind = df.schema[f].dataType.simpleString() if f in df.columns else None
        plain = "array<string>" if f in LIST_FIELDS else "string"
        if kind is None:
            fields[f] = F.lit(None).cast(plain)
        elif kind not in ("string", "array<string>", "void"):
            json = F.to_json(F.col(f))
            leaves = F.filter(json_leaves(json), lambda x: x != "")
            fields[f] = leaves if f in LIST_FIELDS else F.array_join(leaves, "\n")
            router[f] = json_items(json)
        elif kind == "array<string>" and plain == "string":
            fields[f] = F.array_join(F.filter(F.col(f), lambda x: x != ""), "\n")
        elif kind == "void":
            fields[f] = F.col(f).cast(plain)
        elif kind == "string" and plain == "array<string>":
            fields[f] = F.when(F.col(f).isNotNull(), F.array(F.col(f)))
    seen = df.withColumns({f"_router_{f}": c for f, c in router.items()}).withColumns(fields)
    parts = F.flatten(F.array(*[F.coalesce(F.col(f"_router_{f}"), F.array().cast("array<string>")) if f in router else _field_parts(f)
                                for f in rules.ROUTER_TEXT_FIELDS]))
    return seen.withColumn("router_text", F.array_join(F.filter(parts, lambda x: x != ""), "\n")).drop(*[f"_router_{f}" for f in router])


def _field_parts(name: str) -> Column:
    c = F.col(name)
    if name in LIST_FIELDS:
        return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def payload_text(keys: list[str] | tuple[str, ...]) -> Column:
    """J-2: the listed fields joined by LF, lists flattened, empty parts skipped."""
    parts = F.flatten(F.array(*[_field_parts(k) for k in keys]))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def keyword_hits(text: Column, patterns) -> Column:
    """J-9: the patterns (as text, in order) that match ``text`` case-insensitively."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?id)" + p), F.lit(p)) for p in patterns]))


def _any_sub(text: Column, subs) -> Column:
    cond = F.lit(False)
    for s in subs:
        cond = cond | text.contains(s)
    return cond


def route_agents(text_fields=None) -> Column:
    """J-3: sorted agent names chosen by substring rules on text, incident_type and tags.

    Each input is bound once (``let``) so a costly ``incident_type`` or
    ``tags`` expression is never copied into every rule.
    """
    def with_inputs(text: Column, itype: Column, tags: Column) -> Column:
        picks = []
        for agent, subs in rules.ROUTER_TEXT_RULES:
            picks.append(F.when(_any_sub(text, subs), F.lit(agent)))
        for agent, subs in rules.ROUTER_TYPE_RULES:
            picks.append(F.when(_any_sub(itype, subs), F.lit(agent)))
        for agent, vals in rules.ROUTER_TAG_RULES:
            cond = F.lit(False)
            for v in vals:
                cond = cond | F.array_contains(tags, F.lit(v))
            picks.append(F.when(cond, F.lit(agent)))
        default = F.array(*[F.lit(a) for a in sorted(rules.ROUTER_DEFAULT)])
        return let(F.array_sort(F.array_distinct(F.array_compact(F.array(*picks)))),
                   lambda chosen: F.when(F.size(chosen) > 0, chosen).otherwise(default))

    text = F.lower(payload_text(text_fields) if text_fields else F.col("router_text"))
    itype = F.lower(F.coalesce(F.col("incident_type"), F.lit("none")))
    tags = F.transform(F.filter(F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                                lambda x: x.isNotNull() & (x != "")),
                       lambda x: F.lower(py_strip(x)))
    return let(F.struct(text.alias("t"), itype.alias("i"), tags.alias("g")),
               lambda b: with_inputs(b["t"], b["i"], b["g"]))


def keyword_agent(agent: rules.Agent) -> Column:
    """J-4 ... J-7: one keyword agent's result struct."""
    def build(text: Column) -> Column:
        return let(keyword_hits(text, agent.patterns), lambda hits: F.struct(
            F.lit(agent.name).alias("agent"),
            F.when(F.size(hits) > 0, F.lit(agent.hit_summary)).otherwise(F.lit(agent.miss_summary)).alias("summary"),
            F.transform(hits, lambda h: F.concat(F.lit(agent.finding_prefix), h)).alias("findings"),
            F.when(F.size(hits) > 0, F.lit(agent.hit_conf)).otherwise(F.lit(agent.miss_conf)).alias("confidence"),
            first_nonblank_lines(text, 3).alias("evidence"),
        ))
    return let(payload_text(agent.keys), build)


def docs_agent(doc_sources: Column | None = None) -> Column:
    """J-8: docs agent from G-2 hits (``doc_sources``: array of matched sources, best first)."""
    a = rules.DOCS_AGENT
    q = F.coalesce(F.nullif(F.col("rag_query"), F.lit("")), F.nullif(F.col("query"), F.lit("")))
    srcs = doc_sources if doc_sources is not None else F.array().cast("array<string>")
    srcs = F.coalesce(srcs, F.array().cast("array<string>"))
    has_q = q.isNotNull()
    hit = F.size(srcs) > 0
    summary = F.when(~has_q, F.lit(a["skip_summary"])).when(hit, F.lit(a["hit_summary"])).otherwise(F.lit(a["miss_summary"]))
    conf = F.when(~has_q, F.lit(a["skip_conf"])).when(hit, F.lit(a["hit_conf"])).otherwise(F.lit(a["miss_conf"]))
    srcs = F.when(has_q, srcs).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.lit("docs_retrieval").alias("agent"), summary.alias("summary"),
        F.transform(srcs, lambda s: F.concat(F.lit("Doc match: "), s)).alias("findings"),
        conf.alias("confidence"), srcs.alias("evidence"))


def run_agents(agents: Column, doc_sources: Column | None = None, registry: list[rules.Agent] | None = None) -> Column:
    """Results of the routed agents, ordered by agent name; ``registry`` takes further keyword agents."""
    results = [F.when(F.array_contains(agents, F.lit(a.name)), keyword_agent(a)) for a in registry or rules.AGENTS]
    results.append(F.when(F.array_contains(agents, F.lit("docs_retrieval")), docs_agent(doc_sources)))
    arr = F.array_compact(F.array(*results))
    return F.array_sort(arr, lambda x, y: F.when(x["agent"] < y["agent"], -1).when(x["agent"] > y["agent"], 1).otherwise(0))


def merge_agents(results: Column) -> Column:
    """J-10: struct(summary, findings, evidence) of the merged agent results."""
    summaries = F.transform(results, lambda r: F.concat(r["agent"], F.lit(": "), r["summary"]))
    return F.struct(
        F.when(F.size(results) > 0, F.array_join(summaries, " | ")).alias("summary"),
        F.flatten(F.transform(results, lambda r: r["findings"])).alias("findings"),
        F.flatten(F.transform(results, lambda r: r["evidence"])).alias("evidence"),
    )


def py_round(x: Column, digits: int = 2) -> Column:
    """Python ``round(x, digits)`` on the exact binary value (half-even), for 0.25 <= |x| <= 1."""
    two54 = 18014398509481984
    scaled = (x * F.lit(float(two54))).cast("decimal(38,0)")
    num = scaled * F.lit(10 ** digits)
    q = F.floor(num / F.lit(two54)).cast("decimal(38,0)")
    r = num - q * F.lit(two54)
    up = F.when(r * 2 > F.lit(two54), q + 1).when((r * 2 == F.lit(two54)) & (F.pmod(q, F.lit(2)) == 1), q + 1).otherwise(q)
    return (up.cast("double") / F.lit(float(10 ** digits)))


def root_cause(merged: Column, results: Column, text_keys=None) -> Column:
    """J-11: struct(summary, findings, confidence, evidence, severity, dependency_chain,
    affected_systems, remediation_steps)."""
    def with_text(text: Column) -> Column:
        lowered = F.lower(F.concat(F.array_join(merged["findings"], " "), F.lit(" "), text))
        return let(lowered, lambda low: let(F.array(*[_rc_hit(low, text, r[0]) for r in rules.ROOT_CAUSE_RULES]),
                                            lambda hits: _rc_struct(hits, merged, results, text)))
    return let(payload_text(text_keys or rules.ROOT_CAUSE_KEYS), with_text)


def _rc_hit(lowered: Column, text: Column, subs) -> Column:
    cond = _any_sub(lowered, subs)
    if "database_url" in subs:
        cond = cond | text.contains("missing DATABASE_URL")
    return cond


def _rc_struct(hits: Column, merged: Column, results: Column, text: Column) -> Column:
    def pick(idx):
        return F.array_compact(F.array(*[F.when(F.element_at(hits, i + 1), F.lit(r[idx]))
                                         for i, r in enumerate(rules.ROOT_CAUSE_RULES)]))
    none = ~F.exists(hits, lambda h: h)
    probable = F.when(none, F.array(F.lit(rules.ROOT_CAUSE_FALLBACK))).otherwise(pick(1))
    remediation = F.when(none, F.array(F.lit(rules.ROOT_CAUSE_FALLBACK_FIX))).otherwise(pick(4))
    confs = F.transform(results, lambda r: r["confidence"])
    n = F.size(results)
    mean = F.aggregate(confs, F.lit(0.0), lambda a, x: a + x) / n
    conf_agents = F.least(F.lit(0.99), F.greatest(F.lit(0.3), mean))
    conf = F.when(n > 0, py_round(conf_agents, 2)).when(none, F.lit(0.35)).otherwise(F.lit(0.5))
    shared_ev = merged["evidence"]
    evidence = F.when(F.size(shared_ev) > 0, shared_ev).otherwise(first_nonblank_lines(text, 3))

    def build(prob: Column) -> Column:
        severe = F.exists(prob, lambda p: F.lower(p).contains("database") | F.lower(p).contains("out of memory"))
        rc_findings = let(remediation, lambda rem: F.concat(
            F.transform(prob, lambda p: F.concat(F.lit("Probable cause: "), p)),
            F.transform(rem, lambda r: F.concat(F.lit("Suggested remediation: "), r))))
        return F.struct(
            F.concat(F.lit("root cause analysis: "), F.element_at(prob, 1)).alias("summary"),
            rc_findings.alias("findings"),
            conf.alias("confidence"),
            evidence.alias("evidence"),
            F.when(severe, F.lit("Critical")).otherwise(F.lit("High")).alias("severity"),
            pick(2).alias("dependency_chain"),
            pick(3).alias("affected_systems"),
            remediation.alias("remediation_steps"),
        )
    return let(probable, build)


def recommendations(merged: Column) -> Column:
    """J-12: fix sentences from the merged findings; two defaults when none apply."""
    def build(text: Column) -> Column:
        recs = F.array_compact(F.array(*[F.when(_any_sub(text, subs), F.lit(s)) for subs, s in rules.REMEDIATION_RULES]))
        return let(recs, lambda r: F.when(F.size(r) > 0, r).otherwise(
            F.array(*[F.lit(s) for s in rules.REMEDIATION_DEFAULTS])))
    return let(F.lower(F.array_join(merged["findings"], " ")), build)


def analyze_incidents(payloads: DataFrame, key: str = "incident_id", doc_hits: DataFrame | None = None,
                      registry: list[rules.Agent] | None = None, extra_routes: dict[str, Column] | None = None) -> DataFrame:
    """J-13: the whole analysis for a table of payloads.

    Agents of one's own go into ``registry`` (``rules.AGENTS`` plus them), and ``extra_routes`` says by
    a condition over the payload's columns when each of them runs.

    ``doc_hits(key, source, rank)`` — top-k document sources per incident
    from ``retrieval.cosine_topk`` — feeds the docs agent; it is
    pre-aggregated per key and left-joined, so incidents without hits stay.
    """
    p = with_payload_fields(payloads)
    doc_col = None
    if doc_hits is not None:
        per = doc_hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("_dh"))
        p = p.join(per, key, "left")
        doc_col = F.transform(F.col("_dh"), lambda s: s["source"])
    routes = route_agents()
    for name, when in (extra_routes or {}).items():
        routes = F.when(when, F.array_sort(F.array_distinct(F.concat(routes, F.array(F.lit(name)))))).otherwise(routes)
    staged = p.select("*", routes.alias("agents"))
    staged = staged.select("*", run_agents(F.col("agents"), doc_col, registry).cast(f"array<{AGENT_RESULT}>").alias("agent_results"))
    staged = staged.select("*", merge_agents(F.col("agent_results")).alias("merged"))
    out = staged.select(
        key, "agents", "agent_results",
        F.col("merged.summary").alias("summary"),
        F.col("merged.findings").alias("findings"),
        F.col("merged.evidence").alias("evidence"),
        root_cause(F.col("merged"), F.col("agent_results")).alias("root_cause"),
        recommendations(F.col("merged")).alias("recommendations"),
    )
    return out


def ai_event(results: DataFrame, key: str = "incident_id", auto: bool = False) -> DataFrame:
    """J-14: the incident event text; ``auto`` skips rows with nothing to say."""
    lines = F.concat(
        F.when(F.col("summary").isNotNull() & (F.col("summary") != ""),
               F.array(F.concat(F.lit("Summary: "), F.col("summary")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("recommendations") > 0,
               F.concat(F.array(F.lit("Recommendations:")),
                        F.transform("recommendations", lambda r: F.concat(F.lit("- "), r)))).otherwise(F.array().cast("array<string>")),
    )
    detail = F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
    title = "AI Auto-Analysis" if auto else "AI Orchestrator Analysis"
    out = results.select(key, F.lit(title).alias("title"), detail.alias("detail"), F.lit("ai").alias("source"))
    if not auto:
        return out
    # a value of its own: pushed below the projections that make the text, the filter would repeat the whole analysis
    return out.select(F.inline(F.array(F.struct(*out.columns)))).where(F.col("detail").isNotNull())


def auto_analyze_payloads(files: DataFrame, key: str = "file_id", text_col: str = "text",
                          source_col: str = "source", enabled: bool = True) -> DataFrame:
    """J-15: payloads of the upload hook (blank texts skipped; ``enabled`` = the feature flag)."""
    if not enabled:
        return files.limit(0).select(F.col(key).alias("incident_id"))
    src = F.col(source_col)
    tags = F.when(src.isNotNull() & (src != ""), F.array(F.lit("auto-analysis"), src)).otherwise(F.array(F.lit("auto-analysis")))
    return files.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(key).alias("incident_id"), src.alias("incident_type"), F.col(text_col).alias("log_text"), tags.alias("tags"))


def analysis_payload(incidents: DataFrame, requests: DataFrame | None, latest_logs: DataFrame | None) -> DataFrame:
    """J-1: request fields win over incident fields; the latest log text fills ``logs`` when none sent.

    ``incidents(id, title, description, severity, environment, service_name)``,
    ``requests(incident_id, <payload fields>)``, ``latest_logs(incident_id, log_text)``.
    """
    base = incidents.select(F.col("id").alias("incident_id"), F.col("title").alias("summary"),
                            "description", F.col("severity").alias("incident_severity"),
                            F.col("environment"), F.col("service_name"))
    out = base
    if requests is not None:
        req = with_payload_fields(requests).drop("router_text")
        out = out.join(req.select("incident_id", *[F.col(c).alias("_r_" + c) for c in PAYLOAD_FIELDS]), "incident_id", "left")
        for c in PAYLOAD_FIELDS:
            if c in out.columns:
                out = out.withColumn(c, F.coalesce(F.col("_r_" + c), F.col(c)))
            else:
                out = out.withColumn(c, F.col("_r_" + c))
        out = out.drop(*["_r_" + c for c in PAYLOAD_FIELDS])
    if latest_logs is not None:
        out = out.join(latest_logs.select("incident_id", F.col("log_text").alias("_ll")), "incident_id", "left")
        cur = F.col("logs") if "logs" in out.columns else F.lit(None).cast("array<string>")
        out = out.withColumn("logs", F.when(cur.isNull() & F.col("_ll").isNotNull(), F.array(F.col("_ll"))).otherwise(cur)).drop("_ll")
    return with_payload_fields(out)


def agent_result(agent_col: Column, doc_sources: Column | None = None) -> Column:
    """Result struct of the agent named in ``agent_col`` (only that agent runs)."""
    expr = None
    for a in rules.AGENTS:
        expr = F.when(agent_col == a.name, keyword_agent(a)) if expr is None else expr.when(agent_col == a.name, keyword_agent(a))
    return expr.when(agent_col == "docs_retrieval", docs_agent(doc_sources)).cast(AGENT_RESULT)


def agent_results_long(payloads: DataFrame, key: str = "incident_id") -> DataFrame:
    """One row per (incident, routed agent) with that agent's result (J-3 + J-4 ... J-8)."""
    p = with_payload_fields(payloads)
    routed = p.select("*", F.explode(route_agents()).alias("agent"))
    return routed.select(key, agent_result(F.col("agent")).alias("r")).select(key, "r.*")
