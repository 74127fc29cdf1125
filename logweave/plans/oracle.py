"""DuckDB SQL for the registered queries (the correctness oracle).

Each query is written directly in SQL over the driver's pre-registered
tables; views of FIXTURES.md are spelled out as CTEs.  Regexes run in RE2
with ``(?i)``; only the fixed rule tables are shared with the Spark side.
"""

from __future__ import annotations

from .. import rules
from ..functions.text import ANSI_RE, CONTROL_RE, PY_WHITESPACE, PY_WHITESPACE_NO_NL, _class_body
from ..operators.detect import any_pattern
from ..sources import fixtures as fx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(p: str) -> str:
    """Case-insensitive RE2 pattern literal."""
    return lit("(?i)" + p)


def rx_cs(p: str) -> str:
    return lit(p)


WS_SQL = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def strip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def clean(e: str) -> str:
    t = f"regexp_replace({e}, {lit(ANSI_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(CONTROL_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(chr(92) + 'r' + chr(92) + 'n?')}, chr(10), 'g')"
    ws = "[" + _class_body(PY_WHITESPACE_NO_NL) + "]+(\\n|$)"
    return f"regexp_replace({t}, {lit(ws)}, '\\1', 'g')"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def values_table(name: str, cols: list[str], rows: list[tuple]) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return lit(x)
        return repr(x)
    body = ",\n    ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES\n    {body})"


# ---------------------------------------------------------------------------
# Fixture views
# ---------------------------------------------------------------------------
def _line_expr() -> str:
    t = "t.tmpl"
    for key, val in (("{iso}", "strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ')"),
                     ("{clf}", "strftime(e.ts, '%d/%b/%Y:%H:%M:%S') || ' +0000'"),
                     ("{jts}", "strftime(e.ts, '%Y-%m-%d %H:%M:%S') || '.000 +0000'"),
                     ("{sp}", "strftime(e.ts, '%Y-%m-%d %H:%M:%S')"),
                     ("{ngx}", "strftime(e.ts, '%Y/%m/%d %H:%M:%S')"),
                     ("{uid}", "CAST(e.user_id AS VARCHAR)"),
                     ("{eid}", "CAST(e.event_id AS VARCHAR)")):
        t = f"replace({t}, {lit(key)}, {val})"
    return t


TEMPLATES = values_table("tmpl_t", ["k", "tmpl"], sorted(fx.full_templates().items()))

LOG_LINES = f"""{TEMPLATES},
log_lines AS (
  SELECT e.event_id // 50 AS file_id, CAST(e.event_id % 50 AS INTEGER) AS line_no,
         e.event_id, e.ts, {_line_expr()} AS line
  FROM events e LEFT JOIN tmpl_t t
    ON t.k = CAST((e.event_id // 50) % 9 AS VARCHAR) || ':' || e.event_type)"""

LOG_FILES = """log_files AS (
  SELECT file_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines
  FROM log_lines GROUP BY file_id)"""


def parser_source_sql(e: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({e}, {rx(any_pattern(ps))}) THEN {lit(n)}"
                     for n, ps in rules.PARSER_PATTERNS)
    return f"CASE {whens} ELSE 'generic' END"


def rule_count_sql(e: str, p: str) -> str:
    return f"len(regexp_extract_all({e}, {rx(p)}, 0))"


SCORED = f"""scored AS (
  SELECT *, greatest({', '.join(f'c{i}' for i in range(len(rules.SOURCE_RULES)))}) AS best,
         {' + '.join(f'c{i}' for i in range(len(rules.SOURCE_RULES)))} AS total
  FROM (SELECT *, {', '.join(f'{rule_count_sql("clean_text", p)} AS c{i}' for i, (_, p) in enumerate(rules.SOURCE_RULES))}
        FROM staged))"""


def classified_sql() -> str:
    whens = " ".join(f"WHEN c{i} = best THEN {lit(n)}" for i, (n, _) in enumerate(rules.SOURCE_RULES))
    return f"CASE WHEN total = 0 THEN 'generic' {whens} END"


PREPARED = f"""staged AS (
  SELECT file_id, text, {parser_source_sql('text')} AS parser_source, {clean('text')} AS clean_text
  FROM log_files),
{SCORED},
prepared AS (
  SELECT *, {classified_sql()} AS classification_source,
         CASE WHEN total = 0 THEN CAST(0.5 AS DOUBLE) ELSE least(best / total + CAST(0.3 AS DOUBLE), CAST(1.0 AS DOUBLE)) END AS classification_confidence,
         CASE WHEN parser_source <> 'generic' THEN parser_source ELSE {classified_sql()} END AS source
  FROM scored)"""

RULES_T = values_table("rules_t", ["rule_no", "category", "severity", "title"],
                       [(r.rule_no, r.category, r.severity, r.title) for r in rules.DETECTION_RULES])


def _rule_select(r: rules.DetectionRule, src_tbl: str, key: str, text: str, src: str) -> str:
    p = rx(r.pattern)
    cond = f"regexp_matches(sample, {p})"
    if r.sources:
        cond = f"{src} IN {in_list(r.sources)} AND " + cond
    return (f"SELECT {key}, {r.rule_no} AS rule_no, sample, {src} AS source_type, "
            f"regexp_extract_all(sample, {p}, 0) AS hits, string_split_regex(sample, {p}) AS gaps "
            f"FROM (SELECT *, {text} AS sample FROM {src_tbl}) WHERE {cond}")


def findings_ctes(src_tbl: str = "prepared", key: str = "file_id", text: str = "clean_text",
                  src: str = "source") -> str:
    union = "\n    UNION ALL ".join(_rule_select(r, src_tbl, key, text, src) for r in rules.DETECTION_RULES)
    return f"""{RULES_T},
m AS (
    {union}),
mi AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m),
mo AS (
  SELECT {key}, rule_no, source_type, sample, i - 1 AS match_no,
         CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS st,
         length(hits[i]) AS hl
  FROM mi),
me AS (
  SELECT {key}, rule_no, source_type, match_no,
         {strip(f"replace(substr(sample, greatest(st - {rules.EVIDENCE_BEFORE}, 0) + 1, least(st + hl + {rules.EVIDENCE_AFTER}, length(sample)) - greatest(st - {rules.EVIDENCE_BEFORE}, 0)), chr(10), ' ')")} AS evidence
  FROM mo),
md AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {key}, rule_no, evidence ORDER BY match_no) AS k1
    FROM me) WHERE k1 = 1),
findings AS (
  SELECT md.{key}, md.rule_no, md.match_no, r.category, r.severity, r.title, md.evidence,
         md.source_type, CAST(1.0 AS DOUBLE) AS confidence
  FROM md JOIN rules_t r ON r.rule_no = md.rule_no)"""


PIPELINE_FINDINGS = f"""WITH {LOG_LINES},
{LOG_FILES},
{PREPARED},
{findings_ctes()}"""


SQL: dict[str, str] = {}

SQL["finding_counts"] = PIPELINE_FINDINGS + """
SELECT category, severity, count(*) AS n_findings FROM findings GROUP BY category, severity"""


# ---------------------------------------------------------------------------
# Parsing (D)
# ---------------------------------------------------------------------------
from ..operators import parse as P  # noqa: E402
from ..functions.text import SPLITLINES_RE  # noqa: E402


def split_lines_sql(e: str) -> str:
    sep = "\\r\\n|[" + _class_body("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ") + "]"
    arr = f"string_split_regex({e}, {lit(sep)})"
    return f"(CASE WHEN {arr}[-1] = '' THEN {arr}[1:len({arr}) - 1] ELSE {arr} END)"


def rxe(e: str, p: str, g: int, ci_: bool = False) -> str:
    return f"regexp_extract({e}, {rx(p) if ci_ else lit(p)}, {g})"


def nz(e: str) -> str:
    return f"nullif({e}, '')"


def ts_parts_sql(y, mo, d, h, mi, s, frac=None, off=None) -> str:
    sec = f"CAST({s} AS DOUBLE)"
    if frac is not None:
        sec = f"({sec} + CASE WHEN {frac} <> '' THEN CAST(rpad(substr({frac}, 1, 6), 6, '0') AS BIGINT) / 1000000.0 ELSE 0 END)"
    t = (f"TRY(make_timestamp(CAST({y} AS BIGINT), CAST({mo} AS BIGINT), CAST({d} AS BIGINT), "
         f"CAST({h} AS BIGINT), CAST({mi} AS BIGINT), {sec}))")
    if off is not None:
        t = f"({t} - to_minutes(CAST({off} AS BIGINT)))"
    return t


def off_sql(z: str) -> str:
    digits = f"regexp_replace({z}, '[^0-9]', '', 'g')"
    return (f"(CASE WHEN {z} = '' OR {z} = 'Z' THEN 0 ELSE (CASE WHEN substr({z}, 1, 1) = '-' THEN -1 ELSE 1 END) * "
            f"(CAST(substr({digits}, 1, 2) AS INTEGER) * 60 + coalesce(TRY_CAST(nullif(substr({digits}, 3, 2), '') AS INTEGER), 0)) END)")


def iso_ts_sql(s: str) -> str:
    p = P.ISO_FULL
    g = [None] + [rxe(s, p, i) for i in range(1, 9)]
    return f"(CASE WHEN regexp_matches({s}, {lit(p)}) THEN {ts_parts_sql(*g[1:7], frac=g[7], off=off_sql(g[8]))} END)"


def naive_iso_sql(s: str) -> str:
    p = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})$"
    return f"(CASE WHEN regexp_matches({s}, {lit(p)}) THEN {ts_parts_sql(*[rxe(s, p, i) for i in range(1, 7)])} END)"


MONTHS_SQL = "[" + ", ".join(lit(m) for m in P.MONTHS) + "]"


def clf_sql(s: str) -> str:
    p = r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})\s+([+-]\d{2}:?\d{2})$"
    mon = f"list_position({MONTHS_SQL}, lower({rxe(s, p, 2)}))"
    return (f"(CASE WHEN regexp_matches({s}, {lit(p)}) AND coalesce({mon}, 0) > 0 THEN "
            f"{ts_parts_sql(rxe(s, p, 3), mon, rxe(s, p, 1), rxe(s, p, 4), rxe(s, p, 5), rxe(s, p, 6), off=off_sql(rxe(s, p, 7)))} END)")


def ymd_sql(s: str, sep: str = "-") -> str:
    p = rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})\s+(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})$"
    return f"(CASE WHEN regexp_matches({s}, {lit(p)}) THEN {ts_parts_sql(*[rxe(s, p, i) for i in range(1, 7)])} END)"


def jenkins_ts_sql(s: str) -> str:
    p = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,6})\s+([+-]\d{4})$"
    g = [None] + [rxe(s, p, i) for i in range(1, 9)]
    return f"(CASE WHEN regexp_matches({s}, {lit(p)}) THEN {ts_parts_sql(*g[1:7], frac=g[7], off=off_sql(g[8]))} END)"


def iso_zone_sql(s: str) -> str:
    p = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})(Z|[+-]\d{2}:?\d{2})$"
    g = [None] + [rxe(s, p, i) for i in range(1, 8)]
    return f"(CASE WHEN regexp_matches({s}, {lit(p)}) THEN {ts_parts_sql(*g[1:7], off=off_sql(g[7]))} END)"


def syslog_sql(s: str) -> str:
    p = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
    mon = f"list_position({MONTHS_SQL}, lower({rxe(s, p, 1)}))"
    return (f"(CASE WHEN regexp_matches({s}, {lit(p)}) AND coalesce({mon}, 0) > 0 THEN "
            f"{ts_parts_sql('1900', mon, rxe(s, p, 2), rxe(s, p, 3), rxe(s, p, 4), rxe(s, p, 5))} END)")


def level_sql(m: str, fold: bool = True) -> str:
    g = f"upper({nz(rxe(m, rules.LEVEL_WORDS, 1, True))})"
    return f"(CASE WHEN {g} = 'WARNING' THEN 'WARN' ELSE {g} END)" if fold else g


def jkey(l: str, k: str) -> str:
    return f"list_contains(json_keys({l}), {lit(k)})"


def jget(l: str, k: str) -> str:
    return f"json_extract_string({l}, {lit('$.' + chr(34) + k + chr(34))})"


def jmeta(l: str, drop: list[str]) -> str:
    ks = f"list_sort(list_filter(json_keys({l}), lambda k: NOT list_contains({ '[' + ', '.join(lit(d) for d in drop) + ']' }, k)))"
    return (f"array_to_string(list_transform({ks}, lambda k: k || '=' || "
            f"coalesce(json_extract_string({l}, '$.\"' || k || '\"'), '')), ';')")


def kv_sql(pairs: list[tuple[str, str]]) -> str:
    """sorted k=v text for fixed keys (null value -> k=)."""
    items = sorted(pairs)
    return " || ';' || ".join(f"{lit(k + '=')} || coalesce({v}, '')" for k, v in items)


def parse_fields_sql(l: str) -> dict[str, str]:
    """Per source: (ts, level, message, meta, raw) SQL expressions on stripped line ``l``."""
    out = {}
    # kubernetes
    isj = f"regexp_matches({l}, {lit(P.K8S_JSON)})"
    ok = f"json_valid({l})"
    pre = rxe(l, P.ISO_PREFIX, 1)
    pts = f"(CASE WHEN {pre} <> '' THEN {iso_ts_sql(pre)} END)"
    pmsg = f"(CASE WHEN {pts} IS NOT NULL THEN regexp_replace({l}, {lit(P.ISO_PREFIX)}, '') ELSE {l} END)"
    jmsg = f"(CASE WHEN {jkey(l, 'log')} THEN {jget(l, 'log')} WHEN {jkey(l, 'message')} THEN {jget(l, 'message')} ELSE {l} END)"
    out["kubernetes"] = (
        f"CASE WHEN {isj} THEN (CASE WHEN {ok} AND {jkey(l, 'time')} THEN {iso_ts_sql(jget(l, 'time'))} END) ELSE {pts} END",
        f"CASE WHEN {isj} THEN (CASE WHEN {ok} THEN (CASE WHEN {jkey(l, 'stream')} THEN {jget(l, 'stream')} WHEN {jkey(l, 'level')} THEN {jget(l, 'level')} END) END) ELSE {level_sql(pmsg)} END",
        f"CASE WHEN {isj} THEN (CASE WHEN {ok} THEN {jmsg} ELSE {l} END) ELSE {pmsg} END",
        f"CASE WHEN {isj} AND {ok} THEN {jmeta(l, ['log', 'message', 'stream', 'time'])} ELSE '' END",
        l)
    # docker
    isj = f"starts_with({l}, '{{')"
    out["docker"] = (
        f"CASE WHEN {isj} THEN (CASE WHEN {ok} AND {jkey(l, 'time')} THEN {iso_ts_sql(jget(l, 'time'))} END) ELSE {pts} END",
        f"CASE WHEN {isj} THEN (CASE WHEN {ok} AND {jkey(l, 'stream')} THEN {jget(l, 'stream')} END) ELSE {level_sql(pmsg, False)} END",
        f"CASE WHEN {isj} THEN (CASE WHEN {ok} THEN {jmsg} ELSE {l} END) ELSE {pmsg} END",
        "''", l)
    # nginx / apache

    def access(p, size):
        g = [None] + [rxe(l, p, i) for i in range(1, 9)]
        st = f"CAST(CAST({g[7]} AS INTEGER) AS VARCHAR)"
        kv = [("ip", g[1]), ("status", st), ("method", g[4]), ("path", g[5])]
        if size:
            kv.append(("size", f"CASE WHEN {g[8]} <> '-' THEN CAST(CAST({g[8]} AS HUGEINT) AS VARCHAR) END"))
        return (clf_sql(g[3]), f"CASE WHEN CAST({g[7]} AS INTEGER) >= 400 THEN 'ERROR' ELSE 'INFO' END",
                f"{g[4]} || ' ' || {g[5]} || ' - ' || {st}", kv_sql(kv))

    def sev(word, mapping):
        whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
        return f"(CASE lower({word}) {whens} ELSE 'INFO' END)"

    a = access(P.NGINX_ACCESS, True)
    e = [None] + [rxe(l, P.NGINX_ERROR, i) for i in range(1, 6)]
    ea = f"regexp_matches({l}, {lit(P.NGINX_ACCESS)})"
    ee = f"regexp_matches({l}, {lit(P.NGINX_ERROR)})"
    out["nginx"] = (
        f"CASE WHEN {ea} THEN {a[0]} WHEN {ee} THEN {ymd_sql(e[1], '/')} END",
        f"CASE WHEN {ea} THEN {a[1]} WHEN {ee} THEN {sev(e[2], rules.NGINX_ERROR_LEVELS)} END",
        f"CASE WHEN {ea} THEN {a[2]} WHEN {ee} THEN {e[5]} ELSE {l} END",
        f"CASE WHEN {ea} THEN {a[3]} WHEN {ee} THEN {kv_sql([('pid', e[3]), ('tid', e[4]), ('nginx_level', e[2])])} ELSE '' END",
        l)
    a = access(P.APACHE_ACCESS, False)
    e = [None] + [rxe(l, P.APACHE_ERROR, i) for i in range(1, 5)]
    ea = f"regexp_matches({l}, {lit(P.APACHE_ACCESS)})"
    ee = f"regexp_matches({l}, {lit(P.APACHE_ERROR)})"
    out["apache"] = (
        f"CASE WHEN {ea} THEN {a[0]} END",
        f"CASE WHEN {ea} THEN {a[1]} WHEN {ee} THEN {sev(e[3], rules.APACHE_ERROR_LEVELS)} END",
        f"CASE WHEN {ea} THEN {a[2]} WHEN {ee} THEN {e[4]} ELSE {l} END",
        f"CASE WHEN {ea} THEN {a[3]} WHEN {ee} THEN {kv_sql([('module', e[2]), ('apache_level', e[3])])} ELSE '' END",
        l)
    # jenkins
    pre = rxe(l, P.JENKINS_TS, 1)
    jts = f"(CASE WHEN {pre} <> '' THEN {jenkins_ts_sql(pre)} END)"
    jm = f"(CASE WHEN {jts} IS NOT NULL THEN regexp_replace({l}, {lit(P.JENKINS_TS)}, '') ELSE {l} END)"
    word = nz(rxe(jm, rules.JENKINS_LEVEL_WORDS, 1, True))
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in rules.JENKINS_LEVELS.items())
    stage = nz(rxe(l, P.JENKINS_STAGE, 1, True))
    out["jenkins"] = (
        jts, f"CASE WHEN {word} IS NOT NULL THEN (CASE {word} {whens} ELSE 'INFO' END) END", jm,
        f"CASE WHEN {stage} IS NOT NULL THEN 'pipeline_action=' || {stage} ELSE '' END", l)
    # github actions
    isa = f"regexp_matches({l}, {rx(P.GHA_ANNOTATION)})"
    typ = f"lower({rxe(l, P.GHA_ANNOTATION, 1, True)})"
    m0 = f"(CASE WHEN {isa} THEN {rxe(l, P.GHA_ANNOTATION, 3, True)} ELSE {l} END)"
    params = rxe(l, P.GHA_ANNOTATION, 2, True)
    pairs = f"list_filter(string_split({params}, ','), lambda p: contains(p, '='))"
    kvl = (f"list_transform({pairs}, lambda p: {{'k': {strip('split_part(p, ' + lit('=') + ', 1)')}, "
           f"'v': {strip('substr(p, strpos(p, ' + lit('=') + ') + 1)')}}})")
    last = f"list_filter({kvl}, lambda e, i: NOT coalesce(list_bool_or(list_transform({kvl}[i+1:], lambda x: x.k = e.k)), false))"
    ann_meta = f"array_to_string(list_sort(list_transform({last}, lambda e: e.k || '=' || e.v)), ';')"
    gpre = rxe(m0, P.GHA_TS_PREFIX, 1)
    gts = f"(CASE WHEN {gpre} <> '' THEN {naive_iso_sql(gpre)} END)"
    out["github_actions"] = (
        gts,
        f"CASE WHEN {isa} THEN (CASE WHEN {typ} = 'notice' THEN 'INFO' ELSE upper({typ}) END) END",
        f"CASE WHEN {gts} IS NOT NULL THEN regexp_replace({m0}, {lit(P.GHA_TS_PREFIX)}, '') ELSE {m0} END",
        f"CASE WHEN {isa} THEN coalesce({ann_meta}, '') ELSE '' END", l)
    # terraform
    lv = nz(rxe(l, P.TERRAFORM_LEVEL, 1, True))
    tm0 = f"(CASE WHEN {lv} IS NOT NULL THEN regexp_replace({l}, {rx(P.TERRAFORM_LEVEL)}, '') ELSE {l} END)"
    tpre = rxe(tm0, P.ISO_PREFIX, 1)
    tts = f"(CASE WHEN {tpre} <> '' THEN {iso_ts_sql(tpre)} END)"
    out["terraform"] = (
        tts, f"upper({lv})",
        f"CASE WHEN {tts} IS NOT NULL THEN regexp_replace({tm0}, {lit(P.ISO_PREFIX)}, '') ELSE {tm0} END",
        "''", l)
    # cloudwatch
    isj = f"(starts_with({l}, '{{') AND {ok})"
    tsv = jget(l, "@timestamp")
    num = f"regexp_matches({l}, {lit(chr(34) + '@timestamp' + chr(34) + r'\s*:\s*-?[0-9]')})"
    cts = (f"(CASE WHEN {jkey(l, '@timestamp')} THEN (CASE WHEN {num} THEN "
           f"TRY(CAST(TIMESTAMP '1970-01-01' + to_microseconds(CAST(round(CAST({tsv} AS DOUBLE) * 1000) AS BIGINT)) AS TIMESTAMP)) "
           f"ELSE {iso_ts_sql(tsv)} END) END)")
    cmsg = f"(CASE WHEN {jkey(l, 'message')} THEN {jget(l, 'message')} WHEN {jkey(l, '@message')} THEN {jget(l, '@message')} ELSE '' END)"
    parts = f"string_split({l}, chr(9))"
    out["cloudwatch"] = (
        f"CASE WHEN {isj} THEN {cts} WHEN len({parts}) >= 2 THEN {iso_ts_sql(parts + '[1]')} END",
        f"CASE WHEN {isj} THEN {level_sql(cmsg)} END",
        f"CASE WHEN {isj} THEN {cmsg} WHEN len({parts}) >= 2 THEN {parts}[2] ELSE {l} END",
        f"CASE WHEN {isj} THEN {jmeta(l, ['@timestamp', 'message', '@message'])} WHEN len({parts}) > 2 THEN 'log_stream=' || {parts}[3] ELSE '' END",
        None)
    # generic
    g1, g2, g3 = (rxe(l, p, 1) for p in P.GENERIC_TS)
    gmsg = (f"(CASE WHEN {g1} <> '' THEN regexp_replace({l}, {lit(P.GENERIC_TS[0])}, '') "
            f"WHEN {g2} <> '' THEN regexp_replace({l}, {lit(P.GENERIC_TS[1])}, '') "
            f"WHEN {g3} <> '' THEN regexp_replace({l}, {lit(P.GENERIC_TS[2])}, '') ELSE {l} END)")
    out["generic"] = (
        f"CASE WHEN {g1} <> '' THEN {iso_zone_sql(g1)} WHEN {g2} <> '' THEN {ymd_sql(g2)} WHEN {g3} <> '' THEN {syslog_sql(g3)} END",
        level_sql(gmsg), gmsg, "''", l)
    return out


def parse_select_sql(l: str = "line", src: str = "source") -> str:
    f = parse_fields_sql(l)
    cols = []
    for i, name in enumerate(["ts", "level", "message", "meta", "raw"]):
        whens = []
        for s_, exprs in f.items():
            e = exprs[i]
            if e is None:
                continue
            whens.append(f"WHEN {src} = {lit(s_)} THEN {e}")
        if name == "raw":
            dumps = (f"'{{' || array_to_string(list_transform(json_keys({l}), lambda k: to_json(k) || ': ' || "
                     f"CAST(json_extract({l}, '$.\"' || k || '\"') AS VARCHAR)), ', ') || '}}'")
            raw_cw = f"CASE WHEN coalesce({jget(l, 'message')}, '') <> '' THEN {dumps} ELSE '' END"
            whens.append(f"WHEN {src} = 'cloudwatch' THEN (CASE WHEN starts_with({l}, '{{') AND json_valid({l}) THEN {raw_cw} ELSE {l} END)")
        cols.append(f"CASE {' '.join(whens)} END AS {name}")
    return ",\n    ".join(cols)


PARSED = f"""pl AS (SELECT file_id, text, {parser_source_sql('text')} AS source FROM log_files),
ln0 AS (SELECT file_id, source, {split_lines_sql('text')} AS arr FROM pl),
ln1 AS (SELECT file_id, source, arr, unnest(range(len(arr))) AS line_no FROM ln0),
ln AS (SELECT file_id, source, CAST(line_no AS INTEGER) AS line_no, {strip('arr[line_no + 1]')} AS line FROM ln1),
entries AS (
  SELECT file_id, line_no, source, {parse_select_sql()}
  FROM ln WHERE line <> '')"""

SQL["parse_logs"] = f"""WITH {LOG_LINES},
{LOG_FILES},
{PARSED}
SELECT file_id, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, level, message, source, meta, raw FROM entries"""

SQL["batch_counts"] = f"""WITH {LOG_LINES},
{LOG_FILES},
b AS (SELECT file_id, list_transform({split_lines_sql('text')}, lambda x: {strip('x')}) AS ls FROM log_files)
SELECT file_id, len(ls) AS total_lines, len(list_filter(ls, lambda x: x <> '')) AS parsed_lines, 0 AS failed_lines FROM b"""

SQL["k8s_batch_flags"] = f"""WITH {LOG_LINES},
{LOG_FILES}
SELECT file_id, {', '.join(f'regexp_matches(text, {rx(p)}) AS {n}' for n, p in rules.K8S_FLAGS)} FROM log_files"""


# ---------------------------------------------------------------------------
# B, C, E
# ---------------------------------------------------------------------------
FILES = f"WITH {LOG_LINES},\n{LOG_FILES}"

SQL["b1_explode_lines"] = f"""{FILES},
ln0 AS (SELECT file_id, {split_lines_sql('text')} AS arr FROM log_files),
ln1 AS (SELECT file_id, arr, unnest(range(len(arr))) AS line_no FROM ln0)
SELECT file_id, line_no, {strip('arr[line_no + 1]')} AS line FROM ln1 WHERE {strip('arr[line_no + 1]')} <> ''"""

SQL["b2_clean_text"] = f"""{FILES},
d AS (SELECT file_id, chr(27) || '[31m' || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10))
             || chr(27) || '[0m' || chr(0) || '  ' || chr(13) AS text FROM log_files)
SELECT file_id, {clean('text')} AS clean_text FROM d"""


def normalize_sql(e: str) -> str:
    t = f"replace({e}, chr(0), ' ')"
    t = f"regexp_replace({t}, {lit(chr(92) + 'r' + chr(92) + 'n?')}, chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(t)


SQL["b3_normalize_text"] = f"""SELECT doc_id, sha256({normalize_sql('text')}) AS digest,
  length({normalize_sql('text')}) AS n_chars FROM documents"""

SQL["b4_first_nonblank_lines"] = f"""{FILES}
SELECT file_id, array_to_string(list_filter(list_transform({split_lines_sql('text')}, lambda x: {strip('x')}), lambda x: x <> '')[1:3], chr(10)) AS evidence
FROM log_files"""

SQL["c1_detect_source"] = f"""{FILES}
SELECT file_id, {parser_source_sql('text')} AS source FROM log_files"""


def classify_first_sql(e: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({e}, {rx(p)}) THEN {lit(n)}" for n, p in rules.SOURCE_RULES)
    return f"CASE {whens} ELSE 'generic' END"


SQL["c2_classify_source"] = f"""{FILES}
SELECT file_id, {classify_first_sql(clean('text'))} AS source FROM log_files"""

_PREP = f"""{FILES},
{PREPARED}"""

SQL["c3_classify_source_scored"] = f"""{_PREP}
SELECT file_id, classification_source AS source, round(classification_confidence, 6) AS confidence FROM prepared"""

SQL["c4_source_match_counts"] = f"""{_PREP},
u AS (UNPIVOT scored ON {', '.join(f'c{i}' for i in range(len(rules.SOURCE_RULES)))} INTO NAME rule VALUE n),
names(rule, source) AS (VALUES {', '.join(f"('c{i}', {lit(n)})" for i, (n, _) in enumerate(rules.SOURCE_RULES))})
SELECT u.file_id, names.source, CAST(u.n AS BIGINT) AS n FROM u JOIN names USING (rule) WHERE u.n > 0"""

SQL["c5_resolve_source"] = f"""{_PREP}
SELECT file_id, parser_source, classification_source, round(classification_confidence, 6) AS classification_confidence, source
FROM prepared"""

SQL["c6_forced_source"] = f"""{FILES}
SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'generic' ELSE {parser_source_sql('text')} END AS source
FROM log_files"""

SQL["e2_rule_applicability"] = f"""{_PREP},
{RULES_T},
src_t(rule_no, sources) AS (VALUES {', '.join(f"({r.rule_no}, {('[' + ', '.join(lit(x) for x in r.sources) + ']') if r.sources else 'NULL'})" for r in rules.DETECTION_RULES)})
SELECT p.file_id, p.source, CAST(s.rule_no AS BIGINT) AS rule_no FROM prepared p JOIN src_t s
  ON s.sources IS NULL OR list_contains(s.sources, p.source)"""

SQL["e3_find_matches"] = PIPELINE_FINDINGS + """
SELECT file_id, CAST(rule_no AS BIGINT) AS rule_no, CAST(match_no AS BIGINT) AS match_no, st AS start, st + hl AS "end" FROM mo"""

SQL["e7_detect_findings"] = PIPELINE_FINDINGS + """
SELECT file_id, CAST(rule_no AS BIGINT) AS rule_no, CAST(match_no AS BIGINT) AS match_no, category, severity, title,
       evidence, source_type, confidence FROM findings"""

_ENTRY_FINDINGS = f"""{FILES},
{PARSED},
ekeyed AS (SELECT file_id || ':' || line_no AS ek, file_id, line_no, source, message AS clean_text, ts FROM entries),
{findings_ctes(src_tbl='ekeyed', key='ek', text='clean_text', src='source')}"""

SQL["e8_detect_findings_from_entries"] = _ENTRY_FINDINGS + """
SELECT e.file_id, CAST(e.line_no AS BIGINT) AS line_no, CAST(f.rule_no AS BIGINT) AS rule_no,
       CAST(f.match_no AS BIGINT) AS match_no, f.category, f.severity, f.title, f.evidence, f.source_type,
       f.confidence, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM findings f JOIN ekeyed e ON e.ek = f.ek"""

ALL_FILES = """,
f AS (SELECT l.file_id, x.file_id AS file_id_f, x.severity, x.title, x.rule_no, x.match_no
      FROM log_files l LEFT JOIN findings x ON x.file_id = l.file_id)
"""

SQL["e9_finding_summary"] = PIPELINE_FINDINGS + ALL_FILES + f"""
SELECT file_id, {', '.join(f"count(*) FILTER (WHERE severity = {lit(s)}) AS {s}" for s in rules.SEVERITIES)},
       count(file_id_f) AS total FROM f GROUP BY file_id"""

SQL["e10_brief_findings"] = PIPELINE_FINDINGS + ALL_FILES + """
SELECT file_id,
  coalesce(string_agg(title, '|' ORDER BY rule_no, match_no) FILTER (WHERE severity IN ('critical', 'high')), '') AS critical_list,
  coalesce(string_agg(title, '|' ORDER BY rule_no, match_no) FILTER (WHERE severity = 'high'), '') AS high_list
FROM f GROUP BY file_id"""

SQL["e10_brief_titles"] = PIPELINE_FINDINGS + """,
lists AS (SELECT file_id, 'critical' AS list, rule_no, match_no, title FROM findings WHERE severity IN ('critical', 'high')
          UNION ALL SELECT file_id, 'high', rule_no, match_no, title FROM findings WHERE severity = 'high')
SELECT file_id, list, row_number() OVER (PARTITION BY file_id, list ORDER BY rule_no, match_no) AS pos, title FROM lists"""

SQL["e11_brief_message"] = PIPELINE_FINDINGS + ALL_FILES + """,
s AS (SELECT file_id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h,
             count(file_id_f) AS t FROM f GROUP BY file_id)
SELECT file_id, CASE WHEN c > 0 THEN 'Critical issues detected: ' || c || ' critical findings'
                     WHEN h > 0 THEN 'High severity issues detected: ' || h || ' high findings'
                     WHEN t > 0 THEN t || ' issues detected' ELSE 'No issues detected' END AS message FROM s"""

SQL["e12_severity_flags"] = PIPELINE_FINDINGS + ALL_FILES + """
SELECT file_id, count(*) FILTER (WHERE severity = 'critical') AS critical_findings,
       count(*) FILTER (WHERE severity = 'high') AS high_findings, coalesce(bool_or(severity = 'critical'), false) AS has_critical_issues
FROM f GROUP BY file_id"""

# ---------------------------------------------------------------------------
# H: relational views and queries
# ---------------------------------------------------------------------------
SOURCES_SQL = "[" + ", ".join(lit(s) for s in rules.SOURCES) + "]"
LI = """li AS (SELECT *, l_orderkey * 1000000 + row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS id FROM lineitem)"""
INCIDENTS = """incidents AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS owner_user_id, 'order ' || o.o_orderkey AS title,
         CAST(NULL AS VARCHAR) AS description,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
              ELSE 'low' END AS severity,
         o.o_orderstatus AS environment, 'svc-' || (o.o_custkey % 10) AS service_name,
         o.o_orderdate AS started_at, e.ended_at, o.o_orderdate AS created_at, o.o_orderdate AS updated_at
  FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ended_at FROM lineitem GROUP BY l_orderkey) e
    ON o.o_orderkey = e.l_orderkey)"""
ATTACHMENTS = """attachments AS (
  SELECT id, l_orderkey AS incident_id, l_suppkey AS uploaded_by_user_id,
         CASE l_linenumber % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'yaml' ELSE 'screenshot' END AS kind,
         'file-' || id || '.log' AS filename, CAST(trunc(l_quantity * 1024) AS BIGINT) AS size_bytes,
         l_shipdate AS created_at FROM li)"""
JOBS = f"""jobs0 AS (
  SELECT id, l_orderkey AS incident_id, id AS attachment_id, l_linenumber,
         CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded'
              WHEN l_linestatus = 'O' THEN 'queued' ELSE 'running' END AS status,
         {SOURCES_SQL}[l_partkey % 9 + 1] AS source_type, l_shipdate AS created_at FROM li),
jobs AS (
  SELECT id, incident_id, attachment_id, status, source_type,
         CASE WHEN status = 'failed' THEN 'ingestion failed' END AS error, created_at,
         CASE WHEN status <> 'queued' THEN created_at END AS started_at,
         CASE WHEN status IN ('succeeded', 'failed') THEN created_at + to_minutes(l_linenumber * 5) END AS finished_at
  FROM jobs0)"""
CATS_SQL = "[" + ", ".join(lit(r.category) for r in rules.DETECTION_RULES) + "]"
SEVS_SQL = "[" + ", ".join(lit(s) for s in rules.SEVERITIES) + "]"
FINDINGS_T = f"""findings_t AS (
  SELECT id, l_orderkey AS incident_id, id AS job_id, {CATS_SQL}[l_suppkey % 20 + 1] AS category,
         {SEVS_SQL}[l_linenumber % 4 + 1] AS severity, l_shipdate AS created_at FROM li)"""
REL = f"WITH {LI},\n{INCIDENTS},\n{ATTACHMENTS},\n{JOBS},\n{FINDINGS_T}"


def ts_out(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


SQL["h1_jobs_by_incident"] = f"""{REL}
SELECT incident_id, id, status, {ts_out('created_at')} AS created_at,
       row_number() OVER (PARTITION BY incident_id ORDER BY created_at DESC, id DESC) AS pos FROM jobs"""

SQL["h3_findings_by_job"] = f"""{REL}
SELECT job_id, id, severity, category,
       row_number() OVER (PARTITION BY job_id ORDER BY severity DESC, category, id) AS pos FROM findings_t"""

SQL["h4_findings_by_incident"] = f"""{REL}
SELECT incident_id, id, severity, {ts_out('created_at')} AS created_at,
       row_number() OVER (PARTITION BY incident_id ORDER BY severity DESC, created_at DESC, id DESC) AS pos FROM findings_t"""

SQL["h5_critical_findings"] = f"""{REL}
SELECT id, incident_id, severity, category, {ts_out('created_at')} AS created_at FROM findings_t
WHERE severity IN ('critical', 'high') ORDER BY severity DESC, findings_t.created_at DESC, id DESC LIMIT 10"""

SQL["h5_critical_findings_ranked"] = f"""{REL}
SELECT id, incident_id, severity, category, {ts_out('created_at')} AS created_at FROM findings_t
WHERE severity IN ('critical', 'high')
ORDER BY CASE severity WHEN 'critical' THEN 1 ELSE 2 END, findings_t.created_at DESC, id DESC LIMIT 10"""

SQL["h6_job_status_counts"] = f"""{REL}
SELECT status, count(*) AS n FROM jobs GROUP BY status"""

SQL["h8_severity_counts"] = f"""{REL}
SELECT severity, count(*) AS n FROM findings_t GROUP BY severity"""

SQL["h8_category_counts"] = f"""{REL}
SELECT category, count(*) AS n FROM findings_t GROUP BY category"""

SQL["h10_jobs_for_owner"] = f"""{REL}
SELECT i.owner_user_id, j.incident_id, j.id, {ts_out('j.created_at')} AS created_at,
       row_number() OVER (PARTITION BY i.owner_user_id ORDER BY j.created_at DESC, j.id DESC) AS pos
FROM jobs j JOIN incidents i ON i.id = j.incident_id"""

SQL["h11_owned_by"] = f"""{REL}
SELECT id, incident_id, category FROM findings_t f
WHERE incident_id IN (SELECT i.id FROM incidents i JOIN customer c ON c.c_custkey = i.owner_user_id
                      WHERE c.c_mktsegment = 'BUILDING')"""

SQL["h12_incidents_by_owner"] = f"""{REL}
SELECT owner_user_id, id, {ts_out('created_at')} AS created_at, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY created_at DESC, id DESC) AS pos FROM incidents)"""

SQL["h13_lookup_by_id"] = f"""{REL}
SELECT id, title, severity FROM incidents WHERE id IN (SELECT incident_id FROM jobs WHERE status = 'failed')"""

SQL["h14_latest_log_attachment"] = f"""{REL}
SELECT incident_id, arg_max(id, (created_at, id)) AS attachment_id, {ts_out('max(created_at)')} AS created_at
FROM attachments WHERE kind = 'log' GROUP BY incident_id"""

SQL["h15_incident_timeline"] = f"""WITH {LOG_LINES}
SELECT file_id AS incident_id, event_id AS id, {ts_out('ts')} AS occurred_at,
       row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS pos FROM log_lines"""

SQL["h16_job_state"] = f"""{REL}
SELECT id AS job_id, status, {ts_out('created_at')} AS created_at, {ts_out('started_at')} AS started_at,
       {ts_out('finished_at')} AS finished_at, error FROM jobs"""

SQL["h17_touch_incident"] = f"""{REL}
SELECT i.id, {ts_out('greatest(i.updated_at, a.last)')} AS updated_at FROM incidents i
LEFT JOIN (SELECT incident_id, max(created_at) AS last FROM attachments GROUP BY incident_id) a ON a.incident_id = i.id"""

SQL["h18_incident_defaults"] = f"""{REL}
SELECT id, coalesce(severity, 'medium') AS severity_eff, coalesce(environment, 'production') AS environment_eff,
       length(title) BETWEEN 3 AND 255 AS title_valid FROM incidents"""


# ---------------------------------------------------------------------------
# I: timeline
# ---------------------------------------------------------------------------
from ..operators import timeline as TL  # noqa: E402

LINES_NB = f"""ln0 AS (SELECT file_id, {split_lines_sql('text')} AS arr FROM log_files),
ln1 AS (SELECT file_id, arr, unnest(range(len(arr))) AS line_no FROM ln0),
ln AS (SELECT file_id, CAST(line_no AS INTEGER) AS line_no, {strip('arr[line_no + 1]')} AS line FROM ln1
       WHERE {strip('arr[line_no + 1]')} <> '')"""


def _timeline_sql(use_line_date: bool) -> str:
    h, m, s = (rxe("line", TL.TIME_ONLY, i) for i in (1, 2, 3))
    sec = f"coalesce(nullif({s}, ''), '0')"
    only = (f"CASE WHEN regexp_matches(line, {lit(TL.TIME_ONLY)}) AND base_ts IS NOT NULL AND CAST({sec} AS INTEGER) < 60 THEN "
            f"TRY(make_timestamp(year(base_ts), month(base_ts), day(base_ts), CAST({h} AS BIGINT), CAST({m} AS BIGINT), CAST({sec} AS DOUBLE))) END")
    t = only
    if use_line_date:
        g = [rxe("line", TL.DATED, i) for i in range(1, 7)]
        dsec = f"coalesce(nullif({g[5]}, ''), '0')"
        dated = (f"CASE WHEN CAST({dsec} AS INTEGER) < 60 THEN TRY(make_timestamp(CAST({g[0]} AS BIGINT), CAST({g[1]} AS BIGINT), "
                 f"CAST({g[2]} AS BIGINT), CAST({g[3]} AS BIGINT), CAST({g[4]} AS BIGINT), CAST({dsec} AS DOUBLE))) END")
        t = f"CASE WHEN regexp_matches(line, {lit(TL.DATED)}) THEN {dated} ELSE {only} END"
    union = " UNION ALL ".join(
        f"SELECT file_id, line_no, line, occurred_at, {i} AS rule_no, {lit(title)} AS title FROM t WHERE regexp_matches(line, {rx(p)})"
        for i, (p, title) in enumerate(rules.TIMELINE_RULES))
    return f"""{FILES},
{LINES_NB},
b AS (SELECT ln.*, o.o_orderdate AS base_ts FROM ln LEFT JOIN orders o ON o.o_orderkey = ln.file_id),
t AS (SELECT *, coalesce({t}, TIMESTAMP '2025-01-01 00:00:00') AS occurred_at FROM b),
ev AS ({union}),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, title, date_trunc('second', occurred_at)
                                                     ORDER BY line_no, rule_no) AS r FROM ev) WHERE r = 1)
SELECT file_id, {ts_out('occurred_at')} AS occurred_at, title, line AS detail, {"'auto' AS source, " if not use_line_date else ""}
       CAST(line_no AS BIGINT) AS line_no,
       row_number() OVER (PARTITION BY file_id ORDER BY occurred_at, title, line_no, rule_no) AS pos FROM kept"""


SQL["i4_generate_timeline"] = _timeline_sql(False)
SQL["i4_generate_timeline_line_date"] = _timeline_sql(True)

# ---------------------------------------------------------------------------
# J: incident analysis
# ---------------------------------------------------------------------------
PAY_FIELDS = {"summary": "str", "logs": "list", "incident_type": "str", "tags": "list", "message": "str", "log_text": "str"}


def ptext(keys) -> str:
    parts = []
    for k in keys:
        kind = PAY_FIELDS.get(k)
        if kind == "str":
            parts.append(f"nullif({k}, '')")
        elif kind == "list":
            parts.append(f"nullif(array_to_string(list_filter({k}, lambda x: x IS NOT NULL AND x <> ''), chr(10)), '')")
    if not parts:
        return "''"
    return f"coalesce(concat_ws(chr(10), {', '.join(parts)}), '')"


def first3(e: str) -> str:
    return f"list_filter(list_transform({split_lines_sql(e)}, lambda x: {strip('x')}), lambda x: x <> '')[1:3]"


def sublist(text: str, subs) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(s_)})" for s_ in subs) + ")"


def _route_sql() -> str:
    text = f"lower({ptext(rules.ROUTER_TEXT_FIELDS)})"
    itype = "lower(coalesce(incident_type, 'none'))"
    tags = f"list_transform(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL AND x <> ''), lambda x: lower({strip('x')}))"
    picks = [f"CASE WHEN {sublist(text, subs)} THEN {lit(a)} END" for a, subs in rules.ROUTER_TEXT_RULES]
    picks += [f"CASE WHEN {sublist(itype, subs)} THEN {lit(a)} END" for a, subs in rules.ROUTER_TYPE_RULES]
    picks += [f"CASE WHEN {' OR '.join(f'list_contains({tags}, {lit(v)})' for v in vals)} THEN {lit(a)} END"
              for a, vals in rules.ROUTER_TAG_RULES]
    chosen = f"list_sort(list_distinct(list_filter([{', '.join(picks)}], lambda x: x IS NOT NULL)))"
    return f"CASE WHEN len({chosen}) > 0 THEN {chosen} ELSE {('[' + ', '.join(lit(a) for a in sorted(rules.ROUTER_DEFAULT)) + ']')} END"


def _agent_sql(a) -> str:
    text = ptext(a.keys)
    hits = f"list_filter([{', '.join(f'CASE WHEN regexp_matches({text}, {rx(p)}) THEN {lit(p)} END' for p in a.patterns)}], lambda x: x IS NOT NULL)"
    return (f"{{'agent': {lit(a.name)}, "
            f"'summary': CASE WHEN len({hits}) > 0 THEN {lit(a.hit_summary)} ELSE {lit(a.miss_summary)} END, "
            f"'findings': list_transform({hits}, lambda h: {lit(a.finding_prefix)} || h), "
            f"'confidence': CASE WHEN len({hits}) > 0 THEN CAST({a.hit_conf} AS DOUBLE) ELSE CAST({a.miss_conf} AS DOUBLE) END, "
            f"'evidence': {first3(text)}}}")


def _docs_sql() -> str:
    d = rules.DOCS_AGENT
    return (f"{{'agent': 'docs_retrieval', 'summary': {lit(d['skip_summary'])}, 'findings': CAST([] AS VARCHAR[]), "
            f"'confidence': CAST({d['skip_conf']} AS DOUBLE), 'evidence': CAST([] AS VARCHAR[])}}")


def _results_sql() -> str:
    by_name = {a.name: _agent_sql(a) for a in rules.AGENTS}
    by_name["docs_retrieval"] = _docs_sql()
    items = [f"CASE WHEN list_contains(agents, {lit(n)}) THEN {by_name[n]} END" for n in sorted(by_name)]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def exact_round2(x: str) -> str:
    two54 = 18014398509481984
    num = f"(CAST({x} * {float(two54)} AS HUGEINT) * 100)"
    q = f"({num} // {two54})"
    r = f"({num} - {q} * {two54})"
    return (f"(CAST(CASE WHEN 2 * {r} > {two54} THEN {q} + 1 WHEN 2 * {r} = {two54} AND {q} % 2 = 1 THEN {q} + 1 "
            f"ELSE {q} END AS DOUBLE) / 100.0)")


def _rc_pick(idx: int, lowered: str, text: str) -> str:
    items = []
    for r in rules.ROOT_CAUSE_RULES:
        cond = sublist(lowered, r[0])
        if "database_url" in r[0]:
            cond = f"({cond} OR contains({text}, 'missing DATABASE_URL'))"
        items.append(f"CASE WHEN {cond} THEN {lit(r[idx])} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


MESSAGES = """(SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text), '') AS text
               FROM conversations GROUP BY conv_id)"""

PAY_J13 = f"""pay AS (
  SELECT 'log-' || file_id AS incident_id, {first3('text')}[1] AS summary, [text] AS logs,
         {parser_source_sql('text')} AS incident_type, ['auto-analysis', {parser_source_sql('text')}] AS tags,
         CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS log_text FROM log_files
  UNION ALL
  SELECT 'conv-' || conv_id, NULL, NULL, NULL, NULL, text, NULL FROM {MESSAGES})"""

PAY_J15 = f"""{PREPARED},
pay AS (
  SELECT file_id AS incident_id, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR[]) AS logs,
         source AS incident_type, ['auto-analysis', source] AS tags, CAST(NULL AS VARCHAR) AS message,
         text AS log_text FROM prepared WHERE text IS NOT NULL AND text <> '')"""


def analysis_sql(pay: str) -> str:
    return f"""{FILES},
{pay},
routed AS (SELECT *, {_route_sql()} AS agents FROM pay),
res AS (SELECT *, {_results_sql()} AS results FROM routed),
merged AS (
  SELECT *, array_to_string(list_transform(results, lambda r: r.agent || ': ' || r.summary), ' | ') AS summary_m,
         flatten(list_transform(results, lambda r: r.findings)) AS findings,
         flatten(list_transform(results, lambda r: r.evidence)) AS evidence,
         {ptext(rules.ROOT_CAUSE_KEYS)} AS rc_text FROM res),
rc0 AS (
  SELECT *, lower(array_to_string(findings, ' ') || ' ' || rc_text) AS lowered FROM merged),
rc1 AS (
  SELECT *, {_rc_pick(1, 'lowered', 'rc_text')} AS probable0, {_rc_pick(2, 'lowered', 'rc_text')} AS dependency,
         {_rc_pick(4, 'lowered', 'rc_text')} AS remediation0,
         list_reduce(list_transform(results, lambda r: r.confidence), lambda a, x: a + x) / len(results) AS mean_conf
  FROM rc0),
rc AS (
  SELECT *, CASE WHEN len(probable0) = 0 THEN [{lit(rules.ROOT_CAUSE_FALLBACK)}] ELSE probable0 END AS probable,
         CASE WHEN len(probable0) = 0 THEN [{lit(rules.ROOT_CAUSE_FALLBACK_FIX)}] ELSE remediation0 END AS remediation,
         {exact_round2('least(0.99, greatest(0.3, mean_conf))')} AS rc_confidence FROM rc1),
recs AS (
  SELECT *, list_filter([{', '.join(f'CASE WHEN {sublist("lower(array_to_string(findings, ' '))", subs)} THEN {lit(s_)} END' for subs, s_ in rules.REMEDIATION_RULES)}],
                        lambda x: x IS NOT NULL) AS recs0 FROM rc),
final AS (
  SELECT *, CASE WHEN len(recs0) > 0 THEN recs0 ELSE [{', '.join(lit(x) for x in rules.REMEDIATION_DEFAULTS)}] END AS recommendations
  FROM recs)"""


ANALYSIS = analysis_sql(PAY_J13)

SQL["j13_analyze_incidents"] = f"""{ANALYSIS}
SELECT incident_id, array_to_string(agents, ',') AS agents, summary_m AS summary,
       array_to_string(findings, '|') AS findings, array_to_string(evidence, '|') AS evidence,
       'root cause analysis: ' || probable[1] AS rc_summary,
       array_to_string(list_concat(list_transform(probable, lambda p: 'Probable cause: ' || p),
                                   list_transform(remediation, lambda r: 'Suggested remediation: ' || r)), '|') AS rc_findings,
       rc_confidence,
       array_to_string(CASE WHEN len(evidence) > 0 THEN evidence ELSE {first3('rc_text')} END, '|') AS rc_evidence,
       CASE WHEN list_bool_or(list_transform(probable, lambda p: contains(lower(p), 'database') OR contains(lower(p), 'out of memory')))
            THEN 'Critical' ELSE 'High' END AS rc_severity,
       array_to_string(dependency, '|') AS rc_dependency_chain,
       array_to_string(recommendations, '|') AS recommendations
FROM final"""

SQL["j11_root_cause"] = f"""{ANALYSIS}
SELECT incident_id, array_to_string({_rc_pick(3, 'lowered', 'rc_text')}, '|') AS affected_systems,
       array_to_string(remediation, '|') AS remediation_steps FROM final"""

SQL["j3_route_agents"] = f"""{ANALYSIS}
SELECT incident_id, unnest(agents) AS agent FROM routed"""

SQL["j10_agent_results"] = f"""{ANALYSIS},
x AS (SELECT incident_id, unnest(results) AS r FROM res)
SELECT incident_id, r.agent AS agent, r.summary AS summary, array_to_string(r.findings, '|') AS findings,
       r.confidence AS confidence, array_to_string(r.evidence, '|') AS evidence FROM x"""

SQL["j14_ai_events"] = f"""{ANALYSIS}
SELECT incident_id, 'AI Orchestrator Analysis' AS title,
       'Summary: ' || summary_m || chr(10) || 'Recommendations:' || chr(10)
         || array_to_string(list_transform(recommendations, lambda r: '- ' || r), chr(10)) AS detail,
       'ai' AS source FROM final"""


# ---------------------------------------------------------------------------
# F: chunking (F-3, F-5, F-6 have SQL; the greedy folds are checked in tests)
# ---------------------------------------------------------------------------
WS_CLASS = "[" + _class_body(PY_WHITESPACE) + "]"


def checksum_sql(e: str) -> str:
    return f"substr(sha256({e}), 1, 16)"


SQL["f3_single_chunk"] = f"""{FILES},
c AS (SELECT file_id, {clean('text')} AS t FROM log_files)
SELECT file_id, CAST(0 AS BIGINT) AS chunk_index, CAST(0 AS BIGINT) AS start_line,
       CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) AS end_line, {checksum_sql('t')} AS checksum
FROM c WHERE t <> ''"""

SQL["f5_split_sentences"] = f"""WITH d AS (SELECT doc_id, {normalize_sql('text')} AS t FROM documents),
p0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, {lit(chr(10) + WS_CLASS + '*' + chr(10))}),
                                                 lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM d),
p1 AS (SELECT doc_id, unnest(range(len(ps))) AS para_no, ps FROM p0),
p AS (SELECT doc_id, para_no, ps[para_no + 1] AS para FROM p1),
s0 AS (SELECT doc_id, para_no,
              list_filter(list_transform(string_split(regexp_replace({strip('para')}, {lit('([.!?])' + WS_CLASS + '+')}, '\\1' || chr(1), 'g'), chr(1)),
                                         lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM p),
s1 AS (SELECT doc_id, para_no, unnest(range(len(ss))) AS sent_no, ss FROM s0)
SELECT doc_id, CAST(para_no AS BIGINT) AS para_no, CAST(sent_no AS BIGINT) AS sent_no,
       {checksum_sql('ss[sent_no + 1]')} AS checksum, length(ss[sent_no + 1]) AS n_chars FROM s1"""

SQL["f6_split_long"] = f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN n <= 1200 THEN 0 ELSE CAST(ceil((n - 1200) / 1050.0) AS BIGINT) END)) AS part_no FROM d),
x AS (SELECT doc_id, part_no, {strip('substr(text, CAST(part_no * 1050 + 1 AS BIGINT), 1200)')} AS part FROM w)
SELECT doc_id, part_no, {checksum_sql('part')} AS checksum, length(part) AS n_chars FROM x"""

# ---------------------------------------------------------------------------
# G, K
# ---------------------------------------------------------------------------
TOPK = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, x.vec_id, 1.0 - list_cosine_similarity(q.v, x.v) AS distance
          FROM e q, e x WHERE q.vec_id <> x.vec_id),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
         WHERE rank <= 5)"""

SQL["g2_cosine_topk"] = f"""WITH {TOPK}
SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM topk"""

SQL["g1_with_embeddings"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm, v FROM e),
u AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN nrm > 0 THEN x / nrm ELSE 0.0 END) AS w FROM n)
SELECT d.doc_id AS vec_id, d.source, round(sqrt(list_sum(list_transform(u.w, lambda x: x * x))), 6) AS norm,
       round(u.w[1], 6) AS x1
FROM documents d LEFT JOIN u ON u.vec_id = d.doc_id"""

SQL["g3_format_context"] = f"""WITH {TOPK},
b AS (SELECT t.query_id, t.rank, 'Source: ' || coalesce(d.source, 'unknown') || chr(10) || {strip("coalesce(d.text, '')")} AS blk
      FROM topk t LEFT JOIN documents d ON d.doc_id = t.vec_id),
c AS (SELECT query_id, string_agg(blk, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY query_id)
SELECT query_id, sha256(context) AS digest, length(context) AS n_chars FROM c"""

SQL["k1_mttr"] = f"""{REL}
SELECT service_name, count(*) AS n_resolved, round(avg(CAST(epoch(ended_at) - epoch(started_at) AS DOUBLE)), 6) AS mttr_seconds
FROM incidents WHERE started_at IS NOT NULL AND ended_at IS NOT NULL AND ended_at >= started_at GROUP BY service_name"""

SQL["k2_pipeline_health"] = f"""{REL}
SELECT {ts_out("date_trunc('day', created_at)")} AS period, count(*) AS n_jobs,
       count(*) FILTER (WHERE status = 'succeeded') AS n_succeeded,
       round(avg(CASE WHEN status = 'succeeded' THEN 1.0 ELSE 0.0 END), 6) AS health
FROM jobs GROUP BY date_trunc('day', created_at)"""

SQL["k2_pipeline_health_last_24h"] = f"""{REL}
SELECT count(*) AS n_jobs, round(avg(CASE WHEN status = 'succeeded' THEN 1.0 ELSE 0.0 END), 6) AS health
FROM jobs WHERE created_at > (SELECT max(created_at) FROM jobs) - INTERVAL 24 HOURS"""

SQL["k3_error_latency_trend"] = """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors,
                  avg(value) AS avg_latency FROM events GROUP BY CAST(ts AS DATE))
SELECT CAST(day AS VARCHAR) AS day, errors, round(avg_latency, 6) AS avg_latency,
       round(avg(errors) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS errors_rolling FROM d"""

SQL["k4_latency_p95"] = """SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type"""

SQL["k4_error_rate"] = """SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(*) AS n
FROM events GROUP BY user_id"""

SQL["k5_integration_rollup"] = f"""{REL},
s AS (SELECT source_type AS service, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) AS fr FROM jobs GROUP BY source_type)
SELECT count(*) AS total_integrations,
       coalesce(array_to_string(list_sort(list(service) FILTER (WHERE fr > 0.25)), ','), '') AS degraded,
       CASE WHEN count(*) FILTER (WHERE fr > 0.25) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM s"""

SQL["k5_integration_services"] = f"""{REL},
s AS (SELECT source_type AS service, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) AS fr FROM jobs GROUP BY source_type)
SELECT service, CASE WHEN fr > 0.25 THEN 'degraded' ELSE 'healthy' END AS status, count(*) OVER () AS total_integrations,
       CASE WHEN count(*) FILTER (WHERE fr > 0.25) OVER () > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM s"""

SQL["k6_docs_recall"] = f"""WITH {TOPK},
h AS (SELECT t.query_id, max(CASE WHEN lq.label = lv.label THEN 1 ELSE 0 END) AS hit, lq.label AS label
      FROM topk t JOIN embeddings lq ON lq.vec_id = t.query_id JOIN embeddings lv ON lv.vec_id = t.vec_id
      GROUP BY t.query_id, lq.label)
SELECT CAST(label AS BIGINT) AS label, count(*) AS n_queries, round(avg(hit), 6) AS recall FROM h GROUP BY label"""

# ---------------------------------------------------------------------------
# S: streaming results equal the batch SQL
# ---------------------------------------------------------------------------
SQL["s1_stream_ingest"] = SQL["finding_counts"]


def _line_cats_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT file_id, line_no, ts, line, {lit(r.category)} AS category FROM log_lines WHERE regexp_matches(line, {rx(r.pattern)})"
        for r in rules.DETECTION_RULES)


SQL["s2_stream_finding_counts"] = f"""WITH {LOG_LINES},
h AS ({_line_cats_sql()})
SELECT {ts_out("date_trunc('day', ts)")} AS window_start, {ts_out("date_trunc('day', ts) + INTERVAL 1 DAY")} AS window_end,
       category, count(*) AS n FROM h GROUP BY date_trunc('day', ts), category"""

SQL["s3_stream_incident_sessions"] = """WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                      OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS brk FROM e),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_errors,
       max(ts) + INTERVAL 30 MINUTES > (SELECT max(ts) FROM e) - INTERVAL 1 DAY AS is_open
FROM s GROUP BY user_id, sid"""

SQL["s4_stream_dedup"] = f"""WITH {LOG_LINES}
SELECT DISTINCT {checksum_sql('line')} AS checksum FROM log_lines"""

SQL["s5_stream_job_state"] = f"""WITH j AS (
  SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || strftime(l_shipdate, '%Y%m%d') AS job_id,
         CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded'
              WHEN l_linestatus = 'O' THEN 'queued' ELSE 'running' END AS status, l_shipdate, l_linenumber FROM lineitem)
SELECT job_id, status, {ts_out('l_shipdate')} AS created_at,
       CASE WHEN status <> 'queued' THEN {ts_out('l_shipdate')} END AS started_at,
       CASE WHEN status IN ('succeeded', 'failed') THEN {ts_out('l_shipdate + to_minutes(l_linenumber * 5)')} END AS finished_at
FROM j"""

SQL["s7_stream_static_enrich"] = f"""WITH {LOG_LINES},
{INCIDENTS},
h AS ({_line_cats_sql()})
SELECT h.file_id, CAST(h.line_no AS BIGINT) AS line_no, h.category, i.owner_user_id, i.service_name
FROM h LEFT JOIN incidents i ON i.id = h.file_id"""


# ---------------------------------------------------------------------------
# A
# ---------------------------------------------------------------------------
SQL["a3_infer_doc_type"] = """SELECT doc_id,
  CASE WHEN lang = 'de' THEN 'pdf' WHEN lang = 'fr' THEN 'yaml' WHEN lang = 'en' THEN 'markdown'
       WHEN lang = 'es' THEN 'docx' ELSE 'text' END AS doc_type FROM documents"""

SQL["a5_attachment_manifest"] = f"""{REL}
SELECT id, kind AS kind_norm,
       CASE WHEN regexp_replace(split_part('/uploads/' || incident_id || '/' || id, '/', -1), '[^a-zA-Z0-9._-]+', '_', 'g') = '' THEN 'file'
            ELSE regexp_replace(split_part('/uploads/' || incident_id || '/' || id, '/', -1), '[^a-zA-Z0-9._-]+', '_', 'g') END AS safe_name,
       CASE WHEN kind NOT IN ('log', 'screenshot', 'yaml') THEN 'invalid kind' END AS reject_reason,
       size_bytes > 26214400 AS oversize
FROM attachments"""

SQL["a9_export_log_lines"] = """SELECT event_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0
       THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'
  || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' events: ' || event_type || ' ' || CAST(value AS VARCHAR)
  || ' | {' || array_to_string(list_transform(json_keys(props), lambda k: '''' || k || ''': ' ||
        CAST(json_extract(props, '$."' || k || '"') AS VARCHAR)), ', ') || '}' AS line
FROM events"""

SQL["j15_auto_analyze"] = f"""{analysis_sql(PAY_J15)}
SELECT incident_id AS file_id, 'AI Auto-Analysis' AS title,
       'Summary: ' || summary_m || chr(10) || 'Recommendations:' || chr(10)
         || array_to_string(list_transform(recommendations, lambda r: '- ' || r), chr(10)) AS detail FROM final"""

SQL["s6_stream_auto_analysis"] = SQL["j15_auto_analyze"]

SQL["j8_docs_agent"] = f"""WITH {TOPK},
h AS (SELECT t.query_id, string_agg('Doc match: ' || coalesce(d.source, 'unknown'), '|' ORDER BY t.rank) AS findings
      FROM topk t LEFT JOIN documents d ON d.doc_id = t.vec_id GROUP BY t.query_id)
SELECT d.doc_id AS incident_id,
       CASE WHEN nullif(d.text, '') IS NULL THEN 'docs retrieval skipped'
            WHEN h.findings IS NOT NULL THEN 'docs retrieval complete' ELSE 'no docs matched' END AS summary,
       CASE WHEN nullif(d.text, '') IS NULL THEN '' ELSE coalesce(h.findings, '') END AS findings,
       CAST(CASE WHEN nullif(d.text, '') IS NULL THEN 0.3 WHEN h.findings IS NOT NULL THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence
FROM documents d JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id
LEFT JOIN h ON h.query_id = d.doc_id"""

for _src, _name in {"kubernetes": "d1_parse_kubernetes", "docker": "d3_parse_docker", "nginx": "d4_parse_nginx",
                    "apache": "d6_parse_apache", "jenkins": "d8_parse_jenkins",
                    "github_actions": "d9_parse_github_actions", "terraform": "d10_parse_terraform",
                    "cloudwatch": "d12_parse_cloudwatch", "generic": "d13_parse_generic"}.items():
    SQL[_name] = SQL["parse_logs"] + f" WHERE source = {lit(_src)}"

SQL["a4_split_oversize"] = f"""SELECT doc_id, strlen(text) > {rules.DOC_MAX_BYTES} AS oversize FROM documents"""

SQL["j16_run_pipeline"] = PIPELINE_FINDINGS + f""",
cnt AS (SELECT file_id, list_transform({split_lines_sql('text')}, lambda x: {strip('x')}) AS ls FROM log_files),
nf AS (SELECT file_id, count(*) AS n FROM findings GROUP BY file_id)
SELECT p.file_id, p.source AS source_type, p.parser_source, p.classification_source,
       round(p.classification_confidence, 6) AS classification_confidence,
       len(c.ls) AS total_lines, len(list_filter(c.ls, lambda x: x <> '')) AS parsed_lines, 0 AS failed_lines,
       coalesce(nf.n, 0) AS n_findings
FROM prepared p JOIN cnt c ON c.file_id = p.file_id LEFT JOIN nf ON nf.file_id = p.file_id"""

PAY_J1 = f"""{LI},
{ATTACHMENTS},
latest AS (SELECT incident_id, incident_id + arg_max(id, (created_at, id)) % 1000000 AS file_id FROM attachments WHERE kind = 'log' GROUP BY incident_id),
pay AS (
  SELECT o.o_orderkey AS incident_id, 'order ' || o.o_orderkey AS summary,
         CASE WHEN lf.text IS NOT NULL THEN [lf.text] END AS logs, CAST(NULL AS VARCHAR) AS incident_type,
         CAST(NULL AS VARCHAR[]) AS tags, c.text AS message, CAST(NULL AS VARCHAR) AS log_text
  FROM orders o LEFT JOIN latest a ON a.incident_id = o.o_orderkey LEFT JOIN log_files lf ON lf.file_id = a.file_id
  LEFT JOIN {MESSAGES} c ON c.conv_id = o.o_orderkey)"""

SQL["j1_analysis_payload"] = f"""{analysis_sql(PAY_J1)}
SELECT incident_id, array_to_string(agents, ',') AS agents, summary_m AS summary,
       CASE WHEN list_bool_or(list_transform(probable, lambda p: contains(lower(p), 'database') OR contains(lower(p), 'out of memory')))
            THEN 'Critical' ELSE 'High' END AS rc_severity, rc_confidence,
       array_to_string(recommendations, '|') AS recommendations FROM final"""

SQL["a2_read_documents"] = """SELECT doc_id, 'text' AS doc_type, length(text) AS n_chars, sha256(text) AS digest FROM documents"""


# ---------------------------------------------------------------------------
# F-1 / F-2 as a recursive CTE: the greedy line fold, one line per step
# ---------------------------------------------------------------------------
def chunk_fold_sql(max_chars: int, overlap: int, respect_lines: bool) -> str:
    add = 1 if respect_lines else 0
    over = f"(size + n + {add} > {max_chars} AND len(buf) > 0)"
    body = strip("array_to_string(buf, chr(10))")
    step = f"""SELECT file_id, ls, i + 1 AS i,
         list_append(CASE WHEN NOT ov THEN buf WHEN has_ov THEN keep ELSE CAST([] AS VARCHAR[]) END, line) AS buf,
         CASE WHEN NOT ov THEN size WHEN has_ov THEN coalesce(list_sum(list_transform(keep, lambda x: length(x))), 0) + len(keep) - 1 ELSE 0 END
           + n + {add} AS size,
         {"CASE WHEN ov AND len(outs1) > 0 THEN outs1[-1].e + 1 ELSE " if respect_lines else "("}
           CASE WHEN NOT ov THEN first WHEN has_ov THEN last - len(tail) + 2 ELSE first END END AS first,
         outs1 AS outs
  FROM (SELECT *, CASE WHEN len(tail) > 1 THEN tail[2:] ELSE tail END AS keep FROM (
    SELECT *, ov AND {overlap} > 0 AND body <> '' AND length(body) > {overlap} AS has_ov,
           string_split(right(body, {overlap}), chr(10)) AS tail,
           CASE WHEN ov AND body <> '' THEN list_append(outs, {{'idx': len(outs), 'body': body, 's': first, 'e': last}}) ELSE outs END AS outs1
    FROM (SELECT *, {over} AS ov, {body} AS body, first + len(buf) - 1 AS last
          FROM (SELECT *, ls[i] AS line, length(ls[i]) AS n FROM st WHERE i <= len(ls)))))"""
    if not respect_lines:
        step = step.replace("(\n           CASE WHEN NOT ov THEN first WHEN has_ov THEN last - len(tail) + 2 ELSE first END END AS first",
                            "(CASE WHEN NOT ov THEN first WHEN has_ov THEN last - len(tail) + 2 ELSE first END) AS first")
    return f"""WITH RECURSIVE {LOG_LINES},
{LOG_FILES},
src AS (SELECT file_id, {split_lines_sql(clean('text'))} AS ls FROM log_files WHERE {clean('text')} <> ''),
st(file_id, ls, i, buf, size, first, outs) AS (
  SELECT file_id, ls, 1, CAST([] AS VARCHAR[]), 0, 0,
         CAST([] AS STRUCT(idx BIGINT, body VARCHAR, s BIGINT, e BIGINT)[]) FROM src
  UNION ALL
  {step}),
fin AS (
  SELECT file_id, CASE WHEN len(buf) > 0 AND {body} <> ''
                       THEN list_append(outs, {{'idx': len(outs), 'body': {body}, 's': first, 'e': first + len(buf) - 1}})
                       ELSE outs END AS outs
  FROM st WHERE i = len(ls) + 1),
ch AS (SELECT file_id, unnest(outs) AS c FROM fin)
SELECT file_id, c.idx AS chunk_index, c.s AS start_line, c.e AS end_line, substr(sha256(c.body), 1, 16) AS checksum,
       length(c.body) AS n_chars, sha256(c.body) AS digest FROM ch"""


_F1_ALL = chunk_fold_sql(rules.LOG_CHUNK_MAX, rules.LOG_CHUNK_OVERLAP, True)
SQL["f1_chunk_log_lines"] = _F1_ALL.replace(", sha256(c.body) AS digest FROM ch", " FROM ch")
SQL["f2_chunk_non_line_mode"] = chunk_fold_sql(300, 40, False).replace(
    ",\n       length(c.body) AS n_chars, sha256(c.body) AS digest FROM ch", " FROM ch")

_F1 = f"({SQL['f1_chunk_log_lines']})"

SQL["f9_dedup_chunks"] = f"""SELECT checksum, file_id, chunk_index FROM (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY file_id, chunk_index) AS rn FROM ({_F1_ALL}) c) WHERE rn = 1"""

SQL["f10_embedding_records"] = f"""SELECT file_id, chunk_index,
  'checksum=' || checksum || ';chunk_index=' || chunk_index || ';end_line=' || end_line || ';file_id=' || file_id
  || ';start_line=' || start_line AS meta FROM {_F1} c"""

SQL["h2_chunks_by_job"] = f"""SELECT file_id AS job_id, chunk_index,
  row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) AS pos FROM {_F1} c"""

SQL["h7_chunk_counts"] = f"""SELECT file_id AS incident_id, count(*) AS n_chunks FROM {_F1} c GROUP BY file_id"""


def _h9_sql() -> str:
    sev_txt = " || ';' || ".join(f"'{s}=' || coalesce(sev_{s}, 0)" for s in sorted(rules.SEVERITIES))
    return f"""{REL},
chunks AS (SELECT file_id AS incident_id FROM {_F1} c),
j AS (SELECT incident_id, count(*) AS total_jobs, count(*) FILTER (WHERE status = 'queued') AS pending_jobs,
             count(*) FILTER (WHERE status = 'running') AS running_jobs,
             count(*) FILTER (WHERE status = 'succeeded') AS completed_jobs,
             count(*) FILTER (WHERE status = 'failed') AS failed_jobs FROM jobs GROUP BY ROLLUP (incident_id)),
c AS (SELECT incident_id, count(*) AS total_chunks FROM chunks GROUP BY ROLLUP (incident_id)),
f AS (SELECT incident_id, count(*) AS total_findings,
             {', '.join(f"count(*) FILTER (WHERE severity = {lit(s)}) AS sev_{s}" for s in rules.SEVERITIES)}
      FROM findings_t GROUP BY ROLLUP (incident_id)),
fc0 AS (SELECT incident_id, category, count(*) AS n FROM findings_t GROUP BY incident_id, category
        UNION ALL SELECT NULL, category, count(*) FROM findings_t GROUP BY category),
fc AS (SELECT incident_id, string_agg(category || '=' || n, ';' ORDER BY category) AS by_category FROM fc0 GROUP BY incident_id),
k AS (SELECT coalesce(incident_id, -1) AS k, * FROM j),
kc AS (SELECT coalesce(incident_id, -1) AS k, * FROM c),
kf AS (SELECT coalesce(incident_id, -1) AS k, * FROM f),
kfc AS (SELECT coalesce(incident_id, -1) AS k, * FROM fc),
keys AS (SELECT k FROM k UNION SELECT k FROM kc UNION SELECT k FROM kf)
SELECT CASE WHEN keys.k = -1 THEN 'all' ELSE CAST(keys.k AS VARCHAR) END AS incident_id,
       coalesce(k.total_jobs, 0) AS total_jobs, coalesce(k.pending_jobs, 0) AS pending_jobs,
       coalesce(k.running_jobs, 0) AS running_jobs, coalesce(k.completed_jobs, 0) AS completed_jobs,
       coalesce(k.failed_jobs, 0) AS failed_jobs, coalesce(kc.total_chunks, 0) AS total_chunks,
       coalesce(kf.total_findings, 0) AS total_findings, {sev_txt} AS by_severity,
       coalesce(kfc.by_category, '') AS by_category
FROM keys LEFT JOIN k ON k.k = keys.k LEFT JOIN kc ON kc.k = keys.k LEFT JOIN kf ON kf.k = keys.k
LEFT JOIN kfc ON kfc.k = keys.k"""


SQL["h9_ingestion_stats"] = _h9_sql()


# ---------------------------------------------------------------------------
# F-4: the document fold as a recursive CTE over (unit | paragraph end) events
# ---------------------------------------------------------------------------
def doc_fold_sql(M: int = rules.DOC_CHUNK_MAX, O: int = rules.DOC_CHUNK_OVERLAP) -> str:
    step = M - O
    para_re = lit(chr(10) + WS_CLASS + "*" + chr(10))
    sent = f"string_split(regexp_replace({strip('p')}, {lit('([.!?])' + WS_CLASS + '+')}, '\\1' || chr(1), 'g'), chr(1))"
    parts = (f"list_transform(generate_series(0, CASE WHEN length(u) <= {M} THEN 0 "
             f"ELSE CAST(ceil((length(u) - {M}) / {float(step)}) AS BIGINT) END), "
             f"lambda k: {strip(f'substr(u, CAST(k * {step} + 1 AS BIGINT), {M})')})")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {normalize_sql('text')} AS t FROM documents),
ps AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, {para_re}), lambda x: {strip('x')}), lambda x: x <> '') AS ps
       FROM d WHERE t <> ''),
ev AS (SELECT doc_id, flatten(list_transform(ps, lambda p:
         list_append(list_transform(list_filter(list_transform({sent}, lambda x: {strip('x')}), lambda x: x <> ''),
                                    lambda x: {{'end': false, 'u': x}}),
                     {{'end': true, 'u': ''}}))) AS evs FROM ps),
st(doc_id, evs, i, cur, outs) AS (
  SELECT doc_id, evs, 1, '', CAST([] AS VARCHAR[]) FROM ev
  UNION ALL
  SELECT doc_id, evs, i + 1,
         CASE WHEN e.end THEN (CASE WHEN length(cur) > {M} THEN (CASE WHEN {O} > 0 THEN right(cur, {O}) ELSE '' END) ELSE cur END)
              WHEN length(u) > {M} THEN ''
              ELSE (CASE WHEN cur1 <> '' THEN {strip("cur1 || ' ' || u")} ELSE u END) END,
         CASE WHEN e.end THEN (CASE WHEN length(cur) > {M} THEN list_append(outs, {strip('cur')}) ELSE outs END)
              WHEN length(u) > {M} THEN list_concat(CASE WHEN cur <> '' THEN list_append(outs, {strip('cur')}) ELSE outs END, {parts})
              ELSE outs1 END
  FROM (SELECT *,
               CASE WHEN cur <> '' AND length(cur) + length(u) + 1 > {M} THEN list_append(outs, {strip('cur')}) ELSE outs END AS outs1,
               CASE WHEN cur <> '' AND length(cur) + length(u) + 1 > {M} THEN (CASE WHEN {O} > 0 THEN right(cur, {O}) ELSE '' END) ELSE cur END AS cur1
        FROM (SELECT *, evs[i] AS e, evs[i].u AS u FROM st WHERE i <= len(evs)))),
fin AS (SELECT doc_id, CASE WHEN cur <> '' THEN list_append(outs, {strip('cur')}) ELSE outs END AS outs FROM st WHERE i = len(evs) + 1),
chunks AS (SELECT doc_id, CAST(generate_subscripts(outs, 1) - 1 AS BIGINT) AS chunk_index, unnest(outs) AS text FROM fin)"""


DOC_CHUNKS = doc_fold_sql()

SQL["f4_chunk_documents"] = DOC_CHUNKS + """
SELECT doc_id, chunk_index, substr(sha256(text), 1, 16) AS checksum, length(text) AS n_chars FROM chunks"""

_CID = """,
cid AS (SELECT c.doc_id, c.chunk_index, c.text,
               substr(sha256(d.source), 1, 12) || '-' || c.chunk_index || '-' || substr(sha256(c.text), 1, 16) AS chunk_id,
               count(*) OVER (PARTITION BY c.doc_id) AS chunk_total
        FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)"""

SQL["f7_chunk_ids"] = DOC_CHUNKS + _CID + """
SELECT doc_id, chunk_index, chunk_id, chunk_total FROM cid"""

SQL["a8_upsert_doc_chunks"] = DOC_CHUNKS + _CID + """,
idx AS (SELECT c.* FROM cid c JOIN documents d ON d.doc_id = c.doc_id WHERE d.lang = 'en'),
fresh AS (SELECT * FROM cid WHERE chunk_id NOT IN (SELECT chunk_id FROM idx)),
merged AS (SELECT doc_id FROM idx UNION ALL SELECT doc_id FROM fresh)
SELECT doc_id, count(*) AS n_chunks FROM merged GROUP BY doc_id"""

SQL["g4_index_stats"] = DOC_CHUNKS + """
SELECT count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)"""

# A-1 / A-7 over uploads: a hundred logs of a kind in one file
UPLOADS = """log_files AS (
  SELECT file_id % 9 + 9 * (file_id // 900) AS file_id, string_agg(line, chr(10) ORDER BY file_id, line_no) AS text
  FROM log_lines GROUP BY 1)"""


def of_uploads(sql: str) -> str:
    return sql.replace(LOG_FILES, UPLOADS)


SQL["a1_block_sources"] = of_uploads(SQL["c5_resolve_source"])
SQL["a1_block_findings"] = of_uploads(SQL["e7_detect_findings"])

SQL["a7_write_ingest"] = of_uploads(PIPELINE_FINDINGS + f"""
SELECT 'jobs' AS "table", count(*) AS n, count(*) AS n_keyed FROM log_files
UNION ALL SELECT 'chunks', (SELECT count(*) FROM {_F1} c), (SELECT count(*) FROM {_F1} c)
UNION ALL SELECT 'findings', count(*), count(*) FROM findings""")

SQL["a8_chunk_index"] = DOC_CHUNKS + _CID + """
SELECT chunk_id, min(c.doc_id) AS doc_id, min(chunk_index) AS chunk_index, CASE WHEN bool_or(d.lang = 'en') THEN 'english' ELSE 'all' END AS ingest,
       min(sha256(c.text)) AS digest
FROM cid c JOIN documents d ON d.doc_id = c.doc_id GROUP BY chunk_id"""

SQL["a2_document_source"] = """SELECT doc_id, CASE lang WHEN 'en' THEN '/docs/' || doc_id || '.md' WHEN 'de' THEN doc_id || '.md'
  WHEN 'es' THEN 'in-memory' ELSE coalesce(source, 'in-memory') END AS label FROM documents"""

SQL["g5_rag_query"] = """SELECT doc_id, CASE lang WHEN 'en' THEN coalesce(nullif(substr(text, 1, 40), ''), 'document ' || doc_id)
  WHEN 'de' THEN coalesce(nullif(source, ''), 'document ' || doc_id) WHEN 'es' THEN NULL ELSE 'document ' || doc_id END AS q FROM documents"""


# ---------------------------------------------------------------------------
# Outputs of the pipeline in batch (J-16) and from a stream (S-1, S-2, S-4)
# ---------------------------------------------------------------------------
for _name in ("j16_pipeline_entries", "s1_stream_entries"):
    SQL[_name] = SQL["parse_logs"]
for _name in ("j16_pipeline_chunks", "s1_stream_chunks"):
    SQL[_name] = SQL["f1_chunk_log_lines"]
for _name in ("j16_pipeline_findings", "s1_stream_findings"):
    SQL[_name] = SQL["e7_detect_findings"]

SQL["j16_pipeline_batches"] = f"""SELECT p.file_id, p.parser_source, c.total_lines, c.parsed_lines, c.failed_lines, k.* EXCLUDE (file_id)
FROM ({SQL["c5_resolve_source"]}) p JOIN ({SQL["batch_counts"]}) c ON c.file_id = p.file_id
JOIN ({SQL["k8s_batch_flags"]}) k ON k.file_id = p.file_id"""

SQL["s2_stream_window_counts"] = f"""WITH {LOG_LINES},
h AS ({" UNION ALL ".join(f"SELECT ts, {lit(r.category)} AS category, {lit(r.severity)} AS severity FROM log_lines WHERE regexp_matches(line, {rx(r.pattern)})"
                          for r in rules.DETECTION_RULES)}),
w AS (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM h)
SELECT {ts_out("s")} AS window_start, {ts_out("s + INTERVAL 2 DAY")} AS window_end, category, severity, count(*) AS n
FROM w GROUP BY s, category, severity"""

SQL["s4_stream_dedup_chunks"] = f"SELECT DISTINCT checksum FROM {_F1} c"


def _py_quoted_sql(x: str) -> str:
    q, d = "chr(39)", "chr(34)"
    shown = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't')"
    return (f"CASE WHEN contains({shown}, {q}) AND NOT contains({shown}, {d}) THEN {d} || {shown} || {d} "
            f"ELSE {q} || replace({shown}, {q}, chr(92) || {q}) || {q} END")


SQL["j2_payload_text"] = f"""{FILES},
l AS (SELECT file_id, {split_lines_sql('text')} AS ls FROM log_files)
SELECT file_id,
  array_to_string(list_filter(list_concat([ls[1]], ls[1:2], [CAST(len(ls) AS VARCHAR), ls[-1], CAST(file_id AS VARCHAR), 'alert ' || file_id, 'True']),
                              lambda x: x <> ''), chr(10)) AS text,
  ls[1] || chr(10) || '{{' || chr(39) || 'head' || chr(39) || ': [' || array_to_string(list_transform(ls[1:2], lambda x: {_py_quoted_sql('x')}), ', ')
    || '], ' || chr(39) || 'n' || chr(39) || ': ' || len(ls) || '}}' || chr(10) || '[[' || {_py_quoted_sql('ls[-1]')} || ']]' AS router_text
FROM l"""

SQL["d11_parse_cloudwatch_export"] = f"""WITH {LOG_LINES},
ln AS (SELECT file_id, 'cloudwatch' AS source, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS INTEGER) AS line_no, line
       FROM log_lines WHERE file_id % 9 = 7 AND line LIKE '{{%'),
entries AS (SELECT file_id, line_no, source, {parse_select_sql()} FROM ln)
SELECT file_id, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, level, message, source, meta, raw FROM entries"""
