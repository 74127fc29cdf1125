"""Log parsing (D-1 ... D-15) as column expressions over a line table.

Input: ``log_files(file_id, text, source)``.  ``explode_lines`` turns it
into one row per non-blank stripped line (narrow, no shuffle); every
source's parser is a set of ``regexp_extract`` / ``from_json`` /
``try_make_timestamp_ntz`` expressions, and ``parse_lines`` picks the
file's parser with a ``CASE`` on the source so only one parser runs per
line.  Timestamps are ``timestamp_ntz`` holding UTC wall time (an offset in
the text is applied; a naive stamp is taken as UTC).

Output ``log_entries(file_id, line_no, ts, level, message, source,
metadata map<string,string>, raw)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import py_strip, split_lines
from . import detect


# FIXED VALUES: regexes of the line formats (Python named groups -> numbered).
ISO_PREFIX = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s+"
GHA_TS_PREFIX = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\s+"
K8S_JSON = r'^\s*\{.*"log":'
NGINX_ACCESS = (r'^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s+-\s+(\S+)\s+'
                r'\[([^\]]+)\]\s+'
                r'"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s+HTTP/([^"]+)"\s+'
                r'(\d{3})\s+(\d+|-)\s*'
                r'(?:"([^"]*)"\s+"([^"]*)")?')
NGINX_ERROR = (r'^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+'
               r'\[([^\]]+)\]\s+'
               r'(\d+)#(\d+):\s+'
               r'(.+)$')
APACHE_ACCESS = (r'^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s+\S+\s+(\S+)\s+'
                 r'\[([^\]]+)\]\s+'
                 r'"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)\s+HTTP/([^"]+)"\s+'
                 r'(\d{3})\s+(\d+|-)\s*'
                 r'(?:"([^"]*)"\s+"([^"]*)")?')
APACHE_ERROR = (r'^\[([^\]]+)\]\s+'
                r'\[([^\]]+)\]\s+'
                r'\[([^\]]+)\]\s+'
                r'(.+)$')
JENKINS_TS = r'^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+[+-]\d{4})\s+'
JENKINS_STAGE = r'\[Pipeline\]\s+(.+)$'
GHA_ANNOTATION = r'^(error|warning|notice)::([^:]*):(.*)$'
TERRAFORM_LEVEL = r'^\[(TRACE|DEBUG|WARN|ERROR)\]\s+'
GENERIC_TS = [
    r'^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s+',
    r'^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+',
    r'^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+',
]
# FIXED VALUES: English month abbreviations (strptime %b).
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _s(p: str) -> str:
    """Case-sensitive pattern, `.` stops only at \\n (Python default)."""
    return "(?d)" + p


def _i(p: str) -> str:
    return "(?id)" + p


def _rx(c: Column, p: str, g: int) -> Column:
    return F.regexp_extract(c, p, g)


def _nz(c: Column) -> Column:
    """'' (no match) -> null."""
    return F.when(c != F.lit(""), c)


def _map(*kv) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


# ---------------------------------------------------------------------------
# Timestamp helpers (all -> timestamp_ntz in UTC, null when invalid)
# ---------------------------------------------------------------------------
def _ts_from_parts(y, mo, d, h, mi, s, frac: Column | None = None, off_min: Column | None = None) -> Column:
    sec = s.cast("decimal(10,6)")
    if frac is not None:
        f6 = F.rpad(F.substring(frac, 1, 6), 6, "0")
        sec = sec + F.when(frac != "", f6.cast("int").cast("decimal(16,6)") / F.lit(1000000)).otherwise(F.lit(0))
    ts = F.try_make_timestamp_ntz(y.cast("int"), mo.cast("int"), d.cast("int"), h.cast("int"),
                                  mi.cast("int"), sec.cast("decimal(16,6)"))
    ts = F.when(s.cast("int") < 60, ts)  # Python rejects second 60/61
    if off_min is not None:
        ts = ts - F.make_dt_interval(F.lit(0), F.lit(0), off_min, F.lit(0))
    return ts


def _offset_minutes(z: Column) -> Column:
    """'' / 'Z' -> 0; '+HH', '+HHMM', '+HH:MM' -> signed minutes."""
    digits = F.regexp_replace(z, "[^0-9]", "")
    hh = F.substring(digits, 1, 2).cast("int")
    mm = F.coalesce(F.try_to_number(F.nullif(F.substring(digits, 3, 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    sign = F.when(F.substring(z, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.when((z == "") | (z == "Z"), F.lit(0)).otherwise(sign * (hh * 60 + mm))


ISO_FULL = (r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
            r"(Z|[+-]\d{2}(?::?\d{2})?)?$")


def iso_ts(s: Column) -> Column:
    """``datetime.fromisoformat(s.replace("Z", "+00:00"))`` for ``YYYY-MM-DDTHH:MM:SS[.f][zone]``."""
    ok = s.rlike(ISO_FULL)
    parts = [_rx(s, ISO_FULL, i) for i in range(1, 9)]
    ts = _ts_from_parts(*parts[:6], frac=parts[6], off_min=_offset_minutes(parts[7]))
    return F.when(ok, ts)


def level_of(msg: Column, fold_warning: bool = True) -> Column:
    g = F.upper(_nz(_rx(msg, _i(rules.LEVEL_WORDS), 1)))
    if fold_warning:
        return F.when(g == "WARNING", F.lit("WARN")).otherwise(g)
    return g


def _entry(ts, level, message, metadata, raw) -> Column:
    return F.struct(ts.cast("timestamp_ntz").alias("ts"), level.cast("string").alias("level"),
                    message.cast("string").alias("message"),
                    metadata.cast("map<string,string>").alias("metadata"), raw.cast("string").alias("raw"))


def _json_map(line: Column) -> Column:
    return F.from_json(line, "map<string,string>")


def _get(j: Column, k: str) -> Column:
    return F.when(F.map_contains_key(j, F.lit(k)), j[k])


def _without(j: Column, keys: list[str]) -> Column:
    return F.map_filter(j, lambda k, v: ~k.isin(*keys))


# ---------------------------------------------------------------------------
# Parts of the parsers
# ---------------------------------------------------------------------------
def _severity(word: Column, mapping: dict[str, str]) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*items), F.lower(word)), F.lit("INFO"))


def _params_map(params: Column) -> Column:
    """``k=v`` pairs split on ",", both sides stripped; a later key wins."""
    pairs = F.filter(F.split(params, ",", -1), lambda p: p.contains("="))
    kv = F.transform(pairs, lambda p: F.struct(py_strip(F.substring_index(p, "=", 1)).alias("k"),
                                               py_strip(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    last = F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.greatest(F.size(kv), F.lit(1))),
                                                lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def _py_json_dumps(obj: Column) -> Column:
    """``json.dumps`` spacing (", " and ": ") for a flat JSON object, key order kept."""
    typed = F.from_json(obj, "map<string,variant>")
    parts = F.transform(F.map_entries(typed), lambda e: F.concat(
        F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6),
        F.lit(": "), F.to_json(e["value"])))
    return _ascii_json(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")))


def _ascii_json(text: Column) -> Column:
    """Characters beyond ASCII as ``\\uXXXX`` of their UTF-16 units, as ``json.dumps`` writes them."""
    def unit(c):
        return F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1")
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    escaped = F.array_join(F.transform(runs, lambda c: F.when(c.rlike(r"^[\x00-\x7F]"), c).otherwise(unit(c))), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)


# ---------------------------------------------------------------------------
# Staged parser: each regex runs once per line
# ---------------------------------------------------------------------------
SEP = "\u0001\u0002"
SEP_CHARS = SEP


def groups(c: Column, pattern: str, n: int, flags: str = "(?d)") -> Column:
    """All ``n`` capture groups of the first (anchored) match in ONE regex pass, or null.

    The whole string is replaced by ``<SEP>$1<SEP>$2...`` and split; the
    leading separator marks a match (an unmatched string comes back
    unchanged).  A group that did not take part comes back as "".
    """
    full = flags + "(?:" + pattern + ")(?s:.*)"
    rep = "".join(SEP + f"${i}" for i in range(1, n + 1))
    out = F.regexp_replace(c, full, rep)
    return F.when(F.startswith(out, F.lit(SEP_CHARS)), F.slice(F.split(out, SEP, -1), 2, n))


ISO_P = ISO_FULL
CLF_P = r"^(\d{1,2})/([A-Za-z]{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})\s+([+-]\d{2}:?\d{2})$"
YMD_P = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
NGX_TS_P = r"^(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
JEN_TS_P = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,6})\s+([+-]\d{4})$"
ISOZ_P = r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})()(Z|[+-]\d{2}:?\d{2})$"
NAIVE_P = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})$"
SYSLOG_P = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def _ts_groups(kind: Column, s: Column) -> Column:
    """Normalise any supported stamp to [y, mo, d, h, mi, s, frac, zone] strings."""
    def pad(arr, lead=None, tail=0):
        items = ([lead] if lead is not None else []) + [arr[i] for i in range(0, 8 - tail - (1 if lead is not None else 0))]
        return F.array(*items, *[F.lit("") for _ in range(tail)])
    clf = groups(s, CLF_P, 7)
    syslog = groups(s, SYSLOG_P, 5)
    return (F.when(kind == "iso", groups(s, ISO_P, 8))
            .when(kind == "clf", F.when(clf.isNotNull(), F.array(clf[2], clf[1], clf[0], clf[3], clf[4], clf[5], F.lit(""), clf[6])))
            .when(kind == "ymd", F.concat(groups(s, YMD_P, 6), F.array(F.lit(""), F.lit(""))))
            .when(kind == "ngx", F.concat(groups(s, NGX_TS_P, 6), F.array(F.lit(""), F.lit(""))))
            .when(kind == "jenkins", groups(s, JEN_TS_P, 8))
            .when(kind == "isoz", groups(s, ISOZ_P, 8))
            .when(kind == "naive", F.concat(groups(s, NAIVE_P, 6), F.array(F.lit(""), F.lit(""))))
            .when(kind == "syslog", F.when(syslog.isNotNull(), F.array(F.lit("1900"), syslog[0], syslog[1], syslog[2], syslog[3], syslog[4], F.lit(""), F.lit("")))))


def _ts_from_groups(g: Column) -> Column:
    mon_txt = g[1]
    mon = F.coalesce(F.try_to_number(F.when(mon_txt.rlike(r"^\d+$"), mon_txt), F.lit("99")).cast("int"),
                     F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(mon_txt)).cast("int"))
    ts = _ts_from_parts(g[0], F.when(mon > 0, mon), g[2], g[3], g[4], g[5], frac=g[6],
                        off_min=_offset_minutes(g[7]))
    return F.when(g.isNotNull(), ts)


def parse_lines(lines: DataFrame, line_col: str = "line", source_col: str = "source") -> DataFrame:
    """Parse every line with its source's parser; adds ts, level, message, metadata, raw."""
    l = F.col(line_col)
    src = F.col(source_col)
    keep = [c for c in lines.columns]
    k8s_json = (src == "kubernetes") & l.rlike(_s(K8S_JSON))
    jd = F.startswith(l, F.lit("{"))
    json_branch = k8s_json | (src.isin("docker", "cloudwatch") & jd)
    # stage 1: one pass per pattern
    s1 = lines.select(
        *keep,
        json_branch.alias("_jb"),
        F.when(json_branch, _json_map(l)).alias("_j"),
        F.when(src.isin("kubernetes", "docker", "generic") & ~json_branch,
               groups(l, ISO_PREFIX, 1)[0]).alias("_iso"),
        F.when(src == "nginx", groups(l, NGINX_ACCESS, 8)).when(src == "apache", groups(l, APACHE_ACCESS, 8)).alias("_acc"),
        F.when(src == "nginx", groups(l, NGINX_ERROR, 5)).when(src == "apache", groups(l, APACHE_ERROR, 4)).alias("_err"),
        F.when(src == "jenkins", groups(l, JENKINS_TS, 1)[0]).alias("_jpre"),
        F.when(src == "jenkins", _nz(_rx(l, _i(JENKINS_STAGE), 1))).alias("_stage"),
        F.when(src == "github_actions", groups(l, GHA_ANNOTATION, 3, "(?id)")).alias("_ann"),
        F.when(src == "terraform", groups(l, TERRAFORM_LEVEL, 1, "(?id)")[0]).alias("_tfl"),
        F.when(src == "cloudwatch", F.split(l, "\t", -1)).alias("_tab"),
        F.when(~src.isin("kubernetes", "docker", "nginx", "apache", "jenkins", "github_actions", "terraform", "cloudwatch"),
               F.array(*[groups(l, p, 1)[0] for p in GENERIC_TS])).alias("_gen"),
    )
    # stage 2: message before the stamp cut, and which stamp to parse
    j = F.col("_j")
    jok = F.col("_jb") & j.isNotNull()
    acc, err, ann, tab, gen = F.col("_acc"), F.col("_err"), F.col("_ann"), F.col("_tab"), F.col("_gen")
    tfl = F.col("_tfl")
    gha_msg0 = F.when(ann.isNotNull(), ann[2]).otherwise(l)
    tf_msg0 = F.when(tfl.isNotNull(), F.regexp_replace(l, _i(TERRAFORM_LEVEL), "")).otherwise(l)
    cw_json = (src == "cloudwatch") & jok
    cw_tab = (src == "cloudwatch") & ~cw_json & (F.size(tab) >= 2)
    gen_idx = F.when(gen[0].isNotNull(), 0).when(gen[1].isNotNull(), 1).when(gen[2].isNotNull(), 2)
    ts_src = (F.when(src.isin("kubernetes", "docker") & F.col("_jb"), F.when(jok, _get(j, "time")))
              .when(src.isin("kubernetes", "docker"), F.col("_iso"))
              .when(src.isin("nginx", "apache"), F.when(acc.isNotNull(), acc[2]).when((src == "nginx") & err.isNotNull(), err[0]))
              .when(src == "jenkins", F.col("_jpre"))
              .when(src == "github_actions", groups(gha_msg0, GHA_TS_PREFIX, 1)[0])
              .when(src == "terraform", groups(tf_msg0, ISO_PREFIX, 1)[0])
              .when(cw_json, _get(j, "@timestamp"))
              .when(cw_tab, tab[0])
              .when(gen_idx == 0, gen[0]).when(gen_idx == 1, gen[1]).when(gen_idx == 2, gen[2]))
    ts_kind = (F.when(src.isin("kubernetes", "docker", "terraform"), F.lit("iso"))
               .when(src.isin("nginx", "apache"), F.when(acc.isNotNull(), F.lit("clf")).otherwise(F.lit("ngx")))
               .when(src == "jenkins", F.lit("jenkins"))
               .when(src == "github_actions", F.lit("naive"))
               .when(src == "cloudwatch", F.lit("iso"))
               .when(gen_idx == 0, F.lit("isoz")).when(gen_idx == 1, F.lit("ymd")).when(gen_idx == 2, F.lit("syslog")))
    s2 = s1.select("*", gha_msg0.alias("_gm0"), tf_msg0.alias("_tm0"), ts_src.alias("_tss"), ts_kind.alias("_tsk"),
                   cw_json.alias("_cwj"), cw_tab.alias("_cwt"), gen_idx.alias("_gi"))
    # stage 3: stamp groups (one regex pass), epoch-ms json stamps
    line_raw = F.col(line_col)
    cw_num = F.col("_cwj") & line_raw.rlike(r'"@timestamp"\s*:\s*-?[0-9]')
    s3 = s2.select("*", F.when(F.col("_tss").isNotNull() & ~cw_num, _ts_groups(F.col("_tsk"), F.col("_tss"))).alias("_tg"),
                   cw_num.alias("_cwn"))
    # stage 4: fields
    ts = F.when(F.col("_cwn"), _epoch_ms_ts(_get(j, "@timestamp"))).otherwise(_ts_from_groups(F.col("_tg")))
    s4 = s3.select("*", ts.alias("_ts"))
    tsc = F.col("_ts")
    jmsg = F.when(F.map_contains_key(j, F.lit("log")), j["log"]).when(
        F.map_contains_key(j, F.lit("message")), j["message"]).otherwise(l)
    iso_cut = F.when(tsc.isNotNull(), F.regexp_replace(l, _s(ISO_PREFIX), "")).otherwise(l)
    acc_status = acc[6].cast("int")
    acc_msg = F.concat(acc[3], F.lit(" "), acc[4], F.lit(" - "), acc_status.cast("string"))
    cw_msg = F.coalesce(_get(j, "message"), _get(j, "@message"), F.lit(""))
    gi = F.col("_gi")
    gen_msg = (F.when(gi == 0, F.regexp_replace(l, _s(GENERIC_TS[0]), ""))
               .when(gi == 1, F.regexp_replace(l, _s(GENERIC_TS[1]), ""))
               .when(gi == 2, F.regexp_replace(l, _s(GENERIC_TS[2]), ""))
               .otherwise(l))
    message = (F.when(src.isin("kubernetes", "docker") & F.col("_jb"), F.when(jok, jmsg).otherwise(l))
               .when(src.isin("kubernetes", "docker"), iso_cut)
               .when(src.isin("nginx", "apache"), F.when(acc.isNotNull(), acc_msg)
                     .when(err.isNotNull(), F.when(src == "nginx", err[4]).otherwise(err[3])).otherwise(l))
               .when(src == "jenkins", F.when(tsc.isNotNull(), F.regexp_replace(l, _s(JENKINS_TS), "")).otherwise(l))
               .when(src == "github_actions", F.when(tsc.isNotNull(), F.regexp_replace(F.col("_gm0"), _s(GHA_TS_PREFIX), "")).otherwise(F.col("_gm0")))
               .when(src == "terraform", F.when(tsc.isNotNull(), F.regexp_replace(F.col("_tm0"), _s(ISO_PREFIX), "")).otherwise(F.col("_tm0")))
               .when(F.col("_cwj"), cw_msg)
               .when(F.col("_cwt"), tab[1])
               .when(src == "cloudwatch", l)
               .otherwise(gen_msg))
    s5 = s4.select("*", message.alias("_msg"))
    msg = F.col("_msg")
    items = []
    for k, v in rules.JENKINS_LEVELS.items():
        items += [F.lit(k), F.lit(v)]
    jword = _nz(_rx(msg, _i(rules.JENKINS_LEVEL_WORDS), 1))
    gtyp = F.lower(ann[0])
    level = (F.when(src.isin("kubernetes", "docker") & F.col("_jb"),
                    F.when(jok, F.when(F.map_contains_key(j, F.lit("stream")), j["stream"])
                           .when((src == "kubernetes") & F.map_contains_key(j, F.lit("level")), j["level"])))
             .when(src == "kubernetes", level_of(msg, True))
             .when(src == "docker", level_of(msg, False))
             .when(src.isin("nginx", "apache"), F.when(acc.isNotNull(), F.when(acc_status >= 400, F.lit("ERROR")).otherwise(F.lit("INFO")))
                   .when(err.isNotNull(), F.when(src == "nginx", _severity(err[1], rules.NGINX_ERROR_LEVELS))
                         .otherwise(_severity(err[2], rules.APACHE_ERROR_LEVELS))))
             .when(src == "jenkins", F.when(jword.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*items), jword), F.lit("INFO"))))
             .when(src == "github_actions", F.when(ann.isNotNull(), F.when(gtyp == "notice", F.lit("INFO")).otherwise(F.upper(gtyp))))
             .when(src == "terraform", F.upper(tfl))
             .when(F.col("_cwj"), level_of(msg, True))
             .when(src == "cloudwatch", F.lit(None))
             .otherwise(level_of(msg, True)))
    acc_kv = ["ip", acc[0], "status", acc_status.cast("string"), "method", acc[3], "path", acc[4]]
    metadata = (F.when(src == "kubernetes", F.when(jok, _without(j, ["log", "message", "stream", "time"])))
                .when(src == "nginx", F.when(acc.isNotNull(), _map(*acc_kv, "size", F.when(acc[7] != "-", acc[7].cast("decimal(38,0)").cast("string"))))
                      .when(err.isNotNull(), _map("pid", err[2], "tid", err[3], "nginx_level", err[1])))
                .when(src == "apache", F.when(acc.isNotNull(), _map(*acc_kv))
                      .when(err.isNotNull(), _map("module", err[1], "apache_level", err[2])))
                .when(src == "jenkins", F.when(F.col("_stage").isNotNull(), _map("pipeline_action", F.col("_stage"))))
                .when(src == "github_actions", F.when(ann.isNotNull(), _params_map(ann[1])))
                .when(F.col("_cwj"), _without(j, ["@timestamp", "message", "@message"]))
                .when(F.col("_cwt") & (F.size(tab) > 2), _map("log_stream", tab[2])))
    raw = F.when(F.col("_cwj"), F.when(F.coalesce(_get(j, "message"), F.lit("")) != "", _py_json_dumps(l)).otherwise(F.lit(""))).otherwise(l)
    return s5.select(*keep, tsc.alias("ts"), level.cast("string").alias("level"), msg.alias("message"),
                     F.coalesce(metadata.cast("map<string,string>"), _empty_map()).alias("metadata"),
                     raw.alias("raw"))


def _epoch_ms_ts(v: Column) -> Column:
    micros = F.round(F.try_multiply(v.cast("double"), F.lit(1000.0))).cast("long")
    return F.try_add(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                     F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(20,0)") / F.lit(1000000)))


# ---------------------------------------------------------------------------
# Table-level operators
# ---------------------------------------------------------------------------
def explode_lines(files: DataFrame, text_col: str = "text", key: str = "file_id") -> DataFrame:
    """B-1: ``(key, line_no, line)`` for every non-blank stripped line.

    ``line_no`` is the 0-based index in ``splitlines()`` (blank lines count).
    """
    others = [c for c in files.columns if c != text_col]
    return (files.select(*others, F.posexplode(split_lines(F.col(text_col))).alias("line_no", "_l"))
            .select(*others, "line_no", py_strip(F.col("_l")).alias("line"))
            .where(F.col("line") != ""))


def with_parser_source(files: DataFrame, text_col: str = "text", forced_col: str | None = None) -> DataFrame:
    """C-1 / C-6: the parser chosen for each file."""
    src = detect.detect_source(F.col(text_col))
    if forced_col is not None:
        src = detect.forced_source(F.col(forced_col), src)
    return files.withColumn("source", src)


def is_cloudwatch_export(source: Column, text: Column) -> Column:
    """D-11: a CloudWatch text that is one JSON array."""
    return (source == "cloudwatch") & F.from_json(text, "array<string>").isNotNull()


def entry_lines(files: DataFrame, text_col: str = "text", key: str = "file_id", source_col: str = "source") -> DataFrame:
    """One row per line to parse: non-blank lines, or the object items of a CloudWatch export.

    Both come from one ``posexplode`` of one array, so the text is scanned once.
    """
    text, source = F.col(text_col), F.col(source_col)
    export = is_cloudwatch_export(source, text)
    items = F.when(export, F.from_json(text, "array<string>")).otherwise(split_lines(text))
    lines = (files.select(key, source.alias("source"), export.alias("_export"), F.posexplode(items).alias("line_no", "_l"))
             .select(key, "line_no", "source", "_export", py_strip(F.col("_l")).alias("line")).where(F.col("line") != ""))
    is_object = F.startswith("line", F.lit("{")) & F.from_json("line", "map<string,string>").isNotNull()
    return lines.where(~F.col("_export") | is_object).drop("_export")


def parse_entries(files: DataFrame, text_col: str = "text", key: str = "file_id", source_col: str = "source") -> DataFrame:
    """D-1 ... D-13 for texts whose parser source is known."""
    return parse_lines(entry_lines(files, text_col, key, source_col)).select(
        key, "line_no", "ts", "level", "message", "source", "metadata", "raw")


def parse_logs(files: DataFrame, text_col: str = "text", key: str = "file_id",
               forced_col: str | None = None) -> DataFrame:
    """D-14: detect each file's source (or take the forced one) and parse every line.

    CloudWatch texts that are one JSON array give an entry per object item (D-11), all others
    one per line.  Narrow plan over one scan: no shuffle.
    """
    srcd = with_parser_source(files.select(key, text_col, *([forced_col] if forced_col else [])),
                              text_col, forced_col)
    return parse_entries(srcd, text_col, key)


def batch_columns(text_col: str = "text") -> list[Column]:
    """D-15 columns: total lines (blank included), parsed (non-blank) and failed lines of a text."""
    lines = F.transform(split_lines(F.col(text_col)), lambda x: py_strip(x))
    return [F.size(lines).alias("total_lines"), F.size(F.filter(lines, lambda x: x != "")).alias("parsed_lines"),
            F.lit(0).alias("failed_lines")]


def batch_counts(files: DataFrame, text_col: str = "text", key: str = "file_id") -> DataFrame:
    """D-15: line counts per file."""
    return files.select(key, *batch_columns(text_col))


def k8s_flag_columns(text_col: str = "text") -> list[Column]:
    """D-2 columns: the five Kubernetes flags of a whole text."""
    return [F.col(text_col).rlike(_i(p)).alias(n) for n, p in rules.K8S_FLAGS]


def k8s_batch_flags(files: DataFrame, text_col: str = "text", key: str = "file_id") -> DataFrame:
    """D-2: the five Kubernetes flags over each whole text."""
    return files.select(key, *k8s_flag_columns(text_col))


def metadata_text(m: Column) -> Column:
    """Flatten a metadata map to ``k=v;k=v`` sorted by key (null values as ``k=``)."""
    ents = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(ents, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
