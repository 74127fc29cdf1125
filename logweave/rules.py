"""Fixed values that must equal the behaviour being rebuilt.

Everything in this module is data: rule names, severities, titles, regex
patterns and keyword lists.  They are stated plainly, in their natural
order, because results depend on them verbatim.  All regex patterns are
matched case-insensitively unless noted; the helpers below add the flags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES: the nine log sources, in detection order (generic is last).
# ---------------------------------------------------------------------------
SOURCES = [
    "kubernetes",
    "docker",
    "nginx",
    "apache",
    "jenkins",
    "github_actions",
    "terraform",
    "cloudwatch",
    "generic",
]


@dataclass(frozen=True)
class DetectionRule:
    rule_no: int
    category: str
    severity: str
    title: str
    pattern: str
    sources: tuple[str, ...] | None  # None = applies to every source


# ---------------------------------------------------------------------------
# FIXED VALUES: the twenty finding rules, in evaluation order.
# Evidence window: 120 chars before a match, 200 after.
# ---------------------------------------------------------------------------
EVIDENCE_BEFORE = 120
EVIDENCE_AFTER = 200

DETECTION_RULES: list[DetectionRule] = [
    DetectionRule(1, "CrashLoopBackOff", "high",
                  "CrashLoopBackOff detected - Container is repeatedly crashing",
                  r"CrashLoopBackOff|Back-off restarting failed container",
                  ("kubernetes", "generic")),
    DetectionRule(2, "OOMKilled", "high",
                  "OOMKilled - Container terminated due to out-of-memory",
                  r"OOMKilled|Out of memory|Killed process \d+|killed process|memory cgroup out of memory",
                  None),
    DetectionRule(3, "ProbeFailure", "medium",
                  "Kubernetes probe failure detected",
                  r"readiness probe failed|liveness probe failed|startup probe failed",
                  ("kubernetes", "generic")),
    DetectionRule(4, "ImagePullError", "medium",
                  "Container image pull error",
                  r"ImagePullBackOff|ErrImagePull|image not found|manifest unknown|unauthorized",
                  ("kubernetes", "docker", "generic")),
    DetectionRule(5, "DNSFailure", "medium",
                  "DNS resolution failure detected",
                  r"Temporary failure in name resolution|no such host|NXDOMAIN|SERVFAIL|getaddrinfo failed|DNS.*failed",
                  None),
    DetectionRule(6, "ConnectionTimeout", "medium",
                  "Connection timeout detected",
                  r"timed out|ETIMEDOUT|context deadline exceeded|Read timed out|connection timed out|dial timeout|connection reset by peer",
                  None),
    DetectionRule(7, "ConnectionRefused", "medium",
                  "Connection refused detected",
                  r"connection refused|ECONNREFUSED|can't connect|unable to connect",
                  None),
    DetectionRule(8, "SSLFailure", "medium",
                  "SSL/TLS failure detected",
                  r"SSL routines|certificate verify failed|x509: certificate|handshake failure|TLS handshake|certificate expired|CERT_",
                  None),
    DetectionRule(9, "MemoryLeak", "low",
                  "Potential memory leak symptoms detected",
                  r"memory leak|heap size|GC overhead limit exceeded|OutOfMemoryError|java\.lang\.OutOfMemoryError|cannot allocate memory",
                  None),
    DetectionRule(10, "CPUSpike", "low",
                  "Potential CPU spike symptoms detected",
                  r"cpu throttling|load average|CPU\s+usage\s+\d{2,}%|high cpu|cpu.*spike",
                  None),
    DetectionRule(11, "DiskSpace", "medium",
                  "Disk space issue detected",
                  r"no space left on device|ENOSPC|disk full|filesystem full|quota exceeded",
                  None),
    DetectionRule(12, "BuildFailure", "high",
                  "Build failure detected",
                  r"BUILD FAILED|Build step .* marked build as failure|##\[error\]|Process completed with exit code|FAILED!|error TS\d+|error CS\d+",
                  ("jenkins", "github_actions", "generic")),
    DetectionRule(13, "TestFailure", "medium",
                  "Test failure detected",
                  r"FAILED|tests? failed|AssertionError|assert.*false|expect.*received|Test.*FAILED",
                  ("jenkins", "github_actions", "generic")),
    DetectionRule(14, "TerraformError", "high",
                  "Terraform error detected",
                  r"Error:|terraform.*error|resource.*not found|Invalid.*configuration",
                  ("terraform", "generic")),
    DetectionRule(15, "TerraformPlanChange", "low",
                  "Terraform plan shows infrastructure changes",
                  r"Plan: \d+ to add|\d+ to change|\d+ to destroy",
                  ("terraform", "generic")),
    DetectionRule(16, "HTTPError5xx", "high",
                  "HTTP 5xx server error detected",
                  r'" (5\d{2}) ',
                  ("nginx", "apache", "generic")),
    DetectionRule(17, "HTTPError4xx", "low",
                  "HTTP 4xx client error detected",
                  r'" (4\d{2}) ',
                  ("nginx", "apache", "generic")),
    DetectionRule(18, "PanicError", "critical",
                  "Application panic detected",
                  r"panic:|fatal error:|runtime error:|uncaught exception",
                  None),
    DetectionRule(19, "SegfaultError", "critical",
                  "Segmentation fault detected",
                  r"segmentation fault|SIGSEGV|core dumped",
                  None),
    DetectionRule(20, "DatabaseError", "high",
                  "Database error detected",
                  r"database.*error|SQL.*error|connection.*database|postgres.*error|mysql.*error|mongodb.*error",
                  None),
]

SEVERITIES = ["critical", "high", "medium", "low"]

# ---------------------------------------------------------------------------
# FIXED VALUES: source classification rules, in order.
# ---------------------------------------------------------------------------
SOURCE_RULES: list[tuple[str, str]] = [
    ("kubernetes", r"CrashLoopBackOff|OOMKilled|kubelet|kubectl|namespace=|pod/"),
    ("docker", r"docker\[|containerd|\{\"log\":|\{\"time\":.*\"log\":"),
    ("nginx", r"nginx\/\d|\s\"(GET|POST|PUT|DELETE|PATCH)\s+[^\"]+\s+HTTP\/"),
    ("apache", r"\"(GET|POST|PUT|DELETE|PATCH)\s+[^\"]+\s+HTTP\/\d\.\d\"\s+\d{3}\s+"),
    ("jenkins", r"\[Pipeline\]|Finished: (SUCCESS|FAILURE)|hudson\.model"),
    ("github_actions", r"##\[(error|warning)\]|Run actions\/checkout|GITHUB_ACTIONS"),
    ("terraform", r"Terraform will perform|Plan: \d+ to add|Error: .*"),
    ("cloudwatch", r"\t@timestamp\t|\"@timestamp\"|CloudWatch"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: parser detection patterns, in order.
# A parser is chosen when any of its patterns matches; generic otherwise.
# ---------------------------------------------------------------------------
PARSER_PATTERNS: list[tuple[str, list[str]]] = [
    ("kubernetes", [
        r"CrashLoopBackOff|OOMKilled|kubelet|kubectl|namespace=",
        r"pod/|deployment/|replicaset/|statefulset/",
        r"\[kubelet\]|\[kubectl\]|\[kube-apiserver\]",
        r"k8s\.io|kubernetes\.io",
        r"Error from server|error when reading",
    ]),
    ("docker", [
        r"docker\[|containerd|docker-compose",
        r'\{"log":|\{"time":.*"log":',
        r"^\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
        r"container\s+\w+\s+(started|stopped|created|removed)",
    ]),
    ("nginx", [
        r"nginx/\d|nginx:",
        r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\s+-\s+-\s+",
        r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[\w+\]\s+\d+#\d+:",
    ]),
    ("apache", [
        r'"(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+[^"]+\s+HTTP/\d\.\d"\s+\d{3}\s+',
        r"\[apache\]|\[mpm_|\[core\]|\[http:",
        r"apache2|httpd",
    ]),
    ("jenkins", [
        r"\[Pipeline\]|Finished: (SUCCESS|FAILURE)|hudson\.model",
        r"Jenkins CLI|Jenkins Web UI",
        r"\[JENKINS\]|\[hudson\]",
        r"Building in workspace|Checking out git",
    ]),
    ("github_actions", [
        r"##\[error\]|##\[warning\]|##\[notice\]",
        r"Run actions/checkout|GITHUB_ACTIONS",
        r"\^::(error|warning|notice)::",
        r"GITHUB_WORKFLOW|GITHUB_RUN_ID|GITHUB_SHA",
    ]),
    ("terraform", [
        r"Terraform will perform|Plan: \d+ to add|Error: .*",
        r"Apply complete|Destroy complete|Refresh complete",
        r"\[TRACE\]|\[DEBUG\]|\[WARN\]",
        r"terraform(?:\.exe)?\s+(apply|plan|destroy|init)",
    ]),
    ("cloudwatch", [
        r'\t@timestamp\t|"@timestamp"|CloudWatch',
        r'"logStream"|"logGroup"|"owner"',
        r'"message":\s*"',
    ]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: Kubernetes batch flags (whole text).
# ---------------------------------------------------------------------------
K8S_FLAGS: list[tuple[str, str]] = [
    ("has_crash_loop", r"CrashLoopBackOff|Back-off restarting failed container"),
    ("has_oom", r"OOMKilled|Out of memory|Killed process"),
    ("has_probe_issues", r"readiness probe failed|liveness probe failed"),
    ("has_image_issues", r"ImagePullBackOff|ErrImagePull|image not found"),
    ("has_resource_issues", r"Insufficient (cpu|memory|ephemeral-storage)"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: level words and severity maps of the parsers.
# ---------------------------------------------------------------------------
LEVEL_WORDS = r"\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"
NGINX_ERROR_LEVELS = {
    "emerg": "CRITICAL", "alert": "CRITICAL", "crit": "CRITICAL", "error": "ERROR",
    "warn": "WARN", "notice": "INFO", "info": "INFO", "debug": "DEBUG",
}
APACHE_ERROR_LEVELS = {**NGINX_ERROR_LEVELS, "trace": "TRACE"}
JENKINS_LEVEL_WORDS = r"\b(SEVERE|WARNING|INFO|FINE|FINER|FINEST)\b"
JENKINS_LEVELS = {
    "SEVERE": "ERROR", "WARNING": "WARN", "INFO": "INFO",
    "FINE": "DEBUG", "FINER": "DEBUG", "FINEST": "DEBUG",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: timeline title rules, in order (a line can hit several).
# ---------------------------------------------------------------------------
TIMELINE_RULES: list[tuple[str, str]] = [
    (r"deployment (started|begin)|starting deployment", "Deployment Started"),
    (r"CrashLoopBackOff|pod .*crash|container .*crash", "Pod Crash Detected"),
    (r"timeout|timed out|ETIMEDOUT|DB timeout", "DB Timeout Observed"),
    (r"root cause|identified root cause|cause identified", "Root Cause Identified"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: analysis agents - payload keys, patterns, texts, confidences.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Agent:
    name: str
    keys: tuple[str, ...]
    patterns: tuple[str, ...]
    finding_prefix: str
    hit_summary: str
    miss_summary: str
    hit_conf: float
    miss_conf: float


AGENTS: list[Agent] = [
    Agent("log_analysis",
          ("logs", "log_text", "error", "trace", "details"),
          ("exception", "traceback", "segmentation fault", "panic", "out of memory",
           "connection refused", "timeout", "permission denied", "disk full"),
          "Matched log signal: ", "log analysis complete",
          "no critical log signals detected", 0.7, 0.4),
    Agent("kubernetes",
          ("logs", "kubernetes", "events", "description", "details", "summary"),
          ("crashloopbackoff", "imagepullbackoff", "oomkilled", "node not ready",
           "failed scheduling", "pod.*evicted", "back-off restarting failed container"),
          "Detected k8s condition: ", "kubernetes analysis complete",
          "no critical k8s signals detected", 0.75, 0.45),
    Agent("cicd",
          ("pipeline", "ci", "cd", "logs", "details", "summary"),
          ("build failed", "test(s)? failed", "pipeline.*failed", "artifact.*missing",
           "deploy(ment)? failed", "permission denied", "timeout"),
          "Detected CI/CD signal: ", "cicd analysis complete",
          "no critical cicd signals detected", 0.7, 0.4),
    Agent("security",
          ("security", "alerts", "logs", "details", "summary", "description"),
          (r"cve-\d{4}-\d+", "unauthorized", "privilege escalation", "token leak",
           "credentials? exposed", "malware", "sql injection"),
          "Security signal: ", "security analysis complete",
          "no critical security signals detected", 0.8, 0.35),
]

# Docs agent: confidences hit / miss / skipped and summaries.
DOCS_AGENT = {
    "hit_summary": "docs retrieval complete", "miss_summary": "no docs matched",
    "skip_summary": "docs retrieval skipped",
    "hit_conf": 0.6, "miss_conf": 0.4, "skip_conf": 0.3, "top_k": 5,
}

# Router: payload fields whose text is searched, then the keyword rules.
ROUTER_TEXT_FIELDS = ["message", "summary", "description", "log_text", "logs", "error", "details"]
ROUTER_TEXT_RULES: list[tuple[str, list[str]]] = [
    ("kubernetes", ["kubernetes", "k8s", "kubectl", "pod", "node", "helm", "etcd"]),
    ("cicd", ["ci", "cd", "pipeline", "github actions", "gitlab", "jenkins", "build failed"]),
    ("security", ["vulnerab", "cve", "malware", "unauthorized", "exploit", "token leak"]),
    ("log_analysis", ["log", "exception", "traceback", "error", "panic", "stack trace"]),
    ("docs_retrieval", ["doc", "runbook", "kb", "knowledge", "procedure"]),
]
ROUTER_TYPE_RULES: list[tuple[str, list[str]]] = [
    ("kubernetes", ["kuber"]),
    ("cicd", ["ci", "cd"]),
    ("security", ["security"]),
]
ROUTER_TAG_RULES: list[tuple[str, list[str]]] = [
    ("security", ["security"]),
    ("kubernetes", ["kubernetes", "k8s"]),
    ("cicd", ["cicd", "pipeline"]),
]
ROUTER_DEFAULT = ["docs_retrieval", "log_analysis"]

# Root cause: (tests on lower-cased findings + text, cause, dependency,
# affected system, remediation), in order.
ROOT_CAUSE_KEYS = ["message", "summary", "description", "logs", "error", "details"]
ROOT_CAUSE_RULES: list[tuple[list[str], str, str, str, str]] = [
    (["database_url", "missing database"],
     "Missing DATABASE_URL environment variable",
     "database: postgres/postgres-compatible service",
     "application backend / DB-dependent services",
     "Set the DATABASE_URL env var and restart the service."),
    (["connection refused", "could not connect to"],
     "Database or upstream service unreachable (connection refused)",
     "network / database endpoint",
     "backend services relying on DB or upstream APIs",
     "Verify network connectivity and that the target service is running."),
    (["out of memory", "oom"],
     "Out of memory in container/pod",
     "container runtime / node resources",
     "service instance(s) experiencing restarts",
     "Increase memory limits and inspect memory usage / leaks."),
    (["imagepullbackoff", "image pull"],
     "Image pull failure (registry/auth) ",
     "container registry / image artifact",
     "deployment/pods relying on the image",
     "Check registry credentials and image tag availability."),
    (["permission denied", "access denied"],
     "Permission denied when accessing resource",
     "iam / service account / secret mount",
     "operations that require the permission",
     "Audit roles and permissions; ensure service accounts and secrets are correct."),
]
ROOT_CAUSE_FALLBACK = "Insufficient signals to determine a single root cause"
ROOT_CAUSE_FALLBACK_FIX = "Collect more logs, system metrics and recent deployment history."

# Remediation: (substrings of the joined lower-cased findings, sentence).
REMEDIATION_RULES: list[tuple[list[str], str]] = [
    (["oom", "out of memory"], "Increase pod/container memory limits and inspect memory leaks."),
    (["imagepullbackoff"], "Verify image registry credentials and image tag availability."),
    (["failed scheduling"], "Check node capacity and taints; adjust requests/limits or add nodes."),
    (["build failed", "pipeline"], "Review CI pipeline logs and rollback the last failing change."),
    (["permission denied"], "Verify service account permissions and secret mounts."),
    (["timeout"], "Check upstream dependencies and increase timeout thresholds if needed."),
    (["cve", "vulnerab"], "Patch affected packages and rotate exposed credentials."),
]
REMEDIATION_DEFAULTS = [
    "Collect full logs and confirm the incident scope.",
    "Validate recent changes or deployments in the last 24 hours.",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: limits and defaults.
# ---------------------------------------------------------------------------
UPLOAD_LIMIT_BYTES = 25 * 1024 * 1024
DOC_MAX_BYTES = 20_000_000
LOG_CHUNK_MAX = 2200
LOG_CHUNK_OVERLAP = 200
DOC_CHUNK_MAX = 1200
DOC_CHUNK_OVERLAP = 150
ATTACHMENT_KINDS = ["log", "screenshot", "yaml"]
# FIXED VALUES: content types accepted for a kind; kinds not named accept all.
ATTACHMENT_CONTENT_TYPES = {
    "screenshot": ["image/png", "image/jpeg", "image/jpg", "image/webp"],
    "yaml": ["application/x-yaml", "text/yaml", "text/plain", "application/octet-stream"],
}
DOC_SUFFIX_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown",
    ".txt": "text", ".yaml": "yaml", ".yml": "yaml",
}


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside its groups and classes."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


#: a first character that every match of an alternative has (not an optional or repeated one)
_FIRST = re.compile(r"""(\\[dst]|\\[^A-Za-z0-9]|[A-Za-z0-9 "'/:=#,;<>@_-])(?![?*{])""")


def first_tested(pattern: str) -> str:
    """The pattern behind a test of its first character: the same matches (Java regex), fewer alternatives tried.

    A pattern with an alternative whose first character isn't plain comes back as it is.
    """
    parts = alternatives(pattern)
    firsts = [_FIRST.match(a) for a in parts]
    if not all(firsts):
        return pattern
    chars = {m[1] if m[1][0] == "\\" or m[1].isalnum() else "\\" + m[1] for m in firsts}
    return f"(?=[{''.join(sorted(chars))}])(?:{pattern})"


def ci(pattern: str) -> str:
    """Java-regex flags for a case-insensitive pattern: `.` stops only at \\n."""
    return "(?id)" + pattern


def cs(pattern: str) -> str:
    """Case-sensitive variant (`.` stops only at \\n)."""
    return "(?d)" + pattern
