"""Finding detection over whole log texts (E-1 ... E-12).

Plan shape, all of it in the row:

1. one projection per text decides natively which rules apply to the source and
   hit (``rlike``); texts without a hit go no further;
2. the texts left (null for the others) go to Arrow batches once, where each hitting rule's matches are
   searched, their evidence cut and equal evidence of a rule dropped.

No row per match is shuffled, no window runs over matches and no text is joined
to its own offsets, so nothing depends on how many texts or matches a key has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.text import py_strip
from ..rules import ci, first_tested
from .ranking import ranked

#: rows of findings handed back at once
OUT_ROWS = 10_000


def rule_applies(rule: rules.DetectionRule, source: Column) -> Column:
    """E-2: the rule has no source filter or the filter holds the source."""
    if rule.sources is None:
        return F.lit(True)
    return source.isin(*rule.sources)


def _rule_meta(col: Column, field: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules.DETECTION_RULES]),
                        col)


def rule_hits(text: Column, source: Column, detection_rules: list[rules.DetectionRule] | None = None) -> Column:
    """Numbers of the rules that apply to the source and match the text somewhere."""
    drs = detection_rules or rules.DETECTION_RULES
    return F.array_compact(F.array(*[F.when(rule_applies(r, source) & text.rlike(ci(first_tested(r.pattern))), F.lit(r.rule_no))
                                     for r in drs]))


def search_matches(texts: DataFrame, keep: list[str], text_col: str, source_col: str,
                   detection_rules: list[rules.DetectionRule] | None = None, distinct: bool = True) -> DataFrame:
    """Every match of every hitting rule, with ``keep`` columns of its text.

    Adds ``rule_no, match_no, start, end, evidence`` (offsets are 0-based character
    positions, ``match_no`` the 0-based match order).  ``distinct`` keeps the first match of
    each distinct evidence of a rule (E-5); nothing is capped.
    """
    drs = detection_rules or rules.DETECTION_RULES
    patterns = {r.rule_no: r.pattern for r in drs}
    before, after, out_rows = rules.EVIDENCE_BEFORE, rules.EVIDENCE_AFTER, OUT_ROWS
    # not a filter: pushed below the projections that make the text, it would repeat them for every rule
    hit = texts.select(*keep, F.col(text_col).alias("_text"), rule_hits(F.col(text_col), F.col(source_col), drs).alias("_hits"))
    hit = hit.select(*keep, F.when(F.size("_hits") > 0, F.col("_text")).alias("_text"), "_hits")
    schema = T.StructType([*hit.schema.fields[:len(keep)], T.StructField("rule_no", T.IntegerType(), False),
                           T.StructField("match_no", T.IntegerType(), False), T.StructField("start", T.LongType(), False),
                           T.StructField("end", T.LongType(), False), T.StructField("evidence", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {no: re.compile(p, re.IGNORECASE) for no, p in patterns.items()}

        def rows(batch, found):
            at = pa.array([f[0] for f in found], pa.int64())
            kept = [c.take(at) for c in batch.columns[:-2]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array([f[k + 1] for f in found], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(kept + made, [*batch.schema.names[:-2], "rule_no", "match_no", "start", "end", "evidence"])

        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                text = batch.column("_text")[i].as_py()
                for no in batch.column("_hits")[i].as_py() if text is not None else ():
                    seen = set()
                    for k, m in enumerate(compiled[no].finditer(text)):
                        evidence = text[max(m.start() - before, 0):m.end() + after].replace("\n", " ").strip()
                        if distinct:
                            if evidence in seen:
                                continue
                            seen.add(evidence)
                        found.append((i, no, k, m.start(), m.end(), evidence))
                        if len(found) >= out_rows:
                            yield rows(batch, found)
                            found = []
            if found:
                yield rows(batch, found)

    return hit.mapInArrow(run, schema)


def match_offsets(files: DataFrame, text_col: str = "text", source_col: str = "source",
                  key: str = "file_id",
                  detection_rules: list[rules.DetectionRule] | None = None) -> DataFrame:
    """E-3: ``(key, rule_no, match_no, start, end)`` of every match of every applicable rule."""
    found = search_matches(files, [key], text_col, source_col, detection_rules, distinct=False)
    return found.select(key, "rule_no", "match_no", "start", "end")


def evidence_window(sample: Column, start: Column, end: Column,
                    before: int = rules.EVIDENCE_BEFORE, after: int = rules.EVIDENCE_AFTER) -> Column:
    """E-4: text from start-before to end+after, newlines -> spaces, stripped."""
    a = F.greatest(start - before, F.lit(0))
    b = F.least(end + after, F.length(sample))
    return py_strip(F.translate(F.substring(sample, a + 1, b - a), "\n", " "))


def described(found: DataFrame, keys: list[str], carried: list[str] = ()) -> DataFrame:
    """Matches with what their rules say of them (columns of E-7)."""
    rn = F.col("rule_no")
    return found.select(*keys, "rule_no", "match_no",
                        _rule_meta(rn, "category").alias("category"),
                        _rule_meta(rn, "severity").alias("severity"),
                        _rule_meta(rn, "title").alias("title"),
                        "evidence", F.col("_source").alias("source_type"), F.lit(1.0).alias("confidence"), *carried)


def detect_findings(files: DataFrame, text_col: str = "text", source_col: str = "source",
                    key: str = "file_id") -> DataFrame:
    """E-4 ... E-7: findings of all rules for a table of texts, one per distinct evidence of a rule.

    Output: ``file_id, rule_no, match_no, category, severity, title,
    evidence, source_type, confidence`` — rule order then match order is
    ``(rule_no, match_no)``.  A projection and a map over batches: no shuffle.
    """
    texts = files.withColumn("_source", F.col(source_col))
    return described(search_matches(texts, [key, "_source"], text_col, "_source"), [key])


def detect_findings_from_entries(entries: DataFrame, source_col: str = "source",
                                 keys: tuple[str, ...] = ("file_id", "line_no"),
                                 message_col: str = "message", ts_col: str = "ts") -> DataFrame:
    """E-8: the same rules per parsed entry message; findings carry the entry's ts.

    Dedup applies per entry, as every entry is its own text.
    """
    texts = entries.withColumns({"_source": F.col(source_col), "ts": F.col(ts_col)})
    found = search_matches(texts, [*keys, "_source", "ts"], message_col, "_source")
    return described(found, list(keys), ["ts"])


def finding_counts(findings: DataFrame) -> DataFrame:
    """Count of findings by (category, severity)."""
    return findings.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n_findings"))


def _for_all(per_key: DataFrame, files: DataFrame | None, key: str) -> DataFrame:
    """A row for every file: zeros, false or empty lists where a file has no finding."""
    if files is None:
        return per_key
    empty = {"bigint": F.lit(0).cast("long"), "boolean": F.lit(False), "array<string>": F.array().cast("array<string>")}
    return files.select(key).distinct().join(per_key, key, "left").select(
        key, *[F.coalesce(c, empty[t]).alias(c) for c, t in per_key.dtypes if c != key])


def finding_summary(findings: DataFrame, key: str = "file_id", files: DataFrame | None = None) -> DataFrame:
    """E-9: per-key critical/high/medium/low/total counts (total includes other severities).

    With ``files``, files without findings have a row of zeros (also in E-10 ... E-12).
    """
    sev = F.col("severity")
    return _for_all(findings.groupBy(key).agg(
        *[F.count_if(sev == s).alias(s) for s in rules.SEVERITIES],
        F.count(F.lit(1)).alias("total"),
    ), files, key)


def brief_findings(findings: DataFrame, key: str = "file_id", files: DataFrame | None = None) -> DataFrame:
    """E-10: per key, titles listed as "critical" (critical or high) and "high" (high only).

    Lists keep finding order (rule, match)."""
    item = F.struct("rule_no", "match_no", "title")
    crit = F.collect_list(F.when(F.col("severity").isin("critical", "high"), item))
    high = F.collect_list(F.when(F.col("severity") == "high", item))
    return _for_all(findings.groupBy(key).agg(
        F.transform(F.array_sort(crit), lambda s: s["title"]).alias("critical_list"),
        F.transform(F.array_sort(high), lambda s: s["title"]).alias("high_list"),
    ), files, key)


def brief_titles(findings: DataFrame, key: str = "file_id") -> DataFrame:
    """E-10 as rows: ``(key, list, pos, title)``, in finding order; no list is held whole.

    A high finding is in both lists, as in ``brief_findings``.
    """
    lists = F.array_compact(F.array(F.when(F.col("severity").isin("critical", "high"), F.lit("critical")),
                                    F.when(F.col("severity") == "high", F.lit("high"))))
    rows = findings.select(key, F.explode(lists).alias("list"), "rule_no", "match_no", "title")
    return ranked(rows, [key, "list"], ["rule_no", "match_no"]).select(key, "list", "pos", "title")


def brief_message(summary: DataFrame) -> DataFrame:
    """E-11: a one-line message by precedence critical, high, any, none."""
    # FIXED VALUES: message texts.
    msg = (F.when(F.col("critical") > 0,
                  F.format_string("Critical issues detected: %d critical findings", F.col("critical")))
           .when(F.col("high") > 0,
                 F.format_string("High severity issues detected: %d high findings", F.col("high")))
           .when(F.col("total") > 0, F.format_string("%d issues detected", F.col("total")))
           .otherwise(F.lit("No issues detected")))
    return summary.withColumn("message", msg)


def severity_flags(findings: DataFrame, key: str = "file_id", files: DataFrame | None = None) -> DataFrame:
    """E-12: counts of critical / high findings and ``has_critical_issues`` per key."""
    sev = F.col("severity")
    return _for_all(findings.groupBy(key).agg(
        F.count_if(sev == "critical").alias("critical_findings"),
        F.count_if(sev == "high").alias("high_findings"),
        F.bool_or(sev == "critical").alias("has_critical_issues"),
    ), files, key)
