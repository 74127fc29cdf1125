"""Source detection and classification (C-1 ... C-6).

All rules are literal regexes evaluated with built-in ``rlike`` /
``regexp_count`` inside ``CASE WHEN`` chains, so they stay in whole-stage
codegen and each regex is compiled once per task.  Evaluation order inside
``when`` is guaranteed, so later rules are skipped once one hits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ..rules import ci, first_tested


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_pattern(patterns: list[str]) -> str:
    """One regex that finds a hit iff any of ``patterns`` finds one."""
    return "|".join(f"(?:{p})" for p in patterns)


def any_tested(patterns: list[str]) -> str:
    """``any_pattern`` with one test of the first character for all alternatives that have a plain one."""
    parts = [a for p in patterns for a in rules.alternatives(p)]
    tested = [a for a in parts if first_tested(a) != a]
    return any_pattern([*([first_tested("|".join(tested))] if tested else []), *[a for a in parts if a not in tested]])


def detect_source(text) -> Column:
    """C-1: first parser (fixed order) whose patterns hit the text."""
    sample = _c(text)
    expr = None
    for name, patterns in rules.PARSER_PATTERNS:
        cond = sample.rlike(ci(any_tested(patterns)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("generic"))


def classify_source(text) -> Column:
    """C-2: first of the eight source rules that hits the text."""
    sample = _c(text)
    expr = None
    for name, pattern in rules.SOURCE_RULES:
        cond = sample.rlike(ci(first_tested(pattern)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("generic"))


def source_rule_counts(text) -> Column:
    """Match count of every source rule (array<int>, rule order)."""
    sample = _c(text)
    return F.array(*[F.regexp_count(sample, F.lit(ci(first_tested(p)))).cast("int")
                     for _, p in rules.SOURCE_RULES])


def classify_source_scored(text) -> Column:
    """C-3: ``struct(source, confidence)`` from per-rule match counts.

    argmax of counts, ties to the earlier rule; confidence =
    min(best/total + 0.3, 1.0); no hit at all gives ("generic", 0.5).
    """
    return scored_counts(source_rule_counts(text))


def scored_counts(counts: Column) -> Column:
    """C-3 from the source rules' match counts (``source_rule_counts``, or their sums over parts of a text)."""
    names = F.array(*[F.lit(n) for n, _ in rules.SOURCE_RULES])
    scored = F.zip_with(counts, names, lambda c, n: F.struct(c.alias("n"), n.alias("name")))
    indexed = F.transform(scored, lambda s, i: F.struct(s["n"].alias("n"), (-i).alias("neg_idx"),
                                                        s["name"].alias("name")))
    best = F.array_max(indexed)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    conf = F.least(best["n"].cast("double") / total.cast("double") + F.lit(0.3), F.lit(1.0))
    return (F.when(total > 0, F.struct(best["name"].alias("source"), conf.alias("confidence")))
            .otherwise(F.struct(F.lit("generic").alias("source"), F.lit(0.5).alias("confidence"))))


def source_match_counts(text) -> Column:
    """C-4: map rule name -> match count, positive counts only."""
    names = F.array(*[F.lit(n) for n, _ in rules.SOURCE_RULES])
    return F.map_filter(F.map_from_arrays(names, source_rule_counts(text)),
                        lambda k, v: v > 0)


def resolve_source(parser_source, classified_source) -> Column:
    """C-5: the parser's source unless it is generic, else the classified one."""
    p = _c(parser_source)
    return F.when(p != F.lit("generic"), p).otherwise(_c(classified_source))


def forced_source(forced, detected) -> Column:
    """C-6: a forced source skips detection; an unknown forced name means generic."""
    f = F.lower(_c(forced))
    known = F.when(f.isin(*rules.SOURCES), f).otherwise(F.lit("generic"))
    return F.when(_c(forced).isNull(), _c(detected)).otherwise(known)
