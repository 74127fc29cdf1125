"""Incident timelines from log text (I-1 ... I-4).

Per line: a time from the first ``HH:MM(:SS)`` on the line combined with
the incident's base date (quirk Q-8: the time-only pattern is tried first,
so a line's own date is ignored unless ``use_line_date=True``); lines
without a usable time take ``run_ts`` (Q-9: the reference used the wall
clock).  Every line can hit several title rules; the first line wins per
(title, second).  Only the dedup window shuffles, keyed by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .parse import explode_lines

TIME_ONLY = r"(\d{2}):(\d{2})(?::(\d{2}))?"
DATED = r"(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(Z)?"


def timeline_timestamp(line: Column, base_ts: Column, run_ts: Column, use_line_date: bool = False) -> Column:
    """I-1: event time of a line (timestamp_ntz, UTC)."""
    has_t = line.rlike(TIME_ONLY)
    h, m, s = (F.regexp_extract(line, TIME_ONLY, i) for i in (1, 2, 3))
    sec = F.when(s == "", F.lit("0")).otherwise(s)
    from_base = F.try_make_timestamp_ntz(F.year(base_ts), F.month(base_ts), F.dayofmonth(base_ts),
                                         h.cast("int"), m.cast("int"), sec.cast("decimal(16,6)"))
    time_only = F.when(has_t & base_ts.isNotNull() & (sec.cast("int") < 60), from_base)
    if use_line_date:
        g = [F.regexp_extract(line, DATED, i) for i in range(1, 7)]
        dsec = F.when(g[5] == "", F.lit("0")).otherwise(g[5])
        dated = F.try_make_timestamp_ntz(g[0].cast("int"), g[1].cast("int"), g[2].cast("int"),
                                         g[3].cast("int"), g[4].cast("int"), dsec.cast("decimal(16,6)"))
        t = F.when(line.rlike(DATED), F.when(dsec.cast("int") < 60, dated)).otherwise(time_only)
    else:
        t = time_only
    return F.coalesce(t, run_ts.cast("timestamp_ntz"))


def timeline_titles(line: Column) -> Column:
    """I-2: array of struct(rule_no, title) for every rule the line hits, in rule order."""
    hits = [F.when(line.rlike("(?id)" + p), F.struct(F.lit(i).alias("rule_no"), F.lit(t).alias("title")))
            for i, (p, t) in enumerate(rules.TIMELINE_RULES)]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def generate_timeline(files: DataFrame, run_ts, base_col: str = "base_ts", text_col: str = "text",
                      key: str = "file_id", use_line_date: bool = False) -> DataFrame:
    """I-4: ``(key, occurred_at, title, detail, source, line_no, pos)`` sorted per key.

    ``files`` carries the text and the base date (incident ``started_at``,
    else ``created_at``); ``run_ts`` replaces "now" for lines with no usable
    time.
    """
    run = F.lit(run_ts) if not isinstance(run_ts, Column) else run_ts
    lines = explode_lines(files.select(key, base_col, text_col), text_col, key)
    ev = (lines.select(key, "line_no", "line",
                       timeline_timestamp(F.col("line"), F.col(base_col), run, use_line_date).alias("occurred_at"),
                       F.explode(timeline_titles(F.col("line"))).alias("t"))
          .select(key, "line_no", "occurred_at", F.col("t.rule_no").alias("rule_no"),
                  F.col("t.title").alias("title"), F.col("line").alias("detail")))
    first = Window.partitionBy(key, "title", F.date_trunc("second", "occurred_at")).orderBy("line_no", "rule_no")
    kept = ev.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")
    order = Window.partitionBy(key).orderBy("occurred_at", "title", "line_no", "rule_no")
    return kept.select(key, "occurred_at", "title", "detail", F.lit("auto").alias("source"), "line_no",
                       F.row_number().over(order).alias("pos"))


def timeline_for_incidents(files: DataFrame, incidents: DataFrame, run_ts, key: str = "file_id",
                           use_line_date: bool = False) -> DataFrame:
    """Join each file to its incident for the base date (started_at, else created_at)."""
    base = incidents.select(F.col("id").alias(key), F.coalesce("started_at", "created_at").alias("base_ts"))
    return generate_timeline(files.join(base, key, "left"), run_ts, key=key, use_line_date=use_line_date)
