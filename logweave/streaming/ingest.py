"""Structured Streaming plans (S-1 ... S-7).

Sources are file streams (parquet tables or log files).  Sinks never go
through the driver: every query writes parquet into the shared folder named
by ``spark.checkpoint.dir`` (its checkpoint sits next to it), either with
the file sink (append) or with ``foreachBatch`` into ``BatchTable`` folders, one per
batch id, which makes a replayed batch overwrite its own output
(idempotent after an executor or driver restart) and which are folded as they grow.

Results don't depend on how the input was cut into triggers: S-1 derives every file a batch
touches anew from all its lines so far, S-2 and S-5 merge partial aggregates, S-6 waits until a
file is complete or silent.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from .closing import CLOSED, close_files, open_files
from .tables import BatchTable, delete_folder, newest


def stream_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/logweave-streams/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream of one parquet table of the driver folder (schema from the batch reader)."""
    schema = fx.table(spark, sf_dir, name).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir.rstrip("/"))


def log_line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S source: log lines rendered from the events stream (a projection, no state)."""
    return fx.render_log_lines(table_stream(spark, sf_dir, "events"))


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need ``timestamp`` (not ``timestamp_ntz``); the stored wall time is UTC."""
    if df.schema[col].dataType.simpleString() == "timestamp_ntz":
        return df.withColumn(col, F.to_utc_timestamp(F.col(col).cast("timestamp"), F.current_timezone()))
    return df


def run_available_now(query_builder, checkpoint: str):
    """Start a ``writeStream`` builder with ``availableNow`` and wait for it."""
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    ex = q.exception()
    if ex is not None:
        raise RuntimeError(str(ex))
    return q


# ---------------------------------------------------------------------------
# S-1: ingest (files, entries, chunks, findings and flags)
# ---------------------------------------------------------------------------
LINE_BUCKETS = 64
LINE_SCHEMA = "file_id long, line_no int, line string, bucket int"


def newest_lines(rows: DataFrame) -> DataFrame:
    """One row per (file, line): a line delivered again replaces the one before."""
    return (rows.groupBy("file_id", "line_no", "bucket")
            .agg(F.max_by("line", "batch_id").alias("line"), F.max("batch_id").alias("batch_id"))
            .select("file_id", "line_no", "line", "bucket", "batch_id"))


def newest_files(rows: DataFrame) -> DataFrame:
    """Texts of files from all versions of their lines: ``assemble_files`` of ``newest_lines``, in one shuffle."""
    versions = F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), F.col("batch_id").alias("b"), F.col("line").alias("l"))))
    last = F.filter("_v", lambda v, i: ~v["n"].eqNullSafe(F.get("_v", i + 1)["n"]) | (i == F.size("_v") - 1))
    lines = F.transform(last, lambda v: v["l"])
    return rows.groupBy("file_id").agg(versions.alias("_v")).select("file_id", F.array_join(lines, "\n").alias("text"))


@dataclass
class IngestTables:
    """What S-1 has written: every file's outputs as of the last batch that touched it."""

    tables: dict[str, BatchTable]

    def read(self, name: str) -> DataFrame:
        """``files``, ``entries``, ``chunks``, ``findings`` or ``batches`` (see ``run_pipeline``)."""
        return self.tables[name].read().drop("batch_id")


def stream_ingest(spark: SparkSession, lines: DataFrame, name: str = "ingest", fold_every: int = 10) -> IngestTables:
    """S-1: lines as they come -> entries, chunks, findings and flags of whole files.

    A batch appends its lines to a table bucketed by file, reads all lines so far of the files it
    touches (only their buckets) and runs the pipeline on these files once; the new
    versions of their outputs replace the old ones.  So a file cut over triggers, in any order, has one
    source, the offsets of its whole text and no doubled finding: the tables equal ``run_pipeline`` over all lines.
    """
    from ..plans.pipeline import run_pipeline
    root = stream_root(spark, name)
    sample = run_pipeline_schemas(spark, lines)
    line_table = BatchTable(spark, f"{root}/lines", LINE_SCHEMA, newest_lines, fold_every, buckets="bucket")
    files = BatchTable(spark, f"{root}/files", sample["files"], lambda r: newest(r, ["file_id"]), fold_every)

    def of_newest_files(rows: DataFrame) -> DataFrame:
        return rows.join(files.read().select("file_id", "batch_id"), ["file_id", "batch_id"], "left_semi").select(*rows.columns)

    tables = {"files": files} | {n: BatchTable(spark, f"{root}/{n}", sample[n], of_newest_files, fold_every)
                                 for n in ("entries", "chunks", "findings", "batches")}

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("file_id"), F.lit(LINE_BUCKETS)).cast("int")
        line_table.add(batch.select("file_id", F.col("line_no").cast("int").alias("line_no"), "line", bucket.alias("bucket")), batch_id)
        touched = line_table.batch(batch_id).select("file_id", "bucket").distinct()  # as written, not rendered again
        numbers = [r.bucket for r in touched.select("bucket").distinct().collect()]  # LINE_BUCKETS at most
        so_far = line_table.rows(batch_id).where(F.col("bucket").isin(numbers)).join(touched.select("file_id"), "file_id", "left_semi")
        scratch = f"{root}/prepared/{batch_id}"
        done = run_pipeline(newest_files(so_far), path=scratch)
        for n, table in tables.items():
            table.add(getattr(done, n), batch_id)
        delete_folder(spark, scratch)
        for table in (*[t for n, t in tables.items() if n != "files"], files, line_table):
            table.fold_if_due(batch_id)

    run_available_now(lines.writeStream.foreachBatch(write), f"{root}/_ckpt")
    return IngestTables(tables)


def run_pipeline_schemas(spark: SparkSession, lines: DataFrame) -> dict[str, str]:
    """Schemas of the pipeline's outputs, taken from its plan over no files."""
    from ..plans.pipeline import pipeline_outputs, prepare_files
    none = spark.createDataFrame([], f"file_id {lines.schema['file_id'].dataType.simpleString()}, text string")
    out = pipeline_outputs(prepare_files(none), "file_id")
    return {n: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in getattr(out, n).schema.fields)
            for n in ("files", "entries", "chunks", "findings", "batches")}


# ---------------------------------------------------------------------------
# S-2: windowed finding counts with a watermark and a late side table
# ---------------------------------------------------------------------------
def line_rule_hits(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Rule categories that hit each line (no source filter: a line has no file context)."""
    hits = F.array_compact(F.array(*[F.when(F.col(line_col).rlike(rules.ci(r.pattern)),
                                            F.struct(F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")))
                                     for r in rules.DETECTION_RULES]))
    return lines.select("*", F.inline(hits))


@dataclass
class WindowCounts:
    """S-2: counts of the rows that came in time, and the rows that came too late."""

    counts: DataFrame
    late: DataFrame


WINDOW_KEYS = ["window_start", "window_end", "category", "severity"]


def stream_window_counts(spark: SparkSession, lines: DataFrame, window: str = "1 day", slide: str | None = None,
                         watermark: str = "1 day", name: str = "finding-counts", fold_every: int = 10) -> WindowCounts:
    """S-2: finding counts by category and severity per tumbling (or, with ``slide``, sliding) window.

    The watermark of a batch is the newest event time of the batches before it less ``watermark``; a
    row is late for a window that ended by then.  Counts of a batch are partial sums, merged
    when read and folded as they grow, so nothing is held in state.  Rows too late for a window
    aren't lost: each (row, window) goes to the side table with the watermark it missed, and
    counts plus side table equal the batch counts whatever the order of the triggers.
    """
    root = stream_root(spark, name)
    keys = ", ".join(f"{k} {t}" for k, t in zip(WINDOW_KEYS, ("timestamp", "timestamp", "string", "string"), strict=True))

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*WINDOW_KEYS).agg(F.sum("n").alias("n"), F.max("batch_id").alias("batch_id"))

    seen = BatchTable(spark, f"{root}/seen", "newest timestamp", lambda r: r.agg(F.max("newest").alias("newest"), F.max("batch_id").alias("batch_id")), fold_every)
    counts = BatchTable(spark, f"{root}/counts", f"{keys}, n long", merged, fold_every)
    late = BatchTable(spark, f"{root}/late", f"file_id long, line_no int, ts timestamp, {keys}, missed timestamp", lambda r: r, fold_every)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = seen.rows(batch_id - 1).agg(F.max("newest")).first()[0] if batch_id else None
        seen.add(event_time(batch).agg(F.max("ts").alias("newest")), batch_id)
        mark = F.lit(before) - F.expr(f"interval {watermark}") if before is not None else F.lit(None).cast("timestamp")
        hits = line_rule_hits(event_time(batch)).select("*", w.alias("_w"))
        hits = hits.select("file_id", "line_no", "ts", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                           "category", "severity", mark.alias("missed"))
        behind = F.coalesce(F.col("window_end") <= F.col("missed"), F.lit(False))
        counts.add(hits.where(~behind).groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("n")), batch_id)
        late.add(hits.where(behind).withColumn("line_no", F.col("line_no").cast("int")), batch_id)
        for t in (seen, counts, late):
            t.fold_if_due(batch_id)

    run_available_now(lines.writeStream.foreachBatch(write), f"{root}/_ckpt")
    return WindowCounts(counts.read().select(*WINDOW_KEYS, "n"), late.read().drop("batch_id"))


def stream_finding_counts(spark: SparkSession, lines: DataFrame, window: str = "1 day",
                          slide: str | None = None, watermark: str = "1 day", name: str = "finding-counts") -> DataFrame:
    """S-2: per-category counts per event-time window of the rows in time."""
    out = stream_window_counts(spark, lines, window, slide, watermark, name)
    return out.counts.groupBy("window_start", "window_end", "category").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------
# S-3: error bursts as session windows
# ---------------------------------------------------------------------------
def stream_incident_sessions(spark: SparkSession, events: DataFrame, key: str = "user_id", gap: str = "30 minutes",
                             watermark: str = "1 day", is_error: Column | None = None,
                             name: str = "sessions", output_mode: str = "append") -> DataFrame:
    """S-3: bursts of error events per key; a session closes after ``gap`` of silence.

    ``append`` (default) keeps state bounded: a session is written once the
    watermark (max event time - ``watermark``) passes its end.  Sessions still
    open when the ``availableNow`` run ends are read from the state it has
    committed; ``is_open`` marks them.  ``complete`` rewrites the
    whole session table per trigger (includes open sessions; state is never
    dropped, so only for bounded inputs).
    """
    out = stream_root(spark, name)
    err = is_error if is_error is not None else (F.col("event_type") == "error")
    agg = (event_time(events).where(err).withWatermark("ts", watermark)
           .groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n_errors")))
    flat = agg.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_errors")
    if output_mode == "complete":
        whole = BatchTable(spark, out + "/data", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields),
                           lambda r: r.where(F.col("batch_id") == r.select(F.max("batch_id")).scalar()))

        def write(batch: DataFrame, batch_id: int) -> None:
            whole.add(batch, batch_id)
            whole.fold_if_due(batch_id)

        run_available_now(flat.writeStream.outputMode("complete").foreachBatch(write), out + "/_ckpt")
        return whole.read().drop("batch_id")
    run_available_now(flat.writeStream.outputMode("append").format("parquet").option("path", out + "/data"),
                      out + "/_ckpt")
    closed = spark.read.schema(flat.schema).parquet(out + "/data").withColumn("is_open", F.lit(False))
    state = spark.read.format("statestore").load(out + "/_ckpt").select("value.*")
    still = state.select(key, F.col("session_window.start").alias("session_start"),
                         F.col("session_window.end").alias("session_end"), F.col("count").alias("n_errors"))
    return closed.unionByName(still.withColumn("is_open", F.lit(True)))


# ---------------------------------------------------------------------------
# S-4: repeated uploads suppressed within the watermark
# ---------------------------------------------------------------------------
def fnd_checksum(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def stream_dedup(spark: SparkSession, rows: DataFrame, text_col: str, keep: list[str], watermark: str = "1 day",
                 name: str = "dedup") -> DataFrame:
    """S-4: the first row of each text (whole digest) within the watermark delay of ``ts``."""
    out = stream_root(spark, name)
    keyed = rows.withColumn("checksum", fnd_checksum(F.col(text_col))).withColumn("digest", F.sha2(text_col, 256))
    dedup = event_time(keyed).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["digest"])
    flat = dedup.select("checksum", *keep, "ts")
    run_available_now(flat.writeStream.outputMode("append")
                      .format("parquet").option("path", out + "/data"), out + "/_ckpt")
    return spark.read.schema(flat.schema).parquet(out + "/data")


def stream_dedup_lines(spark: SparkSession, lines: DataFrame, watermark: str = "1 day", name: str = "dedup") -> DataFrame:
    """S-4 on log lines."""
    return stream_dedup(spark, lines, "line", ["line"], watermark, name)


def stream_dedup_chunks(spark: SparkSession, chunks: DataFrame, watermark: str = "1 day", name: str = "dedup-chunks") -> DataFrame:
    """S-4: chunks (F-1) of repeated uploads; the first chunk of each text stays."""
    return stream_dedup(spark, chunks, "text", ["file_id", "chunk_index", "text"], watermark, name)


# ---------------------------------------------------------------------------
# S-5: job life cycle over a change stream
# ---------------------------------------------------------------------------
def stream_job_state(spark: SparkSession, transitions: DataFrame, name: str = "job-state", fold_every: int = 10) -> DataFrame:
    """S-5: current state per job from a stream of (job_id, status, at) changes, in any order.

    A batch's changes become one partial state per job; partial states merge by the same rule, when
    read and at every fold.  No state is held in the stream, and folders and files stay as many
    however many triggers have run.
    """
    from ..operators.store import JOB_STATES
    root = stream_root(spark, name)
    kind = transitions.schema["at"].dataType.simpleString()

    def fold(rows: DataFrame) -> DataFrame:
        order = F.struct("at", F.array_position(F.array(*[F.lit(s) for s in JOB_STATES]), F.col("status")).alias("k"))
        return rows.groupBy("job_id").agg(
            F.max_by("status", order).alias("status"), F.max("at").alias("at"), F.min("created_at").alias("created_at"),
            F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.max("batch_id").alias("batch_id"))

    table = BatchTable(spark, f"{root}/states", f"job_id {transitions.schema['job_id'].dataType.simpleString()}, status string, "
                       f"at {kind}, created_at {kind}, started_at {kind}, finished_at {kind}", fold, fold_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        at, status = F.col("at"), F.col("status")
        rows = batch.select("job_id", "status", "at", at.alias("created_at"), F.when(status == "running", at).alias("started_at"),
                            F.when(status.isin("succeeded", "failed"), at).alias("finished_at"), F.lit(batch_id).alias("batch_id"))
        table.add(fold(rows).drop("batch_id"), batch_id)
        table.fold_if_due(batch_id)

    run_available_now(transitions.writeStream.foreachBatch(write), f"{root}/_ckpt")
    return table.read().select("job_id", "status", "created_at", "started_at", "finished_at")


# ---------------------------------------------------------------------------
# S-6: auto-analysis, one event a file
# ---------------------------------------------------------------------------
def stream_auto_analysis(spark: SparkSession, lines: DataFrame, name: str = "auto-analysis", silence: str = "30 minutes",
                         watermark: str = "1 day", last_col: str | None = None) -> DataFrame:
    """S-6: the upload hook (J-15), once per file: when it is complete or has been silent.

    Lines are held per file in state; a timer, set anew by every line, fires ``silence`` (event time)
    after the last one (``last_col`` marks a last line and closes a file at once when no
    line before it is missing).  Files still open when the ``availableNow`` run ends are read from the state
    it has committed and analysed as they are.  So every file has one event, whatever the triggers.
    """
    from ..operators import incidents as inc
    from ..plans.pipeline import resolve_files, settled
    root = stream_root(spark, name)

    def events(files: DataFrame) -> DataFrame:
        resolved = settled(resolve_files(files.select("file_id", "text")), "file_id", "text", "source")
        return inc.ai_event(inc.analyze_incidents(inc.auto_analyze_payloads(resolved)), auto=True)

    none = spark.createDataFrame([], CLOSED)
    table = BatchTable(spark, f"{root}/events", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events(none).schema.fields),
                       lambda r: r)

    def write(batch: DataFrame, batch_id: int) -> None:
        scratch = f"{root}/closed/{batch_id}"  # the analysis starts from written files, not from the state's plan
        batch.write.mode("overwrite").parquet(scratch)
        table.add(events(spark.read.schema(CLOSED).parquet(scratch)), batch_id)
        delete_folder(spark, scratch)
        table.fold_if_due(batch_id)

    closed = close_files(event_time(lines), silence, watermark, last_col)
    run_available_now(closed.writeStream.outputMode("append").foreachBatch(write), f"{root}/_ckpt")
    still = f"{root}/open"
    open_files(spark, f"{root}/_ckpt").write.parquet(still)
    return table.read().drop("batch_id").unionByName(events(spark.read.schema(CLOSED).parquet(still)))


# ---------------------------------------------------------------------------
# S-7: stream-static enrichment
# ---------------------------------------------------------------------------
def stream_static_enrich(spark: SparkSession, lines: DataFrame, incidents: DataFrame,
                         name: str = "enrich") -> DataFrame:
    """S-7: rule hits per line left-joined with the static incident (owner, service)."""
    out = stream_root(spark, name)
    inc = incidents.select(F.col("id").alias("file_id"), "owner_user_id", "service_name")
    enriched = line_rule_hits(lines).join(inc, "file_id", "left").select(
        "file_id", "line_no", "category", "owner_user_id", "service_name")
    run_available_now(enriched.writeStream.outputMode("append").format("parquet").option("path", out + "/data"),
                      out + "/_ckpt")
    return spark.read.parquet(out + "/data")
