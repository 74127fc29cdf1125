"""Streams in several triggers against their batch twins."""

from pyspark.sql import functions as F

from logweave.streaming import ingest as st


def test_sessions_of_the_last_day_come_out(spark, tmp_path):
    """Three triggers: closed and open sessions are those of the whole table."""
    base = "timestamp '2024-01-01 00:00:00'"
    events = spark.range(600).selectExpr(
        "id % 7 as user_id", "if(id % 5 = 0, 'view', 'error') as event_type",
        f"{base} + make_interval(0, 0, 0, 0, 0, 12 * cast(id as int) + 180 * cast(id div 40 as int), 0) as ts")
    for day, part in enumerate((events.where("id < 200"), events.where("id >= 200 and id < 400"), events.where("id >= 400"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert len(list((tmp_path / "in").glob("*.parquet"))) == day + 1
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.stream_incident_sessions(spark, stream).collect()
    want = (events.where("event_type = 'error'").groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("n")).select("user_id", "s.start", "s.end", "n").collect())
    assert sorted(tuple(r)[:4] for r in got) == sorted(tuple(r) for r in want)
    end = events.where("event_type = 'error'").agg(F.max(F.col("ts") - F.expr("interval 1 day"))).first()[0]
    assert all(r.is_open == (r.session_end > end) for r in got) and {r.is_open for r in got} == {True, False}


# ---------------------------------------------------------------------------
# files cut over triggers
# ---------------------------------------------------------------------------
LINES = "file_id long, line_no int, line string, ts timestamp"


def log_table(spark):
    """Files of sf0.001, some 20, with their lines."""
    from logweave.sources import fixtures as fx
    return fx.log_lines(spark, "/root/testdata/sf0.001").select(
        "file_id", "line_no", "line", F.col("ts").cast("timestamp").alias("ts"))


def in_triggers(spark, parts, path):
    """A stream that hands out one of ``parts`` per trigger, in order."""
    import time
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source orders files by their time
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def cut_files(lines):
    """Every file over three parts, the ends first and the beginnings in the middle."""
    third = F.col("line_no") % 3
    return [lines.where((third == 2) | (F.col("line_no") > 40)), lines.where((third == 0) & (F.col("line_no") <= 40)),
            lines.where((third == 1) & (F.col("line_no") <= 40))]


def rows_of(df, columns=None):
    return sorted((tuple(str(x) for x in r) for r in df.select(*(columns or df.columns)).collect()))


def test_ingest_of_cut_files_equals_batch(spark, tmp_path):
    from logweave.plans.pipeline import run_pipeline
    from logweave.sources.files import assemble_files
    lines = log_table(spark)
    stream = in_triggers(spark, cut_files(lines), str(tmp_path / "in"))
    got = st.stream_ingest(spark, stream, fold_every=2)
    want = run_pipeline(assemble_files(lines))
    for name in ("files", "entries", "chunks", "findings", "batches"):
        table = getattr(want, name)
        assert rows_of(got.read(name), table.columns) == rows_of(table), name
    assert got.read("findings").count() > 100


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    lines = log_table(spark)
    order = F.unix_timestamp("ts")
    ends = lines.select(F.min(order).alias("a"), F.max(order).alias("b")).first()
    cut = [ends.a + (ends.b - ends.a) * k // 3 for k in range(1, 3)]
    parts = [lines.where(order > cut[1]), lines.where((order > cut[0]) & (order <= cut[1])), lines.where(order <= cut[0])]
    for window, slide in (("1 day", None), ("2 days", "1 day")):
        stream = in_triggers(spark, parts, str(tmp_path / f"in-{slide}"))
        out = st.stream_window_counts(spark, stream, window, slide, watermark="6 hours", fold_every=2)
        w = F.window("ts", window, slide) if slide else F.window("ts", window)
        hits = st.line_rule_hits(lines).select(w.alias("w"), "category", "severity")
        want = hits.groupBy("w.start", "w.end", "category", "severity").count()
        late = out.late.groupBy(*st.WINDOW_KEYS).agg(F.count("*").alias("n"))
        both = out.counts.unionByName(late).groupBy(*st.WINDOW_KEYS).agg(F.sum("n").alias("n"))
        assert rows_of(both) == rows_of(want) and late.count() > 0 and out.counts.count() > 0
        # what is late ended before the newest row so far less the watermark
        assert out.late.where("window_end > missed").count() == 0


def test_one_analysis_per_file(spark, tmp_path):
    from logweave.operators import incidents as inc
    from logweave.plans.pipeline import resolve_files
    from logweave.sources.files import assemble_files
    lines = log_table(spark).where("file_id < 8")
    stream = in_triggers(spark, cut_files(lines), str(tmp_path / "in"))
    got = st.stream_auto_analysis(spark, stream, silence="1 hour", watermark="30 days")
    files = resolve_files(assemble_files(lines)).select("file_id", "text", "source")
    files.write.parquet(str(tmp_path / "files"))
    payloads = inc.auto_analyze_payloads(spark.read.parquet(str(tmp_path / "files")))
    want = inc.ai_event(inc.analyze_incidents(payloads), auto=True)
    assert rows_of(got, want.columns) == rows_of(want) and got.count() == 8


def test_files_close_by_silence_and_by_their_last_line(spark, tmp_path):
    from logweave.streaming.closing import close_files, open_files
    at = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0)")
    rows = spark.range(240).select((F.col("id") % 4 + 10 * (F.col("id") / 120).cast("int")).alias("file_id"), F.col("id").cast("int").alias("line_no"),
                                   F.concat(F.lit("l"), "id").alias("line"), at.alias("ts"))
    # file 3 says which line is its last: numbers from 0, so its lines are renumbered
    rows = rows.withColumn("line_no", F.when(F.col("file_id") == 3, ((F.col("line_no") - 3) / 4).cast("int")).otherwise(F.col("line_no")))
    rows = rows.withColumn("end", (F.col("file_id") == 3) & (F.col("line_no") == 29))
    early = F.col("line_no") % 2 == 0
    parts = [rows.where((F.col("file_id") < 10) & early), rows.where((F.col("file_id") < 10) & ~early), rows.where("file_id >= 10")]
    stream = in_triggers(spark, parts, str(tmp_path / "in"))
    closed = close_files(stream, "30 minutes", "2 hours", "end")
    seen = []
    st.run_available_now(closed.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())), str(tmp_path / "ckpt"))
    got = {r.file_id: r.n_lines for r in seen}
    assert len(got) == len(seen) and got[3] == 30  # whole, though its last line came before others
    still = {r.file_id: r.n_lines for r in open_files(spark, str(tmp_path / "ckpt")).collect()}
    assert not set(got) & set(still) and {**got, **still} == {f: 30 for f in (0, 1, 2, 3, 10, 11, 12, 13)}


def test_job_states_stay_few_files_over_many_triggers(spark, tmp_path):
    from logweave.operators.store import job_state
    from logweave.streaming.tables import folders
    changes = spark.range(300).selectExpr(
        "id % 40 as job_id", "element_at(array('queued', 'running', 'succeeded'), cast(id % 3 + 1 as int)) as status",
        "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast((id * 37) % 300 as int), 0) as at", "cast(null as string) as error")
    for k in range(25):
        changes.where(f"id % 25 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = []
    real = st.BatchTable.fold_if_due

    def watched(self, batch_id):
        real(self, batch_id)
        counts.append(len(folders(spark, f"{self.path}/batch")) + len(folders(spark, f"{self.path}/fold")))
    st.BatchTable.fold_if_due = watched
    try:
        got = st.stream_job_state(spark, stream, fold_every=5)
    finally:
        st.BatchTable.fold_if_due = real
    assert rows_of(got) == rows_of(job_state(changes), got.columns)
    assert len(counts) == 25 and max(counts) <= 12


def test_chunks_uploaded_again_are_dropped(spark, tmp_path):
    rows = spark.range(20).selectExpr("id as file_id", "cast(id % 3 as int) as chunk_index", "concat('text ', id % 7) as text",
                                      "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int), 0, 0) as ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = st.stream_dedup_chunks(spark, stream)
    assert sorted(r.text for r in got.collect()) == [f"text {k}" for k in range(7)]
