"""Whole files, however long."""

from pyspark.sql import functions as F

from logweave.sources import files as fls


def test_long_files_are_read_whole(spark, tmp_path):
    size = 10_000_000 + 5_000
    (tmp_path / "long.log").write_bytes(b"x" * (size - 6) + b"\nERROR")
    row = fls.read_log_files(spark, str(tmp_path)).select(F.octet_length("text").alias("n"), F.right("text", F.lit(5)).alias("end")).first()
    assert row.n == size and row.end == "ERROR"
    lines = spark.range(3).select(F.lit(1).alias("file_id"), (F.col("id") * 10_000_000).alias("line_no"), F.expr("repeat('y', 6000000)").alias("line"))
    row = fls.assemble_files(lines).select("n_lines", F.octet_length("text").alias("n")).first()
    assert row.n_lines == 3 and row.n == 18_000_002


def test_chunk_index_writes_only_what_is_new(spark, tmp_path):
    from logweave.sources import sinks
    index = sinks.ChunkIndex(spark, str(tmp_path / "index"), "chunk_id string, doc_id long, text string", buckets=8)
    assert index.read().count() == 0
    rows = spark.range(100).selectExpr("concat('c', id) as chunk_id", "id as doc_id", "concat('t', id) as text")
    assert index.upsert(rows.where("doc_id < 90").union(rows.where("doc_id < 5")), "a").count() == 90
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    for _ in range(2):  # the second run is a retry
        assert index.upsert(rows, "b").count() == 10
    assert index.read().count() == index.read().select("chunk_id").distinct().count() == 100
    assert all(p.stat().st_mtime_ns == before[str(p)] for p in (tmp_path / "index").rglob("*.parquet") if "ingest=a" in str(p))


def test_ingest_written_again_doubles_nothing(spark, tmp_path):
    from logweave.sources import sinks
    jobs = spark.sql("SELECT id, 'succeeded' AS status, timestamp_ntz'2024-01-01 10:00:00' AS created_at, id + 1 AS incident_id FROM range(3)")
    chunks = spark.sql("SELECT id % 3 AS file_id, id AS chunk_index FROM range(9)")
    found = spark.sql("SELECT id % 3 AS file_id, id AS rule_no FROM range(6)")
    for ingest in ("x", "y", "x"):
        paths = sinks.write_ingest(jobs, chunks, found, str(tmp_path / "t"), ingest_id=ingest)
    counts = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    assert counts == {"jobs": 6, "chunks": 18, "findings": 12}
    assert spark.read.parquet(paths["chunks"]).where("incident_id = file_id + 1 and ingest = 'x' and job_id = file_id").count() == 9
