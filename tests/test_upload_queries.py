"""Queries that write files first: what they hand on is written once, and by many tasks."""

import glob
import hashlib
import os
import re

import pytest

from logweave.plans import queries as q
from logweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def test_ingest_retry_repeats_writes_only(spark, monkeypatch):
    def seen(jobs, chunks, findings, root, ingest_id):
        raise Seen([df._jdf.queryExecution().executedPlan().toString() for df in (jobs, chunks, findings)])

    monkeypatch.setattr(q.sinks, "write_ingest", seen)
    with pytest.raises(Seen) as e:
        QUERIES["a7_write_ingest"](spark, SF)
    for plan in e.value.args[0]:
        assert "Exchange" not in plan and "MapInArrow" not in plan


def test_documents_are_written_by_many_tasks(spark, monkeypatch):
    def seen(spark, root):
        raise Seen(root)

    monkeypatch.setattr(q.fls, "read_documents", seen)
    with pytest.raises(Seen) as e:
        QUERIES["a2_read_documents"](spark, SF)
    names = glob.glob(f"{e.value.args[0].removeprefix('file:')}/part-*.txt")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    tasks = {re.search(r"part-(\d+)", x)[1] for x in names}
    assert len(names) >= n and len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("local", [True, False])
def test_written_documents_come_back_whole(spark, tmp_path, monkeypatch, local):
    """A file per row and nothing beside it (a checksum file costs as much again); other file systems get Spark's writer."""
    rows = [(1, "a\n\nb\n"), (2, ""), (3, "3\n"), (4, "é😀 \r\n"), (4, "é😀 \r\n"), (4, "other"), (5, "x" * 300_000)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "sf/documents.parquet"))
    root = str(tmp_path / "docs")
    monkeypatch.setattr(q.st, "stream_root", lambda spark, name: root)
    if not local:
        monkeypatch.setattr(q.fls, "local_folder", lambda spark, path: None)
    got = sorted((r.doc_id, r.n_chars, r.digest) for r in QUERIES["a2_read_documents"](spark, str(tmp_path / "sf")).collect())
    assert got == sorted((i, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    if local:
        assert all(re.fullmatch(r"part-.*\.txt", x) for x in os.listdir(root)) and len(os.listdir(root)) == len(rows)


def test_document_files_are_read_by_few_tasks(spark, tmp_path):
    docs = spark.range(1500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["a2_read_documents"](spark, str(tmp_path)).rdd.getNumPartitions() <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
