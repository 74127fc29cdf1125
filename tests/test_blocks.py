"""Files read in blocks give what their whole texts give."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import chunking, findings
from logweave.plans import pipeline
from logweave.sources import blocks as bl
from logweave.sources import files as fls


def log_file(seed, lines):
    rng = random.Random(seed)
    kinds = ["2024-01-01T00:00:0{} INFO request {}", "ERROR connection refused by host {} {}", "\x1b[31mpanic: worker {} {}\x1b[0m  ", "", "  ",
             'x "GET /a HTTP/1.1" 500 {} {}', "é" * 90 + " timed out {} {}", "same line connection refused", "w" * 700]
    return "\n".join(rng.choice(kinds).format(rng.randrange(9), rng.randrange(5)) for _ in range(lines))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    texts = {"a.log": log_file(1, 3000), "b.log": log_file(2, 40) + "\n", "sub/c.log": "one line with no space left on device", "d.log": "x" * 5000 + "\nCrashLoopBackOff\n" + "y" * 3000}
    for name, text in texts.items():
        (path / name).parent.mkdir(exist_ok=True)
        (path / name).write_text(text)
    (path / "empty.log").write_text("")
    return str(path)


def rows(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_blocks_equal_whole_files(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)  # files of many splits
    try:
        lines = bl.read_lines(spark, folder)
        blocks = bl.file_blocks(lines, block_chars=2000, overlap=500).cache()
        assert blocks.groupBy("file_id").count().agg(F.max("count")).first()[0] > 50
        whole = fls.read_log_files(spark, folder).select(F.sha2("path", 256).alias("file_id"), "path", "text").where("text <> ''")
        # lines, numbers and offsets
        for r in lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "start", "line"))).alias("l")).join(whole, "file_id").collect():
            text = r.text.removesuffix("\n")
            assert "\n".join(x.line for x in r.l) == text and [x.line_no for x in r.l] == list(range(len(r.l)))
            assert all(text[x.start:x.start + len(x.line)] == x.line for x in r.l)
        sources = bl.block_sources(blocks)
        prepared = pipeline.settled(pipeline.prepare_files(whole), "file_id", "clean_text", "parser_source", "classification_source",
                                    "classification_confidence", "source")
        kept = ("file_id", "parser_source", "classification_source", F.round("classification_confidence", 9), "source")
        assert rows(sources, *kept) == rows(prepared, *kept)
        want = findings.detect_findings(prepared, text_col="clean_text", source_col="source")
        got = bl.block_findings(blocks, sources)
        assert rows(got, *want.columns) == rows(want, *want.columns) and want.count() > 100
        want = chunking.chunk_log_lines(prepared.select("file_id", F.col("clean_text").alias("text")))
        assert rows(bl.block_chunks(blocks), *want.columns) == rows(want, *want.columns)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fold_equals_line_chunks():
    rng = random.Random(9)
    for _ in range(300):
        text = "\n".join(rng.choice(["", " ", "ab", "x" * rng.randrange(80), "word " * rng.randrange(9)]) for _ in range(rng.randrange(30)))
        for limit, overlap, respect in ((100, 20, True), (60, 0, True), (80, 30, False), (10, 9, True)):
            assert list(chunking.fold_lines(text.splitlines(), limit, overlap, respect)) == chunking.line_chunks(text, limit, overlap, respect)
