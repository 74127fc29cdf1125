"""Chunk folds (F) against hand-computed results, splitters against Python, top-k against numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import chunking as ch
from logweave.operators import retrieval as rt


def test_line_chunks_count_the_opening_again():
    # traced by hand: the opening's line is counted again in the next chunk's range (quirk Q-10)
    assert ch.line_chunks("aaaa\nbbbb\ncccc\ndddd", 10, 4) == [
        (0, "aaaa\nbbbb", 0, 1), (1, "bbbb\ncccc", 2, 3), (2, "cccc\ndddd", 4, 5)]
    # without a line break in the overlap the last characters open the next chunk
    assert ch.line_chunks("abcdefgh\nxy", 9, 3, respect_lines=False) == [(0, "abcdefgh", 0, 0), (1, "fgh\nxy", 1, 2)]


def test_line_chunks_keep_every_line():
    text = "\n".join(f"{i:04d} " + "v" * (1 + 7 * i % 53) for i in range(700))
    chunks = ch.line_chunks(text, 333, 0)
    assert "\n".join(c[1] for c in chunks) == text and max(len(c[1]) for c in chunks) <= 333
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert [(c[2], c[3]) for c in ch.line_chunks(text, 10**6)] == [(0, 699)]
    assert ch.line_chunks("", 9, 2) == [] and ch.line_chunks(" \n \n", 2, 1) == []
    assert ch.line_chunks("z" * 90, 8, 0) == [(0, "z" * 90, 0, 0)]  # over-long line kept whole


def test_chunk_log_lines_spark_equals_python(spark):
    texts = {1: "\n".join(f"row {i} " + "y" * (i % 37) for i in range(300)), 2: "", 3: "short", 4: None}
    df = spark.createDataFrame(list(texts.items()), "file_id long, text string")
    got = {}
    for r in ch.chunk_log_lines(df, max_chars=400, overlap_chars=60).collect():
        got.setdefault(r.file_id, []).append((r.chunk_index, r.text, r.start_line, r.end_line))
        assert len(r.checksum) == 16
    for k, t in texts.items():
        assert sorted(got.get(k, [])) == ch.line_chunks(t or "", 400, 60)
    whole = ch.chunk_log_lines(df, max_chars=0)
    assert {(r.file_id, r.text, r.end_line) for r in whole.collect()} == {(1, texts[1], 299), (3, "short", 0)}
    assert "MapInPandas" not in whole._jdf.queryExecution().executedPlan().toString()


def test_sentence_chunks_keep_pending_text_q11():
    assert ch.sentence_chunks("Short one. " + "W" * 50 + ". Tail.", 20, 5)[0] == "Short one."
    got = ch.sentence_chunks("a" * 150 + ". " + "b" * 1999 + ".")
    assert [len(x) for x in got] == [151, 1200, 950]
    with pytest.raises(ValueError):
        ch.windows("abc", 3, 3)  # quirk Q-12


def test_documents_of_over_a_thousand_chunks(spark):
    text = " ".join(f"Sentence {i:05d} of one long document." for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = ch.chunk_documents(df, max_chars=80, overlap=0).orderBy("chunk_index").collect()
    assert len(rows) == 2000 and {r.chunk_total for r in rows} == {2000}
    assert " ".join(r.text for r in rows) == text


def test_sentence_and_window_split_match_python(spark):
    docs = ["First one. Second!  Third?\nfourth\n\n  Next para. Done", "", "no punctuation here",
            "x" * 2600]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string")
    rows = df.select("i", ch.split_paragraphs(F.col("t")).alias("p"),
                     ch.split_long(F.col("t"), 1200, 150).alias("w")).orderBy("i").collect()
    for r, d in zip(rows, docs):
        assert r.p == [p.strip() for p in re.split(r"\n\s*\n", d) if p.strip()]
        assert r.w == ch.windows(d, 1200, 150)
    s = spark.createDataFrame([("a. b! c?  d",)], "t string").select(ch.split_sentences(F.col("t")).alias("s")).collect()[0].s
    assert s == ["a.", "b!", "c?  d"] or s == ["a.", "b!", "c?", "d"]
    assert s == [x.strip() for x in re.split(r"(?<=[.!?])\s+", "a. b! c?  d") if x.strip()]


def test_dedup_chunks_keeps_smallest(spark):
    df = spark.createDataFrame([(2, 0, "aa"), (1, 3, "aa"), (1, 4, "bb")], "file_id long, chunk_index int, text string")
    got = sorted((r.text, r.file_id, r.chunk_index) for r in ch.dedup_chunks(df).collect())
    assert got == [("aa", 1, 3), ("bb", 1, 4)]


def test_cosine_topk_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    V = rng.normal(size=(60, 8))
    Q = rng.normal(size=(7, 8))
    vdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(V)], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(100 + i, [float(x) for x in q]) for i, q in enumerate(Q)], "query_id long, embedding array<double>")
    # tiny blocks force several query and vector blocks
    got = rt.cosine_topk(qdf, vdf, k=3, max_block_vectors=16, max_block_queries=3).collect()
    res = {}
    for r in got:
        res.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    Vn = V / np.linalg.norm(V, axis=1, keepdims=True)
    for i, q in enumerate(Q):
        d = 1 - Vn @ (q / np.linalg.norm(q))
        exp = [int(j) for j in np.lexsort((np.arange(len(d)), d))[:3]]
        assert [v for _, v in sorted(res[100 + i])] == exp


def test_cosine_topk_under_small_partition_coalescing(spark):
    """The settings that made a cogroup-based top-k return nothing must not matter."""
    rng = np.random.default_rng(5)
    V = rng.normal(size=(300, 16))
    vdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(V)], "vec_id long, embedding array<double>")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.minPartitionSize",
                                                "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        q = vdf.select(F.col("vec_id").alias("query_id"), "embedding")
        got = rt.cosine_topk(q, vdf, k=2, exclude_self=True, max_block_vectors=64, max_block_queries=50).count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got == 300 * 2


def test_chunks_are_handed_back_in_bounded_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(ch, "OUT_CHARS", 3000)
    texts = ["\n".join(f"line {i} of text {n}" for i in range(200)) for n in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["file_id", "text"])
    made = [("chunk_index", pa.int32()), ("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]
    out = list(ch.cut_texts(iter([batch]), ["file_id"], lambda t: ch.line_chunks(t, 400, 60), made))
    assert len(out) > 40 and max(sum(map(len, b.column("text").to_pylist())) for b in out) < 3000 + 401
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(n, *c) for n, t in enumerate(texts) for c in ch.line_chunks(t, 400, 60)]


def test_chunk_index_writes_a_file_per_bucket(spark, tmp_path):
    from logweave.sources import sinks
    rows = spark.range(0, 3000, 1, 12).select(F.concat(F.lit("c"), F.col("id") % 2500).alias("chunk_id"), F.lit("t").alias("text"))
    index = sinks.ChunkIndex(spark, str(tmp_path / "index"), "chunk_id string, text string", buckets=5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.upsert(rows.where("chunk_id < 'c2'"), "first")
        index.upsert(rows, "second")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for ingest in ("first", "second"):
        assert len(list((tmp_path / "index" / f"ingest={ingest}").glob("bucket=*/*.parquet"))) == 5
    assert index.read().count() == index.read().select("chunk_id").distinct().count() == 2500
