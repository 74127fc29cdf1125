"""Log files of any size as line-aligned blocks (A-1), with findings and chunks over them.

``read_lines`` lets Spark split the files; a line's number and character offset in its file come from
per-split counts summed over the splits before it.  ``file_blocks`` joins lines to blocks of
about ``block_chars`` characters and gives each the characters around it.  Everything downstream
works on blocks: sources by aggregating what the blocks show, findings by matches that start
in a block (searched with the text around it), chunks by one streaming pass over a file's
blocks.  No task holds a file, whatever its size; results equal those of the whole text.

A match longer than ``overlap`` characters that crosses a block's edge is the one case that isn't found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import clean_text
from ..operators import chunking, detect
from ..operators.findings import described, search_matches
from ..session import ensure_checkpoint_dir

BLOCK_CHARS = 4_000_000
OVERLAP = 8_192


def read_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``(file_id, path, line_no, start, line)`` of all text files below ``path``, split by Spark.

    ``file_id`` is the SHA-256 of the path, so two files never share it; ``start`` is the line's
    offset in the lines joined by LF.  Bytes that aren't UTF-8 become U+FFFD.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.make_valid_utf8("value").alias("line"))
    raw = raw.withColumn("m", F.monotonically_increasing_id())
    size = F.length("line") + F.lit(1)
    splits = raw.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"), F.min("m").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
                           F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    own = Window.partitionBy("path", "split").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)  # one split
    lines = raw.withColumn("inside", F.coalesce(F.sum(size).over(own), F.lit(0))).join(splits, ["path", "split"])
    return lines.select(F.sha2("path", 256).alias("file_id"), "path", (F.col("m") - F.col("first") + F.col("lines_before")).alias("line_no"),
                        (F.col("inside") + F.col("chars_before")).alias("start"), "line")


def file_blocks(lines: DataFrame, block_chars: int = BLOCK_CHARS, overlap: int = OVERLAP, key: str = "file_id") -> DataFrame:
    """``(key, block, first_line, text, before, after)``: whole lines joined by LF, and the text around them.

    A block holds the lines that start in its range of ``block_chars`` characters.
    """
    if 2 * overlap > block_chars:
        raise ValueError("a block must be at least twice as long as the overlap")
    grouped = lines.groupBy(key, F.floor(F.col("start") / block_chars).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))  # bounded by block_chars and a line
    blocks = grouped.select(key, "block", F.col("l")[0]["line_no"].alias("first_line"),
                            F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    # two neighbours on each side hold ``overlap`` characters; only these ends go through the window
    w = Window.partitionBy(key).orderBy("block")
    ends = blocks.select(key, "block", F.left("text", F.lit(overlap)).alias("head"), F.right("text", F.lit(overlap)).alias("tail"))
    lag = lambda k: F.lag("tail", k).over(w)
    lead = lambda k: F.lead("head", k).over(w)
    before = F.concat(F.when(lag(2).isNotNull(), F.concat(lag(2), F.lit("\n"))).otherwise(""), F.concat(lag(1), F.lit("\n")))
    after = F.concat(F.lit("\n"), lead(1), F.when(lead(2).isNotNull(), F.concat(F.lit("\n"), lead(2))).otherwise(""))
    ends = ends.select(key, "block", F.right(F.coalesce(before, F.lit("")), F.lit(overlap)).alias("before"),
                       F.left(F.coalesce(after, F.lit("")), F.lit(overlap)).alias("after"))
    return blocks.join(ends, [key, "block"])


def block_sources(blocks: DataFrame, key: str = "file_id") -> DataFrame:
    """C-1 ... C-5 of whole files from their blocks: ``parser_source``, classification and ``source``."""
    # only a file's first block starts the text (a pattern may be anchored there); others follow a line break
    follows = F.col("before") != ""
    shown = blocks.select(key, F.concat(F.when(follows, F.lit(".\n")).otherwise(""), "text", F.left("after", F.lit(256))).alias("raw"),
                          F.concat(F.when(follows, F.lit("\n")).otherwise(""), clean_text(F.col("text"))).alias("clean"))
    hits = [F.bool_or(F.col("raw").rlike(rules.ci(detect.any_tested(p)))).alias(f"p{i}") for i, (_, p) in enumerate(rules.PARSER_PATTERNS)]
    counts = [F.sum(F.regexp_count("clean", F.lit(rules.ci(rules.first_tested(p))))).alias(f"c{i}") for i, (_, p) in enumerate(rules.SOURCE_RULES)]
    per = shown.groupBy(key).agg(*hits, *counts)
    parser = F.lit("generic")
    for i in range(len(rules.PARSER_PATTERNS) - 1, -1, -1):
        parser = F.when(F.col(f"p{i}"), F.lit(rules.PARSER_PATTERNS[i][0])).otherwise(parser)
    scored = detect.scored_counts(F.array(*[F.col(f"c{i}").cast("int") for i in range(len(rules.SOURCE_RULES))]))
    out = per.select(key, parser.alias("parser_source"), scored.alias("_s")).select(
        key, "parser_source", F.col("_s.source").alias("classification_source"), F.col("_s.confidence").alias("classification_confidence"))
    return out.withColumn("source", detect.resolve_source("parser_source", "classification_source"))


def block_findings(blocks: DataFrame, sources: DataFrame, key: str = "file_id", path: str | None = None) -> DataFrame:
    """E-7 of whole files: like ``detect_findings`` over the cleaned text of each file.

    A block's matches are those that start in it; equal evidence of a rule is folded over the
    file's blocks, and matches are numbered by the counts of the blocks before.  The matches are
    written under ``path`` (a folder of the shared checkpoint directory if none is given), so that the
    counts and the findings take one search.
    """
    spark = blocks.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-matches/{uuid.uuid4().hex}"
    parts = blocks.join(sources.select(key, "source"), key).select(
        key, "block", F.col("source").alias("_source"), clean_text(F.col("before")).alias("b"), clean_text(F.col("text")).alias("t"),
        clean_text(F.col("after")).alias("a"))
    parts = parts.select(key, "block", "_source", F.length("b").alias("_from"), (F.length("b") + F.length("t")).alias("_to"),
                         F.concat("b", "t", "a").alias("_text"))
    found = search_matches(parts, [key, "block", "_source", "_from", "_to"], "_text", "_source", distinct=False)
    # what starts on the line break behind a block's text is the block's own
    own = found.where((F.col("start") >= F.col("_from")) & (F.col("start") <= F.col("_to"))).select(
        key, "block", "_source", "rule_no", "match_no", "evidence")
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    counts = own.groupBy(key, "rule_no", "block").agg(F.count(F.lit(1)).alias("n"), F.min("match_no").alias("first"))
    before = Window.partitionBy(key, "rule_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    counts = counts.select(key, "rule_no", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = own.join(counts, [key, "rule_no", "block"]).withColumn("match_no", (F.col("match_no") - F.col("first") + F.col("base")).cast("int"))
    first = numbered.groupBy(key, "rule_no", "evidence", "_source").agg(F.min("match_no").alias("match_no"))
    return described(first, [key])


def block_chunks(blocks: DataFrame, max_chars: int = rules.LOG_CHUNK_MAX, overlap_chars: int = rules.LOG_CHUNK_OVERLAP,
                 key: str = "file_id") -> DataFrame:
    """F-1 of whole files: one pass over a file's blocks in order, holding one block and an unfinished chunk."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.select(key, "block", clean_text(F.col("text")).alias("text")).repartition(parts, key).sortWithinPartitions(key, "block")
    schema = f"{key} {blocks.schema[key].dataType.simpleString()}, {chunking.LINE_CHUNKS}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = [pa.null(), pa.int32(), pa.string(), pa.int32(), pa.int32()], []

        def listed():
            for batch in batches:
                kinds[0] = batch.schema.field(0).type
                yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                              [key, "chunk_index", "text", "start_line", "end_line"])

        for k, group in groupby(listed(), key=lambda r: r[0]):
            lines = (line for _, text in group for line in (text.splitlines() if text else [""]))
            for c in chunking.fold_lines(lines, max_chars, overlap_chars):
                out.append((k, *c))
                if len(out) >= 1000:
                    yield flush()
                    out = []
        if out:
            yield flush()

    return ordered.mapInArrow(cut, schema).withColumn("checksum", chunking.checksum(F.col("text")))
