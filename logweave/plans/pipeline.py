"""J-16 run_pipeline: detect -> clean -> classify -> resolve -> entries, chunks, findings, flags.

Everything up to the outputs is a narrow projection per file row.  ``run_pipeline`` writes that
projection once and derives all four outputs from the written frame.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import chunking, detect, parse
from ..operators.findings import detect_findings
from ..session import ensure_checkpoint_dir


def prepare_files(files: DataFrame, text_col: str = "text", forced_col: str | None = None) -> DataFrame:
    """Add ``parser_source``, ``clean_text``, ``classification_source``,
    ``classification_confidence`` and the resolved ``source``.

    Parsing sees the raw text, classification and detection the cleaned
    text (quirk Q-21).  A forced source (C-6) replaces the parser's choice.
    """
    parser = detect.detect_source(F.col(text_col))
    if forced_col is not None:
        parser = detect.forced_source(F.col(forced_col), parser)
    staged = files.withColumn("parser_source", parser).withColumn("clean_text", clean_text(F.col(text_col)))
    scored = detect.classify_source_scored(F.col("clean_text"))
    return (staged
            .withColumn("_cls", scored)
            .withColumn("classification_source", F.col("_cls.source"))
            .withColumn("classification_confidence", F.col("_cls.confidence"))
            .drop("_cls")
            .withColumn("source", detect.resolve_source("parser_source", "classification_source")))


def resolve_files(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Only what the findings need: ``clean_text`` and the resolved ``source``.

    The eight-rule scoring runs only for files the parsers call generic
    (``CASE WHEN`` evaluates its branches lazily).
    """
    parser = detect.detect_source(F.col(text_col))
    staged = files.select("*", parser.alias("parser_source"), clean_text(F.col(text_col)).alias("clean_text"))
    classified = detect.classify_source_scored(F.col("clean_text"))["source"]
    return staged.withColumn("source", detect.resolve_source(F.col("parser_source"), classified))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as values of their own: a generator of one row, which the optimiser doesn't merge.

    Without it, what is built on detection and cleaning repeats their expressions once per
    use, and the plan grows beyond what can be optimised.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def pipeline_findings(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Findings of J-16 for a table of raw log texts."""
    prepared = resolve_files(files, text_col)
    return detect_findings(prepared, text_col="clean_text", source_col="source")


@dataclass(frozen=True)
class PipelineResult:
    """J-16 for a table of files: one row per file, and its entries, chunks, findings and flags."""

    files: DataFrame
    entries: DataFrame
    chunks: DataFrame
    findings: DataFrame
    batches: DataFrame


def run_pipeline(files: DataFrame, text_col: str = "text", key: str = "file_id", forced_col: str | None = None,
                 path: str | None = None) -> PipelineResult:
    """J-16: the whole log pipeline over a table of raw log texts.

    The prepared files (sources and cleaned text) are written under ``path`` (a folder of the
    shared checkpoint directory if none is given) and read back, so that detection,
    cleaning and classification run once for all outputs, and a lost executor costs a re-read.

    ``files``: key, source_type, parser_source, classification_source, classification_confidence.
    ``entries``: D-14 of the raw text.  ``chunks``: F-1 of the cleaned text.  ``findings``: E-7
    of the cleaned text under the resolved source.  ``batches``: line counts (D-15) and Kubernetes flags (D-2).
    """
    spark = files.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-pipeline/{uuid.uuid4().hex}"
    prepared = prepare_files(files.withColumnRenamed(text_col, "text"), "text", forced_col).select(
        key, "text", "clean_text", "source", "parser_source", "classification_source", "classification_confidence")
    prepared.write.mode("overwrite").parquet(path)
    return pipeline_outputs(spark.read.schema(prepared.schema).parquet(path), key)


def pipeline_outputs(prepared: DataFrame, key: str = "file_id") -> PipelineResult:
    """The outputs of J-16 from files as ``prepare_files`` makes them."""
    return PipelineResult(
        files=prepared.select(key, F.col("source").alias("source_type"), "parser_source", "classification_source",
                              "classification_confidence"),
        entries=parse.parse_entries(prepared, "text", key, "parser_source"),
        chunks=chunking.chunk_log_lines(prepared.select(key, F.col("clean_text").alias("text")), key=key),
        findings=detect_findings(prepared, text_col="clean_text", source_col="source", key=key),
        batches=prepared.select(key, "parser_source", *parse.batch_columns("text"), *parse.k8s_flag_columns("text")),
    )
