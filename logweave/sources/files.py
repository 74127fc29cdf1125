"""Scans: log files, documents, attachment manifests (A-1 ... A-5).

Files are read with the ``binaryFile`` source (one row per file, parallel
over files).  Line tables are turned into file texts with
``assemble_files``.  Both keep the whole text; a file is one row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import py_strip


#: write options by which tasks put their files in place side by side; by default the driver moves
#: every file at the end, one after the other
COMMIT_IN_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def read_log_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """A-1: ``(file_id, path, size_bytes, modified_at, text)``, whole files as UTF-8, malformed bytes replaced (U+FFFD).

    ``file_id`` is a 64-bit hash of the path so it is stable across re-reads
    and across executors (no driver-side numbering).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.select(
        F.xxhash64("path").alias("file_id"),
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def assemble_files(lines: DataFrame, key: str = "file_id", order: str = "line_no",
                   line: str = "line") -> DataFrame:
    """Line table -> ``(file_id, text, n_lines)``: all lines joined by LF in order."""
    grouped = lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(line).alias("l")))).alias("_ls"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    text = F.array_join(F.transform("_ls", lambda s: s["l"]), "\n")
    return grouped.select(key, text.alias("text"), "n_lines")


def simple_assemble_files(lines: DataFrame, key: str = "file_id", order: str = "line_no",
                          line: str = "line") -> DataFrame:
    """Join lines per file, without their number."""
    grouped = lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(line).alias("l")))).alias("_ls"))
    return grouped.select(key, F.array_join(F.transform("_ls", lambda s: s["l"]), "\n").alias("text"))


def infer_doc_type(path_col, content_type_col) -> F.Column:
    """A-3: pdf / docx / yaml / markdown from the content type, else by suffix, else text."""
    ct = F.lower(F.coalesce(content_type_col, F.lit("")))
    suffix = F.lower(F.regexp_extract(F.coalesce(path_col, F.lit("")), r"(\.[^./\\]+)$", 1))
    items = []
    for k, v in rules.DOC_SUFFIX_TYPES.items():
        items += [F.lit(k), F.lit(v)]
    by_suffix = F.try_element_at(F.create_map(*items), suffix)
    return (F.when(ct.contains("pdf"), "pdf")
            .when(ct.contains("word") | ct.contains("docx"), "docx")
            .when(ct.contains("yaml"), "yaml")
            .when(ct.contains("markdown"), "markdown")
            .otherwise(F.coalesce(F.when(suffix != "", by_suffix), F.lit("text"))))


def read_documents(spark: SparkSession, path: str, content_type: str | None = None) -> DataFrame:
    """A-2: plain/markdown documents, bytes decoded with bad bytes dropped.

    Returns ``(source, doc_type, size_bytes, text)``; the 20 MB limit (A-4)
    is marked by ``flag_oversize``.
    """
    df = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return df.select(
        F.col("path").alias("source"),
        infer_doc_type(F.col("path"), F.lit(content_type)).alias("doc_type"),
        F.col("length").alias("size_bytes"),
        text.alias("text"),
    )


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in the file system of this machine's paths (``file:``), else null; the folder is made."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    return jvm_path.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_documents(texts: DataFrame, path: str) -> None:
    """A text file per row of the one column ``texts`` has, ended by a newline, all in one folder that executors share.

    Hadoop's local file system starts two processes (``chmod``) for a file, so files of a local path are
    written by Python.  A task's rows have a fixed order, so an attempt that runs again replaces its files by the same.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if texts.rdd.getNumPartitions() < min(parts, spark.sparkContext.defaultParallelism):
        texts = texts.repartition(parts, *texts.columns)  # a file costs more than its bytes: by number, not by size
    folder = local_folder(spark, path)
    if folder is None:
        texts.write.mode("append").options(**COMMIT_IN_TASKS).option("maxRecordsPerFile", 1).text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                own = f"{folder}/_{part}-{attempt}"
                with open(own, "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                os.replace(own, f"{folder}/part-{part:05d}-{n:08d}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    texts.sortWithinPartitions(*texts.columns).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def document_source(path_col, filename_col, metadata_source_col) -> F.Column:
    """A-2: source label = path | filename | metadata.source | "in-memory"."""
    return F.coalesce(path_col, filename_col, metadata_source_col, F.lit("in-memory"))


def flag_oversize(docs: DataFrame, size_col: str = "size_bytes", limit: int = rules.DOC_MAX_BYTES) -> DataFrame:
    """A-4: ``oversize`` marks documents over ``limit`` bytes; all of them stay."""
    return docs.withColumn("oversize", F.col(size_col) > limit)


def safe_filename(name_col) -> F.Column:
    """A-5: last path part of the stripped name, runs of [^a-zA-Z0-9._-] -> "_", empty -> "file"."""
    last = F.element_at(F.split(F.regexp_replace(py_strip(name_col), r"\\", "/"), "/"), -1)
    cleaned = F.regexp_replace(F.coalesce(last, F.lit("")), r"[^a-zA-Z0-9._-]+", "_")
    return F.when(cleaned == "", F.lit("file")).otherwise(cleaned)


def attachment_manifest(files: DataFrame, kind_col: str = "kind", name_col: str = "filename",
                        size_col: str = "size_bytes", content_type_col: str | None = None,
                        content_types: dict[str, list[str]] = rules.ATTACHMENT_CONTENT_TYPES,
                        max_bytes: int = rules.UPLOAD_LIMIT_BYTES) -> DataFrame:
    """A-5: normalised kind, safe name, ``reject_reason`` (null = accepted) and ``oversize``.

    With ``content_type_col`` the content type must be one of its kind's (null counts as
    empty).  Size is only marked, never a reason to reject.
    """
    kind = F.lower(py_strip(F.col(kind_col)))
    reason = F.when(~kind.isin(*rules.ATTACHMENT_KINDS), F.lit("invalid kind"))
    if content_type_col is not None:
        own = F.lower(F.coalesce(F.col(content_type_col), F.lit("")))
        for name, allowed in content_types.items():
            reason = reason.when((kind == name) & ~own.isin(*allowed), F.lit("unsupported content type"))
    return files.select(
        "*",
        kind.alias("kind_norm"),
        safe_filename(F.col(name_col)).alias("safe_name"),
        reason.alias("reject_reason"),
        (F.col(size_col) > max_bytes).alias("oversize"),
    )
