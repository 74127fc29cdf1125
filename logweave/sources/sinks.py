"""Sinks (A-7 ... A-9).

Writes are plain ``DataFrame.write`` jobs (tasks write their own files; the
driver only commits), partitioned by day so later scans prune by date.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import py_quoted


def write_ingest(jobs: DataFrame, chunks: DataFrame, findings: DataFrame, root: str,
                 mode: str = "append", ingest_id: str | None = None) -> dict[str, str]:
    """A-7: one job row per file plus its chunks and findings, parquet by the job's day.

    ``jobs`` is written first and read back; chunks and findings take job_id, created_at
    and, where jobs have them, incident_id and attachment_id from the job of their file, so
    all rows of a job lie in one day.  With ``ingest_id`` the rows go to the ingest's own partition
    of each table, which a repeated run overwrites: a retry doubles nothing.
    """
    paths = {name: f"{root.rstrip('/')}/{name}" for name in ("jobs", "chunks", "findings")}
    own_paths = {n: f"{p}/ingest={ingest_id}" if ingest_id else p for n, p in paths.items()}
    mode = "overwrite" if ingest_id else mode
    jobs.withColumn("day", F.to_date("created_at")).write.mode(mode).partitionBy("day").parquet(own_paths["jobs"])
    own = [c for c in ("incident_id", "attachment_id") if c in jobs.columns]
    written = jobs.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in jobs.schema.fields)}, day date").parquet(own_paths["jobs"])
    keys = written.groupBy(F.col("id").alias("file_id")).agg(
        F.max(F.struct("created_at", F.col("id").alias("job_id"), *own, "day")).alias("_j")).select("file_id", "_j.*")
    for name, df in (("chunks", chunks), ("findings", findings)):
        carried = [c for c in keys.columns if c == "file_id" or c not in df.columns]
        df.join(keys.select(carried), "file_id", "left").write.mode(mode).partitionBy("day").parquet(own_paths[name])
    return paths


def upsert_doc_chunks(new: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A-8: add chunks whose content id is not yet in the index (left-anti join + union)."""
    fresh = new.join(index.select(key), key, "left_anti")
    return index.unionByName(fresh.select(*index.columns))


class ChunkIndex:
    """A-8 as a stored index: chunks by content id, in buckets of the id's digest.

    An upsert reads the ids of the buckets it touches and nothing else, and writes only the chunks that
    are new, under its own ``ingest`` folder (a retry overwrites that folder).  What is in the index is
    never rewritten.  A bucket's new chunks are written by one task, so an upsert adds ``buckets`` files at
    most, whatever its size.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "chunk_id", buckets: int = 256):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """All chunks, with ``ingest`` and ``bucket``."""
        schema = f"{self.schema}, ingest string, bucket int"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def upsert(self, new: DataFrame, ingest_id: str) -> DataFrame:
        """Write the chunks of ``new`` whose id isn't in the index yet (one per id); returns them.

        ``new`` is read twice, first for its ids alone: give written rows where making them is costly.
        """
        rows = new.withColumn("bucket", self._bucket())
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # ``buckets`` at most
        there = self.read().where(F.col("bucket").isin(touched) & (F.col("ingest") != ingest_id)).select("bucket", self.key)
        rest = [c for c in rows.columns if c not in (self.key, "bucket")]
        once = rows.groupBy("bucket", self.key).agg(F.min(F.struct(*rest)).alias("_r")).select("bucket", self.key, "_r.*")
        path = f"{self.path}/ingest={ingest_id}"
        fresh = once.join(there, ["bucket", self.key], "left_anti")
        fresh.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(path)


def py_dict_repr(json_text: Column) -> Column:
    """``repr(json.loads(s))`` for a flat JSON object: ``{'k': 69, 's': 'x', 'b': True, 'n': None}``."""
    m = F.from_json(json_text, "map<string,variant>")
    quoted = py_quoted

    def item(e):
        v = F.to_json(e["value"])
        val = (F.when(F.startswith(v, F.lit('"')), quoted(e["value"].cast("string")))
               .when(v == "true", "True").when(v == "false", "False").when(v.isNull() | (v == "null"), "None").otherwise(v))
        return F.concat(quoted(e["key"]), F.lit(": "), val)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), item), ", "), F.lit("}"))


def iso_utc(ts: Column) -> Column:
    """``datetime.isoformat()`` of an aware UTC time (fraction only when non-zero)."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("+00:00"))


def export_log_lines(events: DataFrame, ts: str = "ts", level: Column | None = None, source: Column | None = None,
                     message: Column | None = None, metadata_json: str = "props") -> DataFrame:
    """A-9: ``"{ts} {level} {source}: {message} | {metadata}"`` per event."""
    lvl = level if level is not None else F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    src = source if source is not None else F.lit("events")
    msg = message if message is not None else F.concat(F.col("event_type"), F.lit(" "), F.col("value").cast("string"))
    line = F.concat(iso_utc(F.col(ts)), F.lit(" "), lvl, F.lit(" "), src, F.lit(": "), msg, F.lit(" | "),
                    py_dict_repr(F.col(metadata_json)))
    return events.select("*", line.alias("line"))
