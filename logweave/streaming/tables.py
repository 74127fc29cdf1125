"""Tables that micro-batches write to, one folder a batch, folded as they grow.

``BatchTable`` holds what ``foreachBatch`` functions produce.  A batch overwrites its own folder,
so a replayed batch leaves no doubled row.  Every ``every`` batches the rows so far are folded
into one folder by the table's own rule (newest version per key, or merged partial
aggregates) and what lies before the fold before it is deleted: a reader meets at most one
fold and ``2 * every`` batch folders, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop path and file system of a folder (local, HDFS or an object store alike)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = hadoop_path(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key's last batch (a key's rows of one batch stay together)."""
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*keys, "batch_id"], "left_semi").select(*rows.columns)


class BatchTable:
    """One folder per batch and, every ``every`` batches, a fold of all before it."""

    def __init__(self, spark: SparkSession, path: str, schema, fold: Fold, every: int = 10, buckets: str | None = None):
        self.spark, self.path, self.fold, self.every, self.buckets = spark, path.rstrip("/"), fold, every, buckets
        self.schema = schema

    def _write(self, rows: DataFrame, path: str) -> None:
        w = rows.write.mode("overwrite")
        (w.partitionBy(self.buckets) if self.buckets else w).parquet(path)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch's rows (again: the same folder)."""
        self._write(rows.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{self.path}/batch/{batch_id:010d}")

    def batch(self, batch_id: int) -> DataFrame:
        """One batch's rows as they were written."""
        return self.spark.read.schema(f"{self.schema}, batch_id long").parquet(f"{self.path}/batch/{batch_id:010d}")

    def parts(self, upto: int | None = None) -> list[str]:
        """Folders that together hold every batch up to ``upto``: the last fold and the batches behind it."""
        done = [f for f in folders(self.spark, f"{self.path}/fold") if upto is None or int(f) < upto]
        batches = folders(self.spark, f"{self.path}/batch")
        base = int(done[-1]) if done else -1
        return ([f"{self.path}/fold/{done[-1]}"] if done else []) + [
            f"{self.path}/batch/{b}" for b in batches if base < int(b) and (upto is None or int(b) <= upto)]

    def rows(self, upto: int | None = None) -> DataFrame:
        """All rows with ``batch_id``, not yet folded into one version."""
        reader, paths = self.spark.read.schema(f"{self.schema}, batch_id long"), self.parts(upto)
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, batch_id long")
        out = None
        for p in paths:  # folder by folder, as buckets are found below each
            df = reader.parquet(p)
            out = df if out is None else out.unionByName(df)
        return out

    def read(self, upto: int | None = None) -> DataFrame:
        """The table as of a batch: its rows folded."""
        return self.fold(self.rows(upto))

    def fold_if_due(self, batch_id: int) -> None:
        """At every ``every``-th batch write the fold; delete what only older folds need.

        The fold before this one and the batches behind it stay, so that this batch can be replayed.
        """
        if (batch_id + 1) % self.every:
            return
        self._write(self.read(batch_id), f"{self.path}/fold/{batch_id:010d}")
        keep_from = batch_id - self.every
        for kind in ("fold", "batch"):
            for f in folders(self.spark, f"{self.path}/{kind}"):
                if int(f) < keep_from or (kind == "batch" and int(f) == keep_from):
                    delete_folder(self.spark, f"{self.path}/{kind}/{f}")
