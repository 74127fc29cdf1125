"""Positions and running sums per key without a window over a whole key.

A window partitioned by a business key sorts all of the key's rows in one task.  That is fine up to
a bound, so the largest key is counted first.  Beyond it the rows are dealt by ranges of (key,
order) and written once; every part is summed up per key, the sums of the parts before it are
its offset, and rows are numbered inside their part only.  A key with any share of the rows is
then spread over as many parts as it fills.  Both ways give the same result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: rows of one key that one task may sort
WHOLE_KEY_ROWS = 1_000_000


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right`` by all keys, null equal to null."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(right, on).drop(*[f"_right_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], weight: Column, name: str,
                whole_key_rows: int = WHOLE_KEY_ROWS) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over its key's rows up to and including the row.

    ``order`` must be total within a key.
    """
    whole = Window.partitionBy(*keys)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= whole_key_rows:
        return df.withColumn(name, F.sum(weight).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest // whole_key_rows))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-ranges/{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(parts, *keys, *order).withColumns({"_w": weight, "_p": F.spark_partition_id()})
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("_w").alias("_s"))
    before = F.sum("_s").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_local", F.sum("_w").over(own))
    out = joined(dealt, sums, [*keys, "_p"])
    return out.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos",
           whole_key_rows: int = WHOLE_KEY_ROWS) -> DataFrame:
    """``df`` with ``name``: the row's position (from 1) within its key by ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name, whole_key_rows)


def percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str,
               whole_key_rows: int = WHOLE_KEY_ROWS) -> DataFrame:
    """Exact ``p`` quantile (linear interpolation) and row count ``n`` per key; nulls don't count.

    Up to ``whole_key_rows`` distinct values a key (counted first, by a sketch) Spark's ``percentile``
    holds them in one buffer.  Beyond that what is ranked are distinct values with their counts, dealt
    by ranges; the two values around the wanted rank are picked by the counts before them.
    """
    df = df.where(F.col(value).isNotNull())
    most = df.groupBy(*keys).agg(F.approx_count_distinct(value).alias("_d")).agg(F.max("_d")).first()[0] or 0
    if most <= whole_key_rows:
        return df.groupBy(*keys).agg(F.percentile(value, p).alias(name), F.count(value).alias("n"))
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sum(counts, keys, [F.col(value)], F.col("_c"), "_upto", whole_key_rows)
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("n"))
    rows = joined(upto, total, keys)
    rank = (F.col("n") - 1) * F.lit(p)
    low, high = F.floor(rank), F.ceil(rank)
    holds = lambda r: (F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto"))
    picked = rows.where(holds(low) | holds(high)).groupBy(*keys, "n").agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"))
    return picked.select(*keys, (F.col("_low") + (rank - low) * (F.col("_high") - F.col("_low"))).alias(name), "n")
