"""Operator 4, sharding by balanced label propagation (DataFrame operations only).

Documents with equal texts are linked.  Every document starts in a shard by hash, and a text's
label is the shard that most of its copies are in (votes by text and shard, combined before the
shuffle).  In each round the shards' loads are compared with their capacity, an even share of
all rows: of a shard that is too full so many texts leave, by a hash, that the rest fits, each for
the shard with room for it that has most of its copies, weighted by the room left.  Rounds
go on until every shard fits or nothing moves.  A text moves whole, so copies gather and no edge
of it crosses shards.  Texts with more copies than a shard holds (fewer than there are shards) can't be
whole: their rows fill what the others leave, one text after the other, in as few shards as
that takes; rows without links come last.  ``cuts`` counts linked pairs across shards.

The law is ``rows``: shard sizes differ by at most one.  After the rounds each shard keeps
its first rows, smaller texts first, up to its quota, and the surplus fills the others.
Positions inside a shard (``slot``, from 0) are numbered by counting rows per (shard,
hash bucket), summing over buckets, and numbering inside a bucket, so no window holds a
shard or a text.

Defined results: a null text has size 1, the checksum of the empty text and links with
nothing; rows with null or repeated doc_id are placed like any other; very long texts count by their
digest; an empty table gives an empty result; further columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, slices

SHARDS = 8
#: bound on the rounds; they end sooner when nothing moves
ROUNDS = 20
#: texts with more copies than this share of all rows are numbered by row, not by text
LARGE = 1 / 1000


def numbered(rows: DataFrame, by: str, first, out: str, together=None) -> DataFrame:
    """``out``: gapless number from 0 of each row among those with equal ``by``.

    ``first`` is a small integer; lower ones come first, otherwise the order is by a hash of
    ``row_no``, or of ``together`` to keep rows with an equal value of it next to each other.
    """
    n = slices(rows.sparkSession, 8)
    spread = F.xxhash64("row_no", F.lit(7)) if together is None else F.coalesce(F.xxhash64(together), F.xxhash64("row_no", F.lit(7)))
    placed = rows.withColumn("_near", spread).withColumn("_bucket", first * n + F.pmod("_near", F.lit(n)))
    counts = placed.groupBy(by, "_bucket").agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(by, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))  # at most 2 n buckets
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("_near", "row_no")) - 1
    return (placed.withColumn("_inside", inside).join(starts, [by, "_bucket"])
            .withColumn(out, F.col("_start") + F.col("_inside")).drop("_near", "_bucket", "_inside", "_start"))


def propagate(groups: DataFrame, capacity: int, shards: int, rounds: int) -> DataFrame:
    """``groups`` (key, copies, votes, label) with the labels at which every shard fits, or no move helps."""
    past = None
    for turn in range(rounds):
        loads = {r["label"]: r["load"] for r in groups.groupBy("label").agg(F.sum("copies").alias("load")).collect()}  # one row a shard
        load = [loads.get(s, 0) for s in range(shards)]
        over = [max(0, x - capacity) for x in load]
        if not any(over) or load == past:
            break
        past = load
        pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("label") + 1)
        luck = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1_000_003)) / 1_000_003
        leaves = luck < pick([o / x if x else 0 for o, x in zip(over, load, strict=True)])
        wishes = []
        for s in range(shards):
            room = capacity - load[s]
            if room > 0:
                tie = F.pmod(F.xxhash64("key", F.lit(turn), F.lit(s)), F.lit(1_000_003)) / 1_000_003
                score = (F.element_at("votes", s + 1) + 1) * (room / capacity) * (tie + 0.01)
                wishes.append(F.when(F.col("copies") <= room, F.struct(score.alias("score"), F.lit(s).alias("shard"))))
        if not wishes:
            break
        best = F.array_max(F.array_compact(F.array(*wishes)))["shard"]
        groups = shared_table(groups.withColumn("label", F.when(leaves & best.isNotNull(), best).otherwise(F.col("label"))), "labels")
    return groups


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    nodes = shared_table(docs.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("key")), "nodes")
    total = nodes.count()
    capacity = total // shards
    start = F.pmod(F.xxhash64("row_no"), F.lit(shards)).cast("int")
    votes = nodes.where("key is not null").groupBy("key", start.alias("shard")).agg(F.count("*").alias("n"))
    most = F.max_by("shard", F.struct("n", F.xxhash64("key", "shard"))).alias("label")
    groups = shared_table(votes.groupBy("key").agg(
        F.sum("n").alias("copies"), most,
        F.array(*[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)) for s in range(shards)]).alias("votes")).where("copies > 1"), "groups")
    giants = [bytes(r["key"]) for r in groups.where(F.col("copies") > capacity).select("key").orderBy("key").collect()]  # fewer than shards
    labels = propagate(groups.where(F.col("copies") <= capacity), capacity, shards, rounds).select("key", "copies", "label")

    rows = nodes.select("row_no", "key").join(labels, "key", "left")
    large = F.col("copies") > F.greatest(F.lit(total * LARGE), F.lit(2.0))
    ordered = shared_table(numbered(rows.where("label is not null").withColumnRenamed("label", "shard"), "shard", F.when(large, 1).otherwise(0), "place",
                                    F.when(~large, F.col("key"))), "ordered")
    held = {r["shard"]: r["count"] for r in ordered.groupBy("shard").count().collect()}  # one number a shard
    quota, since, target = F.lit(0), 0, F.lit(None).cast("int")
    for s in range(shards):
        own = capacity + (s < total % shards)
        quota = F.when(F.col("shard") == s, own).otherwise(quota)
        free = max(0, own - held.get(s, 0))
        target = F.when((F.col("turn") >= since) & (F.col("turn") < since + free), s).otherwise(target)
        since += free
    stay = ordered.where(F.col("place") < quota).select("row_no", "shard")
    rank = F.lit(shards)
    for i, key in enumerate(giants):
        rank = F.when(F.col("key") == F.lit(key), i).otherwise(rank)
    fill = rows.where("label is null").select("row_no", F.lit(0).alias("all"), rank.alias("rank"))
    surplus = ordered.where(F.col("place") >= quota).select("row_no", F.lit(0).alias("all"), F.lit(shards).alias("rank"))
    refilled = numbered(fill.unionByName(surplus), "all", F.col("rank"), "turn").select("row_no", target.alias("shard"))
    final = numbered(stay.unionByName(refilled), "shard", F.lit(0), "slot")
    return (nodes.join(final, "row_no")
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def cuts(sharded: DataFrame) -> DataFrame:
    """Linked pairs of rows (equal checksum and size), and those of them in different shards."""
    per = sharded.groupBy("text_crc32", "size", "shard").agg(F.count("*").cast("double").alias("n"))
    per = per.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("linked"),
                   F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0)).alias("cut"))
