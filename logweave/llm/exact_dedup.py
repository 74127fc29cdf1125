"""Operator 7, exact dedup: a sharded cuckoo-filter index over live content digests.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became one
space; the digest is the SHA-256 of that text.  ``CuckooIndex`` keeps short
fingerprints in two-choice buckets; each slot points to its stored key, so a hit is
verified against the bucket's content, a delete removes exactly the right slot, and an
overflow rebuilds a filter of twice the size from the stored keys.

Spark side: every map task first runs its rows through a small index of its own and
passes on one row per digest (so a group of copies sends one row per task, whatever its
size).  The rows are then dealt by digest to shards, each of which runs its index; there are
shards enough for ``SHARD_KEYS`` rows each, so a shard's memory doesn't grow with the input.

Defined results: very long texts are digested whole; a null text counts as empty; null ``doc_id`` sorts last, so it is the
keeper only when the whole group has none; of repeated rows of the keeper's id one stays;
an empty table gives an empty result; further columns of the input are ignored by
``dedup`` and carried through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, slices

BUCKET_SLOTS = 4
MAX_KICKS = 200
#: digests that one map task holds before it passes them on
LOCAL_KEYS = 100_000
#: digests that a shard holds, on average at most
SHARD_KEYS = 500_000


class CuckooIndex:
    """Cuckoo filter whose slots refer to stored keys; values are kept beside the keys."""

    def __init__(self, buckets: int = 1024):
        self.keys: list[bytes | None] = []
        self.values: list = []
        self._free: list[int] = []
        self._layout(buckets)

    def _layout(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [[] for _ in range(buckets)]
        self.refs = [[] for _ in range(buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:12], "little")
        mark = ((h >> 64) & 0xFFFF) or 1
        one = h & self.mask
        return mark, one, one ^ ((mark * 0x5BD1E995) & self.mask)

    def _slot(self, key: bytes) -> tuple[int, int] | None:
        mark, one, two = self._places(key)
        for b in (one, two):
            prints = self.prints[b]
            if mark in prints:  # a filter hit: verify against the bucket's content
                for s, p in enumerate(prints):
                    if p == mark and self.keys[self.refs[b][s]] == key:
                        return b, s
        return None

    def find(self, key: bytes) -> int | None:
        """Reference of a live key, or None."""
        at = self._slot(key)
        return None if at is None else self.refs[at[0]][at[1]]

    def insert(self, key: bytes, value) -> int:
        """Store a key that is not live yet; returns its reference."""
        if self._free:
            ref = self._free.pop()
            self.keys[ref], self.values[ref] = key, value
        else:
            ref = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        if not self._place(ref):
            self._resize()
        return ref

    def _place(self, ref: int) -> bool:
        mark, one, two = self._places(self.keys[ref])
        for b in (one, two):
            if len(self.prints[b]) < BUCKET_SLOTS:
                self.prints[b].append(mark)
                self.refs[b].append(ref)
                return True
        b = two
        for kick in range(MAX_KICKS):
            s = kick % BUCKET_SLOTS
            self.prints[b][s], mark = mark, self.prints[b][s]
            self.refs[b][s], ref = ref, self.refs[b][s]
            b ^= (mark * 0x5BD1E995) & self.mask
            if len(self.prints[b]) < BUCKET_SLOTS:
                self.prints[b].append(mark)
                self.refs[b].append(ref)
                return True
        return False  # the key in hand is still stored: the resize places it

    def _resize(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._layout(buckets)
            if all(self._place(ref) for ref, key in enumerate(self.keys) if key is not None):
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at is None:
            return False
        b, s = at
        ref = self.refs[b].pop(s)
        self.prints[b].pop(s)
        self.keys[ref] = self.values[ref] = None
        self._free.append(ref)
        return True

    def items(self):
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)

    def __len__(self) -> int:
        return len(self.keys) - len(self._free)


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """row_no, doc_id and content digest of every row, written to the shared folder."""
    return shared_table(docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id",
                                    F.unhex(F.sha2(normalised(text), 256)).alias("digest")), "digests")


_GROUP = "digest binary, no_id boolean, keep_id long, keep_row long, group_size long"


def _frame(index: CuckooIndex) -> pd.DataFrame:
    rows = [(k, *v[0], v[1]) for k, v in index.items()]
    return pd.DataFrame(rows, columns=["digest", "no_id", "keep_id", "keep_row", "group_size"])


def _add(index: CuckooIndex, key: bytes, first: tuple, size: int) -> None:
    ref = index.find(key)
    if ref is None:
        index.insert(key, [first, size])
    else:
        held = index.values[ref]
        held[1] += size
        if first < held[0]:
            held[0] = first


def _local_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for batch in batches:
        for key, absent, doc, row in zip(batch["digest"], batch["no_id"], batch["keep_id"], batch["row_no"], strict=True):
            _add(index, bytes(key), (bool(absent), int(doc), int(row)), 1)
        if len(index) >= LOCAL_KEYS:
            yield _frame(index)
            index = CuckooIndex()
    yield _frame(index)


def _shard_groups(rows: pd.DataFrame) -> pd.DataFrame:
    index = CuckooIndex()
    for key, absent, doc, row, size in zip(rows["digest"], rows["no_id"], rows["keep_id"], rows["keep_row"], rows["group_size"], strict=True):
        _add(index, bytes(key), (bool(absent), int(doc), int(row)), int(size))
    return _frame(index)


def shard_of(digest="digest", shards: int = 64):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def shards_for(spark, rows: int) -> int:
    return max(slices(spark), -(-rows // SHARD_KEYS))


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: keeper (smallest doc_id, then first row) and group size.

    ``rows`` is a written table, so that its rows are counted from its footers.
    """
    spark = rows.sparkSession
    local = (rows.select("row_no", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("keep_id"), "digest")
             .mapInPandas(_local_groups, _GROUP))
    n = shards_for(spark, rows.count())
    found = (local.withColumn("shard", shard_of("digest", n)).groupBy("shard")
             .applyInPandas(lambda pdf: _shard_groups(pdf), _GROUP))
    return found.withColumn("keep_id", F.when(~F.col("no_id"), F.col("keep_id"))).drop("no_id")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too."""
    rows = digests(docs, text)
    found = groups(rows).select("digest", "keep_id", "keep_row", "group_size")
    return (rows.join(found, "digest")
            .select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows and digests are written together, so the row number that names a keeper is the
    same in both reads.
    """
    held = shared_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                    F.col("doc_id"), F.monotonically_increasing_id().alias("row_no"),
                                    F.unhex(F.sha2(normalised(text), 256)).alias("digest")), "rows")
    keepers = groups(held).select(F.col("keep_row").alias("row_no"))
    return held.join(keepers, "row_no", "left_semi").select("row.*")


_INDEX = "digest binary, live long"


def _apply_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Live counts after a shard's changes; ``first`` says whether a digest was new."""
    index = CuckooIndex()
    out = []
    for kind, key, count in sorted(zip(rows["kind"], map(bytes, rows["digest"]), rows["live"], strict=True)):
        ref = index.find(key)
        if kind == 0:  # the index as it stands
            index.insert(key, int(count))
        elif kind == 1:  # insertions
            out.append((key, "insert", ref is None, int(count)))
            if ref is None:
                index.insert(key, int(count))
            else:
                index.values[ref] += int(count)
        else:  # deletions
            held = index.values[ref] if ref is not None else 0
            out.append((key, "delete", held > 0, min(held, int(count))))
            if ref is not None and held <= count:
                index.delete(key)
            elif ref is not None:
                index.values[ref] = held - int(count)
    out += [(k, "live", True, v) for k, v in index.items()]
    return pd.DataFrame(out, columns=["digest", "kind", "hit", "live"])


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Insert and delete documents in a live index (``digest, live``).

    ``inserts`` and ``deletes`` hold ``digest`` rows; both are pre-aggregated by digest.
    Result rows by ``kind``: ``insert`` (``hit``: the digest was new, so the document
    stays), ``delete`` (``hit``: it was live) and ``live`` (the index afterwards).
    Insertions of one call are applied before its deletions.
    """
    count = lambda df, kind: df.groupBy("digest").agg(F.count("*").alias("live")).withColumn("kind", F.lit(kind))
    rows = (index.select("digest", "live").withColumn("kind", F.lit(0))
            .unionByName(count(inserts, 1)).unionByName(count(deletes, 2)))
    n = shards_for(index.sparkSession, index.count() + inserts.count())
    return (rows.withColumn("shard", shard_of("digest", n)).groupBy("shard")
            .applyInPandas(lambda pdf: _apply_shard(pdf), "digest binary, kind string, hit boolean, live long"))
