"""Shared helpers of the training-data operators.

* ``shared_table`` writes a frame to the cluster's shared folder and reads it back:
  the lineage is cut, so a lost executor costs a re-read and not a recomputation.
* ``text_buffer`` / ``words`` / ``word_hashes`` view an Arrow text column as one byte
  array and find, and hash, all its words with a few numpy passes (no Python loop per
  word, whole texts always).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: random 64-bit value per byte and the odd base of the polynomial word hash
_RNG = np.random.default_rng(20240917)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
#: bytes handled at once by the vectorised helpers; longer texts are taken whole
PIECE_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="logweave-llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the written rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(spark: SparkSession, per_partition: int = 4) -> int:
    """Number of key slices: follows the session's shuffle partitions, which follow the data."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one behind the other, and their offsets (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES):
    """(first row, rows, bytes, offsets) of consecutive row runs of about ``limit`` bytes."""
    data, offsets = text_buffer(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end - row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE):
    """Start, end and row of every maximal run of non-white bytes inside a row."""
    inside = ~white[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    row = np.searchsorted(offsets[1:], start, "right")
    return start, end, row


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run ``data[start:end]`` (runs are not empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    inside = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
    values = BYTE_VALUE[data[inside + np.repeat(start, size)]]
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(values * _powers(int(size.max()))[inside], first))


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs ``start .. start + size``, one behind the other."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
