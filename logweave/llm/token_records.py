"""Operator 11, token ids in length-delimited binary records with an offset index.

A record holds one document's ids.  Its frame is: payload length (u64), masked checksum
of these eight bytes (u32), payload, masked checksum of the payload (u32), all little
endian.  A payload starts with the doc_id (i64), a flag byte (1: the doc_id is null) and
the bytes per id (2 or 4), followed by the ids.  The checksum is CRC-32, rotated right by
15 bits plus a constant, so that checksums stored among the data don't disturb one another.

``write`` deals documents out by ranges of doc_id; each task encodes its rows in order and
appends the frames to files of its own attempt under the shared folder.  The offset index is
a Parquet table beside them, which Spark commits: a record counts only if the index names it, so
files left by a lost executor or a repeated attempt are ignored.  ``read`` goes from the index
to the frames, in file order or, with ``seed``, in a shuffled order that every run repeats.

Defined results: a null text counts as empty and holds the end id alone; null doc_ids come
first; rows of one doc_id are ordered by the hash of their text, equal rows stay apart (one
record each); very long texts are one record; an empty table gives an index without rows;
further columns don't matter and aren't carried.  A frame whose lengths or checksums
don't fit raises ``ValueError``.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gather, shared_dir

#: added to the rotated checksum (fixed value of this masking)
MASK = 0xA282EAD8
HEAD = "<qBB"
HEAD_SIZE = struct.calcsize(HEAD)
#: distinct pieces whose ids a task remembers before it starts anew
CACHE_PIECES = 800_000
#: pieces given to the library as one text
JOINED_PIECES = 500
#: characters encoded at once
BATCH_CHARS = 2_000_000
#: a task goes on with its next file beyond so many bytes
FILE_BYTES = 1 << 30
#: white space before other characters, then these: no match of the vocabulary's pattern spans two of them
PIECE = re.compile(r"\s*\S+|\s+")
#: what ``\s`` takes for white space here but not in the library; such texts are encoded whole
NOT_SPACES = re.compile("[\x1c-\x1f]")
INDEX = "doc_id long, part int, file string, offset long, size long, first long, n_tokens long"


def masked(data) -> int:
    """Masked CRC-32 of a byte string."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: memoryview) -> memoryview:
    """The payload of one whole frame."""
    size = int.from_bytes(data[:8], "little")
    if len(data) != size + 16 or masked(data[:8]) != int.from_bytes(data[8:12], "little"):
        raise ValueError("record length is damaged")
    if masked(data[12:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("record payload is damaged")
    return data[12:-4]


def filesystem(path: str):
    """File system and local path of a folder's address."""
    from pyarrow.fs import FileSystem
    if "://" not in path:
        path = re.sub(r"^file:/+", "/", path)
    return FileSystem.from_uri(path)


class _Numbers(dict):
    """Numbers of pieces in the order of their first look-up; ``new`` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """The tokenizers library, asked once for each distinct piece of the texts.

    Many pieces go to the library as one text where they start with white space and end without, since no
    match crosses from the one to the other; the ids' bytes tell the pieces apart again.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_str(spec)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        vocab = self._tokenizer.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(self._tokenizer.get_vocab().values()) + 1, np.int64)
        self._bytes[list(vocab.values())] = [len(t) for t in vocab]  # a character stands for each byte
        for i, t in self._tokenizer.get_added_tokens_decoder().items():
            self._bytes[i] = len(t.content.encode())
        self._reset()

    def _reset(self) -> None:
        self._number = _Numbers()
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0
        self._start, self._size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], first: int) -> None:
        """Ids of the pieces numbered from ``first``."""
        open_end = np.fromiter((x[0].isspace() and not x[-1].isspace() for x in new), bool, len(new))
        joined = [x for x, j in zip(new, open_end.tolist(), strict=True) if j]
        alone = [x for x, j in zip(new, open_end.tolist(), strict=True) if not j]
        ids = self._encode(["".join(joined[k:k + JOINED_PIECES]) for k in range(0, len(joined), JOINED_PIECES)])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        ends = np.cumsum(np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in joined), np.int64, len(joined)))
        cuts = np.searchsorted(np.cumsum(self._bytes[flat]), ends, "right")
        self._remember(first + np.flatnonzero(open_end), flat, np.diff(cuts, prepend=0))
        ids = self._encode(alone)
        self._remember(first + np.flatnonzero(~open_end), np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))),
                       np.fromiter(map(len, ids), np.int64, len(ids)))

    def _remember(self, numbers: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        end, total = self._used, len(flat)
        while len(self._flat) < end + total:
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while len(self._start) < len(self._number):
            self._start, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._size))
        self._flat[end:end + total] = flat
        self._start[numbers] = end + np.cumsum(sizes) - sizes
        self._size[numbers] = sizes
        self._used = end + total

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self._number) > CACHE_PIECES:
            self._reset()
        whole = {i for i, t in enumerate(texts) if NOT_SPACES.search(t)}
        cut = [PIECE.findall(t) if i not in whole else [] for i, t in enumerate(texts)]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        first = len(self._number)
        known = np.fromiter(map(self._number.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if self._number.new:
            self._learn(self._number.new, first)
            self._number.new = []
        sizes = self._size[known]
        flat = self._flat[gather(self._start[known], sizes)] if len(known) else np.zeros(0, np.uint32)
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in whole:
            out[i] = np.array(self._encode([texts[i]])[0], np.uint32)
        return out


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(spec: str) -> PieceEncoder:
    """The encoder of a vocabulary; a Python worker keeps one, with its pieces, over its tasks."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(spec)
    return _ENCODERS[key]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BATCH_CHARS:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write records and index under the shared folder ``path``.

    ``tokenizer`` is the vocabulary file (read here, sent to the tasks); ``end_id`` is appended to
    each document.  Ids take two bytes if all of them fit.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    records = f"{path}/records"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(records)
        codec = encoder(spec)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, name, at, first, files = None, "", 0, 0, 0
        try:
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for a, b in _runs(texts):
                    rows = []
                    for doc_id, ids in zip(doc_ids[a:b], codec.encode(texts[a:b]), strict=True):
                        if end_id is not None:
                            ids = np.append(ids, np.uint32(end_id))
                        width = 2 if not len(ids) or ids.max() < 65536 else 4
                        record = frame(struct.pack(HEAD, doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes())
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            fs.create_dir(folder, recursive=True)
                            name, at, files = f"part-{part:06d}-{files:04d}-{attempt}.rec", 0, files + 1
                            out = fs.open_output_stream(f"{folder}/{name}")
                        out.write(record)
                        rows.append((doc_id, part, name, at, len(record), first, len(ids)))
                        at, first = at + len(record), first + len(ids)
                    names = ("doc_id", "part", "file", "offset", "size", "first", "n_tokens")
                    kinds = (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4)
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})
        finally:
            if out is not None:
                out.close()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # equal rows differ in ``row`` only: a doc_id with very many rows is spread over tasks too
    order = ["doc_id", "digest", "row"]
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(run, INDEX).write.parquet(f"{path}/index"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """Every record's place and ``start``, the ids of all records before it."""
    rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    # one row per written part, so the window is as long as the number of parts
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = base.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "first")


def read(spark: SparkSession, path: str, seed: int | None = None, as_binary: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, from the files.

    With ``seed`` the rows come in a random order which the seed fixes (over partitions and in
    them); ``as_binary`` gives the ids as little-endian unsigned 32-bit integers.
    """
    records = f"{path}/records"
    rows = index(spark, path)
    if seed is not None:
        rows = rows.withColumn("draw", F.xxhash64("start", "part", "offset", F.lit(seed)))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(parts, "draw").sortWithinPartitions("draw")
    schema = f"doc_id long, start long, n_tokens long, ids {'binary' if as_binary else 'array<int>'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(records)
        opened: dict[str, object] = {}
        for batch in batches:
            rows = batch.to_pylist()
            for a, b in _spans(rows):
                out = []
                for r in rows[a:b]:
                    if r["file"] not in opened:
                        for f in opened.values():
                            f.close()
                        opened = {r["file"]: fs.open_input_file(f"{folder}/{r['file']}")}
                    data = memoryview(opened[r["file"]].read_at(r["size"], r["offset"]))
                    payload = unframe(data)
                    doc_id, null, width = struct.unpack(HEAD, payload[:HEAD_SIZE])
                    ids = np.frombuffer(payload[HEAD_SIZE:], f"<u{width}")
                    if len(ids) != r["n_tokens"] or (None if null else doc_id) != r["doc_id"]:
                        raise ValueError("index and record differ")
                    out.append((r["doc_id"], r["start"], len(ids), ids.astype("<u4").tobytes() if as_binary else ids.astype(np.int32)))
                kind = pa.binary() if as_binary else pa.list_(pa.int32())
                yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, v, k in zip(
                    ("doc_id", "start", "n_tokens", "ids"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)})
        for f in opened.values():
            f.close()

    return rows.select("doc_id", "file", "offset", "size", "n_tokens", "start").mapInArrow(run, schema)


def _spans(rows: list[dict], limit: int = 16_000_000) -> Iterator[tuple[int, int]]:
    """Runs of index rows whose records have about ``limit`` bytes."""
    at = total = 0
    for i, r in enumerate(rows):
        total += r["size"]
        if total >= limit:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(rows):
        yield at, len(rows)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` and read them back: doc_id, start, n_tokens and the checksum of the ids of each."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return read(spark, path, as_binary=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
