"""Operator 9, BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file is a public ``tokenizers`` JSON with word-end BPE (its path is a
parameter; it is read once on the driver, and about 3 MB of tables go to the tasks).
Each task cuts its texts at white space, encodes every distinct piece of a batch once and
looks the pieces up again.  All new words of a batch lie in one flat symbol array; a
round finds the rank of every adjacent pair by binary search over the sorted pair keys,
takes the lowest rank of each word and merges its occurrences from the left.

Defined results: a null text counts as empty and has no tokens; very long texts are encoded whole; repeated rows are encoded
alike; an empty table gives an empty result; further columns stay as they are in
``encode`` / ``decode``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import gather

#: distinct pieces that a task remembers before it starts anew
CACHE_PIECES = 400_000
#: text bytes handled at once
BATCH_CHARS = 2_000_000
#: white space as the vocabulary's pattern language defines it (fixed values)
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: what ``str.split`` takes for white space besides (fixed values)
NOT_SPACES = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class WordBpe:
    """Tables and encoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_rank = order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        names = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token.encode()
        self.name_size = np.array([len(n) for n in names], np.int64)
        self.name_start = np.cumsum(self.name_size) - self.name_size
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self._compiled = None
        self.reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compiled = None
        self.reset()

    def reset(self) -> None:
        self._known: dict[str, int] = {}
        self._word_no = {"\n": -1} | {"\n" + t: k for k, t in enumerate(self.special)}
        self._word_ids = np.array([*self.special.values()], np.int64)
        self._word_sizes = np.ones(len(self.special), np.int64)
        self._ids = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)

    # -- words -> ids -------------------------------------------------------------
    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and the number of ids of each."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[data]
        symbol[np.cumsum(size) - 1] = self.last[data[np.cumsum(size) - 1]]
        owner = np.repeat(np.arange(len(words)), size)
        done_symbol, done_owner = [], []
        top = np.int64(len(self.merged))
        while len(symbol) > 1:
            pair = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
            rank = np.where((self.pair_keys[at] == pair) & (owner[:-1] == owner[1:]), self.pair_rank[at], top)
            rank = np.append(rank, top)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbol)))
            live = np.repeat(lowest < top, sizes)
            if not live.all():  # finished words leave the array
                done_symbol.append(symbol[~live])
                done_owner.append(owner[~live])
                lowest = np.repeat(lowest, sizes)[live]
                symbol, owner, rank = symbol[live], owner[live], rank[live]
                if not len(symbol):
                    break
            else:
                lowest = np.repeat(lowest, sizes)
            hit = rank == lowest
            at = np.flatnonzero(hit)
            # of pairs that overlap (runs of one symbol), every other one from the left
            run = np.append(True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        if len(symbol):
            done_symbol.append(symbol)
            done_owner.append(owner)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(words))

    # -- pieces (runs without white space) -> ids ---------------------------------
    def _words_of(self, pieces: list[str]) -> list[str]:
        """Words of all pieces, a line feed between pieces; special tokens with one before them."""
        if self._compiled is None:
            import regex
            pattern = self.pattern.replace(r"[^\s", rf"[^{SPACES}").replace(r"\s", f"[{SPACES}]")
            self._compiled = regex.compile(pattern + r"|\n")
        joined = "\n".join(pieces)
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        return self._compiled.findall(joined.lower())

    def _special_words_of(self, piece: str) -> list[str]:
        out: list[str] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", piece):
            out += ["\n" + part] if part in self.special else self._words_of([part]) if part else []
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces that are not known yet."""
        marked = [p for p in pieces if "<|" in p and self.special]
        plain = [p for p in pieces if not ("<|" in p and self.special)]
        flat = self._words_of(plain)
        for k, p in enumerate(marked):
            flat += ["\n"] * bool(k or plain) + self._special_words_of(p)
        number = self._word_no
        new = [w for w in dict.fromkeys(flat) if w not in number]
        if new:
            for w in new:
                number[w] = len(number) - 1  # the separator is -1
            ids, sizes = self.merge_words([w.encode() for w in new])
            self._word_ids = np.concatenate([self._word_ids, ids])
            self._word_sizes = np.concatenate([self._word_sizes, sizes])
        at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        piece = np.cumsum(at < 0)[at >= 0]
        at = at[at >= 0]
        sizes = self._word_sizes[at]
        ids = self._word_ids[gather((np.cumsum(self._word_sizes) - self._word_sizes)[at], sizes)]
        for p in plain + marked:
            self._known[p] = len(self._known)
        self._ids = np.concatenate([self._ids, ids])
        self._sizes = np.concatenate([self._sizes, np.bincount(piece, sizes, len(pieces)).astype(np.int64)])

    def split(self, text: str) -> list[str]:
        if any(c in text for c in NOT_SPACES):
            return [p for p in re.split(f"[{SPACES}]+", text) if p]
        return text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and the number of ids of each text."""
        if len(self._known) > CACHE_PIECES:
            self.reset()
        cut = [self.split(t) if t else [] for t in texts]
        new = list({p: None for pieces in cut for p in pieces if p not in self._known})
        if new:
            self._learn(new)
        counts = np.array([len(p) for p in cut], np.int64)
        known = np.fromiter((self._known[p] for pieces in cut for p in pieces), np.int64, int(counts.sum()))
        sizes = self._sizes[known]
        start = (np.cumsum(self._sizes) - self._sizes)[known]
        ids = self._ids[gather(start, sizes)]
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        return ids, np.diff(np.append(0, ends))

    # -- ids -> text ----------------------------------------------------------------
    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 text of each id run: the tokens' names joined by one space (the file names no decoder)."""
        length = self.name_size[ids] + 1
        out = np.full(int(length.sum()), 32, np.uint8)
        to = np.cumsum(length) - length
        out[gather(to, length - 1)] = self.names[gather(self.name_start[ids], length - 1)]
        ends = np.append(0, np.cumsum(length))[np.cumsum(np.append(0, sizes))]
        raw = out.tobytes()
        return [raw[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _text_runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= BATCH_CHARS:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids`` (array of int)."""
    codec = WordBpe(path)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in _text_runs(texts):
                flat, sizes = codec.encode(texts[a:b])
                column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``text``."""
    codec = WordBpe(path)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            sizes = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            out = codec.decode(np.asarray(column.flatten(), np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in out], pa.string())],
                                             [*batch.schema.names, text])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: token count, digest of its ids and digest of the text decoded from them."""
    codec = WordBpe(path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _text_runs(texts):
                flat, sizes = codec.encode(texts[a:b])
                raw = flat.astype("<u4").tobytes()
                ends = np.append(0, np.cumsum(sizes)) * 4
                columns = {
                    "doc_id": batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(flat, sizes)], pa.string()),
                }
                if with_ids:
                    columns["token_ids"] = pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, schema)
