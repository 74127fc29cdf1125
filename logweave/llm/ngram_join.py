"""Operator 8, n-gram Jaccard join with adaptive multi-match prefixes.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D`` after lower-casing A-Z; a
document's set holds its distinct 5-word shingles (64-bit hashes of the words' bytes), or
its whole word sequence if that is shorter.  Documents link when
``100 * |x ∩ y| >= 75 * |x ∪ y|``.

A prefix with multiplicity l holds the first ``n - ceil(0.75 n) + l`` shingles of a set in
one global order.  Linked sets share at least l shingles in their prefixes for every l, and
sets with different l_x, l_y share at least ``min(l_x, l_y)`` in theirs.  Hence:

1. *Who can have a partner at all.*  With l = n / 8, a set needs l prefix shingles that
   another document has in its prefix too.  Tasks send 32-bit prints of the shingles that
   are new in their batch to key slices and get back, per document, how many are shared
   (a print that collides only lets a document through).  A shingle that repeats inside a
   batch is sent once, so a passage that many documents hold does not pile up.
2. *Equal sets* fold into one class (grouped by a 128-bit digest of the set).
3. *Adaptive prefixes.*  Shingles are ordered from rare to frequent by a count sketch of
   all classes.  Each class takes the l that minimises list entries read plus candidates
   to verify (by Markov at most entries / l).  Candidates have enough common prefix
   shingles and fitting sizes; whole sets decide.
4. *Inside groups.*  Classes that share a minimum hash, directly or through others, form a
   group.  A group is compared in blocks of ``BLOCK`` classes: a task counts the common
   prefix shingles of two blocks, verifies the candidates, and passes on the components
   it finds, at most one row per class.  So many near copies of one text make no row per
   pair, and no task holds more than two blocks of them.
   *Between groups.*  Rows (shingle, class) of the prefixes meet by shingle, only shingles
   that several groups hold; pairs with enough meetings are verified.
5. Components of all verified links.

Defined results: very long texts enter whole; null and empty texts have the empty set and link with nothing; rows with
a null ``doc_id`` link with nothing and have a null component; repeated rows share their
component; an empty table gives an empty result; further columns are ignored by
``near_components`` and kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, gather, mix, pieces, shared_table, slices, word_hashes, words
from .components import components

SHINGLE = 5
PERCENT = 75
#: cells of the count sketch (2 MB), its sum goes through the driver
SKETCH = 1 << 18
#: bits of the filter by which representatives' texts are picked
CELLS = 1 << 25
#: minimum hashes by which groups are formed
STAR_KEYS = 4
#: classes and bytes of sets in a block of a group, and matrix columns held at once
BLOCK = 6144
BLOCK_BYTES = 16_000_000
#: classes of a block that are compared by one matrix
TILE = 2048
COLUMNS = 4096
#: light pairs listed at once
PAIRS = 4_000_000
MAX_MATCHES = 64
#: rows of a block of documents (its ordinals take 16 bits) and the ordinal of no document
BLOCK_ROWS = 32_768
_NONE = np.uint16(0xFFFF)
_FACTORS = np.random.default_rng(11).integers(1, 2**62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text."""
    for row, rows, data, offsets in pieces(column):
        data = LOWER[data]
        start, end, owner = words(data, offsets)
        h = word_hashes(data, start, end)
        bounds = np.searchsorted(owner, np.arange(rows + 1))
        with np.errstate(over="ignore"):
            run = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
            for j in range(SHINGLE):
                run += h[j:len(h) - SHINGLE + 1 + j] * _FACTORS[j] if len(run) else run
            run = mix(run + np.uint64(SHINGLE))
            for i in range(rows):
                a, b = bounds[i], bounds[i + 1]
                if b - a >= SHINGLE:
                    yield row + i, np.unique(run[a:b - SHINGLE + 1])
                elif b > a:
                    yield row + i, mix(np.array([(h[a:b] * _FACTORS[:b - a]).sum() + np.uint64(b - a)], np.uint64))
                else:
                    yield row + i, np.zeros(0, np.uint64)


def needed(n):
    """Smallest overlap that a set of size n has with any linked set."""
    return (PERCENT * n + 99) // 100


def prefix_size(n, matches):
    return np.minimum(n, n - needed(n) + matches)


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


# -- 1. who can have a partner ---------------------------------------------------------
_PARTS = "slice long, block long, a binary, b binary, c binary, d binary"


def _block_parts(batches: Iterator[pa.RecordBatch], n_slices: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    parts = (batch.slice(x, BLOCK_ROWS) for batch in batches for x in range(0, batch.num_rows, BLOCK_ROWS))
    for number, batch in enumerate(parts):
        block = task << 32 | number
        size = np.zeros(batch.num_rows, np.int64)
        marks, prefix = [], []
        for i, hashes in shingle_sets(batch.column("text")):
            size[i] = len(hashes)
            marks.append(digest(hashes))
            prefix.append(hashes[:prefix_size(len(hashes), max(1, len(hashes) // 8))])
        matches = np.maximum(1, size // 8)
        lengths = np.array([len(p) for p in prefix], np.int64)
        ordinal = np.repeat(np.arange(batch.num_rows), lengths)
        values, inverse, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *prefix]), return_inverse=True, return_counts=True)
        shared = np.bincount(ordinal[counts[inverse] > 1], minlength=batch.num_rows)
        owner = np.full(len(values), _NONE, np.uint16)
        owner[inverse] = ordinal
        owner[counts > 1] = _NONE
        ids = batch.column("doc_id")
        out = [(-1 - block, block, np.asarray(ids.fill_null(0), np.int64).tobytes(), np.stack([size, matches, shared]).tobytes(),
                b"".join(marks), np.asarray(ids.is_null(), np.uint8).tobytes())]
        spread = mix(values ^ np.uint64(0x5851F42D4C957F2D))
        where = ((spread >> np.uint64(32)) % np.uint64(n_slices)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, prints, owner = where[order], spread[order].astype(np.uint32), owner[order]
        cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
        for x, y in zip(cuts, [*cuts[1:], len(where)]):  # noqa: B905
            out.append((int(where[x]), block, prints[x:y].tobytes(), owner[x:y].tobytes(), None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)],
                                         ["slice", "block", "a", "b", "c", "d"])


def _slice_replies(rows: pd.DataFrame) -> pd.DataFrame:
    """How many of each document's prints in this slice another document has too."""
    if rows["slice"].iloc[0] < 0:  # a block's own documents: passed on
        return rows
    prints = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["a"]])
    owner = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["b"]])
    block = np.repeat(rows["block"].to_numpy(), [len(x) // 4 for x in rows["a"]])
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    hit = order[(np.append(False, same) | np.append(same, False))]
    hit = hit[owner[hit] != _NONE]
    out = []
    for b in np.unique(block[hit]):
        who, count = np.unique(owner[hit[block[hit] == b]], return_counts=True)
        out.append((-1, b, who.tobytes(), count.astype(np.uint32).tobytes(), None, None))
    return pd.DataFrame(out, columns=list(rows.columns))


def _block_documents(rows: pd.DataFrame) -> pd.DataFrame:
    own = rows[rows["c"].notna()].iloc[0]
    ids = np.frombuffer(own["a"], np.int64)
    size, matches, shared = np.frombuffer(own["b"], np.int64).reshape(3, -1).copy()
    for who, count in zip(rows["a"][rows["c"].isna()], rows["b"][rows["c"].isna()], strict=True):
        shared[np.frombuffer(who, np.uint16)] += np.frombuffer(count, np.uint32)
    return pd.DataFrame({"doc_id": ids, "no_id": np.frombuffer(own["d"], np.uint8).astype(bool), "n": size,
                         "digest": [own["c"][i:i + 16] for i in range(0, 16 * len(ids), 16)], "open": shared >= matches})


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, no_id, n, digest of the set, and ``open``: may have a partner (written)."""
    n = slices(docs.sparkSession, 8)
    parts = docs.select("doc_id", "text").mapInArrow(lambda it: _block_parts(it, n), _PARTS)
    replies = parts.groupBy("slice").applyInPandas(_slice_replies, _PARTS)
    return shared_table(replies.groupBy("block").applyInPandas(
        _block_documents, "doc_id long, no_id boolean, n long, digest binary, open boolean"), "profiles")


# -- 2. classes and their sets ---------------------------------------------------------
def _membership(ids: DataFrame) -> np.ndarray:
    """Bits of the hash cells of all ``doc_id`` in ids: a filter of fixed size (4 MB)."""
    width = CELLS // 1024

    def bits(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(width, bool)
        own[rows["cell"].to_numpy() % width] = True
        return pd.DataFrame({"part": [int(rows["cell"].iloc[0]) // width], "bits": [np.packbits(own).tobytes()]})

    cells = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")).distinct().withColumn("part", F.floor(F.col("cell") / width))
    out = np.zeros((1024, width // 8), np.uint8)
    for r in cells.groupBy("part").applyInPandas(bits, "part long, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """node, digest, rep (smallest doc_id), n and hashes of each set that may have a partner (written).

    A filter of fixed size lets through the representatives (and few others) where texts
    are read, so texts are not shuffled; the join by digest is exact.
    """
    reps = shared_table(found.where("open and not no_id").groupBy("digest").agg(F.min("doc_id").alias("rep")), "reps")
    held = docs.sparkSession.sparkContext.broadcast(_membership(reps.select(F.col("rep").alias("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column("cell"), np.int64)
            batch = batch.filter(pa.array((held.value[cell // 8] >> (7 - cell % 8).astype(np.uint8)) & 1 == 1, pa.bool_()))
            sets = [(digest(h), len(h), h.tobytes()) for _, h in shingle_sets(batch.column("text"))]
            mark, n, hashes = zip(*sets, strict=True) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(mark, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes, pa.binary())],
                                             ["doc_id", "digest", "n", "hashes"])

    texts = docs.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CELLS)).alias("cell"), "text")
    sets = texts.mapInArrow(run, "doc_id long, digest binary, n long, hashes binary").join(reps, "digest").where("doc_id = rep").drop("doc_id")
    return shared_table(sets.dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()), "sets")


# -- 3. adaptive prefixes ---------------------------------------------------------------
def sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all shingles of all classes by ``SKETCH`` hash cells (a bounded array)."""
    cells, parts = SKETCH, 16

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                held = np.frombuffer(b"".join(batch.column("hashes").slice(x, 500).to_pylist()), np.uint64)
                total += np.bincount((held % np.uint64(cells)).astype(np.int64), minlength=cells)
        for p, x in enumerate(np.split(total, parts)):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "cells"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "cells": [sum(np.frombuffer(x, np.int64) for x in rows["cells"]).tobytes()]})

    found = sets.select("hashes").mapInArrow(count, "part int, cells binary").groupBy("part").applyInPandas(add, "part int, cells binary").collect()
    out = np.zeros(cells, np.int64)
    for r in found:
        out[r["part"] * (cells // parts):(r["part"] + 1) * (cells // parts)] = np.frombuffer(r["cells"], np.int64)
    return out


def adaptive_prefix(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Prefix of a set, rare shingles first, and its multiplicity of least estimated cost.

    A cell's count less what chance puts into a cell estimates how many sets hold a
    shingle.  The order depends on the shingle and the sketch alone, so it is global.
    """
    n = len(hashes)
    mean = counts.mean()
    held = counts[(hashes % np.uint64(len(counts))).astype(np.int64)] - mean - 4 * np.sqrt(mean)
    held = np.maximum(1, held)
    order = np.lexsort((hashes, np.log2(held).astype(np.int64)))
    read = np.cumsum(held[order])
    options = [x for x in (2**k for k in range(20)) if x <= min(MAX_MATCHES, needed(n))]
    cost = [read[prefix_size(n, x) - 1] * (1 + n / 8 / x) for x in options]
    matches = options[int(np.argmin(cost))]
    return hashes[order[:prefix_size(n, matches)]], matches


# -- 4. inside groups -------------------------------------------------------------------
def _star_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, nodes = [], []
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            h = np.frombuffer(raw, np.uint64)
            keys += [int(mix(h + np.uint64(7919 * (k + 1))).min().view(np.int64)) for k in range(STAR_KEYS)]
            nodes += [node] * STAR_KEYS
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], ["token", "node"])


def group_labels(sets: DataFrame) -> DataFrame:
    """node, component: classes with an equal minimum hash, directly or through others."""
    keys = sets.select("node", "hashes").mapInArrow(_star_keys, "token long, node long")
    hubs = keys.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("held")).where("held > 1").drop("held")
    return components(keys.join(hubs, "token").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of every left and every right set.

    Elements that many sets of both sides hold are counted by products of 0/1 matrices,
    the others by listing the few pairs that hold them.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate([np.zeros(0, np.uint64), *side]) for side in (left, right)]
    row = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    common = np.intersect1d(*flat)
    if not len(common):
        return out
    at = [np.minimum(np.searchsorted(common, f), len(common) - 1) for f in flat]
    hit = [common[p] == f for p, f in zip(at, flat, strict=True)]
    at, row = [p[h] for p, h in zip(at, hit, strict=True)], [r[h] for r, h in zip(row, hit, strict=True)]
    held = [np.bincount(p, minlength=len(common)) for p in at]
    heavy = held[0] * held[1] > out.size // 128
    number = np.cumsum(heavy) - 1
    for x in range(0, int(heavy.sum()), COLUMNS):
        m = []
        for side, p, r in zip((left, right), at, row, strict=True):
            own = heavy[p] & (number[p] >= x) & (number[p] < x + COLUMNS)
            cells = np.zeros((len(side), COLUMNS), np.float32)
            cells[r[own], number[p[own]] - x] = 1
            m.append(cells)
        out += m[0] @ m[1].T
    own = ~heavy[at[0]]
    token, first = at[0][own], row[0][own]
    order = np.argsort(at[1], kind="stable")
    start, partners = (np.cumsum(held[1]) - held[1])[token], held[1][token]
    total = np.cumsum(partners)
    cuts = np.searchsorted(total, np.arange(PAIRS, (total[-1] if len(total) else 0) + PAIRS, PAIRS), "right")
    for x, y in zip([0, *cuts], cuts):  # noqa: B905
        pair = np.repeat(first[x:y], partners[x:y]) * len(right) + row[1][order[gather(start[x:y], partners[x:y])]]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
    return out


def _tile_links(low, high, sets, prefix) -> np.ndarray:
    """Which sets of two tiles link: sizes, common prefix shingles, then whole sets."""
    size = [np.array([len(sets[i]) for i in side], np.int64) for side in (low, high)]
    matches = [np.array([prefix[i][1] for i in side]) for side in (low, high)]
    fit = 100 * np.minimum.outer(*size) >= PERCENT * np.maximum.outer(*size)
    fit &= _overlaps(*[[prefix[i][0] for i in side] for side in (low, high)]) >= np.minimum.outer(*matches)
    rows, cols = np.flatnonzero(fit.any(1)), np.flatnonzero(fit.any(0))
    out = np.zeros_like(fit)
    if len(rows):
        both = _overlaps([sets[i] for i in low[rows]], [sets[j] for j in high[cols]]).astype(np.int64)
        out[np.ix_(rows, cols)] = 100 * both >= PERCENT * (np.add.outer(size[0][rows], size[1][cols]) - both)
    return out & fit


def _resolve(rows: pd.DataFrame, counts: np.ndarray) -> pd.DataFrame:
    """Links (node, smallest node it reaches) among the classes of each group in ``rows``."""
    out = []
    for _, own in rows.groupby("component", sort=False):
        if len(own) < 2:
            continue
        node, block = own["node"].to_numpy(), own["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in own["hashes"]]
        prefix = [adaptive_prefix(x, counts) for x in sets]
        sides = [np.array_split(x, -(-len(x) // TILE)) for x in (np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max()))]
        same = block.min() == block.max()
        tiles = [(low, high, _tile_links(low, high, sets, prefix)) for i, low in enumerate(sides[0]) for high in sides[1][i if same else 0:]]
        label, far = node.copy(), np.iinfo(np.int64).max
        while True:  # smallest label among neighbours until nothing changes
            best = label.copy()
            for low, high, link in tiles:
                best[low] = np.minimum(best[low], np.where(link, best[high][None, :], far).min(1))
                best[high] = np.minimum(best[high], np.where(link, best[low][:, None], far).min(0))
            if (best == label).all():
                break
            label = best
        out.append(pd.DataFrame({"a": label, "b": node})[label != node])
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def inside_links(sets: DataFrame, labels: DataFrame, counts) -> DataFrame:
    """Links inside groups (written); small groups share tasks, large ones go by pairs of blocks."""
    n = slices(sets.sparkSession, 2)
    member = labels.join(sets.select("node", "n"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks")
    member = member.drop("n").join(member.groupBy("component").agg(blocks), "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.expr("sequence(0, int(blocks) - 1)")).alias("other")
    placed = (sets.select("node", "hashes").join(member, "node").select("node", "hashes", "component", "blocks", "block", other)
              .withColumn("key", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(n)))
                          .otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))))
    return shared_table(placed.select("key", "component", "block", "node", "hashes").groupBy("key")
                        .applyInPandas(lambda pdf: _resolve(pdf, counts.value), "a long, b long"), "links")


# -- and between groups -------------------------------------------------------------------
def candidates(sets: DataFrame, labels: DataFrame, counts) -> DataFrame:
    """Pairs of classes of different groups with enough common prefix shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                part = batch.slice(x, 500)
                found = [adaptive_prefix(np.frombuffer(raw, np.uint64), counts.value) for raw in part.column("hashes").to_pylist()]
                size = [len(p) for p, _ in found]
                again = lambda v: pa.array(np.repeat(np.asarray(v, np.int64), size))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p for p, _ in found]).view(np.int64)), again(part.column("node")), again(part.column("n")),
                                                  again([m for _, m in found]), again(part.column("component"))], ["token", "node", "n", "matches", "component"])

    labelled = sets.select("node", "n", "hashes").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = labelled.select("node", "n", "hashes", "component").mapInArrow(run, "token long, node long, n long, matches long, component long")
    same = Window.partitionBy("token")
    met = shared_table(rows.withColumn("low", F.min("component").over(same)).withColumn("high", F.max("component").over(same))
                       .where("low < high").drop("low", "high"), "met")
    a, b = (met.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "matches", "component")]) for s in "ab")
    fit = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & (
        100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return (a.join(b, "token").where(fit).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
            .agg(F.count("*").alias("met"), F.min(F.least("matches_a", "matches_b")).alias("need")).where("met >= need").select("a", "b"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, name: sets.select(F.col("node").alias(node), F.col("hashes").alias(name), F.col("n").alias(f"n_{name}"))
    both = (pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
            .where(100 * F.least("n_x", "n_y") >= PERCENT * F.greatest("n_x", "n_y")).select("a", "b", "x", "y"))
    return shared_table(both.mapInArrow(run, "a long, b long"), "links")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    found = profiles(docs)
    sets = classes(docs, found)
    counts = docs.sparkSession.sparkContext.broadcast(sketch(sets))
    grouped = group_labels(sets)
    links = inside_links(sets, grouped, counts).unionByName(verified(candidates(sets, grouped, counts), sets))
    labels = components(links)
    named = sets.select("node", "digest", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = named.join(first, "component").select("digest", "component_id")
    return (found.join(of_set, "digest", "left")
            .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(~F.col("no_id"), F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id."""
    drop = near_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
