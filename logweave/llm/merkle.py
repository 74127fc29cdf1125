"""Operator 12, Merkle manifest of a dataset by lag and lead windows.

Rows are leaves, ordered by doc_id within their language; runs of eight nodes have one
parent.  Positions come from a range-sorted, written table: a row's number in its partition
plus the rows of its language in earlier partitions.  Blocks of 512 leaves (three levels) are
then hashed in windows: on the rows of a block, the value of a level-l node stands in the row of
its first leaf, so its siblings are lag and lead columns at multiples of 8^l, masked
by the node's slot and the run's length, and first-child rows hash the parent.  The block's roots are
the leaves of the next round, until one node of each language is left; the subroots are the leaves
of a last tree.  Going down again, a block's rows get the siblings above it by a join on the block.

So a language with any share of the rows is spread by its blocks, the leaves are shuffled three
times as about a hundred bytes a row (never as texts), and the levels above cost 1/512 each.

Defined results: a null field hashes as ``-``; null languages are a group of their own, first in order;
null doc_ids come first in their language, rows of one doc_id by their leaf, equal rows stay apart with equal leaves; a
null doc_id is never tampered with; a lone leaf is its subroot and a lone subroot the root, so
that one row alone has the hash of the empty text as its proof; an empty table gives no rows; very
long texts are hashed whole; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

FAN = 8
#: levels hashed in one block, and its leaves
LEVELS = 3
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` if null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0 within ``keys``, by ``order``) and ``n``, the rows of the key.

    Rows are dealt by ranges of both, written with their number in the partition, and counted by
    partition and key; no task needs all rows of a key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    written = shared_table(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                           .withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    at = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    written = written.withColumns({"_p": part, "_at": at}).drop("_m")
    key = Window.partitionBy(*keys)
    counts = (written.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
              .withColumns({"n": F.sum("_c").over(key),
                            "_base": F.sum("_c").over(key.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")}))
    return (written.join(counts.drop("_c"), [*keys, "_p"])
            .withColumn("pos", F.col("_base") + F.col("_at") - F.col("_first")).drop("_base", "_at", "_first", "_p"))


def blocks(nodes: DataFrame) -> DataFrame:
    """Per node (``g``, ``pos``, ``n``, ``h``): its siblings on three levels and the root of its block.

    ``path`` is an array of (left, right): the digests of the siblings before and behind the node's
    ancestor on each level that has more than one node, the nearest level first.
    """
    block = F.floor(F.col("pos") / BLOCK)
    # dealt by block, so all windows below find their rows together; sorted once for all of them
    rows = nodes.withColumn("block", block)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "g", "block")
    w = Window.partitionBy("g", "block").orderBy("pos")
    level, live = "h", []
    for k in range(LEVELS):
        step = FAN**k
        count = F.ceil(F.col("n") / step)  # nodes of this level
        node = F.floor(F.col("pos") / step)
        slot = node % FAN
        size = F.least(F.lit(FAN), count - (node - slot))  # nodes in its run
        first = F.col("pos") % step == 0  # the row that stands for the node
        active = count > 1
        rows = rows.withColumns({
            **{f"lag{j}": F.when(first & active & (slot >= j), F.lag(level, j * step).over(w)) for j in range(1, FAN)},
            **{f"lead{j}": F.when(first & active & (slot + j < size), F.lead(level, j * step).over(w)) for j in range(1, FAN)},
        })
        left = F.concat_ws("", *[F.col(f"lag{j}") for j in range(FAN - 1, 0, -1)])
        right = F.concat_ws("", *[F.col(f"lead{j}") for j in range(1, FAN)])
        rows = rows.withColumns({
            f"s{k}": F.when(first & active, F.struct(left.alias("left"), right.alias("right"))),
            f"h{k + 1}": F.when(F.col("pos") % (step * FAN) == 0,
                                F.when(active, F.sha2(F.concat(F.col(level), right), 256)).otherwise(F.col(level))),
        }).drop(*[f"{x}{j}" for x in ("lag", "lead") for j in range(1, FAN)])
        level = f"h{k + 1}"
        live.append(active)
    # a node's siblings stand in its first row; the rows behind it take them from there
    fill = w.rowsBetween(Window.unboundedPreceding, 0)
    path = F.array_compact(F.array(*[F.when(live[k], F.last(f"s{k}", ignorenulls=True).over(fill)) for k in range(LEVELS)]))
    return rows.withColumn("path", path).withColumnRenamed(level, "up").drop(*[f"s{k}" for k in range(LEVELS)], *[f"h{k}" for k in range(1, LEVELS)])


def tree(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with their whole ``path`` to the one node of their ``g``, and these nodes (``g``, ``root``).

    Rounds go on while a group has more than one node; each cuts the number of nodes by 512.
    """
    low = blocks(nodes)
    up = shared_table(low.where(F.col("pos") % BLOCK == 0).select(
        "g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("up").alias("h")), f"{name}-up")
    low = low.drop("up")
    if up.where("n > 1").isEmpty():
        return low.drop("block"), up.select("g", F.col("h").alias("root"))
    high, roots = tree(up, f"{name}-up")
    high = high.select("g", F.col("pos").alias("block"), F.col("path").alias("above"))
    low = low.join(high, ["g", "block"]).withColumn("path", F.concat("path", "above")).drop("above", "block")
    return low, roots


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document (see the module's text)."""
    doc_id, source, lang, n_chars, text = (docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))
    tampered = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate(text, UPPER, LOWER)
    leaves = docs.select(
        doc_id.cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("g"),
        leaf_hash(doc_id, source, lang, n_chars, text).alias("h"),
        F.when(tampered & (lower != text), leaf_hash(doc_id, source, lang, n_chars, lower)).alias("other"))
    rows, subroots = tree(positions(leaves, ["g"], ["doc_id", "h"], "leaves"), "nodes")
    subroots = subroots.select(F.lit("").alias("top"), F.col("g"), F.col("root").alias("h"))
    subroots = positions(subroots, ["top"], ["g"], "subroots").withColumnsRenamed({"g": "lang_key", "top": "g"})
    top, root = tree(subroots, "subroots")
    top = top.join(root, "g").select(F.col("lang_key").alias("g"), F.col("h").alias("subroot"), F.col("path").alias("above"), "root")
    rows = rows.join(top, "g").withColumn("path", F.concat("path", "above"))
    proof = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = fold(F.coalesce("other", "h"), F.col("path"))
    return (rows.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
                        folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def oracle_sql() -> str:
    """DuckDB SQL of ``op12_merkle_manifest``: level by level over the whole tree."""
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        parts = [f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in fields]
        return f"sha256({' || '.join(parts)})"

    # CRC-32 of a decimal number, a bit at a time: the sum over bytes of shifts of the reflected polynomial
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"lambda crc, x: list_reduce(range(8), {step}, xor(crc, x))"
    crc = ("xor(4294967295::BIGINT, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           f"lambda d: CAST(ascii(d) AS BIGINT)), {byte}, 4294967295::BIGINT))")

    def levels(name: str, start: str) -> str:
        return f"""{name}(g, lvl, idx, h, n) AS (
  {start}
  UNION ALL
  SELECT g, lvl + 1, idx // {FAN}, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + {FAN - 1}) // {FAN})
  FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // {FAN}
)"""

    def siblings(name: str) -> str:
        run = f"PARTITION BY g, lvl, idx // {FAN} ORDER BY idx"
        return f"""SELECT g, lvl, idx, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM {name} WHERE n > 1"""

    # lower() would also change letters other than A-Z
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf("text")} END AS shown
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
), {levels("low", "SELECT g, 0, pos, leaf, n FROM placed")}, subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), {levels("top", "SELECT '', 0, pos, subroot, n FROM subroots")},
low_siblings AS ({siblings("low")}), top_siblings AS ({siblings("top")}),
ways AS (
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, p.pos, p.g, q.lvl, q.before, q.behind
  FROM placed p JOIN subroots s USING (g) JOIN low_siblings q ON q.g = p.g AND q.idx = p.pos // CAST({FAN} ** q.lvl AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, p.pos, p.g, 1000 + q.lvl, q.before, q.behind
  FROM placed p JOIN subroots s USING (g) JOIN top_siblings q ON q.idx = s.pos // CAST({FAN} ** q.lvl AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, p.pos, p.g, 2000, NULL, NULL FROM placed p JOIN subroots s USING (g)
), rows AS (
  SELECT g, pos, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(shown) AS shown, any_value(subroot) AS subroot,
    coalesce(string_agg(before || behind, '' ORDER BY lvl), '') AS said,
    list({{'a': before, 'b': behind}} ORDER BY lvl) AS way
  FROM ways GROUP BY g, pos
), folded(g, pos, k, h) AS (
  SELECT g, pos, 1, shown FROM rows
  UNION ALL
  SELECT f.g, f.pos, f.k + 1, sha256(r.way[f.k].a || f.h || r.way[f.k].b)
  FROM folded f JOIN rows r USING (g, pos) WHERE f.k < len(r.way)
)
SELECT r.doc_id, r.leaf, r.subroot, t.h AS root, sha256(r.said) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM rows r JOIN (SELECT h FROM top WHERE n = 1) t ON true JOIN folded f ON f.g = r.g AND f.pos = r.pos AND f.k = len(r.way)
"""
