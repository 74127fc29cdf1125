"""Operator 13, conversation structure repair by a run-length dynamic program.

The rows of a conversation become symbols: role initial and fault.  Editing is a walk through
four states (nothing yet, behind system, user or assistant); a symbol is a min-plus
matrix over them.  Runs of one symbol are advanced through cached powers of two of its matrix,
from the last run to the first, which gives the cost still to come at every run.  The audit is then
unrolled forward: of the edits that keep the least cost, the first in ASCII order.

Rows are dealt by ranges of (conv_id, turn), so a conversation with any share of the rows is
spread.  Conversations that lie whole inside an Arrow batch are finished there.  Those cut by a
batch or partition go on as segments of at most 4,096 rows: matrices per segment in parallel,
one pass backward over a conversation's matrices, unrolling from all four states in parallel, one
pass forward over the state maps, and one over its rows for the digest (a sequential hash, so
this pass alone reads a conversation's texts in one task, as a stream).

Defined results: nulls in role, text and in the damage key are one space; a null conv_id is a
conversation; null turns come first, equal turns by role and text; role initials are the first
character as it is (an empty role has none and can't be kept); empty texts are blank; texts are
never cut; rows with equal role and text after the first are duplicates, repeated rows too; an empty
table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 50
#: state reached by the next user or assistant from: start, behind system, behind user, behind assistant
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ACCEPT = (True, False, False, True)
LEGAL = {"su", "ua", "au"}
SEGMENT_BITS = 12
WHITE = r"[\x20\x09-\x0D]"
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
ROW = "m long, turn long, role string, text string, dropped boolean, is_blank boolean, is_truncated boolean"


# -- symbols and their matrices -------------------------------------------------------
def symbol(initial: str, fault: str) -> str:
    """Two characters: role initial (``-`` if it can't be kept) and ``t`` if truncated; ``x`` must go."""
    if fault in ("blank", "duplicate"):
        return "x"
    return (initial if initial in ("s", "u", "a") else "-") + ("t" if fault == "truncated" else "")


def kept_state(state: int, initial: str) -> int | None:
    """State behind a row that is kept, if it may be."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if NEXT[state] == 2 else None
    return 3 if initial == "a" and state == 2 else None


@lru_cache(None)
def edits(sym: str) -> tuple:
    """Per state: (letter, cost, next state) of what may be done with a row of this symbol."""
    out = []
    for s in range(4):
        moves = [("D", DELETE, s)]
        if sym != "x":
            more = TRUNCATED if sym.endswith("t") else 0
            t = kept_state(s, sym[0])
            if t is not None:
                moves.append(("K", more, t))
            moves.append(("R", REROLE + more, NEXT[s]))
        out.append(tuple(moves))
    return tuple(out)


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two 4 x 4 matrices."""
    return tuple(tuple(min(x + b[k][t] for k, x in enumerate(row)) for t in range(4)) for row in a)


def apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


UNIT = tuple(tuple(0 if s == t else FAR for t in range(4)) for s in range(4))


@lru_cache(None)
def inserted() -> tuple:
    """Least cost of going from one state to another by insertions alone."""
    out = [[FAR] * 4 for _ in range(4)]
    for s in range(4):
        t, cost = s, 0
        for _ in range(4):
            out[s][t] = min(out[s][t], cost)
            t, cost = NEXT[t], cost + INSERT
    return tuple(map(tuple, out))


@lru_cache(None)
def power(sym: str, j: int) -> tuple:
    """Matrix of 2**j rows of one symbol."""
    if j:
        half = power(sym, j - 1)
        return times(half, half)
    row = [[FAR] * 4 for _ in range(4)]
    for s, moves in enumerate(edits(sym)):
        for _, cost, t in moves:
            row[s][t] = min(row[s][t], cost)
    return times(inserted(), tuple(map(tuple, row)))


def advance(v: tuple, sym: str, count: int) -> tuple:
    """Cost to come before ``count`` rows of one symbol, from the cost behind them."""
    j = 0
    while count:
        if count & 1:
            v = apply(power(sym, j), v)
        count, j = count >> 1, j + 1
    return v


END = apply(inserted(), tuple(0 if a else FAR for a in ACCEPT))


@lru_cache(1 << 16)
def choose(sym: str, state: int, behind: tuple) -> tuple[str, int]:
    """Edits of one row from ``state`` (insertions before it included), given the cost behind it."""
    here, letters = apply(power(sym, 0), behind), ""
    while True:
        options = [(letter, cost + behind[t], t) for letter, cost, t in edits(sym)[state]]
        options.append(("I", INSERT + here[NEXT[state]], NEXT[state]))
        letter, _, t = min(o for o in options if o[1] == here[state])
        letters, state = letters + letter, t
        if letter != "I":
            return letters, state


def unroll(symbols: list[str], state: int, behind: tuple) -> tuple[list[str], int]:
    """Cheapest, then ASCII-least edits of every row, and the state behind them."""
    runs, v = [], behind
    for sym, group in groupby(reversed(symbols)):
        count = len(list(group))
        runs.append((sym, count, v))
        v = advance(v, sym, count)
    out = []
    for sym, count, v in reversed(runs):
        inside = [v]
        for _ in range(count - 1):
            inside.append(apply(power(sym, 0), inside[-1]))
        for w in reversed(inside):
            low = min(w)  # only differences decide, so that few cases are ever computed
            letters, state = choose(sym, state, tuple(x - low for x in w))
            out.append(letters)
    return out, state


def matrix(symbols: list[str]) -> tuple:
    """Min-plus matrix of a segment."""
    total = UNIT
    for sym, group in groupby(symbols):
        count, j = len(list(group)), 0
        while count:
            if count & 1:
                total = times(total, power(sym, j))
            count, j = count >> 1, j + 1
    return total


# -- one conversation -----------------------------------------------------------------
class Tally:
    """Figures, audit and digest of a conversation whose rows come one after the other."""

    def __init__(self):
        self.turns = [None, None, 0]  # first, last, distinct
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal = self.cost = self.state = 0
        self.last_initial = None
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _insert(self) -> None:
        self.state, self.cost = NEXT[self.state], self.cost + INSERT
        self._say(ROLE[self.state], "")

    def add(self, turn: int | None, role: str, text: str, fault: str, letters: str) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if self.last_initial is not None and self.last_initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.last_initial = role[:1]
        self.audit.append(letters)
        for letter in letters:
            if letter == "I":
                self._insert()
            elif letter == "D":
                self.cost += DELETE
            else:
                self.cost += TRUNCATED * (fault == "truncated") + REROLE * (letter == "R")
                self.state = NEXT[self.state] if letter == "R" else kept_state(self.state, role[:1])
                self._say(ROLE[self.state] if letter == "R" else role, text)

    def result(self, conv_id: int | None) -> tuple:
        while not ACCEPT[self.state]:
            self._insert()
            self.audit.append("I")
        first, last, distinct = self.turns
        gaps = 0 if first is None else last - first + 1 - distinct
        return (conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"],
                self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def fault_of(blank: bool, duplicate: bool, truncated: bool) -> str:
    return "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else ""


def whole(conv_id: int | None, rows: list[tuple]) -> tuple:
    """Result of a conversation all of whose (sorted) rows are at hand."""
    seen, said = set(), []
    for _, turn, role, text, dropped, blank, truncated in rows:
        if not dropped:
            said.append((turn, role, text, fault_of(blank, (role, text) in seen, truncated)))
            seen.add((role, text))
    letters, _ = unroll([symbol(role[:1], fault) for _, role, _, fault in said], 0, END)
    tally = Tally()
    for row, x in zip(said, letters, strict=True):
        tally.add(*row, x)
    return tally.result(conv_id)


def _rows(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations inside a batch; the rows of its first and last one stay open."""
    none = [None] * 8
    schema = _arrow(RESULT + ", " + ROW)
    for batch in batches:
        groups = [(k, [r[1:] for r in g]) for k, g in groupby(_rows(batch), lambda r: r[0])]
        out = [whole(k, g) + (None,) * 7 for k, g in groups[1:-1]]
        for k, g in groups[:1] + groups[1:][-1:]:
            out += [(k, *none, *r) for r in g]
        if out:
            yield _batch(out, schema)


# -- conversations cut by a batch -----------------------------------------------------
def segments(group: pd.DataFrame) -> pd.DataFrame:
    """Symbols, row numbers and matrix of one segment (bounded rows)."""
    group = group.sort_values("m")
    symbols = group["symbol"].tolist()
    flat = [x for row in matrix(symbols) for x in row]
    return pd.DataFrame({"conv_id": [group["conv_id"].iloc[0]], "seg": [int(group["m"].iloc[0])],
                         "symbols": [symbols], "ms": [group["m"].tolist()], "flat": [flat]})


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, cost behind it) from a conversation's matrices, the last one first."""
    now, v = (), END
    for batch in batches:
        out = []
        for conv_id, seg, flat in _rows(batch):
            if (conv_id,) != now:
                now, v = (conv_id,), END
            out.append((seg, list(v)))
            v = apply(tuple(tuple(flat[k:k + 4]) for k in range(0, 16, 4)), v)
        yield _batch(out, _arrow("seg long, behind array<long>"))


def forks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment: for each state before it, the state behind it and every row's edits."""
    for batch in batches:
        for conv_id, seg, symbols, ms, behind in _rows(batch):
            found = [unroll(symbols, s, tuple(behind)) for s in range(4)]
            yield _batch([(conv_id, seg, ms, [t for _, t in found], *[letters for letters, _ in found])],
                         _arrow("conv_id long, seg long, ms array<long>, ends array<long>, " + ", ".join(f"from{s} array<string>" for s in range(4))))


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, state before it) from a conversation's state maps, the first one first."""
    now, state = (), 0
    for batch in batches:
        out = []
        for conv_id, seg, ends in _rows(batch):
            if (conv_id,) != now:
                now, state = (conv_id,), 0
            out.append((seg, state))
            state = ends[state]
        yield _batch(out, _arrow("seg long, state long"))


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results from the sorted rows of open conversations; a row's edits come just before it."""
    now, tally, letters, out = (), None, "", []
    for batch in batches:
        for conv_id, _, _, choice, turn, role, text, dropped, fault in _rows(batch):
            if (conv_id,) != now:
                if now:
                    out.append(tally.result(*now))
                now, tally = (conv_id,), Tally()
            if choice is not None:
                letters = choice
            elif not dropped:
                tally.add(turn, role, text, fault, letters)
        if out:
            yield _batch(out, _arrow(RESULT))
            out = []
    if now:
        yield _batch([tally.result(*now)], _arrow(RESULT))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage; dropped ones stay as marks of their conversation, without text."""
    c = conversations
    space = F.lit(" ")
    key = F.concat(F.coalesce(c["conv_id"].cast("string"), space), F.lit(":"), F.coalesce(c["turn"].cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
                    F.coalesce(c["role"], space).alias("role"), F.coalesce(c["text"], space).alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"),
                       F.explode(copies).alias("copy")).drop("copy")
    return rows.withColumns({"is_blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
                             "is_truncated": ~F.col("text").rlike(rf"[.!?]{WHITE}*\z")})


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults, cheapest edits and digest of the repaired rows."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = F.substring("text", 1, 64)
    rows = (damaged(conversations).repartitionByRange(parts, "conv_id", "turn", "role", near)
            .sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("m", F.monotonically_increasing_id())
            .select("conv_id", "m", "turn", "role", "text", "dropped", "is_blank", "is_truncated"))
    settled = shared_table(rows.mapInArrow(settle, RESULT + ", " + ROW), "settled")
    done = settled.where("m is null").select(*[x.split()[0] for x in RESULT.split(", ")])
    still = settled.where("m is not null").select("conv_id", *[x.split()[0] for x in ROW.split(", ")])
    return done.unionByName(_open(still, parts))


def _open(rows: DataFrame, parts: int) -> DataFrame:
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    alive = rows.where(~F.col("dropped"))
    firsts = alive.groupBy("conv_id", digest.alias("digest")).agg(F.min("m").alias("m")).select("m", F.lit(True).alias("first"))
    fault = (F.when(F.col("is_blank"), "blank").when(F.col("first").isNull(), "duplicate")
             .when(F.col("is_truncated"), "truncated").otherwise(""))
    rows = shared_table(rows.join(firsts, "m", "left").withColumn("fault", F.when(~F.col("dropped"), fault))
                        .select("conv_id", "m", "turn", "role", "text", "dropped", "fault"), "open")
    initial = F.substring("role", 1, 1)
    sym = (F.when(F.col("fault").isin("blank", "duplicate"), "x")
           .otherwise(F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), F.when(F.col("fault") == "truncated", "t").otherwise(""))))
    cut = (rows.where(~F.col("dropped")).select("conv_id", "m", sym.alias("symbol"))
           .groupBy("conv_id", F.shiftright("m", SEGMENT_BITS).alias("run"))
           .applyInPandas(lambda g: segments(g), "conv_id long, seg long, symbols array<string>, ms array<long>, flat array<long>"))
    cut = shared_table(cut, "segments")
    behind = (cut.select("conv_id", "seg", "flat").repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
              .mapInArrow(backward, "seg long, behind array<long>"))
    maps = shared_table(cut.drop("flat").join(behind, "seg").select("conv_id", "seg", "symbols", "ms", "behind").mapInArrow(
        forks, "conv_id long, seg long, ms array<long>, ends array<long>, " + ", ".join(f"from{s} array<string>" for s in range(4))), "forks")
    states = (maps.select("conv_id", "seg", "ends").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seg")
              .mapInArrow(forward, "seg long, state long"))
    letters = F.element_at(F.array(*[f"from{s}" for s in range(4)]), (F.col("state") + 1).cast("int"))
    choices = (maps.join(states, "seg").select("conv_id", F.explode(F.arrays_zip(F.col("ms").alias("m"), letters.alias("choice"))).alias("x"))
               .select("conv_id", "x.m", F.lit(0).alias("tag"), "x.choice"))
    both = choices.unionByName(rows.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    return (both.select("conv_id", "m", "tag", "choice", "turn", "role", "text", "dropped", "fault")
            .repartition(parts, "conv_id").sortWithinPartitions("conv_id", "m", "tag").mapInArrow(finish, RESULT))


def oracle_sql() -> str:
    """DuckDB SQL of ``op13_conversation_repair``: row by row, the least (cost, audit) of every state."""
    step = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    crc = ("xor(4294967295::BIGINT, list_reduce(list_transform(string_split("
           "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), "
           f"lambda d: CAST(ascii(d) AS BIGINT)), lambda crc, x: list_reduce(range(8), {step}, xor(crc, x)), 4294967295::BIGINT))")
    white = r"[^\x20\x09-\x0D]"
    # states by the last initial; up to two insertions reach every other state
    inserts = []
    for start in ("", "s", "u", "a"):
        at, said = start, ""
        for k in range(3):
            inserts.append(f"('{start}', {k}, '{at}', '{said}')")
            at = "a" if at == "u" else "u"
            said += {"u": "user:", "a": "assistant:"}[at] + "|"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE kind <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), checked AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '{white}') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), ins(start, k, here, said) AS (VALUES {', '.join(inserts)}
), letters(letter) AS (VALUES ('D'), ('K'), ('R')
), dp(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} FROM src
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT d.conv_id, r.i, CASE letter WHEN 'D' THEN x.here WHEN 'K' THEN r.initial ELSE CASE x.here WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
      {{'cost': d.best.cost + {INSERT} * x.k + CASE letter WHEN 'D' THEN {DELETE} ELSE CASE letter WHEN 'R' THEN {REROLE} ELSE 0 END
          + CASE WHEN r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END END,
        'audit': d.best.audit || repeat('I', x.k) || letter,
        'said': d.best.said || replace(x.said, '|', chr(10)) || CASE letter WHEN 'D' THEN ''
          WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE CASE x.here WHEN 'u' THEN 'assistant:' ELSE 'user:' END || r.text || chr(10) END}} AS best
    FROM dp d JOIN checked r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1
    JOIN ins x ON x.start = d.state CROSS JOIN letters
    WHERE letter = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (letter = 'R'
      OR (r.initial = 's' AND x.here = '') OR (r.initial = 'u' AND x.here <> 'u') OR (r.initial = 'a' AND x.here = 'u')))
  ) GROUP BY conv_id, i, state
), figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM checked GROUP BY conv_id
), ends AS (
  SELECT d.conv_id, d.i, min({{'cost': d.best.cost + {INSERT} * x.k, 'audit': d.best.audit || repeat('I', x.k),
    'said': d.best.said || replace(x.said, '|', chr(10))}}) AS best
  FROM dp d JOIN ins x ON x.start = d.state WHERE x.here IN ('', 'a') GROUP BY d.conv_id, d.i
)
SELECT e.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate,
  coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit,
  sha256(CASE WHEN e.best.said = '' THEN '' ELSE left(e.best.said, length(e.best.said) - 1) END) AS repaired_sha256
FROM ends e LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(f.n, 0)
"""
