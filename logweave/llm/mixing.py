"""Operator 3, mixing sources to target weights (DataFrame operations only).

Tokens (runs of non-white characters) are summed by cell (source, language, topic).
Iterative proportional fitting rakes the cells' expected tokens to the three target
marginals, one after the other, for ``ROUNDS`` rounds; the cells are an aggregate, the
documents are not touched again.  A cell can't give more than it holds, so the fit is bounded:
each step finds the factor of a value by which the tokens of its cells, each cut at what the cell
holds, add up to the value's goal.  Cut cells are thus made up for by the others of their value.
The sum of the expected tokens is ``BUDGET`` of all, or less where a value holds too little for its target
(``feasible_budget``), so that the marginals hold and not only the budget; ``gaps`` tells what is left.
A document's probability is its cell's expected tokens over the tokens held.
Documents are drawn by comparing the probability with a hash of doc_id, so a run can be
repeated and the same document is always drawn alike.

Default targets temper the marginals found: the share to the power ``POWER``, scaled to 1.
Own targets are frames (value, share); values without a target keep their tempered share.
The topic is a column expression, by default the form of the text (``topic_of``).

Defined results: null source, language and topic are values of their own; a null or empty
text has no tokens, and rows of cells without tokens have probability ``BUDGET``; rows with
a null doc_id are drawn alike by one fixed hash, rows of one doc_id too; very long texts count like others; an empty table gives an empty result;
further columns are ignored by ``mix`` and kept by ``draw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

ROUNDS = 12
POWER = 0.5
BUDGET = 0.5
#: cells that are broadcast to the documents; with more they are joined by shuffle
BROADCAST_CELLS = 100_000
SIDES = ("source", "lang", "topic")
NONE = "(null)"
#: forms of text: the first pattern found names the topic (fixed values)
TOPICS = (("legal", r"(?:[Ll]icense|[Cc]opyright)"), ("contact", r"[0-9]{5}|@"), ("table", r" \| "), ("noisy", r"%%%|&&&|###|!!"))


def topic_of(text: str = "text") -> Column:
    out = F.when(F.coalesce(F.col(text), F.lit("")) == "", "empty")
    for name, pattern in TOPICS:
        out = out.when(F.col(text).rlike(pattern), name)
    return out.otherwise("prose")


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def _tempered(cells: DataFrame, side: str, power: float) -> DataFrame:
    found = cells.groupBy(side).agg(F.sum("tokens").alias("held")).where("held > 0")
    weight = F.pow(F.col("held").cast("double"), F.lit(power))
    return found.withColumn("target", weight / F.sum(weight).over(Window.partitionBy(F.lit(0))))  # one row a value


def goals(cells: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = POWER) -> dict[str, DataFrame]:
    """Per side: its values with the tokens ``held`` and the ``target`` share."""
    out = {}
    for side in SIDES:
        goal = _tempered(cells, side, power)
        if side in (targets or {}):
            own = targets[side].select(F.col("value").alias(side), F.col("share").alias("given"))
            goal = goal.join(own, side, "left").withColumn("target", F.coalesce("given", "target")).drop("given")
            goal = goal.withColumn("target", F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(0))))
        out[side] = goal
    return out


def feasible_budget(cells: DataFrame, wanted: dict[str, DataFrame], budget: float) -> float:
    """``budget``, or the largest share of all tokens at which every value holds enough for its target."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    least = [wanted[s].where("target > 0").agg(F.min(F.col("held") / F.col("target"))).first()[0] for s in SIDES]
    return min([budget, *(x / total for x in least if total and x is not None)])


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS,
         power: float = POWER) -> DataFrame:
    """``cells`` (sides, tokens) with ``weight``: least(weight, tokens) are the expected tokens of a cell."""
    cells = cells.where("tokens > 0")
    wanted = goals(cells, targets, power)
    share = feasible_budget(cells, wanted, budget)
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a cell
    fitted = fitted.withColumn("budget", F.lit(share) * total)
    for side in SIDES:
        fitted = fitted.join(wanted[side].select(side, F.col("target").alias(f"target_{side}")), side)
        fitted = fitted.withColumn(f"goal_{side}", F.col(f"target_{side}") * F.col("budget"))
    fitted = shared_table(fitted.drop("budget"), "cells")
    for turn in range(rounds):
        for side in SIDES:
            fitted = _fit(fitted, side)
        if turn % 3 == 2 or turn == rounds - 1:
            fitted = shared_table(fitted, "raked")
    return fitted


def _fit(cells: DataFrame, side: str) -> DataFrame:
    """Scale the weights of each value of ``side`` so that its cells' tokens, cut at what they hold, give its goal.

    In the order of tokens / weight the cells before the first one that stays below its tokens are cut.
    """
    order = Window.partitionBy(side).orderBy("ratio", *SIDES)
    cut = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = cells.withColumn("ratio", F.col("tokens") / F.col("weight"))
    rows = rows.withColumn("factor", (F.col(f"goal_{side}") - cut) / rest)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    factor = F.coalesce(F.first(F.when(F.col("factor") < F.col("ratio"), F.col("factor")), ignorenulls=True).over(whole),
                        F.max("ratio").over(Window.partitionBy(side)))
    return rows.withColumn("weight", F.col("weight") * factor).drop("ratio", "factor")


def gaps(raked: DataFrame) -> DataFrame:
    """side, value, target, expected (its share of the expected tokens) and gap of every target."""
    given = F.least("weight", "tokens")
    out = None
    for side in SIDES:
        one = raked.groupBy(F.lit(side).alias("side"), F.col(side).alias("value")).agg(F.max(f"target_{side}").alias("target"), F.sum(given).alias("given"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("expected", F.col("given") / F.sum("given").over(Window.partitionBy("side"))).drop("given")  # one row a value
    return out.withColumn("gap", F.abs(F.col("expected") - F.col("target")))


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, topic: Column | None = None,
                  carry: list[str] | None = None) -> DataFrame:
    """Rows with source, lang, topic, n_tokens, probability and kept; ``carry`` names further columns (a struct ``row``)."""
    side = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    rows = docs.select("doc_id", side(F.col("source")).alias("source"), side(F.col("lang")).alias("lang"),
                       side(topic if topic is not None else topic_of()).alias("topic"), tokens().alias("n_tokens"),
                       *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    rows = shared_table(rows, "rows")
    cells = shared_table(rows.groupBy(*SIDES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, targets, budget)
    chance = raked.select(*SIDES, F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("chance"))
    if chance.count() <= BROADCAST_CELLS:
        chance = F.broadcast(chance)
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))), 1, 8), 16, 10).cast("double") / float(2**32)
    return (rows.join(chance, list(SIDES), "left").withColumn("chance", F.coalesce("chance", F.lit(float(budget))))
            .withColumn("probability", F.round("chance", 6)).withColumn("kept", u < F.col("probability")).drop("chance"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every document."""
    return probabilities(docs, targets, budget).select("doc_id", *SIDES, "n_tokens", "probability", "kept")


def draw(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    return probabilities(docs, targets, budget, carry=docs.columns).where("kept").select("row.*")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL: one recursive step per side, each a bounded fit by windows."""
    topics = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    goal = " UNION ALL ".join(
        f"SELECT {k} AS side, {s} AS value, h AS held, pow(h, {POWER}) / sum(pow(h, {POWER})) OVER () AS target "
        f"FROM (SELECT {s}, sum(tokens) AS h FROM c GROUP BY {s})" for k, s in enumerate(SIDES))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN coalesce(text, '') = '' THEN 'empty' {topics} ELSE 'prose' END AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
goal AS MATERIALIZED ({goal}),
budget AS MATERIALIZED (SELECT least({BUDGET} * (SELECT sum(tokens) FROM c), min(held / target)) AS budget FROM goal),
r(k, source, lang, topic, tokens, weight) AS (
  SELECT 0, source, lang, topic, tokens, tokens FROM c
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, weight * coalesce(
    first_value(CASE WHEN factor < ratio THEN factor END IGNORE NULLS) OVER (PARTITION BY value ORDER BY ratio, source, lang, topic
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), max(ratio) OVER (PARTITION BY value))
  FROM (SELECT *, (wanted - coalesce(sum(tokens) OVER (PARTITION BY value ORDER BY ratio, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (PARTITION BY value ORDER BY ratio, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
    FROM (SELECT r.*, r.tokens / r.weight AS ratio, g.value, g.target * b.budget AS wanted FROM r
      JOIN goal g ON g.side = r.k % 3 AND g.value = CASE r.k % 3 WHEN 0 THEN r.source WHEN 1 THEN r.lang ELSE r.topic END, budget b WHERE r.k < {3 * rounds}))
)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '{NONE}')), 1, 8) AS BIGINT) / 4294967296.0 < round(p, 6) AS kept
FROM (SELECT d.*, CASE WHEN w.weight IS NULL THEN {BUDGET} ELSE least(1.0, w.weight / w.tokens) END AS p
  FROM d LEFT JOIN (SELECT * FROM r WHERE k = {3 * rounds}) w USING (source, lang, topic))"""
