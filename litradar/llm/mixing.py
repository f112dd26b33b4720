"""Mixing sources to target weights: budgets flow down a tree of levels such as domain, language, source.

A node's budget is dealt to its children by weight. A child cannot take more than it holds (its tokens times the
epochs allowed); what it cannot take goes to its siblings, and since a node's own capacity is the sum of its children's,
only what a whole family cannot take reaches the siblings of its ancestors. A leaf with more budget than tokens is read
in whole epochs; the last, partial epoch is a token prefix of an order seeded by epoch.

Only the tree is windowed by parent. The prefix of a leaf is found from sums per slice of the hash order, so a leaf with
a third of all rows is not sorted in one task: only the slice in which the prefix ends is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import small_side

# hex digits of the hash that number the slices of a leaf
SLICE_DIGITS = 3


def token_count(text: Column) -> Column:
    """Runs of other than white space (space, tab to carriage return); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted(nodes: DataFrame, level: str, weights: Mapping[str, int]) -> Column:
    """The weight of a node by its name at this level; names that are not listed weigh 1."""
    found = F.lit(None).cast("long")
    for name, weight in weights.items():
        found = F.when(F.col(level) == name, F.lit(weight)).otherwise(found)
    return F.coalesce(found, F.lit(1)).cast("long")


def deal(children: DataFrame, parents: Sequence[str]) -> DataFrame:
    """Split ``budget`` (of the parent) over rows with ``cap`` and ``weight``: all up to their cap, else by weight.

    With the children in the order of cap / weight, one is full exactly if the ones before it are and its cap is no more
    than its part of what is left. Whole tokens only: shares are rounded down.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    order = family.orderBy((F.col("cap") / F.col("weight")), "node")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = children.select("*", F.sum("cap").over(upto).alias("_caps"), (F.sum("weight").over(family) - F.sum("weight").over(upto)).alias("_later"))
    full = wide(F.col("budget") - F.col("_caps")) * F.col("weight") >= wide(F.col("cap")) * F.col("_later")
    rows = rows.withColumn("_full", full & (F.col("budget") >= F.col("_caps")))
    left = F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(family)
    open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(family)
    rows = rows.withColumn("_left", left).withColumn("_open", open_weight)
    share = F.floor(wide(F.col("_left")) * F.col("weight") / F.greatest("_open", F.lit(1))).cast("long")
    taken = F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", share))
    return rows.withColumn("budget", taken).drop("_caps", "_later", "_full", "_left", "_open")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` has the levels and ``tokens``; adds ``budget``. ``budget`` may use ``tokens``, the total at the root."""
    held = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = held.agg(F.sum("tokens").alias("tokens"), F.sum("cap").alias("cap")).select(F.least(budget.cast("long"), "cap").alias("budget"))
    for depth, level in enumerate(levels):
        parents = list(levels[:depth])
        nodes = held.groupBy(*levels[: depth + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        # the root is one row; else parents and children meet by the parent's path
        with_budget = nodes.join(above, parents) if parents else nodes.join(F.broadcast(above), F.lit(True))
        rows = with_budget.withColumn("weight", weighted(nodes, level, weights.get(level, {}))).withColumn("node", F.col(level))
        dealt = deal(rows, parents)
        above = cut_lineage(dealt.select(*levels[: depth + 1], "budget", "tokens") if level == levels[-1] else dealt.select(*levels[: depth + 1], "budget"))
    return above


def mixture(documents: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget: Column, seed: int,
            max_epochs: int = 1, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows drawn from ``documents`` (``keep``, the levels, ``epoch`` from 1, ``n_tokens``, ``n_taken``).

    ``levels`` names the tree from the top, each with the column that gives a row its node. ``n_taken`` is less than
    ``n_tokens`` only for the last document of a leaf's prefix. A null level is the node ``none``; null texts have no
    tokens and come along while the prefix lasts; rows that are repeated take part one by one; a leaf without tokens
    gets no budget and no row; an empty table gives no rows. A budget beyond all capacities takes everything.
    """
    names = list(levels)
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    rows = documents.select(*keep, F.col("doc_id").alias("_doc"), key.alias("_key"),
                            *[F.coalesce(c, F.lit("none")).alias(n) for n, c in levels.items()], token_count(F.col("text")).alias("n_tokens"))
    rows = cut_lineage(rows)  # the texts are read once
    leaves = cut_lineage(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")))
    plan = leaf_budgets(leaves, names, weights, budget, max_epochs).where((F.col("tokens") > 0) & (F.col("budget") > 0))
    plan = plan.select(*names, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("_whole"), F.pmod("budget", "tokens").alias("_rest"))
    owned = rows.join(small_side(plan), names)
    whole = owned.where(F.col("_whole") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_whole")))).withColumn("n_taken", F.col("n_tokens"))
    out = [*keep, *names, "epoch", "n_tokens", "n_taken"]
    last = owned.where(F.col("_rest") > 0).withColumn("epoch", F.col("_whole") + 1)
    last = last.withColumn("_hash", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("_key"))))
    last = last.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))
    sums = last.groupBy(*names, "_slice").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_end"))
    earlier = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_from", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).where(F.col("_from") < F.col("_end"))
    placed = last.join(sums.select(*names, "_slice", "_from", "_sum"), [*names, "_slice"])
    inside = placed.where(F.col("_from") + F.col("_sum") <= F.col("_rest")).withColumn("n_taken", F.col("n_tokens"))
    within = Window.partitionBy(*names).orderBy("_hash", "_doc", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(F.col("_from") + F.col("_sum") > F.col("_rest"))
    edge = edge.withColumn("_before", F.col("_from") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where(F.col("_before") < F.col("_rest"))
    edge = edge.withColumn("n_taken", F.least("n_tokens", F.col("_rest") - F.col("_before")))
    return whole.select(*out).unionByName(inside.select(*out)).unionByName(edge.select(*out))
