"""Order statistics and the top n of groups without sorting a whole group.

The place of a rank is found by rounds of histograms: the value range of a group is cut into bins, the bins are counted
(combined before the shuffle), the bin that holds the rank becomes the next range. Rounds end when a range has few rows or
one value only, so just these rows are sorted; no task gets a whole group, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import hot_keys, skew_join

BINS = 1024
# a range with at most so many rows is sorted
RANGE_ROWS = 50_000


def _ranges(rows: DataFrame, keys: list[str], targets: DataFrame, value: str, range_rows: int) -> DataFrame:
    """``targets(keys, at)`` (``at`` counts from 0, highest value first) with ``lo, hi, above, inside``.

    ``rows`` is read once a round. The range holds the target's row; ``above`` rows have a higher value, ``inside`` rows are in it.
    """
    sizes = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("inside"))
    state = cut_lineage(targets.join(sizes, keys).select(*keys, "at", "lo", "hi", F.lit(0).cast("long").alias("above"), "inside").where((F.col("at") >= 0) & (F.col("at") < F.col("inside"))))
    wide = (F.col("inside") > range_rows) & (F.col("lo") < F.col("hi"))
    done = []
    while True:
        done.append(state.where(~wide))
        open_ = state.where(wide)
        if open_.isEmpty():
            break
        hot = cut_lineage(hot_keys(rows.select(*keys), keys))
        near = skew_join(rows.select(*keys, F.col(value).alias("_v")), open_, keys, "inner", ["_v"], hot=hot).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        bin_ = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        counts = near.groupBy(*keys, "at", "above", bin_.alias("bin")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("inside"))
        # at most BINS rows a target
        down = Window.partitionBy(*keys, "at").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("upto", F.col("above") + F.sum("inside").over(down))
        hit = placed.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("inside") <= F.col("at")))
        state = cut_lineage(hit.select(*keys, "at", "lo", "hi", (F.col("upto") - F.col("inside")).alias("above"), "inside"))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return cut_lineage(out)


def values_at(rows: DataFrame, keys: Sequence[str], targets: DataFrame, value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``targets(keys, at)`` with the ``value`` of the row at that place, from 0, highest value first; null values are left out.

    ``rows`` should be a table, because it is read more than once; values are doubles without NaN.
    """
    keys = list(keys)
    held = rows.select(*keys, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL")
    found = _ranges(held, keys, targets.select(*keys, "at").distinct(), "_value", range_rows)
    flat = found.where("lo = hi").select(*keys, "at", F.col("lo").alias(value))
    # few rows a target
    few = found.where("lo < hi")
    inside = held.join(few, keys).where(F.col("_value").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*keys, "at").orderBy(F.desc("_value"))
    nth = inside.withColumn("_n", F.col("above") + F.row_number().over(order) - 1).where("_n = at").select(*keys, "at", F.col("_value").alias(value))
    return flat.union(nth)


def top_n(rows: DataFrame, keys: Sequence[str], by: Column, tie: str, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The ``n`` rows of each group with the highest ``by`` (nulls last), ties by the smaller ``tie``, a unique number in the group.

    First the value of the n-th row is found, then, where more rows share it than fit, the tie number of the last one that
    does; both by histograms. ``rows`` should be a table; groups with a null key are groups.
    """
    keys = list(keys)
    named = [f"_k{i}" for i in range(len(keys))]
    # a null key is a group, a null value comes last
    held = rows.select(*[F.struct(F.col(k).alias("k")).alias(m) for k, m in zip(keys, named, strict=True)], by.cast("double").alias("_by"), (-F.col(tie)).cast("double").alias("_tie"))
    held = held.withColumn("_by", F.coalesce("_by", F.lit(float("-inf"))))
    lowest = held.groupBy(*named).agg(F.min(F.when(F.col("_by") > float("-inf"), F.col("_by"))).alias("_least"), F.count("*").alias("_rows"))
    large = cut_lineage(lowest.where(F.col("_rows") > n))
    if large.isEmpty():
        return rows
    # without a value: one step below the lowest, so that ranges stay finite
    floor = F.coalesce(F.col("_least") - F.greatest(F.abs("_least"), F.lit(1.0)), F.lit(0.0))
    hot = cut_lineage(hot_keys(held.select(*named), named))
    held = skew_join(held, large.select(*named, floor.alias("_floor")), named, "inner", ["_tie"], hot=hot)
    held = cut_lineage(held.select(*named, F.greatest("_by", "_floor").alias("_by"), "_tie"))
    last = values_at(held, named, large.select(*named, F.lit(n - 1).cast("long").alias("at")), "_by", range_rows).select(*named, F.col("_by").alias("_cut"))
    last = cut_lineage(last)
    beside = skew_join(held, last, named, "inner", ["_tie"], hot=hot)
    above = beside.groupBy(*named).agg(F.count_if(F.col("_by") > F.col("_cut")).alias("_above"))
    equal = cut_lineage(beside.where(F.col("_by") == F.col("_cut")).select(*named, "_tie"))
    ties = values_at(equal, named, above.select(*named, (F.lit(n - 1) - F.col("_above")).alias("at")), "_tie", range_rows).select(*named, F.col("_tie").alias("_last"))
    limits = cut_lineage(last.join(ties, named).join(large.select(*named, floor.alias("_floor")), named))
    whole = rows.select(F.struct("*").alias("_row"), *[F.struct(F.col(k).alias("k")).alias(m) for k, m in zip(keys, named, strict=True)], by.cast("double").alias("_by"), (-F.col(tie)).cast("double").alias("_tie"))
    judged = skew_join(whole, limits, named, "left", ["_tie"], hot=hot)
    score = F.greatest(F.coalesce("_by", "_floor"), F.col("_floor"))
    return judged.where(F.col("_cut").isNull() | (score > F.col("_cut")) | ((score == F.col("_cut")) & (F.col("_tie") >= F.col("_last")))).select("_row.*")
