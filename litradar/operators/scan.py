"""Running values over a global order without one task per group.

A window over ``profile_id`` sorts a whole profile in one task. Here the rows are
range-partitioned on the full order, each range is a chunk, windows run inside
(group, chunk), and the totals of earlier chunks of the group are added. A group
with a third of all rows is thus spread over a third of the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Range-partition on (keys, order) and fix the chunk number of each row.

    The frame is written out: range bounds are sampled, so a second evaluation could
    cut elsewhere. ``order`` must be unique within ``keys``.
    """
    columns = [*[F.col(k) for k in keys], *order]
    # without a number, small neighbouring ranges are merged at run time
    ranged = df.repartitionByRange(*columns) if parts is None else df.repartitionByRange(parts, *columns)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column] | None = None,
            mins_before: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums (current row included) and running minima (current row left out)."""
    sums, mins = sums or {}, mins_before or {}
    group = [*keys, CHUNK]
    ordered = Window.partitionBy(*group).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[F.sum(c).over(upto).alias(f"_{n}") for n, c in sums.items()],
        *[F.min(c).over(before).alias(f"_{n}") for n, c in mins.items()],
    )
    totals = df.groupBy(*group).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.min(c).alias(f"_t_{n}") for n, c in mins.items()]
    )
    # one row per (group, chunk): a chunk holds a contiguous key range, so at most groups + chunks rows
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
        *[F.min(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in mins],
    )
    joined = local.join(offsets, group)
    return joined.select(
        *df.columns,
        *[(F.col(f"_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.least(f"_{n}", f"_o_{n}").alias(n) for n in mins],
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """1-based position within the group; ``df`` comes from ``chunked``."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")})
