"""Token-set similarity of titles.

For token sets A and B with common part S (all parts sorted and joined by blanks) the
ratio is 100 when S is not empty and one side has nothing else, and otherwise the best
of S against A, S against B, and A against B, where a string pair scores
1 - indel distance / total length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import bind


def token_key(title: Column) -> Column:
    """Sorted distinct tokens of a normalised title as one string: titles with equal keys are equal for the ratio."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(title, " "))), " ")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word row per character of ``b``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """Ratio in [0, 100] of two normalised titles."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100.0
    s = len(" ".join(shared))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    gap = 1 if shared else 0
    len_a, len_b = s + gap + len(only_a), s + gap + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * common_length(only_a, only_b)
    best = 100.0 - 100.0 * distance / (len_a + len_b)
    if shared:
        for rest, whole in ((only_a, len_a), (only_b, len_b)):
            best = max(best, 100.0 - 100.0 * (gap + len(rest)) / (s + whole))
    return max(best, 0.0)


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) / 100.0 for x, y in zip(a, b, strict=True)])


def overlap_ratio(a: Column, b: Column) -> Column:
    """The part of the ratio of two token keys that needs no edit distance: containment, and S against each side."""

    def ratio(x: Column) -> Column:
        s, shared = F.length(F.array_join(x["s"], " ")), F.size(x["s"])
        sides = [(F.lit(100.0) - F.lit(100.0) * (F.length(k) - s) / (s + F.length(k))) / F.lit(100.0) for k in (a, b)]
        return F.when(shared == 0, F.lit(0.0)).when((shared == x["m"]) | (shared == x["n"]), F.lit(1.0)).otherwise(F.greatest(*sides))

    left, right = F.split(a, " "), F.split(b, " ")
    both = F.when((a == "") | (b == ""), F.array().cast("array<string>")).otherwise(F.array_intersect(left, right))
    return bind(F.struct(both.alias("s"), F.size(left).alias("m"), F.size(right).alias("n")), ratio)
