"""Score expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Decay, Fusion, JournalScores
from .clock import age_days


def temporal_weight(added: Column, as_of, decay: Decay = Decay()) -> Column:
    """Exponential decay with a floor; missing and future dates weigh 1."""
    age = age_days(added, as_of)
    decayed = F.greatest(F.lit(decay.min_weight), F.exp(age * F.lit(-math.log(2) / decay.halflife_days)))
    return F.when(added.isNull() | (age <= 0), F.lit(1.0)).otherwise(decayed)


def journal_score(factor: Column, is_cn: Column, p: JournalScores = JournalScores()) -> Column:
    """Score of one listed journal; null when it has neither CN status nor a factor."""
    return F.when(is_cn, F.lit(p.cn_core)).when(
        factor.isNotNull(), F.least(F.lit(1.0), F.log(factor + 1) / F.lit(math.log(p.log_base)))
    )


def fused_similarity(micro: Column, macro: Column, p: Fusion = Fusion()) -> Column:
    return F.lit(p.micro_weight) * micro + F.lit(1 - p.micro_weight) * macro


def final_score(similarity: Column, journal: Column, p: Fusion = Fusion()) -> Column:
    return F.lit(p.similarity_weight) * similarity + F.lit(p.journal_weight) * journal


def label(score: Column, must_read: Column, consider: Column) -> Column:
    return F.when(score >= must_read, "must_read").when(score >= consider, "consider").otherwise("ignore")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    norm = l2_norm(v) + F.lit(eps)
    return F.transform(v, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    """Interpreted element by element: for one vector per row, not for pair joins (see operators.neighbors)."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
