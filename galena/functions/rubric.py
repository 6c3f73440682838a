"""Checklists as array<struct<criterion, weight>> columns: scores, groups, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(value: Column) -> Column:
    """Between 0 and 1; null stays null, which greatest and least would skip."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def weighted_score(weight: Column, met: Column, strict: bool = True) -> Column:
    """Aggregate: earned weight over positive weight, between 0 and 1.

    Without positive weight: an error, or null if not strict.
    """
    earned, whole = F.sum(weight * met.cast("double")), F.sum(F.greatest(weight, F.lit(0.0)))
    return clipped(earned / whole if strict else F.try_divide(earned, whole))


def total(items: Column, of=lambda x: x) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + of(x))


def array_score(rubric: Column, met: Column) -> Column:
    """weighted_score of one row's array<struct<weight>> and array<boolean>."""
    pairs = F.zip_with(rubric, met, lambda c, m: c.weight * m.cast("double"))
    return clipped(F.try_divide(total(pairs), total(rubric, lambda c: F.greatest(c.weight, F.lit(0.0)))))


def covers_once(groups: Column, n: Column) -> Column:
    """Whether array<array<int>> holds each of 1..n exactly once."""
    return F.array_sort(F.flatten(groups)) == F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def group_weight(rubric: Column, indices: Column) -> Column:
    """Sum of the absolute weights of the criteria at 1-based indices."""
    return total(indices, lambda i: F.abs(F.element_at(rubric, i).weight))


def with_mean_weight(rubric: Column, criterion: str) -> Column:
    """One more criterion, of the mean weight."""
    own = total(rubric, lambda c: c.weight) / F.size(rubric)
    return F.concat(rubric, F.array(F.struct(F.lit(criterion).alias("criterion"), own.alias("weight"))))


def with_share(rubric: Column, criterion: str, k: Column) -> Column:
    """One more criterion, of 1/k of the absolute weight."""
    own = total(rubric, lambda c: F.abs(c.weight)) / k
    return F.concat(rubric, F.array(F.struct(F.lit(criterion).alias("criterion"), own.alias("weight"))))


def split_weight(weights: Column, whole: Column) -> Column:
    """``whole`` dealt to items in proportion to their absolute weight, keeping signs."""
    return F.transform(weights, lambda w: F.try_divide(whole * F.abs(w), total(weights, F.abs)) * F.signum(w))


def reweighted(rubric: Column, labels: Column, multipliers: dict[str, float], default: str) -> Column:
    """Weights times their label's multiplier; labels that are missing or too few count as ``default``."""
    times = F.create_map(*[F.lit(x) for pair in multipliers.items() for x in pair])
    usable = F.when(F.size(labels) == F.size(rubric), labels).otherwise(F.transform(rubric, lambda c: F.lit(default)))
    return F.zip_with(rubric, usable, lambda c, l: F.struct(c.criterion.alias("criterion"), (c.weight * F.coalesce(times[l], F.lit(multipliers[default]))).alias("weight")))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def length_adjusted(score: Column, length: Column, center: float, penalty: float) -> Column:
    return score - penalty * (length - center) / 500


def truncated_jsd(p: Column, q: Column, beta: float = 0.5) -> Column:
    """Generalised Jensen-Shannon divergence of two array<double> of probabilities of the same choices."""
    eps = 1e-12
    mixed = F.zip_with(p, q, lambda a, b: beta * a + (1 - beta) * b)
    kl = lambda x: total(F.zip_with(x, mixed, lambda a, m: F.when(a > 0, a * F.ln((a + eps) / (m + eps))).otherwise(0.0)))
    return beta * kl(p) + (1 - beta) * kl(q)
