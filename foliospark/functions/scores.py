"""Class scores as Column expressions over an array of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_nan(scores: Column) -> Column:
    """The scores as doubles, NaN as minus infinity so that it never wins."""
    return F.transform(scores, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x.cast("double")))


def best_class(scores: Column) -> Column:
    """The index of the largest score from 0, the first of equal ones; 0 for an empty array."""
    finite = without_nan(scores)
    return F.greatest(F.coalesce(F.array_position(finite, F.array_max(finite)), F.lit(1)), F.lit(1)).cast("int") - 1


def is_distribution(scores: Column) -> Column:
    """Whether scores already are probabilities: within 0 and 1, and 1 in sum, but for rounding."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return (F.array_min(scores) >= -1e-4) & (F.array_max(scores) <= 1 + 1e-4) & (F.abs(total - 1) <= 1e-3)


def best_probability(scores: Column) -> Column:
    """The probability of the largest score: itself in a distribution, else by softmax."""
    top = F.array_max(scores).cast("double")
    weight = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    soft = F.when((weight > 0) & (weight < float("inf")), 1 / weight).otherwise(0.0)
    return F.when(is_distribution(scores), F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0))).otherwise(soft)


def label_angle(label: Column) -> Column:
    """The angle of an orientation's label such as 90 or 180_degree: its leading digits, if they're a quarter turn; else null."""
    angle = F.regexp_extract(label, "^([0-9]*)", 1).try_cast("int")
    return F.when(angle.isin(0, 90, 180, 270), angle)
