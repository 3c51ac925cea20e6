"""Expressions over probability arrays (one entry per class, class 1 first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_total(values: Column) -> Column:
    """Array of prefix sums."""
    return F.transform(
        F.sequence(F.lit(1), F.size(values)),
        lambda k: F.aggregate(F.slice(values, 1, k), F.lit(0.0), lambda acc, v: acc + v),
    )


def clipped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def reached_by(label: Column, classes: int) -> Column:
    """0/1 array: entry k is 1 once the label has been reached, i.e. the label's own running total."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(classes)), lambda k: F.when(k >= label, F.lit(1.0)).otherwise(F.lit(0.0))
    )
