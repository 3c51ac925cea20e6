"""Checks of a panel: gaps, first and last dates, series lengths, leading zeros, active days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.functions.columns import ratio


def consecutive_dates(panel: DataFrame, key: str = "sku", time: str = "date") -> DataFrame:
    """Whether the non-null dates of each key form a run without gaps and repeats."""
    days = F.count(time)
    span = F.datediff(F.max(time), F.min(time)) + 1
    unbroken = (days == span) & (days == F.count_distinct(F.col(time)))
    return panel.groupBy(key).agg(F.coalesce(unbroken, F.lit(True)).alias("consecutive"))


def broken_series(panel: DataFrame, key: str = "sku", time: str = "date") -> DataFrame:
    return consecutive_dates(panel, key, time).filter(~F.col("consecutive"))


def date_bounds(panel: DataFrame, key: str = "sku", time: str = "date") -> DataFrame:
    return panel.groupBy(key).agg(F.min(time).alias("first_date"), F.max(time).alias("last_date"))


def distinct_bounds(panel: DataFrame, which: str = "first_date", key: str = "sku", time: str = "date") -> DataFrame:
    """The different first (or last) dates that occur."""
    return date_bounds(panel, key, time).select(which).distinct()


def repeated_times(panel: DataFrame, key: str = "sku", time: str = "date") -> DataFrame:
    """(key, time) pairs with more than one row; a daily panel has none."""
    return panel.groupBy(key, time).count().filter(F.col("count") > 1)


def longest_series(panel: DataFrame, key: str = "sku") -> int:
    """Rows of the longest series; only one number reaches the driver."""
    return panel.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def _histogram(lengths: DataFrame, length: str, by_value: bool = False) -> DataFrame:
    counted = lengths.groupBy(length).agg(F.count(F.lit(1)).alias("count"))
    # The unpartitioned window sees one row per distinct series length, not the panel.
    weight = F.col(length) if by_value else F.col("count")
    share = ratio(weight * F.lit(100.0), F.sum(weight).over(Window.partitionBy(F.lit(1))))
    return counted.withColumn("proportion", share).orderBy(F.col(length).asc())


def length_histogram(panel: DataFrame, key: str = "sku") -> DataFrame:
    """How many items have how many rows, and their percentage."""
    lengths = panel.groupBy(key).agg(F.count(F.lit(1)).alias("number_of_items"))
    return _histogram(lengths, "number_of_items")


def active_histogram(panel: DataFrame, by_value: bool = False, key: str = "sku") -> DataFrame:
    """How many items have how many active days. ``by_value`` weighs by the day count, not its frequency."""
    active = panel.filter(F.col("minutes_active") > 0)
    lengths = active.groupBy(key).agg(F.count(key).alias("counts"))
    return _histogram(lengths, "counts", by_value)


def share_over(histogram: DataFrame, length: str, limit: int = 30) -> DataFrame:
    """Percentage of items with more than ``limit`` rows."""
    over = F.sum(F.when(F.col(length) > limit, F.col("proportion")))
    return histogram.agg(F.coalesce(over, F.lit(0.0)).alias("share_over"))


def leading_zeros(panel: DataFrame, column: str = "minutes_active", key: str = "sku", time: str = "date") -> DataFrame:
    """Number of zero rows before the first non-zero one, in date order; rows without a value do not count.

    No series is gathered: the first non-zero date is an aggregate, and only zero rows are joined to it.
    """
    value = F.col(column)
    first = panel.groupBy(key).agg(F.min(F.when(value != 0, F.col(time))).alias("_first"))
    zeros = panel.filter(value == 0).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_zero"))
    leading = F.col(key).eqNullSafe(F.col("_key")) & (
        F.col("_first").isNull() | (F.col("_time") < F.col("_first"))
    )
    return first.join(zeros, leading, "left").groupBy(key).agg(F.count("_zero").alias("leading_zeros"))


def repeated_days(panel: DataFrame, key: str = "sku", time: str = "date") -> DataFrame:
    """key, day, n of the days an item has more than one row for, which running sums and windows take as ties."""
    return panel.groupBy(key, time).agg(F.count("*").alias("n")).filter("n > 1")
