"""Labelling, numbering and running curves of item series.

Input: one row per (key, time), as :func:`shelfpace.sources.retail.sku_daily` guarantees by grouping. A
series is then at most as long as the calendar, so a window over one key is bounded. Series that are not
bounded this way (several rows per day, one item with a large part of all rows) go through
:mod:`shelfpace.operators.longseries`, which returns the same columns.

All windows of this module partition by the key and order by the time, also those that work inside one
side of the split: rows of the other side enter them as null, which every aggregate used here skips. The
whole chain therefore runs on one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from shelfpace.functions.columns import activity_flag, ratio, selling_rate
from shelfpace.functions.windows import series_window, up_to_now

SPLIT_AT = 30
LOOKBACKS = (1, 2, 3, 4, 5)
CURVES = ("cumsum", "cumsum_pc")


def add_activity(panel: DataFrame) -> DataFrame:
    """Selling rate per active minute and the activity flag."""
    minutes = F.col("minutes_active")
    return panel.withColumns(
        {"selling_rate": selling_rate(F.col("sold_quantity"), minutes), "is_active": activity_flag(minutes)}
    )


def active_only(panel: DataFrame) -> DataFrame:
    """Days with active minutes. Applied before numbering, so days are counted among active days."""
    return panel.filter(F.col("minutes_active") > 0)


def number_days(panel: DataFrame, split_at: int = SPLIT_AT, key: str = "sku", time: str = "date") -> DataFrame:
    """Split each series after ``split_at`` days (``is_train`` 1/0) and number the days of each side (``id``)."""
    position = F.row_number().over(series_window(key, time))
    return (
        panel.withColumn("position", position)
        .withColumns(
            {
                "is_train": F.when(F.col("position") <= split_at, 1).otherwise(0),
                "id": F.when(F.col("position") <= split_at, F.col("position")).otherwise(
                    F.col("position") - split_at
                ),
            }
        )
        .drop("position")
    )


def split_key(key: str = "sku") -> Column:
    """Text key of one side of one series, for outputs that want it."""
    return F.concat(F.col(key).cast("string"), F.lit("_"), F.col("is_train").cast("string"))


def per_split(aggregate: Callable[[Column], Column], column: Column, window: WindowSpec) -> Column:
    """Window aggregate over the rows of the current row's own side of the split."""
    early, late = F.col("is_train") == 1, F.col("is_train") == 0
    return F.when(early, aggregate(F.when(early, column)).over(window)).otherwise(
        aggregate(F.when(late, column)).over(window)
    )


def running_stock(days: DataFrame, running_max: bool = False, key: str = "sku", time: str = "date") -> DataFrame:
    """Running sum of sales per split side, its maximum plus one, and their quotient.

    The maximum is that of the whole side; ``running_max`` takes the maximum so far instead.
    """
    so_far = up_to_now(key, time)
    top = so_far if running_max else series_window(key)
    return (
        days.withColumn("cumsum", per_split(F.sum, F.col("sold_quantity"), so_far))
        .withColumn("max", per_split(F.max, F.col("cumsum"), top) + 1)
        .withColumn("cumsum_pc", ratio(F.col("cumsum"), F.col("max")))
    )


def lookback_means(
    curve: DataFrame, columns: Sequence[str], lookbacks: Sequence[int], ordered: WindowSpec
) -> DataFrame:
    """Means of the current row and up to n rows before it on the same side, for every lookback n.

    Days of a side are numbered without gaps, so the row k places back is on the same side exactly when
    ``id`` exceeds k. The means of all lookbacks add up the same few earlier values; that costs a fraction
    of one moving frame per mean.
    """
    steps = range(1, max(lookbacks) + 1)
    earlier = {
        f"_{column}_{k}": F.when(F.col("id") > k, F.lag(column, k).over(ordered)) for column in columns for k in steps
    }
    means = {}
    for column in columns:
        total, known = F.coalesce(F.col(column), F.lit(0.0)), F.col(column).isNotNull().cast("int")
        for k in steps:
            value = F.col(f"_{column}_{k}")
            total = total + F.coalesce(value, F.lit(0.0))
            known = known + value.isNotNull().cast("int")
            if k in lookbacks:
                means[f"rolling_{column}_{k}"] = ratio(total, known)
    return curve.withColumns(earlier).withColumns(means).drop(*earlier)


def rolling_means(
    curve: DataFrame,
    columns: Sequence[str] = CURVES,
    lookbacks: Sequence[int] = LOOKBACKS,
    key: str = "sku",
    time: str = "date",
) -> DataFrame:
    """Mean of the current day and up to ``lookback`` days before it, on the same side of the split.

    A lookback of n averages n + 1 rows; the first rows of a side average what there is. Missing values do
    not count.
    """
    return lookback_means(curve, columns, lookbacks, series_window(key, time))


def labelled_series(
    panel: DataFrame,
    split_at: int = SPLIT_AT,
    lookbacks: Sequence[int] = LOOKBACKS,
    running_max: bool = False,
    key: str = "sku",
    time: str = "date",
) -> DataFrame:
    """Activity, split, running stock and rolling means in one pass over the panel."""
    days = number_days(add_activity(panel), split_at, key, time)
    return rolling_means(running_stock(days, running_max, key, time), CURVES, lookbacks, key, time)
