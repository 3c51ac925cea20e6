"""Per-item features: category shares, means, weekday profile, activity. One aggregation each, no pivots
and no joins of aggregates; all of them combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.functions.columns import ratio

CATEGORY_COLUMNS = ("listing_type", "shipping_payment", "shipping_logistic_type")
MEANS = {"minutes_active_avg": "minutes_active", "selling_rate_avg": "selling_rate", "price_avg": "current_price"}
MAX_CATEGORIES = 2000
# How a category count becomes a proportion.
SHARE, ODDS, CHARACTER_RULE = "share", "odds", "character_rule"


def category_values(panel: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> dict[str, list[str]]:
    """Distinct non-null values of each column in sorted order, found in one pass.

    The values become columns, so too many of them is an error; nothing is cut off silently.
    """
    pairs = [expr for c in columns for expr in (F.lit(c), F.col(c).cast("string"))]
    found = panel.select(F.stack(F.lit(len(columns)), *pairs).alias("name", "value"))
    limit = MAX_CATEGORIES * len(columns)
    rows = found.filter(F.col("value").isNotNull()).distinct().limit(limit + 1).collect()
    values = {c: sorted(r["value"] for r in rows if r["name"] == c) for c in columns}
    for column, seen in values.items():
        if len(seen) > MAX_CATEGORIES or len(rows) > limit:
            raise ValueError(f"more than {MAX_CATEGORIES} categories ({column}); they cannot all become columns, use category_share_long")
    return values


def _in_long_form(panel: DataFrame, columns: Sequence[str], *kept: str) -> DataFrame:
    """One row per row of ``panel`` and column: ``column`` (its name), ``value`` (as text) and the columns kept."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return panel.select(*kept, F.inline(pairs))


def category_values_long(panel: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """column, value, n: every value of each column (null left out) and its rows; any number of values, none at the driver."""
    rows = _in_long_form(panel, columns).filter(F.col("value").isNotNull())
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def category_share_long(panel: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS, key: str = "sku") -> DataFrame:
    """key, column, value, n, share: the proportions of ``category_share`` as rows, for any number of values.

    Values an item does not have get no row (their share is 0); rows without a category do not count. Rows combine before
    the one exchange by item, column and value; what meets the totals is one row per value of an item.
    """
    rows = _in_long_form(panel, columns, key).filter(F.col("value").isNotNull())
    counts = rows.groupBy(key, "column", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key, "column"))
    return counts.withColumn("share", F.col("n") / total)


def category_proportions(
    column: str,
    values: Sequence[str],
    rule: str = SHARE,
    drop_first: bool = False,
    null_bucket: bool = False,
) -> list[Column]:
    """Aggregate expressions ``<value>_prop`` for one categorical column.

    ``share`` divides by the count of all rows with a category, ``odds`` by that of all other categories.
    ``character_rule`` leaves out of the denominator each category whose name is a single character of
    the name at hand: odds for one-character names, mostly shares for longer ones. A zero denominator
    gives 0. ``null_bucket`` treats null as one more category named "null".
    """
    category = F.col(column)
    counts = {v: F.count_if(category == F.lit(v)) for v in values}
    total = F.count(category)
    if null_bucket:
        counts["null"] = F.count_if(category.isNull())
        total = F.count(F.lit(1))
    shares = []
    for name, count in counts.items():
        if rule == SHARE:
            base = total
        elif rule == ODDS:
            base = total - count
        elif rule == CHARACTER_RULE:
            base = reduce(add, [c for other, c in counts.items() if other not in set(name)], F.lit(0))
        else:
            raise ValueError(f"unknown rule {rule!r}")
        shares.append(F.coalesce(ratio(count, base), F.lit(0.0)).alias(f"{name}_prop"))
    return shares[1:] if drop_first else shares


def category_share(
    panel: DataFrame,
    column: str,
    values: Sequence[str] | None = None,
    rule: str = SHARE,
    drop_first: bool = False,
    null_bucket: bool = False,
    key: str = "sku",
) -> DataFrame:
    """Proportions of one categorical column per item; categories are looked up when not given."""
    if values is None:
        values = category_values(panel, [column])[column]
    return panel.groupBy(key).agg(*category_proportions(column, values, rule, drop_first, null_bucket))


def sku_features(
    panel: DataFrame,
    categories: dict[str, Sequence[str]] | None = None,
    rule: str = SHARE,
    key: str = "sku",
) -> DataFrame:
    """Category proportions and means per item, in one aggregation."""
    if categories is None:
        categories = category_values(panel)
    proportions = [p for c, values in categories.items() for p in category_proportions(c, values, rule)]
    means = [F.avg(source).alias(name) for name, source in MEANS.items()]
    return panel.groupBy(key).agg(*proportions, *means)


def weekday_profile(panel: DataFrame, add_key: bool = False, key: str = "sku", time: str = "date") -> DataFrame:
    """Share of sales per weekday, ``day_0`` = Sunday to ``day_6`` = Saturday; null for items without sales.

    ``add_key`` adds the key itself to the denominator.
    """
    weekday = F.dayofweek(time)
    sums = panel.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(weekday == d + 1, F.col("sold_quantity"))), F.lit(0.0)).alias(f"day_{d}")
            for d in range(7)
        ]
    )
    total = reduce(add, [F.col(f"day_{d}") for d in range(7)])
    if add_key:
        total = total + F.col(key)
    return sums.select(key, *[ratio(F.col(f"day_{d}"), total).alias(f"day_{d}") for d in range(7)])


def active_share(panel: DataFrame, key: str = "sku") -> DataFrame:
    """Active days divided by all days, per item."""
    return panel.groupBy(key).agg(ratio(F.sum("is_active"), F.count(key)).alias("proportion_active"))
