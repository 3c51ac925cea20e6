"""Running curves for series without a length bound.

The windows of :mod:`shelfpace.operators.series` hold one series in one task. When a single key may own a
large part of all rows, rows are laid out in ranges of (key, time) of even size instead (:func:`place`), so that a
long series lies in as many ranges as its rows need. A window only ever sees one range; what came before it arrives
as one state per key and range. A key has a state to carry only where it goes on from one range into the next, and
every border between two ranges is crossed by at most one key: the states are fewer than twice the ranges, whatever
the data, and are broadcast. Results are the same as those of the plain windows, for series of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.functions.columns import ratio
from shelfpace.functions.windows import series_window
from shelfpace.operators.series import CURVES, LOOKBACKS, SPLIT_AT, lookback_means, per_split
from shelfpace.session import staged

BLOCK_ROWS = 100_000


def place(
    rows: DataFrame, time: str, key: str = "sku", parts: int | None = None, table: str | None = None
) -> DataFrame:
    """The rows in ranges of (key, time), numbered by ``_part`` in ascending order, written once and read back.

    The sampled bounds give ranges of about the same number of rows; rows of one key and time stay together. Null keys
    and null times come first, as in a window. ``parts`` fixes the number of ranges, which else follows the session's
    shuffle settings. The rows go to ``table``, or to a folder below the shared one.
    """
    by = [F.col(key), F.col(time)]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    numbered = ranged.withColumn("_part", F.spark_partition_id())
    if table is None:
        return staged(numbered, "series")
    numbered.write.format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def _with_states(rows: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """Add the states (one row per key and range) to the rows of keys in several ranges; null for all others."""
    ranges = F.count(F.lit(1)).over(series_window(key))
    crossing = states.withColumn("_ranges", ranges).filter("_ranges > 1").drop("_ranges")
    renamed = crossing.withColumnsRenamed({key: "_key", "_part": "_range"})
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range"))
    return rows.join(F.broadcast(renamed), same, "left").drop("_key", "_range")


def _sum_known(left: Column, right: Column) -> Column:
    """Sum of two values where null means nothing there."""
    return F.coalesce(left + right, left, right)


def _earlier_ranges(key: str):
    return series_window(key, "_part", rows=(Window.unboundedPreceding, -1))


def number_rows(
    placed: DataFrame, time: str, ties: Sequence[str] = (), split_at: int = SPLIT_AT, key: str = "sku"
) -> DataFrame:
    """Split and day numbers as in ``series.number_days``; input from :func:`place`, possibly filtered.
    ``ties`` settles the order among equal times."""
    sizes = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select(key, "_part", F.sum("_rows").over(_earlier_ranges(key)).alias("_before"))
    local = placed.withColumn("_row", F.row_number().over(series_window([key, "_part"], [time, *ties])))
    position = F.coalesce(F.col("_before"), F.lit(0).cast("long")) + F.col("_row")
    early = F.col("_position") <= split_at
    return (
        _with_states(local, starts, key)
        .withColumn("_position", position)
        .withColumns(
            {
                "is_train": F.when(early, 1).otherwise(0),
                "id": F.when(early, F.col("_position")).otherwise(F.col("_position") - split_at),
            }
        )
        .drop("_row", "_before", "_position")
    )


def running_stock(
    numbered: DataFrame, time: str, running_max: bool = False, key: str = "sku", quantity: str = "sold_quantity"
) -> DataFrame:
    """Running sum, maximum plus one and quotient; input from :func:`number_rows`.

    Sums run inside each range first. A range's total and highest point then say, for every range of the
    key, where its sum starts and how high the key has been or will be.
    """
    early, late = F.col("is_train") == 1, F.col("is_train") == 0
    earlier = _earlier_ranges(key)
    reach = earlier if running_max else series_window(key)
    so_far = series_window([key, "_part"], time, values=(Window.unboundedPreceding, Window.currentRow))
    local = numbered.withColumn("_local", per_split(F.sum, F.col(quantity), so_far))

    totals, starts, tops = {}, {}, {}
    for side, here in ((1, early), (0, late)):
        totals[f"_sum{side}"] = F.sum(F.when(here, F.col(quantity)))
        totals[f"_high{side}"] = F.max(F.when(here, F.col("_local")))
        starts[f"_start{side}"] = F.sum(f"_sum{side}").over(earlier)
        tops[f"_top{side}"] = F.max(_sum_known(F.col(f"_start{side}"), F.col(f"_high{side}"))).over(reach)
    ranges = local.groupBy(key, "_part").agg(*[expr.alias(name) for name, expr in totals.items()])
    states = ranges.withColumns(starts).withColumns(tops).select(key, "_part", *starts, *tops)

    def by_side(name: str) -> Column:
        return F.when(early, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    curve = _with_states(local, states, key).withColumn("cumsum", _sum_known(by_side("_start"), F.col("_local")))
    # Highest point inside the range, next to the one of the key's other ranges where it has any.
    inside = per_split(F.max, F.col("cumsum"), so_far if running_max else series_window([key, "_part"]))
    return (
        curve.withColumn("max", F.greatest(by_side("_top"), inside) + 1)
        .drop(*starts, *tops, "_local", "_part")
        .withColumn("cumsum_pc", ratio(F.col("cumsum"), F.col("max")))
    )


def rolling_means(
    curve: DataFrame,
    columns: Sequence[str] = CURVES,
    lookbacks: Sequence[int] = LOOKBACKS,
    key: str = "sku",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling means over blocks of consecutive ids. The last rows of a block are also sent to the next
    one, which needs them to look back, and are dropped there afterwards."""
    reach = max(lookbacks)
    if block_rows <= reach:
        raise ValueError("a block must be longer than the longest lookback")
    own = F.floor((F.col("id") - 1) / F.lit(block_rows))
    is_tail = F.pmod(F.col("id") - 1, F.lit(block_rows)) >= block_rows - reach
    homes = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = curve.withColumn("_block", F.explode(homes))
    ordered = series_window([key, "is_train", "_block"], "id")
    return lookback_means(spread, columns, lookbacks, ordered).filter(F.col("_block") == own).drop("_block")


def labelled_curve(
    placed: DataFrame,
    time: str,
    ties: Sequence[str] = (),
    split_at: int = SPLIT_AT,
    lookbacks: Sequence[int] = LOOKBACKS,
    running_max: bool = False,
    key: str = "sku",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Split, running stock and rolling means of series of any length; input from :func:`place`."""
    numbered = number_rows(placed, time, ties, split_at, key)
    curve = running_stock(numbered, time, running_max, key)
    return rolling_means(curve, CURVES, lookbacks, key, block_rows)
