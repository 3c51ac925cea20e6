"""Fixed day grid: one row per key and day 1..n, with gaps carried forward or marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.functions.columns import MISSING
from shelfpace.functions.windows import series_window
from shelfpace.operators.series import LOOKBACKS

GRID_DAYS = 30
SENTINEL_COLUMNS = (
    "sold_quantity",
    "minutes_active",
    "is_active",
    "current_price",
    "cumsum",
    "selling_rate",
    *[f"rolling_cumsum_{n}" for n in LOOKBACKS],
    *[f"rolling_cumsum_pc_{n}" for n in LOOKBACKS],
)


def day_grid(keys: DataFrame, days: int = GRID_DAYS, key: str = "sku", day: str = "id") -> DataFrame:
    """Every day 1..n for every distinct key; a narrow explode instead of a product of two tables."""
    return keys.select(key).distinct().withColumn(day, F.explode(F.sequence(F.lit(1), F.lit(days))))


def densify(
    frame: DataFrame,
    keys: DataFrame | None = None,
    days: int = GRID_DAYS,
    carry: Sequence[str] = (),
    key: str = "sku",
    day: str = "id",
) -> DataFrame:
    """Lay ``frame`` on the day grid of ``keys`` (of its own keys when none are given).

    Same result as the grid left-joined with the frame on (key, day), without building the grid and
    without shuffling the frame by two columns: each row fills the days up to the next row of its key
    (the first row also those before it), and the new rows hold null. Days outside the grid fall off, so
    at most ``days`` distinct days per key get this far. Keys without rows give ``days`` empty rows.
    Columns named in ``carry`` keep the last non-null value instead of null.
    """
    kept = frame.filter(F.col(day).between(1, days))
    if keys is not None:
        kept = keys.select(key).distinct().join(kept, key, "left")
    ordered = series_window(key, day)
    so_far = series_window(key, day, rows=(Window.unboundedPreceding, Window.currentRow))
    own = F.col(day)
    first = F.when(F.lag(F.lit(True)).over(ordered).isNull(), F.lit(1)).otherwise(own)
    last = F.coalesce(F.lead(day).over(ordered) - 1, F.lit(days))
    carried = {c: F.last(c, ignorenulls=True).over(so_far) for c in carry}
    marked = kept.withColumns({**carried, "_first": first, "_last": last})
    slots = marked.withColumn(
        "_slot", F.explode(F.sequence(F.col("_first"), F.greatest(F.col("_last"), F.col("_first"), own)))
    )
    keep = F.col("_slot") == own
    keep_carried = F.col("_slot") >= own
    values = [
        F.when(keep_carried if c in carry else keep, F.col(c)).alias(c) for c in frame.columns if c not in (key, day)
    ]
    return slots.select(F.col(key), F.col("_slot").alias(day), *values)


def carry_forward(frame: DataFrame, columns: Sequence[str], key: str = "sku", day: str = "id") -> DataFrame:
    """Replace nulls by the last non-null value of the same key; leading nulls stay."""
    so_far = series_window(key, day, values=(Window.unboundedPreceding, Window.currentRow))
    return frame.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})


def mark_missing(frame: DataFrame, columns: Sequence[str] = SENTINEL_COLUMNS) -> DataFrame:
    """Write -1 into the missing values of the given numeric columns."""
    return frame.na.fill({c: MISSING for c in columns if c in frame.columns})


def minimal_table(frame: DataFrame) -> DataFrame:
    return frame.select("sku", "id", "rolling_cumsum_1", "item_domain_id", "site_id")
