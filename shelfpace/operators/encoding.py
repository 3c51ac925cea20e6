"""One integer code per category, in sorted order, shared by several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.functions.windows import series_window
from shelfpace.session import cut_lineage

# Fixed value: monotonically_increasing_id keeps the row's place in its partition in the lower 33 bits.
PLACE_BITS = 33


def category_codes(frames: list[DataFrame], column: str = "item_domain_id") -> DataFrame:
    """Codes 0, 1, 2, ... for the distinct values of all frames in binary text order.

    Every frame is reduced to its distinct values before the union. A distributed sort splits the words
    into ranges of even size, which the checkpoint then fixes; a word's code is its place in its range plus
    the sizes of the ranges before it. No task sees more than one range.
    """
    distinct = [f.select(column).distinct() for f in frames]
    words = reduce(DataFrame.unionAll, distinct).filter(F.col(column).isNotNull()).distinct()
    row = F.monotonically_increasing_id()
    placed = cut_lineage(words.orderBy(column)).withColumn("_row", row)
    placed = placed.select(
        column,
        F.shiftright("_row", PLACE_BITS).alias("range"),
        F.col("_row").bitwiseAND(2**PLACE_BITS - 1).alias("place"),
    )
    # One row per range goes through the unpartitioned window.
    sizes = placed.groupBy("range").count()
    starts = sizes.select("range", (F.sum("count").over(series_window([], "range")) - F.col("count")).alias("start"))
    return placed.join(starts, "range").select(column, (F.col("start") + F.col("place")).cast("int").alias("code"))


def encode(frame: DataFrame, codes: DataFrame, column: str = "item_domain_id") -> DataFrame:
    """Replace the category by its code. A missing category counts as the empty one."""
    filled = frame.withColumn(column, F.coalesce(column, F.lit("")))
    joined = filled.join(codes, column, "left")
    return joined.withColumn(column, F.col("code")).select(*frame.columns)
