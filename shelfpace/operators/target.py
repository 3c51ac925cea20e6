"""Target preparation, per-item maxima, the outlier bound and the sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.functions.columns import log_stock
from shelfpace.functions.windows import series_window
from shelfpace.operators.sampling import rows_of


def blank_plateaus(frame: DataFrame, column: str = "target_stock", key: str = "sku", day: str = "id") -> DataFrame:
    """Keep each value once per key, on its first day; repeats become null."""
    occurrence = F.row_number().over(series_window([key, column], day))
    return (
        frame.withColumn("_occurrence", occurrence)
        .withColumn(column, F.when(F.col("_occurrence") == 1, F.col(column)))
        .drop("_occurrence")
    )


def prepare_target(
    frame: DataFrame, scored: DataFrame | None = None, predictor: str = "rolling_cumsum_1", key: str = "sku"
) -> DataFrame:
    """Log of the stock curve with plateaus blanked, for the items in ``scored`` only.

    Missing values may be null or -1 on the way in; they are null on the way out.
    """
    rows = frame.select(key, "id", log_stock(F.col(predictor)).alias("target_stock"), "item_domain_id")
    if scored is not None:
        rows = rows_of(rows, scored, key)
    return blank_plateaus(rows, key=key)


def log_score_targets(items: DataFrame) -> DataFrame:
    """The same log scale for the stock levels to score."""
    return items.withColumn("target_stock", log_stock(F.col("target_stock")))


def narrow_types(frame: DataFrame, key_type: str = "int") -> DataFrame:
    """Smallest types the model table needs; a key that does not fit raises instead of wrapping."""
    types = {"sku": key_type, "id": "tinyint", "target_stock": "float", "item_domain_id": "int"}
    return frame.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in frame.columns})


def sku_max(frame: DataFrame, column: str = "target_stock", key: str = "sku") -> DataFrame:
    return frame.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(column).alias(column))


def _value_at(values: DataFrame, rank: int, rows: int, accuracy: int, fit: int) -> float:
    """The value with ``rank`` values before it in ascending order, of ``rows`` values in the column ``v``.

    A mergeable sketch gives two values close to the rank on either side; counting says whether the value looked for is
    one of them, or how many lie between them. The next round looks between them only, among some 1 / ``accuracy``
    as many, until ``fit`` or fewer rows are left. Values that many rows share end the search instead of widening it.
    """
    value, inner = F.col("v"), values
    while rows > fit:
        share, margin = rank / (rows - 1), 2.0 / accuracy
        ends = [max(share - margin, 0.0), min(share + margin, 1.0)]
        low, high = inner.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
        places = {
            "below": value < low, "low": value == low, "between": (value > low) & (value < high),
            "high": (value == high) & (value > low), "above": value > high,
        }
        sizes = inner.agg(*[F.count_if(place).alias(name) for name, place in places.items()]).first()
        for name in places:
            if rank < sizes[name]:
                break
            rank -= sizes[name]
        if name in ("low", "high"):
            return low if name == "low" else high
        inner, rows = inner.filter(places[name]), sizes[name]
    return inner.agg(F.sort_array(F.collect_list("v"))[rank]).first()[0]


def exact_quantile(
    frame: DataFrame, column: str, q: float, name: str = "quantile", accuracy: int = 100_000, fit: int = 10_000
) -> DataFrame:
    """Exact interpolated quantile as a one-row table; null values do not count, and without others it is null.

    No task sees more than ``fit`` values at once and nothing is sorted as a whole. The frame is read some times, so it
    should be a written table or a checkpoint.
    """
    value = F.col("v")
    values = frame.select(F.col(column).cast("double").alias("v")).filter(value.isNotNull())
    rows = values.count()
    if rows == 0:
        return values.agg(F.max("v").alias(name))
    position = q * (rows - 1)
    k = int(position)
    here = _value_at(values, k, rows, accuracy, fit)
    near = values.agg(F.count_if(value <= here).alias("upto"), F.min(F.when(value > here, value)).alias("after")).first()
    if position == k or near["upto"] > k + 1:
        found = here
    else:
        found = here + (position - k) * (near["after"] - here)
    return frame.sparkSession.range(1).select(F.lit(found).alias(name))


def outlier_bound(maxima: DataFrame, delta_inf: float = 0.0, q: float = 0.25, column: str = "target_stock") -> DataFrame:
    """Quantile of the per-item maxima, lowered by ``delta_inf`` (one row: ``qq``, ``bound``)."""
    return exact_quantile(maxima, column, q, "qq").withColumn("bound", F.col("qq") - F.lit(float(delta_inf)))


def weight_rule(cut: Column, bound: float, target: Column, null_weight: float, outlier_weight: float) -> Column:
    """Null weight without a target; else 1 above the bound and the outlier weight at or below it (or unknown)."""
    return (
        F.when(target.isNull(), F.lit(float(null_weight)))
        .when(cut > bound, F.lit(1.0))
        .otherwise(F.lit(float(outlier_weight)))
    )


def with_cut(frame: DataFrame, maxima: DataFrame, key: str = "sku") -> DataFrame:
    """Add ``cut``: the training maximum of each row's item."""
    return frame.join(maxima.select(F.col(key), F.col("target_stock").alias("cut")), key, "left")


def weights_from_cut(frame: DataFrame, bound: float, null_weight: float, outlier_weight: float) -> DataFrame:
    """Replace ``cut`` by ``weight``."""
    rule = weight_rule(F.col("cut"), bound, F.col("target_stock"), null_weight, outlier_weight)
    return frame.withColumn("weight", rule).drop("cut")


def sample_weights(
    frame: DataFrame,
    maxima: DataFrame,
    bound: float,
    null_weight: float,
    outlier_weight: float,
    key: str = "sku",
) -> DataFrame:
    """Add ``weight`` from the training maximum of each item and the outlier bound."""
    return weights_from_cut(with_cut(frame, maxima, key), bound, null_weight, outlier_weight)
