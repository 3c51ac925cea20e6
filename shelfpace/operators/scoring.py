"""Scores of predicted day distributions: ranked-probability score and its residuals, weighted log loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.functions.arrays import clipped, reached_by, running_total

CLASSES = 30
# Fixed value: smallest probability inside the logarithm.
LEAST_PROBABILITY = 1e-16


def squared_distance(label: Column, probabilities: Column, classes: int = CLASSES) -> Column:
    """Sum over classes of the squared gap between cumulative label and clipped cumulative probability."""
    start = F.struct(F.lit(0.0).alias("reached"), F.lit(0.0).alias("gap"))

    def add_class(acc: Column, entry: Column) -> Column:
        reached = acc["reached"] + entry["p"]
        goal = F.when(entry["k"] >= label, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.struct(reached.alias("reached"), (acc["gap"] + F.pow(goal - clipped(reached), F.lit(2.0))).alias("gap"))

    entries = F.zip_with(
        F.sequence(F.lit(1), F.lit(classes)), probabilities, lambda k, p: F.struct(k.alias("k"), p.alias("p"))
    )
    return F.aggregate(entries, start, add_class, lambda acc: acc["gap"])


def ranked_probability_score(
    frame: DataFrame, label: str = "id", probabilities: str = "probabilities", classes: int = CLASSES
) -> DataFrame:
    """sqrt(total squared distance / (rows - 1)), labels counted from 1; one row."""
    gap = squared_distance(F.col(label), F.col(probabilities), classes)
    return frame.select(gap.alias("gap")).agg(mean_ranked_score(F.col("gap")).alias("score"))


def mean_ranked_score(gap: Column) -> Column:
    """sqrt(total / (rows - 1)) as an aggregate, over rows whose squared distance is not null."""
    return F.sqrt(F.try_divide(F.sum(gap), F.count(gap) - 1))


def score_residuals(
    frame: DataFrame, label: str = "id", probabilities: str = "probabilities", classes: int = CLASSES
) -> DataFrame:
    """Gradient 2 (P - Y) and curvature 2 of the squared distance, one array entry per class."""
    reached = F.transform(running_total(F.col(probabilities)), clipped)
    gaps = F.zip_with(reached, reached_by(F.col(label), classes), lambda p, y: F.lit(2.0) * (p - y))
    return frame.withColumns(
        {"gradient": gaps, "curvature": F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda _: F.lit(2.0))}
    )


def log_loss(
    frame: DataFrame, label: str = "id", probabilities: str = "probabilities", weight: str | None = "weight"
) -> DataFrame:
    """Weighted mean of -ln(probability of the label), labels counted from 1; one row."""
    w = F.col(weight) if weight else F.lit(1.0)
    return frame.agg(mean_log_loss(F.col(probabilities), w, F.col(label)).alias("log_loss"))


def mean_log_loss(probabilities: Column, weight: Column, label: Column | None = None) -> Column:
    """The same as an aggregate; rows without a weight do not count."""
    label = F.col("id") if label is None else label
    hit = F.greatest(F.element_at(probabilities, label.cast("int")), F.lit(LEAST_PROBABILITY))
    return F.try_divide(F.sum(weight * -F.ln(hit)), F.sum(weight))
