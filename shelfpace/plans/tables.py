"""The feature job: from the three inputs to its seventeen tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfpace.operators import features, grid, longseries, metadata
from shelfpace.operators import series as s
from shelfpace.session import shared_folder
from shelfpace.sources.writers import write_table

FRAMES = ("train", "validation", "train_active", "validation_active")
# Names of the tables the job hands over.
TABLE_NAMES = (
    "train",
    "validation",
    "train_active",
    "validation_active",
    "test",
    "train_active_min",
    "validation_active_min",
    "features_train",
    "features_train_active",
    "features_validation",
    "features_validation_active",
    "dof_train",
    "dof_train_active",
    "dof_validation",
    "dof_validation_active",
    "days_activity_train",
    "days_activity_validation",
)
@dataclass(frozen=True)
class Inputs:
    panel: DataFrame
    meta: DataFrame
    score_items: DataFrame


def label(panel: DataFrame, active: bool, compat: bool = False) -> DataFrame:
    """Labelled panel for all days or for active days, by plain windows: for panels with one row per item and day."""
    return s.labelled_series(s.active_only(panel) if active else panel, running_max=compat)


def dense_frame(frame: DataFrame, keys: DataFrame, meta: DataFrame, compat: bool, active: bool) -> DataFrame:
    """One frame on the day grid with metadata. Currency and maximum carry forward; so would domain and
    site, but cleaned metadata has no nulls to fill."""
    laid = grid.densify(frame.drop("date", "is_train"), keys, carry=("currency", "max"))
    rich = metadata.with_meta(laid, meta)
    filled = grid.mark_missing(rich) if compat else rich
    return filled.drop("is_active") if active else filled


def tables_from_labelled(
    labelled: Callable[[bool], DataFrame],
    meta: DataFrame,
    score_items: DataFrame,
    keys: DataFrame,
    categories: dict[str, Sequence[str]],
    compat: bool,
) -> dict[str, Callable[[], DataFrame]]:
    """One function per table, so that asking for one does not plan the others. ``labelled`` gives the
    labelled panel for all days (false) or for active days (true)."""
    clean = metadata.clean_meta(meta)
    rule = features.CHARACTER_RULE if compat else features.SHARE

    def frame(name: str) -> DataFrame:
        side = 1 if name.startswith("train") else 0
        return labelled(name.endswith("_active")).filter(F.col("is_train") == side)

    def dense(name: str) -> DataFrame:
        return dense_frame(frame(name), keys, clean, compat, active=name.endswith("_active"))

    made: dict[str, Callable[[], DataFrame]] = {"test": lambda: metadata.score_list(score_items, meta)}
    for name in FRAMES:
        made[name] = lambda n=name: dense(n)
        made[f"{name}_min"] = lambda n=name: grid.minimal_table(dense(n))
        made[f"features_{name}"] = lambda n=name: features.sku_features(frame(n), categories, rule)
        made[f"dof_{name}"] = lambda n=name: features.weekday_profile(frame(n), add_key=compat)
        made[f"days_activity_{name}"] = lambda n=name: features.active_share(frame(n))
    return {name: made[name] for name in TABLE_NAMES}


def feature_tables(
    inputs: Inputs,
    categories: dict[str, Sequence[str]] | None = None,
    compat: bool = False,
    keys: DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """All tables as functions that return lazy plans. ``keys`` are the items of the grid (default: those of the panel)."""
    if categories is None:
        categories = features.category_values(inputs.panel)
    keys = inputs.panel.select("sku").distinct() if keys is None else keys
    return tables_from_labelled(lambda active: label(inputs.panel, active, compat), inputs.meta, inputs.score_items, keys, categories, compat)


def build_tables(
    spark: SparkSession,
    inputs: Inputs,
    out: str,
    categories: dict[str, Sequence[str]] | None = None,
    compat: bool = True,
    parts: int | None = None,
) -> dict[str, str]:
    """Write all tables below ``out`` and return their paths.

    The panel is laid out once in ranges of item and day (``longseries.place``, ``parts`` ranges if given), which serve
    both labelled panels; series of any length take this one way. Repeated days are ordered by their other columns, so
    the split falls on the same rows in every run. The labelled panels are written by side of the split, and
    the seventeen tables read one side each. All staged tables are dropped at the end.
    """
    stage = f"shelfpace_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {stage} LOCATION '{shared_folder(spark)}/{stage}'")
    try:
        ties = [c for c in inputs.panel.columns if c not in ("sku", "date")]
        placed = longseries.place(s.add_activity(inputs.panel), "date", parts=parts, table=f"{stage}.placed")
        if categories is None:
            categories = features.category_values(placed)
        for name, frame in (("labelled", placed), ("labelled_active", s.active_only(placed))):
            curve = longseries.labelled_curve(frame, "date", ties, running_max=compat)
            curve.write.format("parquet").partitionBy("is_train").saveAsTable(f"{stage}.{name}")
        labelled = {False: spark.table(f"{stage}.labelled"), True: spark.table(f"{stage}.labelled_active")}
        keys = placed.select("sku").distinct()
        made = tables_from_labelled(labelled.get, inputs.meta, inputs.score_items, keys, categories, compat)
        return {name: write_table(make(), out, name) for name, make in made.items()}
    finally:
        spark.sql(f"DROP DATABASE {stage} CASCADE")
