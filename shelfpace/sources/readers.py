"""Typed scans of the panel (Parquet), the item metadata (JSON lines) and the items to score (CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfpace.sources import schemas


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Daily panel. Columns are cast to the panel types, so files with text dates or integer measures load too."""
    raw = spark.read.parquet(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PANEL])


def read_item_meta(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata; the fixed schema avoids the inference job and skips fields nobody reads."""
    return spark.read.schema(schemas.ITEM_META).json(path)


def read_score_items(spark: SparkSession, path: str) -> DataFrame:
    """Items to score: a CSV with header whose first two columns are ``sku`` and ``target_stock``."""
    return spark.read.schema(schemas.SCORE_ITEMS).csv(path, header=True, enforceSchema=False)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables written by :func:`shelfpace.plans.tables.build_tables`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
