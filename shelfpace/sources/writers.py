"""Sinks. Every write stays parallel: one file per task, never the whole table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.sources.lines import write_manifest


def write_table(df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = ()) -> str:
    path = f"{folder}/{name}.parquet"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def probability_text(df: DataFrame, column: str = "probabilities", classes: int = 30, digits: int = 4) -> DataFrame:
    """One text column per class, each with a fixed number of decimals."""
    return df.select(
        *[F.format_string(f"%.{digits}f", F.col(column)[i]).alias(f"p_{i + 1}") for i in range(classes)]
    )


def write_predictions(
    df: DataFrame, path: str, order: str = "monid", column: str = "probabilities", classes: int = 30
) -> None:
    """Headerless CSV of the class probabilities in input order: the files in name order, one after the other, are
    the whole list. A manifest (lines, checksum) is written last; ``lines.checked_lines`` reads what agrees with it."""
    ordered = df.orderBy(order)
    probability_text(ordered, column, classes).write.mode("overwrite").option("header", False).csv(path)
    write_manifest(df.sparkSession, path)


def write_trials(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
