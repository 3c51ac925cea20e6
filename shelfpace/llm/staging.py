"""Staged tables: rows written once below the shared folder of the cluster and read back by later steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shelfpace.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir``."""
    return f"{shared_folder(spark)}/shelfpace-llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *apart: str) -> DataFrame:
    """Write ``df`` and read it back: its lineage ends at files that every executor can reach. Values of the columns
    ``apart`` have files of their own."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*apart).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 128, size: int = 16 << 20) -> Iterator[None]:
    """While jobs run inside, hand Python that many rows and about so many bytes at once, for rows that hold whole sets or groups."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
