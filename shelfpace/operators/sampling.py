"""Repeatable samples of keys. The choice depends on key and seed only, so frames that share a key agree
on it without a join, and a lost task recomputes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.functions.columns import hash_text, in_hash_share


def key_sample(frame: DataFrame, size: int = 200, seed: int = 42, key: str = "sku") -> DataFrame:
    """``size`` distinct keys, picked by hash order (a top-k, no full sort)."""
    keys = frame.select(key).distinct()
    return keys.orderBy(hash_text(F.col(key), seed), F.col(key)).limit(size)


def rows_of(frame: DataFrame, keys: DataFrame, key: str = "sku") -> DataFrame:
    """Rows whose key is in ``keys``."""
    return frame.join(keys.select(key), key, "left_semi")


def group_sample(frame: DataFrame, share: float = 0.2, seed: int = 42, key: str = "sku") -> DataFrame:
    """All rows of about ``share`` of the keys; a filter, so it runs inside the scan stage."""
    return frame.filter(in_hash_share(F.col(key), share, seed))
