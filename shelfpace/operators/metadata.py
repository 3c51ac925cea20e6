"""Item metadata: cleaning, enrichment of the panel, and the list of items to score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpace.functions.columns import domain_name


def clean_meta(meta: DataFrame) -> DataFrame:
    """Domain without its prefixes; missing texts become empty."""
    return meta.withColumn("item_domain_id", domain_name(F.col("item_domain_id"))).na.fill("")


def duplicate_keys(meta: DataFrame, key: str = "sku") -> DataFrame:
    """Keys that occur more than once; each would multiply the rows it is joined to."""
    return meta.groupBy(key).count().filter(F.col("count") > 1)


def with_meta(frame: DataFrame, meta: DataFrame, how: str = "inner", key: str = "sku") -> DataFrame:
    """Add domain and site. Inner: items without metadata vanish. The join strategy is left to Spark,
    which broadcasts the metadata only when its measured size allows."""
    return frame.join(meta.select(key, "item_domain_id", "site_id"), key, how)


def tag_input_order(items: DataFrame) -> DataFrame:
    return items.withColumn("monid", F.monotonically_increasing_id())


def score_list(items: DataFrame, meta: DataFrame, key: str = "sku") -> DataFrame:
    """Items to score with their metadata, in input order (``monid``); unmatched items keep an empty domain."""
    tagged = items if "monid" in items.columns else tag_input_order(items)
    joined = with_meta(tagged, clean_meta(meta), "left", key)
    return joined.withColumn("item_domain_id", F.coalesce("item_domain_id", F.lit(""))).orderBy("monid")
