"""The three inputs derived from retail order tables (part, orders, lineitem) and from an event log."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that one task groups at most, if keys are spread evenly.
TASK_ROWS = 500_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Category columns of the panel and where they come from.
CATEGORY_SOURCES = {
    "currency": "l_linestatus",
    "listing_type": "l_returnflag",
    "shipping_payment": "l_linestatus",
    "shipping_logistic_type": "o_orderpriority",
}


def _tasks(table: DataFrame, task_rows: int) -> int | None:
    """Partitions for grouping ``table``, where the session's number would give a task more than ``task_rows`` rows."""
    parts = math.ceil(table.count() / task_rows)
    return parts if parts > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _spread(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by the keys into so many partitions, if a number is given."""
    return rows.repartition(parts, *keys) if parts else rows


def sku_daily(spark: SparkSession, sf_dir: str, categories: tuple[str, ...] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per item and day, with the category columns asked for.

    The grouping combines on the map side, so an item that owns a large part of all order lines shrinks
    before it is shuffled, and no item keeps more rows than the calendar has days. That is the bound the
    per-item windows downstream rely on.

    The least text of a group cannot be kept in a hash table, and sorting all order lines for it would be
    wasteful. So lines are first grouped by day and category values with hashing; only the few rows left
    are laid out by item and sorted by day, a layout and order the windows then find ready. The join to
    ``orders`` is made only when the one column that needs it is asked for.

    Where the session's partitions would hold more than ``task_rows`` lines each, the number of partitions follows the
    lines. They are then dealt by item, day and values before they are grouped, so no hash table grows with the table.
    """
    lines = _read(spark, sf_dir, "lineitem")
    parts = _tasks(lines, task_rows)
    if "shipping_logistic_type" in categories:
        orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    texts = sorted({CATEGORY_SOURCES[c] for c in categories})
    named = lines.select(
        F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_linenumber", "l_extendedprice", *texts
    )
    by_day = _spread(named, parts, "sku", "date", *texts).groupBy("sku", "date", *texts).agg(
        F.sum("l_quantity").alias("sold_quantity"),
        F.min("l_linenumber").alias("first_line"),
        F.min("l_extendedprice").alias("current_price"),
    )
    by_day = _spread(by_day, parts, "sku")
    if categories:
        by_day = (
            (by_day if parts else by_day.repartition("sku"))
            .groupBy("sku", "date")
            .agg(
                F.sum("sold_quantity").alias("sold_quantity"),
                F.min("first_line").alias("first_line"),
                F.min("current_price").alias("current_price"),
                *[F.min(CATEGORY_SOURCES[c]).alias(c) for c in categories],
            )
        )
    minutes = ((F.col("first_line") - 1) * 240).cast("double").alias("minutes_active")
    return by_day.select("sku", "date", "sold_quantity", minutes, "current_price", *categories)


def sku_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items of the panel, straight from the one column that holds them."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku")).distinct()


def item_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every part, with prefixed domains, some of them null (promotional parts)."""
    part = _read(spark, sf_dir, "part")
    domain = F.concat(F.lit("X-"), F.col("p_brand"), F.lit("-"), F.col("p_type"), F.lit(" "), F.col("p_brand"))
    return part.select(
        F.col("p_partkey").alias("sku"),
        F.when(F.col("p_type") != "PROMO", domain).alias("item_domain_id"),
        F.col("p_brand").alias("site_id"),
    )


def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with a stock level; the factor spreads the levels over the range of the running stock."""
    part = _read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("sku"), (F.col("p_size") * 15).cast("double").alias("target_stock"))


def score_item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of parts as text in key order, one line a part: some without a stock, some that hold no record."""
    part = _read(spark, sf_dir, "part").orderBy("p_partkey")
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 20
    stock = (F.col("p_size") * 15).cast("string")
    line = (
        F.when(kind == 1, F.concat(F.lit("x"), key, F.lit(","), stock))
        .when(kind == 2, F.concat(key, F.lit(",unknown")))
        .when(kind == 3, key)
        .when(kind == 4, F.concat(key, F.lit(",")))
        .otherwise(F.concat(key, F.lit(","), stock))
    )
    return part.select(line.alias("value"))


def user_daily(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Mostly gap-free panel: one row per user and day of the event log."""
    events = _read(spark, sf_dir, "events")
    parts = _tasks(events, task_rows)
    named = _spread(events.select(F.col("user_id").alias("sku"), F.to_date("ts").alias("date")), parts, "sku", "date")
    by_day = named.groupBy("sku", "date").agg(F.count(F.lit(1)).cast("double").alias("sold_quantity"))
    return _spread(by_day, parts, "sku")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single event as one row: series without a calendar bound."""
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sku"), "ts", "event_id", F.col("value").alias("sold_quantity")
    )
