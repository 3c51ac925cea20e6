"""Text inputs line by line: where each line stands, which lines hold a record, and why the others do not.

Spark reads a file in blocks, side by side. The rank of a line inside its block is known where the block is read; one
small table with a row per block says how many lines stand before it. Positions do not depend on how files are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfpace.functions.windows import series_window
from shelfpace.sources import schemas


def numbered_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """position, file_line, raw of every line: ``position`` counts the lines of all files in name order from 0,
    ``file_line`` those of the line's own file. With ``header``, the first line of each file is left out and counts in
    ``file_line`` only. Blank lines count too. An empty file has no lines."""
    block = ["_file", "_start"]
    lines = spark.read.text(path).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        # Ascending inside a block, which one task reads from its first line to its last.
        F.monotonically_increasing_id().alias("_row"),
    )
    blocks = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first"))
    before = (Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    in_file = F.coalesce(F.sum("_lines").over(series_window("_file", "_start", rows=before)), nothing)
    skipped = F.lit(1 if header else 0).cast("long")
    files = blocks.groupBy("_file").agg((F.sum("_lines") - skipped).alias("_all"))
    # One row per file goes through the unpartitioned window.
    earlier = F.coalesce(F.sum("_all").over(series_window([], "_file", rows=before)), nothing)
    starts = blocks.withColumn("_in_file", in_file).join(files.select("_file", earlier.alias("_earlier")), "_file")
    rank = F.col("_row") - F.col("_first") + F.col("_in_file")
    numbered = lines.join(starts, block).withColumn("file_line", rank).filter(F.col("file_line") >= skipped)
    return numbered.select((F.col("_earlier") + F.col("file_line") - skipped).alias("position"), "file_line", "raw")


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """Text of the first check that holds, null if none does."""
    return F.coalesce(*[F.when(check, F.lit(reason)) for check, reason in checks])


def score_item_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every line of the CSV of items to score but headers and blank ones: position, raw, reason, sku, target_stock, monid.

    Each file starts with a header unless told otherwise. ``reason`` is null for a record and else names what is wrong: "wrong number of
    fields", "bad key" (missing, or no whole number of 64 bits) or "bad number" (a stock that is neither missing nor a
    number). Fields beyond the second are not read. ``monid`` is the line's position, which orders the records as in the
    input. Quoted fields must not span lines.
    """
    lines = numbered_lines(spark, path, header).filter(F.trim("raw") != "")
    fields = F.from_csv("raw", "_key string, _stock string", {"mode": "PERMISSIVE"})
    parsed = lines.withColumn("_fields", fields).select("position", "raw", "_fields.*")
    key, stock = F.trim("_key"), F.trim("_stock")
    typed = parsed.withColumns({"sku": key.try_cast("bigint"), "target_stock": stock.try_cast("double")})
    has_stock = F.coalesce(stock != "", F.lit(False))
    reason = _first_reason(
        (~F.contains("raw", F.lit(",")), "wrong number of fields"),
        (F.col("sku").isNull(), "bad key"),
        (has_stock & F.col("target_stock").isNull(), "bad number"),
    )
    return typed.select("position", "raw", reason.alias("reason"), "sku", "target_stock", F.col("position").alias("monid"))


def item_meta_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the metadata but blank ones: position, raw, reason, sku, item_domain_id, site_id.

    ``reason`` is null for a record, else "broken record" (no JSON object, or a field of another type) or "bad key" (a
    readable record without key).
    """
    lines = numbered_lines(spark, path).filter(F.trim("raw") != "")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ITEM_META)
    record = F.from_json("raw", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    parsed = lines.withColumn("_record", record).select("position", "raw", "_record.*")
    no_object = ~F.startswith(F.trim("raw"), F.lit("{"))
    reason = _first_reason((no_object | F.col("_broken").isNotNull(), "broken record"), (F.col("sku").isNull(), "bad key"))
    return parsed.select("position", "raw", reason.alias("reason"), *schemas.ITEM_META.names)


def records(lines: DataFrame) -> DataFrame:
    """The readable records, without their raw text."""
    return lines.filter(F.col("reason").isNull()).drop("position", "raw", "reason")


def rejects(lines: DataFrame, source: str) -> DataFrame:
    """source, position, reason, raw of the lines that hold no record."""
    return lines.filter(F.col("reason").isNotNull()).select(F.lit(source).alias("source"), "position", "reason", "raw")


def digest(lines: DataFrame) -> DataFrame:
    """n_lines and checksum (one row) of positions and texts; any changed, moved, missing or added line changes it
    but by chance. Adds up on the map side."""
    mark = F.pmod(F.xxhash64("position", "raw"), F.lit(1 << 31))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(mark), F.lit(0).cast("long")).alias("checksum"))


def write_manifest(spark: SparkSession, path: str) -> None:
    """Lines and checksum of the text files in ``path``, written beside it once they are complete."""
    digest(numbered_lines(spark, path)).write.mode("overwrite").json(f"{path}.manifest")


def checked_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of files that agree with their manifest. Raises without one, or if they differ, as they do
    after a run that broke off half-way."""
    wanted = spark.read.schema("n_lines long, checksum long").json(f"{path}.manifest").first()
    lines = numbered_lines(spark, path)
    found = digest(lines).first()
    if wanted is None or found != wanted:
        raise ValueError(f"{path} does not agree with its manifest: {found} instead of {wanted}")
    return lines
