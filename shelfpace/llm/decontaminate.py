"""Benchmark decontamination: windows of typed templates, joined by hash, with a check of the slots.

Built-in functions only. Numbers, names and units become placeholders, so that a benchmark question with other values
keeps its template. A document window with the template of a benchmark window counts if the values fit: in the window each
benchmark value stands for one document value and the other way round. A slot that does not fit rejects the windows that hold it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpace.llm.sqltext import let, one_space
from shelfpace.llm.staging import stage

WINDOW = 12  # words
SHORTEST = 5  # words of the shortest item that is searched for
LITERALS = 5  # plain words a window needs so that other values in its slots still count

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"  # private-use characters; texts lose theirs
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs ms hz khz mhz ghz kb mb gb tb v w kw a k c f usd eur gbp percent "
    "meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents"
).split()


def _plain(text: Column) -> Column:
    """The text without private-use characters and without words that hold no letter or digit."""
    kept = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\ue000-\uf8ff]", "")
    return F.regexp_replace(kept, r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)", "")


def _split(text: Column) -> Column:
    return F.filter(F.split(one_space(text), " "), lambda w: w != "")


def values(text: Column) -> Column:
    """Words as they stand, in step with ``template``; case and punctuation at the ends do not count."""
    return F.transform(_split(_plain(text)), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def template(text: Column) -> Column:
    """Words with placeholders for numbers, names (capitals inside a sentence) and units behind a number."""
    t = _plain(text)
    digits = t.rlike("[0-9]")
    t = F.regexp_replace(t, r"(?<=[^\s.!?:;\"»] )[\p{Lu}][^\s0-9]*(?!\S)", NAME)
    t = F.when(digits, F.regexp_replace(t, r"(?<!\S)(?=\S*[0-9])\S+", NUMBER)).otherwise(t)
    unit = rf"(?i)(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])\S*"
    t = F.when(digits, F.regexp_replace(t, unit, UNIT)).otherwise(t)
    t = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}\s\ue000-\ue002]+", ""))
    return _split(t)


def _windows(words: Column, sizes: list[int]) -> Column:
    """size, at, h (hash) of the windows of each size that start at each place; the words are made once."""

    def hashed(ws: Column, size: int) -> Column:
        each = F.transform(ws, lambda w, i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, size))).alias("h")))
        return F.slice(each, 1, F.greatest(F.size(ws) - (size - 1), F.lit(0)))

    return let(words, lambda ws: F.concat(*(hashed(ws, size) for size in sizes)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, size, item_id, place, has_slots, weak, template, values per window of each item; one shorter window for shorter items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.inline(F.array(F.struct(template(F.col("text")).alias("t"), values(F.col("text")).alias("v")))))
    items = items.filter(F.size("t") >= SHORTEST).withColumn("size", F.least(F.size("t"), F.lit(window)))
    places = items.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("place"))
    cut = places.select("item_id", "size", "place", F.slice("t", F.col("place") + 1, F.col("size")).alias("t"), F.slice("v", F.col("place") + 1, F.col("size")).alias("v"))
    slots = F.size(F.filter("t", lambda w: w.isin(NUMBER, NAME, UNIT)))
    hashed = reduce(lambda acc, n: acc.when(F.col("size") == n, F.xxhash64(*(F.get("t", F.lit(k)) for k in range(n)))), range(SHORTEST, window + 1), F.when(F.lit(False), F.lit(0).cast("long")))
    return cut.select(hashed.alias("h"), "size", "item_id", "place", (slots > 0).alias("has_slots"), (F.col("size") - slots < LITERALS).alias("weak"), "t", "v")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, n_windows for every document and item that share a template window whose slots fit."""
    bench = stage(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most ``window`` values
    keys = stage(bench.select("h", "size").distinct(), "benchmark-keys")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not sizes:
        return rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    found = rows.select("doc_id", F.inline(_windows(template(F.col("text")), sizes)))
    hits = stage(found.join(keys, ["h", "size"]).select("doc_id", "at", "h", "size"), "window-hits")
    pairs = hits.join(bench, ["h", "size"]).select("doc_id", "at", "size", "item_id", "place", "has_slots", "weak", "t", F.col("v").alias("theirs"))
    pairs = stage(pairs, "window-pairs")
    # Values of the documents, only where a template has slots.
    slotted = pairs.filter("has_slots")
    needed = stage(slotted.select("doc_id").distinct(), "slot-documents")
    words = rows.join(needed, rows["doc_id"].eqNullSafe(needed["doc_id"]), "left_semi").select(F.col("doc_id").alias("of"), values(F.col("text")).alias("ours"))
    slots = F.filter(F.arrays_zip("t", "theirs", F.slice("ours", F.col("at") + 1, F.col("size")).alias("ours")), lambda s: s["t"].isin(NUMBER, NAME, UNIT))
    checked = slotted.join(words, F.expr("doc_id <=> of")).withColumn("slots", slots)

    def kinds(*fields: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*(s[f] for f in fields)))))

    one_to_one = (kinds("t", "theirs", "ours") == kinds("t", "theirs")) & (kinds("t", "theirs", "ours") == kinds("t", "ours"))
    same = F.forall("slots", lambda s: s["theirs"].eqNullSafe(s["ours"]))
    fits = checked.filter(F.when(F.col("weak"), same).otherwise(one_to_one)).select("doc_id", "item_id", "at", "size")
    fits = pairs.filter(~F.col("has_slots")).select("doc_id", "item_id", "at", "size").unionByName(fits)
    return fits.groupBy("doc_id", "item_id").agg(F.countDistinct("at", "size").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, contaminated, items (sorted ids of the benchmark items found), n_windows.

    Items of fewer than ``window`` words are searched for whole, those of fewer than ``SHORTEST`` words not at all. A
    window with fewer than ``LITERALS`` plain words counts only with the benchmark's own values.

    Null or empty texts hold nothing. Rows with the same doc_id share their result; a null doc_id is an id like others.
    Items with null text are not searched for. Other columns are not read; empty tables give an empty result or none found.
    """
    found = matches(docs, benchmark, window).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sum("n_windows").alias("n_windows"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = ids.join(found.withColumnRenamed("doc_id", "found_id"), F.expr("doc_id <=> found_id"), "left")
    return joined.select(
        "doc_id",
        F.col("n_windows").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("n_windows", F.lit(0).cast("long")).alias("n_windows"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item was found."""
    found = stage(matches(docs, benchmark, window).select(F.col("doc_id").alias("found_id")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["found_id"]), "left_anti")
