"""Registered queries: every operator on inputs derived from the given tables, whole tables always.

Queries ending in ``_compat`` use the historical variants (running maximum, character rule, key in the
weekday denominator, -1 for missing); the others use the plain definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfpace.operators import encoding, features, grid, longseries, metadata, model, quality, sampling, scoring
from shelfpace.operators import series as s
from shelfpace.operators import target as t
from shelfpace.plans import tables
from shelfpace.session import cut_lineage, fresh_folder
from shelfpace.sources import lines, retail

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
# Averages of whole numbers often end exactly halfway between two rounded values, where the last bit of a
# sum decides. Both sides of the comparison shift by this much first.
OFF_HALF = 3e-9
SPLIT = s.SPLIT_AT
ROLLING = [f"rolling_{c}_{n}" for c in s.CURVES for n in s.LOOKBACKS]
# Categories of the given tables, in sorted order; proportions of other values would get no column.
CATEGORIES = {
    "listing_type": ["A", "N", "R"],
    "shipping_payment": ["F", "O"],
    "shipping_logistic_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}
WEIGHTS = {"null_weight": 0.25, "outlier_weight": 0.5}
DELTA_INF = 0.5


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, because the order of summation differs between engines. Scaling and ``rint`` stay
    on primitive doubles, where ``round`` would go through decimals; adding zero drops negative zeros."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    scale = F.lit(float(10**digits))
    rounds = {c: F.rint((F.col(c) + OFF_HALF) * scale) / scale + F.lit(0.0) for c in doubles}
    return df.withColumns(rounds) if rounds else df


# --- shared inputs -------------------------------------------------------------------------------


def _curve(
    spark: SparkSession, sf: str, active: bool = False, compat: bool = False, categories: tuple[str, ...] = ()
) -> DataFrame:
    panel = retail.sku_daily(spark, sf, categories)
    return s.labelled_series(s.active_only(panel) if active else panel, running_max=compat)


def _side(spark: SparkSession, sf: str, train: bool, categories: tuple[str, ...] = ()) -> DataFrame:
    """One side of the split with day numbers, without curves."""
    days = s.number_days(s.add_activity(retail.sku_daily(spark, sf, categories)))
    return days.filter(F.col("is_train") == (1 if train else 0))


def _dense(
    spark: SparkSession,
    sf: str,
    train: bool,
    active: bool,
    categories: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    frame = _curve(spark, sf, active, categories=categories).filter(F.col("is_train") == (1 if train else 0)).drop("date", "is_train")
    own_keys = train and not active
    return grid.densify(frame, None if own_keys else retail.sku_keys(spark, sf), carry=carry)


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.clean_meta(retail.item_meta(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return retail.score_items(spark, sf)


def _target_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The one curve that targets need, of the scored items on active days, for both sides of the split."""
    panel = s.active_only(retail.sku_daily(spark, sf))
    panel = sampling.rows_of(panel, _scored(spark, sf))
    curve = s.rolling_means(s.running_stock(s.number_days(panel)), ["cumsum"], [1])
    return curve.select("sku", "id", "is_train", "rolling_cumsum_1")


def _target(spark: SparkSession, sf: str, train: bool, curve: DataFrame | None = None) -> DataFrame:
    """Prepared target of one side of the active frame; who needs both sides hands in a written curve."""
    curve = _target_curve(spark, sf) if curve is None else curve
    frame = curve.filter(F.col("is_train") == (1 if train else 0)).drop("is_train")
    keys = sampling.rows_of(retail.sku_keys(spark, sf), _scored(spark, sf))
    dense = metadata.with_meta(grid.densify(frame, keys), _meta(spark, sf))
    return t.prepare_target(dense)


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes over the panel's and the score list's domains. The grid only repeats an item's domain, so the
    panel side reads keys and metadata, not the grid."""
    meta, scored = _meta(spark, sf), _scored(spark, sf)
    in_panel = metadata.with_meta(sampling.rows_of(retail.sku_keys(spark, sf), scored), meta)
    to_score = metadata.with_meta(scored, meta, "left").withColumn(
        "item_domain_id", F.coalesce("item_domain_id", F.lit(""))
    )
    return encoding.category_codes([in_panel, to_score])


def _encoded(spark: SparkSession, sf: str, train: bool) -> DataFrame:
    return encoding.encode(_target(spark, sf, train), _codes(spark, sf))


def _chances(rows: DataFrame) -> DataFrame:
    """A day distribution computed from each row itself: weight 1 / (1 + distance) around a day that
    depends on the item, scaled to sum to 1. The scale depends on that day only: one of 30 constants."""
    centre = F.pmod(F.col("sku") * 7 + 3, F.lit(30)) + 1
    totals = F.array(*[F.lit(sum(1.0 / (1.0 + abs(k - c)) for k in range(1, 31))) for c in range(1, 31)])
    placed = rows.withColumn("centre", centre.cast("int")).withColumn("total", F.element_at(totals, F.col("centre")))
    chance = F.transform(
        F.sequence(F.lit(1), F.lit(30)),
        lambda k: F.lit(1.0) / (F.lit(1.0) + F.abs(k - F.col("centre")).cast("double")) / F.col("total"),
    )
    return placed.withColumn("probabilities", chance).drop("centre", "total")


def _weighted(spark: SparkSession, sf: str, train: bool) -> DataFrame:
    """Weights of one side. The curve is written once for both sides, the early side once more: the maxima, the
    quantile and (for the early side itself) the weighted rows come from it."""
    curve = None if train else cut_lineage(_target_curve(spark, sf))
    early = cut_lineage(_target(spark, sf, True, curve))
    maxima = cut_lineage(t.sku_max(early))
    bound = t.outlier_bound(maxima, DELTA_INF).first()["bound"]
    return t.sample_weights(early if train else _target(spark, sf, False, curve), maxima, bound, **WEIGHTS)


# --- queries -------------------------------------------------------------------------------------


def selling_rate(spark: SparkSession, sf: str) -> DataFrame:
    return s.add_activity(retail.sku_daily(spark, sf)).select("sku", "date", "selling_rate", "is_active")


def series_split(spark: SparkSession, sf: str) -> DataFrame:
    days = s.number_days(retail.sku_daily(spark, sf))
    return days.select("sku", "date", "id", "is_train", s.split_key().alias("sku_split"))


def stock_curve(spark: SparkSession, sf: str, active: bool = False) -> DataFrame:
    panel = retail.sku_daily(spark, sf)
    days = s.number_days(s.active_only(panel) if active else panel)
    curve = s.rolling_means(s.running_stock(days), ["cumsum"], [1])
    return curve.select("sku", "date", "id", "is_train", "cumsum", "rolling_cumsum_1")


def cumsum_pc(spark: SparkSession, sf: str, compat: bool = False) -> DataFrame:
    curve = s.running_stock(s.number_days(retail.sku_daily(spark, sf)), running_max=compat)
    return curve.select("sku", "id", "is_train", "cumsum", "max", "cumsum_pc")


def rolling_means(spark: SparkSession, sf: str, active: bool = False, compat: bool = False) -> DataFrame:
    return _curve(spark, sf, active, compat).select("sku", "id", "is_train", *ROLLING)


def event_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Running stock over single events, where one user may own any part of all rows."""
    events = longseries.place(retail.user_events(spark, sf), "ts")
    curve = longseries.labelled_curve(events, time="ts", ties=["event_id"])
    return curve.select("sku", "event_id", "id", "is_train", "cumsum", "max", "cumsum_pc", *ROLLING)


def category_share(spark: SparkSession, sf: str, column: str, rule: str, drop_first: bool = False) -> DataFrame:
    frame = _side(spark, sf, True, (column,))
    return features.category_share(frame, column, CATEGORIES[column], rule, drop_first)


def sku_features(spark: SparkSession, sf: str, rule: str = features.SHARE) -> DataFrame:
    return features.sku_features(_side(spark, sf, True, tuple(CATEGORIES)), CATEGORIES, rule)


def weekday_profile(spark: SparkSession, sf: str, compat: bool = False) -> DataFrame:
    return features.weekday_profile(_side(spark, sf, True), add_key=compat)


def active_share(spark: SparkSession, sf: str) -> DataFrame:
    return features.active_share(_side(spark, sf, True))


def day_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid.day_grid(retail.sku_keys(spark, sf))


def dense_panel(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["sku", "id", "sold_quantity", "currency", "cumsum", "cumsum_pc", "rolling_cumsum_1"]
    return _dense(spark, sf, train=False, active=True, categories=("currency",)).select(*columns)


def category_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every category of the panel, discovered."""
    return features.category_values_long(retail.sku_daily(spark, sf, tuple(CATEGORIES)))


def category_share_long(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of all categories of each item as rows; no list of values anywhere."""
    return rounded(features.category_share_long(retail.sku_daily(spark, sf, tuple(CATEGORIES))))


def repeated_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which an item has several order lines, so that the lines alone are no daily panel."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("sku"), F.col("l_shipdate").cast("date").alias("date"))
    return quality.repeated_days(lines)


def meta_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _meta(spark, sf)


def panel_with_meta(spark: SparkSession, sf: str) -> DataFrame:
    joined = metadata.with_meta(_dense(spark, sf, train=True, active=False), _meta(spark, sf))
    return joined.select("sku", "id", "sold_quantity", "cumsum", "item_domain_id", "site_id")


def forward_filled(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, sf, train=False, active=False, categories=("currency",))
    return grid.carry_forward(dense, ["currency", "max"]).select("sku", "id", "cumsum", "currency", "max")


def sentinel_filled(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, sf, True, True, categories=("currency",), carry=("currency", "max"))
    columns = ["sku", "id", "currency", "max", "cumsum_pc", *grid.SENTINEL_COLUMNS]
    return grid.mark_missing(dense).select(*columns)


def min_table(spark: SparkSession, sf: str) -> DataFrame:
    return grid.minimal_table(metadata.with_meta(_dense(spark, sf, train=True, active=True), _meta(spark, sf)))


def score_list(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.score_list(_scored(spark, sf), retail.item_meta(spark, sf)).drop("monid")


def _score_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The list of parts, written as text and read line by line."""
    folder = fresh_folder(spark, "score-items")
    retail.score_item_text(spark, sf).write.text(folder)
    return lines.score_item_lines(spark, folder, header=False)


def score_order(spark: SparkSession, sf: str) -> DataFrame:
    """The readable items with their metadata and their place in the text."""
    return metadata.score_list(lines.records(_score_lines(spark, sf)), retail.item_meta(spark, sf))


def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.rejects(_score_lines(spark, sf), "score items")


def duplicate_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Sites that several items share, which therefore cannot serve as a key of the metadata."""
    return metadata.duplicate_keys(retail.item_meta(spark, sf), "site_id")


def sentinel_target(spark: SparkSession, sf: str) -> DataFrame:
    """The prepared target from a grid whose missing numbers are -1, as the historical tables hold them."""
    dense = sampling.rows_of(_dense(spark, sf, True, True), _scored(spark, sf))
    marked = grid.mark_missing(metadata.with_meta(dense, _meta(spark, sf)))
    return t.prepare_target(marked)


def date_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return quality.consecutive_dates(retail.user_daily(spark, sf))


def broken_series(spark: SparkSession, sf: str) -> DataFrame:
    return quality.broken_series(retail.sku_daily(spark, sf))


def date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return quality.date_bounds(retail.sku_daily(spark, sf))


def distinct_starts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.distinct_bounds(retail.sku_daily(spark, sf), "first_date")


def distinct_ends(spark: SparkSession, sf: str) -> DataFrame:
    return quality.distinct_bounds(retail.sku_daily(spark, sf), "last_date")


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.length_histogram(retail.sku_daily(spark, sf))


def share_over_30(spark: SparkSession, sf: str) -> DataFrame:
    return quality.share_over(length_histogram(spark, sf), "number_of_items")


def active_histogram(spark: SparkSession, sf: str, compat: bool = False) -> DataFrame:
    return quality.active_histogram(retail.sku_daily(spark, sf), by_value=compat)


def active_share_over_30(spark: SparkSession, sf: str, compat: bool = False) -> DataFrame:
    return quality.share_over(active_histogram(spark, sf, compat), "counts")


def leading_zeros(spark: SparkSession, sf: str) -> DataFrame:
    # Read twice: for the first active days and for the zeros before them.
    return quality.leading_zeros(cut_lineage(retail.sku_daily(spark, sf).select("sku", "date", "minutes_active")))


def target_prep(spark: SparkSession, sf: str, train: bool = True) -> DataFrame:
    return _target(spark, sf, train)


def scored_targets(spark: SparkSession, sf: str) -> DataFrame:
    return t.log_score_targets(_scored(spark, sf))


def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf)


def encoded_panel(spark: SparkSession, sf: str) -> DataFrame:
    narrow = t.narrow_types(_encoded(spark, sf, True))
    # Compared as double, because a rounded float has no exact text.
    return narrow.withColumn("target_stock", F.col("target_stock").cast("double"))


def sku_max(spark: SparkSession, sf: str) -> DataFrame:
    return t.sku_max(_target(spark, sf, True))


def outlier_bound(spark: SparkSession, sf: str) -> DataFrame:
    return t.outlier_bound(cut_lineage(t.sku_max(_target(spark, sf, True))), DELTA_INF)


def sample_weights(spark: SparkSession, sf: str, train: bool = True) -> DataFrame:
    return _weighted(spark, sf, train).select("sku", "id", "weight")


def key_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.key_sample(retail.sku_keys(spark, sf))


def sampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    panel = retail.sku_daily(spark, sf)
    return sampling.rows_of(panel, key_sample(spark, sf)).select("sku", "date", "sold_quantity")


def group_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.group_sample(retail.sku_daily(spark, sf)).select("sku", "date", "sold_quantity")


def _late_chances(spark: SparkSession, sf: str) -> DataFrame:
    """Distributions for the later days. Day numbers are the classes, so later days than the grid has are
    no labels; the grid of the tables leaves them out too."""
    return _chances(_side(spark, sf, False).filter(F.col("id") <= grid.GRID_DAYS).select("sku", "id"))


def rps_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.ranked_probability_score(_late_chances(spark, sf))


def rps_residual(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_residuals(_late_chances(spark, sf))
    wide: list[Column] = [F.col("gradient")[k].alias(f"g_{k + 1}") for k in range(30)]
    return scored.select("sku", "id", *wide, F.aggregate("curvature", F.lit(0.0), lambda a, v: a + v).alias("h_sum"))


def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.log_loss(_chances(_weighted(spark, sf, False)))


def probability_text(spark: SparkSession, sf: str) -> DataFrame:
    from shelfpace.sources.writers import probability_text as as_text

    return as_text(_chances(_scored(spark, sf).select("sku")))


def _fitted(spark: SparkSession, sf: str, curve: DataFrame | None = None) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """Model of the early days of the scored items, with its rows, its maxima and the codes."""
    codes = cut_lineage(_codes(spark, sf))
    train = cut_lineage(encoding.encode(_target(spark, sf, True, curve), codes))
    maxima = cut_lineage(t.sku_max(train))
    rows = model.weighted(train, maxima, model.DEFAULT_CONFIG)
    return model.fit_days(rows, model.DEFAULT_CONFIG), train, maxima, codes


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """The distribution for each stock level to score."""
    fitted, _, _, codes = _fitted(spark, sf)
    items = metadata.with_meta(t.log_score_targets(_scored(spark, sf)), _meta(spark, sf), "left")
    return model.predict_days(fitted, encoding.encode(items.drop("site_id"), codes))


def day_distribution_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every item's distribution."""
    chances = F.col("probabilities")
    total = F.aggregate(chances, F.lit(0.0), lambda a, p: a + p)
    return _predicted(spark, sf).select(
        "sku",
        F.size(chances).alias("days"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.array_min(chances) > 0).alias("all_positive"),
    )


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted model judged on the later days, next to a uniform guess and the training shares."""
    curve = cut_lineage(_target_curve(spark, sf))
    fitted, train, maxima, codes = _fitted(spark, sf, curve)
    late = model.weighted(encoding.encode(_target(spark, sf, False, curve), codes), maxima, model.DEFAULT_CONFIG)
    return model.evaluate(fitted, train, late)


def _calibrated(spark: SparkSession, sf: str, raw: bool = False) -> list[DataFrame]:
    """Chances on the later days of a fifth of the items: fitted on three fifths, calibrated on another fifth; with ``raw``
    those of the same fit before calibration, too."""
    codes, curve = cut_lineage(_codes(spark, sf)), cut_lineage(_target_curve(spark, sf))
    train, late = (cut_lineage(encoding.encode(_target(spark, sf, side, curve), codes)) for side in (True, False))
    maxima = cut_lineage(t.sku_max(train))
    fold = F.pmod(F.xxhash64("sku"), F.lit(5))
    fitted = model.fit_days(model.weighted(train.filter(fold > 1), maxima, model.DEFAULT_CONFIG), model.DEFAULT_CONFIG)
    steps = model.calibrate(fitted, late.filter(fold == 1))
    return [cut_lineage(model.predict_days(fitted, late.filter(fold == 0), calibration=c)) for c in ([steps, None] if raw else [steps])]


def calibration_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log loss on items that neither fit nor calibration has seen, before and after calibration."""
    known = F.col("target_stock").isNotNull()
    steps, raw = (scoring.log_loss(chances.filter(known), weight=None) for chances in _calibrated(spark, sf, raw=True))
    return raw.select(F.col("log_loss").alias("raw_loss")).join(steps.select(F.col("log_loss").alias("calibrated_loss")))


def reliability(spark: SparkSession, sf: str) -> DataFrame:
    """How often days given some calibrated chance are the day, on items held out."""
    return model.reliability(_calibrated(spark, sf)[0])


def day_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the early days of the scored items, predict the distribution for each stock level to score."""
    return _predicted(spark, sf).select("sku", *[F.col("probabilities")[k].alias(f"p_{k + 1}") for k in range(30)])


def config_search(spark: SparkSession, sf: str) -> DataFrame:
    """All trials of the random search, best first."""
    codes, curve = cut_lineage(_codes(spark, sf)), cut_lineage(_target_curve(spark, sf))
    train, validation = [cut_lineage(encoding.encode(_target(spark, sf, side, curve), codes)) for side in (True, False)]
    maxima = cut_lineage(t.sku_max(train))
    trials, _ = model.search(spark, train, validation, maxima, model.draw_configs(20))
    return trials


def _output(name: str) -> Query:
    """One table of the whole feature job, in its historical form."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        panel = retail.sku_daily(spark, sf, tuple(retail.CATEGORY_SOURCES))
        inputs = tables.Inputs(panel, retail.item_meta(spark, sf), retail.score_items(spark, sf))
        made = tables.feature_tables(inputs, CATEGORIES, compat=True, keys=retail.sku_keys(spark, sf))[name]()
        return made.drop("monid")

    return run


def queries() -> dict[str, Query]:
    plain: dict[str, Query] = {
        "selling_rate": selling_rate,
        "series_split": series_split,
        "stock_curve": stock_curve,
        "stock_curve_active": lambda x, d: stock_curve(x, d, active=True),
        "cumsum_pc": cumsum_pc,
        "cumsum_pc_compat": lambda x, d: cumsum_pc(x, d, compat=True),
        "rolling_means": rolling_means,
        "rolling_means_active": lambda x, d: rolling_means(x, d, active=True),
        "rolling_means_compat": lambda x, d: rolling_means(x, d, compat=True),
        "event_curve": event_curve,
        "category_share": lambda x, d: category_share(x, d, "shipping_logistic_type", features.SHARE),
        "category_share_compat": lambda x, d: category_share(x, d, "shipping_logistic_type", features.CHARACTER_RULE),
        "category_odds": lambda x, d: category_share(x, d, "listing_type", features.ODDS),
        "category_share_drop_first": lambda x, d: category_share(x, d, "listing_type", features.SHARE, True),
        "sku_features": sku_features,
        "sku_features_compat": lambda x, d: sku_features(x, d, features.CHARACTER_RULE),
        "weekday_profile": weekday_profile,
        "weekday_profile_compat": lambda x, d: weekday_profile(x, d, compat=True),
        "active_share": active_share,
        "day_grid": day_grid,
        "dense_panel": dense_panel,
        "category_values": category_values,
        "category_share_long": category_share_long,
        "repeated_days": repeated_days,
        "meta_clean": meta_clean,
        "panel_with_meta": panel_with_meta,
        "forward_filled": forward_filled,
        "sentinel_filled": sentinel_filled,
        "min_table": min_table,
        "score_list": score_list,
        "score_order": score_order,
        "rejected_lines": rejected_lines,
        "duplicate_meta": duplicate_meta,
        "sentinel_target": sentinel_target,
        "date_gaps": date_gaps,
        "broken_series": broken_series,
        "date_bounds": date_bounds,
        "distinct_starts": distinct_starts,
        "distinct_ends": distinct_ends,
        "length_histogram": length_histogram,
        "share_over_30": share_over_30,
        "active_histogram": active_histogram,
        "active_histogram_compat": lambda x, d: active_histogram(x, d, compat=True),
        "active_share_over_30": active_share_over_30,
        "active_share_over_30_compat": lambda x, d: active_share_over_30(x, d, compat=True),
        "leading_zeros": leading_zeros,
        "target_prep": target_prep,
        "target_prep_validation": lambda x, d: target_prep(x, d, train=False),
        "scored_targets": scored_targets,
        "category_codes": category_codes,
        "encoded_panel": encoded_panel,
        "sku_max": sku_max,
        "outlier_bound": outlier_bound,
        "sample_weights": sample_weights,
        "sample_weights_validation": lambda x, d: sample_weights(x, d, train=False),
        "key_sample": key_sample,
        "sampled_rows": sampled_rows,
        "group_sample": group_sample,
        "rps_score": rps_score,
        "rps_residual": rps_residual,
        "log_loss": log_loss,
        "probability_text": probability_text,
        "day_distribution": day_distribution,
        "day_distribution_check": day_distribution_check,
        "model_scores": model_scores,
        "calibration_scores": calibration_scores,
        "reliability": reliability,
        "config_search": config_search,
    }
    plain.update({f"table_{name}": _output(name) for name in tables.TABLE_NAMES})
    return {name: (lambda x, d, q=q: rounded(q(x, d))) for name, q in plain.items()}
