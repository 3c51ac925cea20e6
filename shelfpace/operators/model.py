"""Day-distribution model on MLlib as discrete-time survival: feature rows, fit, calibration, scoring and a random search.

The question is on which day a stock level is reached. Each row with a known level is at risk on every day up to its own, where
the event happens; one binary learner gives the chance of the event on a day for rows still at risk (the hazard), and the
chances of the days follow from the running product. Rows without a level (empty grid days) are censored from the
start: they tell nothing about any level, so they are never labels, and their own chances are even.

A forest looks at the bins of its features only. So the rows at risk are counted by bins, day, event and weight first, and
the forest is fitted on these counts: all rows take part, and the fit has as many rows as there are cells of bins, whatever
the size of the table.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfpace.operators.sampling import group_sample
from shelfpace.operators.scoring import CLASSES, log_loss, mean_log_loss, mean_ranked_score, squared_distance
from shelfpace.operators.target import exact_quantile, sample_weights, weight_rule, with_cut
from shelfpace.session import cut_lineage, staged

# Bins of each feature: MLlib's own number, but more of the one that nearly all splits take. Stock and day leave it few of them,
# so this adds few cells.
BINS = {"sku": 32, "stock_or_zero": 32, "stock_per_day": 128, "item_domain_id": 32}
BINNED = tuple(BINS)
CELL = (*[f"{c}_bin" for c in BINNED], "day")
# Features that do not change with the day, and the steps of each: rows with the same steps fall into the same cells on all days.
LASTING = ("sku", "stock_or_zero", "item_domain_id")
PATTERN = tuple(f"{c}_step" for c in LASTING)
# Rows at risk whose quantiles part the bins (MLlib's forest takes 10,000 for the same purpose). All rows are put into bins.
EDGE_ROWS = 100_000

# Share of each prediction spread evenly over the days, because the leaves of a forest give exact zeros.
SMOOTHING = 0.01
# Cells of one partition of a fit.
LAYOUT_ROWS = 100_000
# Rows of one partition that are counted into cells, before each is repeated for its days at risk.
RANGE_ROWS = 100_000
# Patterns of one partition of a prediction, before each is repeated for all days.
PREDICT_ROWS = 4_000
# Rows of one partition of the predicted table.
OUTPUT_ROWS = 50_000
# Hazards are told apart to this fraction when they are calibrated.
HAZARD_STEPS = 1000
# Weights that judge trials: rows with a known target count alike, the others (mostly empty grid days) not at all.
JUDGE_WEIGHTS = {"null_weight": 0.0, "outlier_weight": 1.0, "delta_inf": 0.0}

# Ranges of the search, but for the leaf size, a share of the total weight here. Whole-number ranges exclude their upper end.
SEARCH_SPACE = {
    "min_leaf_share": (0.0, 0.01, float),
    "max_depth": (2, 7, int),
    "subsample": (0.4, 1.0, float),
    "colsample_bytree": (0.4, 1.0, float),
    "null_weight": (0.0, 1.0, float),
    "outlier_weight": (0.0, 1.0, float),
    "delta_inf": (0.0, 6.0, float),
}
# Per day: boundaries of the hazard and the calibrated hazard at each.
Calibration = list[tuple[list[float], list[float]]]
DEFAULT_CONFIG = {
    "min_leaf_share": 0.0,
    "max_depth": 6,
    "subsample": 1.0,
    "colsample_bytree": 1.0,
    "null_weight": 0.5,
    "outlier_weight": 0.5,
    "delta_inf": 1.0,
}


def feature_rows(frame: DataFrame) -> DataFrame:
    """Numeric feature columns per row; ``target_stock`` itself stays as it is."""
    return frame.withColumn("stock_or_zero", F.coalesce(F.col("target_stock").cast("double"), F.lit(0.0)))


def on_days(rows: DataFrame, last: Column) -> DataFrame:
    """Feature rows repeated for each ``day`` from 1 to ``last``, with the (logarithmic) stock per day so far."""
    each = rows.withColumn("day", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    return each.withColumn("stock_per_day", F.col("stock_or_zero") - F.ln("day"))


def known_rows(frame: DataFrame, classes: int = CLASSES) -> DataFrame:
    return frame.filter(F.col("target_stock").isNotNull() & F.col("id").between(1, classes))


def at_risk(frame: DataFrame, classes: int = CLASSES) -> DataFrame:
    """One row per row with a known level and day at risk; ``event`` is 1 on the row's own day. Others are censored."""
    event = F.when(F.col("day") == F.col("id"), 1.0).otherwise(0.0).alias("event")
    return on_days(feature_rows(known_rows(frame, classes)), F.col("id")).select("*", event)


def weighted(frame: DataFrame, maxima: DataFrame, config: dict) -> DataFrame:
    """Sample weights under one configuration; ``qq`` is taken from it or computed from the maxima."""
    qq = config.get("qq")
    if qq is None:
        qq = exact_quantile(maxima, "target_stock", 0.25).first()[0]
    bound = float(qq) - float(config["delta_inf"])
    return sample_weights(frame, maxima, bound, config["null_weight"], config["outlier_weight"])


def fixed_layout(rows: DataFrame, layout_rows: int = LAYOUT_ROWS) -> DataFrame:
    """Rows in an order and partitions that depend on the rows alone, so that the same seed draws the same trees
    however the input was laid out."""
    parts = max(1, math.ceil(rows.count() / layout_rows))
    return rows.repartition(parts, *rows.columns).sortWithinPartitions(*rows.columns)


def key_ranges(frame: DataFrame, classes: int = CLASSES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with a known level in ranges of the key: the rows of one range fall into few cells and combine before they are
    exchanged. A hot key goes on over several ranges."""
    rows = known_rows(frame, classes)
    return rows.repartitionByRange(max(1, math.ceil(rows.count() / range_rows)), "sku", "id")


def bin_edges(rows: DataFrame, classes: int = CLASSES, edge_rows: int = EDGE_ROWS) -> Bucketizer:
    """The stage that puts the features into bins of about as many rows at risk each (``BINS``); where there are no more values, each has a bin.

    The edges come from rows picked by the hash of key and day, so they do not depend on how the input was laid out.
    """
    total = known_rows(rows, classes).agg(F.sum("id")).first()[0] or 0
    picked = F.pmod(F.xxhash64("sku", "id", "day"), F.lit(2**31)) < F.lit(int(2**31 * min(1.0, edge_rows / max(total, 1))))

    def edges(column: str, bins: int) -> Column:
        value, at = F.col(column).cast("double"), [k / bins for k in range(1, bins)]
        seen = F.sort_array(F.collect_set(value))
        between = F.zip_with(seen, F.slice(seen, 2, bins), lambda a, b: (a + b) / 2)
        few = F.filter(between, lambda x: x.isNotNull())
        return F.when(F.size(seen) <= bins, few).otherwise(F.percentile(value, at)).alias(column)

    found = at_risk(rows, classes).filter(picked).agg(*[edges(c, BINS[c]) for c in BINNED]).first()
    splits = [[-math.inf, *(sorted(set(found[c] or [])) or [0.0]), math.inf] for c in BINNED]
    return Bucketizer(splitsArray=splits, inputCols=list(BINNED), outputCols=list(CELL[:-1]))


def _bins(edges: Bucketizer, columns: Sequence[str]) -> Bucketizer:
    """The part of ``edges`` for some of its columns."""
    splits = dict(zip(edges.getInputCols(), edges.getSplitsArray(), strict=True))
    return Bucketizer(splitsArray=[splits[c] for c in columns], inputCols=list(columns), outputCols=[f"{c}_bin" for c in columns])


def _least(split: float, less: float) -> float:
    """The smallest x with x - less >= split, to the last bit."""
    low, high = (split + less + side * (abs(split) + less + 1.0) * 1e-9 for side in (-1, 1))
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if middle - less >= split else (middle, high)
    return high


def step_edges(edges: Bucketizer, spark: SparkSession, classes: int = CLASSES) -> Bucketizer:
    """The stage that gives the steps of a row (``PATTERN``). A stock's step says its own bin and its bins per day on all days: the
    bins' borders, moved by each day's logarithm, are borders of the steps. So there are a bounded number of patterns.
    """
    splits = dict(zip(edges.getInputCols(), edges.getSplitsArray(), strict=True))
    logs = [r[0] for r in spark.range(1, classes + 1).select(F.ln("id")).collect()]  # as ``on_days`` has them
    moved = {_least(x, log) for x in splits["stock_per_day"][1:-1] for log in logs}
    splits["stock_or_zero"] = [-math.inf, *sorted({*splits["stock_or_zero"][1:-1], *moved}), math.inf]
    return Bucketizer(splitsArray=[splits[c] for c in LASTING], inputCols=list(LASTING), outputCols=list(PATTERN))


def risk_cells(rows: DataFrame, edges: Bucketizer, by: str, classes: int = CLASSES) -> DataFrame:
    """``n`` rows at risk per cell of bins and day, ``event`` and the column ``by``."""
    lasting = _bins(edges, LASTING).transform(feature_rows(known_rows(rows, classes)))
    days = on_days(lasting.select(*[f"{c}_bin" for c in LASTING], "stock_or_zero", "id", by), F.col("id"))
    event = F.when(F.col("day") == F.col("id"), 1.0).otherwise(0.0).alias("event")
    return _bins(edges, ["stock_per_day"]).transform(days).groupBy(*CELL, event, by).agg(F.count("*").alias("n"))


def fit_cells(cells: DataFrame, edges: Bucketizer, config: dict, trees: int = 20, seed: int = 42) -> PipelineModel:
    """Random forest for the hazard over cells with ``event``, ``n`` and ``weight``. Cells of one weight are added up, so the
    order of summation plays no part; a tree's bag draws cells, each with all its rows."""
    assembler = VectorAssembler(inputCols=list(CELL), outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="event",
        weightCol="weight",
        probabilityCol="probability",
        numTrees=trees,
        maxDepth=int(config["max_depth"]),
        maxBins=max(BINS.values()),
        minWeightFractionPerNode=float(config["min_leaf_share"]),
        subsamplingRate=min(float(config["subsample"]), 1.0),
        featureSubsetStrategy=str(min(float(config["colsample_bytree"]), 1.0)),
        seed=seed,
    )
    binary = {"ml_attr": {"type": "nominal", "num_vals": 2}}
    added = cells.groupBy(*CELL, "event", "weight").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = fixed_layout(added)
        rows = rows.select(*CELL, F.col("event").alias("event", metadata=binary), (F.col("weight") * F.col("n")).alias("weight"))
        fitted = forest.fit(assembler.transform(rows).select("features", "event", "weight"))
    finally:
        added.unpersist()
    return PipelineModel(stages=[edges, assembler, fitted])


def fit_days(train: DataFrame, config: dict, trees: int = 20, seed: int = 42, classes: int = CLASSES) -> PipelineModel:
    """Random forest for the hazard over the weighted rows; the columns of ``train`` are those of ``sample_weights``."""
    rows = known_rows(train, classes).select("sku", "id", "target_stock", "item_domain_id", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        edges = bin_edges(rows, classes)
        return fit_cells(risk_cells(key_ranges(rows, classes), edges, "weight", classes), edges, config, trees, seed)
    finally:
        rows.unpersist()


def hazards(model: PipelineModel, days: DataFrame) -> DataFrame:
    """``days`` (from ``on_days``) with the ``hazard`` of each row."""
    scored = model.transform(days).withColumn("hazard", vector_to_array("probability")[1])
    return scored.drop(*CELL[:-1], "features", "rawPrediction", "probability", "prediction")


def calibrate(model: PipelineModel, held_out: DataFrame, classes: int = CLASSES, parallel: int = 8) -> Calibration:
    """For each day an isotonic fit of the event on the hazard, over rows of keys that the model has not seen.

    Hazards are counted in ``HAZARD_STEPS`` steps first, so a fit sees at most as many rows, whatever the size of the fold.
    Days without rows keep their hazards.
    """
    binned = hazards(model, at_risk(held_out, classes)).withColumn("hazard", F.rint(F.col("hazard") * HAZARD_STEPS) / HAZARD_STEPS)
    counted = binned.groupBy("day", "hazard").agg(F.avg("event").alias("event"), F.count("*").cast("double").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(day: int) -> tuple[list[float], list[float]]:
        rows = counted.filter(F.col("day") == day)
        if rows.isEmpty():
            return [0.0, 1.0], [0.0, 1.0]
        learner = IsotonicRegression(featuresCol="hazard", labelCol="event", weightCol="n")
        fitted = learner.fit(rows.coalesce(1))
        return [float(x) for x in fitted.boundaries], [float(x) for x in fitted.predictions]

    try:
        with ThreadPoolExecutor(parallel) as pool:
            return list(pool.map(fit, range(1, classes + 1)))
    finally:
        counted.unpersist()


def _calibrated(calibration: Calibration | None) -> Column:
    """The hazard of a row after calibration: linear between the boundaries of its day."""
    hazard = F.col("hazard")
    if not calibration:
        return hazard
    at, to = (F.get(F.array(*[F.array(*[F.lit(x) for x in day[k]]) for day in calibration]), F.col("day") - 1) for k in (0, 1))
    upper = F.size(F.filter(at, lambda x: x < hazard))
    lower = F.greatest(upper - 1, F.lit(0))
    upper = F.least(upper, F.size(at) - 1)
    step = F.get(at, upper) - F.get(at, lower)
    share = F.when(step > 0, F.least(F.greatest((hazard - F.get(at, lower)) / step, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.get(to, lower) + share * (F.get(to, upper) - F.get(to, lower))


def patterns_of(stepped: DataFrame) -> DataFrame:
    """One row per pattern, with the features of one stock, item and domain of it, in partitions of about as many."""
    found = cut_lineage(stepped.groupBy(*PATTERN).agg(*[F.min(c).alias(c) for c in LASTING]))
    return found.repartition(max(1, math.ceil(found.count() / PREDICT_ROWS)), *PATTERN)


def pattern_chances(
    model: PipelineModel,
    patterns: DataFrame,
    smoothing: float = SMOOTHING,
    classes: int = CLASSES,
    calibration: Calibration | None = None,
) -> DataFrame:
    """``probabilities`` of each pattern: one entry above 0 per day, their sum 1.

    The days of a pattern stand side by side, so they combine in a hash table of one number per day.
    """
    even = F.lit(1.0 / classes)
    days = hazards(model, on_days(patterns, F.lit(classes))).withColumn("hazard", _calibrated(calibration))
    by_day = [F.max(F.when(F.col("day") == k, F.col("hazard"))).alias(f"hazard_{k}") for k in range(1, classes + 1)]
    rows = days.groupBy(*PATTERN).agg(*by_day)
    start = F.struct(F.lit(1.0).alias("left"), F.array().cast("array<double>").alias("chances"))

    def next_day(acc: Column, hazard: Column) -> Column:
        chance = acc["left"] * hazard
        return F.struct((acc["left"] - chance).alias("left"), F.concat(acc["chances"], F.array(chance)).alias("chances"))

    # The last day takes what is left.
    hazard_of = F.array(*[F.col(f"hazard_{k}") for k in range(1, classes)], F.lit(1.0))
    chances = F.aggregate(hazard_of, start, next_day, lambda acc: acc["chances"])
    smooth = F.transform(chances, lambda p: p * F.lit(1.0 - smoothing) + even * smoothing)
    return rows.select(*PATTERN, smooth.alias("probabilities"))


def predict_days(
    model: PipelineModel,
    frame: DataFrame,
    smoothing: float = SMOOTHING,
    classes: int = CLASSES,
    calibration: Calibration | None = None,
) -> DataFrame:
    """Add ``probabilities``: one entry above 0 per day, their sum 1; even where the stock level is missing.

    Rows with a level are put into patterns, the forest looks at each pattern once a day, and the rows take the chances of their
    pattern. The rows are written once and dealt into even partitions (a small file of items comes as one). The others get even
    chances.
    """
    rows = staged(frame, "rows-to-predict")
    rows = rows.repartition(max(1, math.ceil(rows.count() / OUTPUT_ROWS)), *rows.columns)
    known, unknown = rows.filter("target_stock IS NOT NULL"), rows.filter("target_stock IS NULL")
    stepped = step_edges(model.stages[0], frame.sparkSession, classes).transform(feature_rows(known))
    chances = pattern_chances(model, patterns_of(stepped), smoothing, classes, calibration)
    found = stepped.join(chances, list(PATTERN)).select(*frame.columns, "probabilities")
    return found.unionByName(unknown.withColumn("probabilities", F.array_repeat(F.lit(1.0 / classes), classes)))


def reliability(judged: DataFrame, bins: int = 10, classes: int = CLASSES) -> DataFrame:
    """bin, n, mean_chance, share: how often the days given some chance are the day, over rows with a known level."""
    known = judged.filter(F.col("target_stock").isNotNull()).select("id", F.posexplode("probabilities").alias("place", "chance"))
    hit = F.when(F.col("place") + 1 == F.col("id"), 1.0).otherwise(0.0)
    bin_of = F.least(F.floor(F.col("chance") * bins), F.lit(bins - 1)).alias("bin")
    return known.groupBy(bin_of).agg(F.count("*").alias("n"), F.avg("chance").alias("mean_chance"), F.avg(hit).alias("share"))


def evaluate(
    model: PipelineModel,
    train: DataFrame,
    validation: DataFrame,
    classes: int = CLASSES,
    calibration: Calibration | None = None,
) -> DataFrame:
    """Scores on the later days, one row: the weighted log loss over all rows (``validation`` has ``weight``); the log
    loss and ranked-probability score over rows with a known target; and the losses of a uniform guess and of the
    training shares of the days, over all rows and over those with a known target."""
    known = F.col("target_stock").isNotNull()
    days = train.filter(known & F.col("id").between(1, classes)).groupBy("id").count()
    counts = {r["id"]: r["count"] for r in days.collect()}  # one row per day of the grid
    total = sum(counts.values()) + classes
    prior = F.array(*[F.lit((counts.get(k, 0) + 1) / total) for k in range(1, classes + 1)])
    judged = predict_days(model, validation, classes=classes, calibration=calibration)
    # One pass over the rows: each carries arrays, and keeping them would take several times the room of the input.
    sure, chances = F.when(known, F.lit(1.0)), F.col("probabilities")
    return judged.agg(
        mean_log_loss(chances, F.col("weight")).alias("weighted_loss"),
        mean_log_loss(chances, sure).alias("known_loss"),
        mean_ranked_score(F.when(known, squared_distance(F.col("id"), chances, classes))).alias("ranked_score"),
        F.lit(math.log(classes)).alias("uniform_loss"),
        mean_log_loss(prior, F.col("weight")).alias("prior_weighted_loss"),
        mean_log_loss(prior, sure).alias("prior_loss"),
    )


def draw_configs(count: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """Independent uniform draws; the same seed gives the same list."""
    rng = random.Random(seed)
    drawn = []
    for _ in range(count):
        config = {}
        for name, (low, high, kind) in (space or SEARCH_SPACE).items():
            config[name] = rng.randrange(low, high) if kind is int else rng.uniform(low, high)
        drawn.append(config)
    return drawn


def search(
    spark: SparkSession,
    train: DataFrame,
    validation: DataFrame,
    maxima: DataFrame,
    configs: Sequence[dict],
    share: float = 0.2,
    trees: int = 20,
    seed: int = 42,
    compat: bool = False,
    parallel: int = 4,
) -> tuple[DataFrame, dict]:
    """Fit every configuration on a sample of the items, judge it by weighted log loss on all later days.

    All trials are judged with ``JUDGE_WEIGHTS``; ``compat`` judges each with its own weights, as the historical job
    did. ``parallel`` trials run at a time. Returns the trials, best first, and the best configuration with its ``qq``.
    """
    qq = exact_quantile(maxima, "target_stock", 0.25).first()[0]

    def bound_of(weights: dict) -> float:
        return float(qq) - float(weights["delta_inf"])

    # Counted once: the trials differ in weights only, and these ask only which bounds a cut exceeds. A cut raised to the
    # next bound exceeds the same ones.
    spent: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        spent.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return table

    def raised(bounds: set[float]) -> Column:
        steps = [F.when(F.col("cut") <= b, F.lit(b)) for b in sorted(bounds)]
        return F.when(F.col("cut").isNotNull(), F.coalesce(*steps, F.lit(math.inf)))

    x_train = with_cut(group_sample(train, share, seed), maxima).withColumn("cut", raised({bound_of(c) for c in configs}))
    x_train = keep(key_ranges(x_train))
    edges = bin_edges(x_train)
    cells = keep(risk_cells(x_train, edges, "cut"))
    # The rows to judge, too: those of one pattern and day have the same loss in a trial, and those without a target the same in all.
    x_val = with_cut(validation, maxima).withColumn("cut", raised({bound_of(c) for c in (configs if compat else [JUDGE_WEIGHTS])}))
    known = F.col("target_stock").isNotNull()
    stepped = step_edges(edges, spark).transform(feature_rows(x_val.filter(known)))
    seen = keep(stepped.groupBy(*PATTERN, "id", "cut").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in LASTING]))
    unknown = keep(x_val.filter(~known).groupBy("id", "cut").agg(F.count("*").alias("n")))
    patterns = keep(patterns_of(seen))

    def run_trial(number: int, drawn: dict) -> dict:
        config = {**drawn, "qq": qq}
        rule = weight_rule(F.col("cut"), bound_of(config), F.lit(0.0), config["null_weight"], config["outlier_weight"])
        model = fit_cells(cells.withColumn("weight", rule), edges, config, trees, seed)
        judge = config if compat else JUDGE_WEIGHTS
        rule = weight_rule(F.col("cut"), bound_of(judge), F.lit(0.0), judge["null_weight"], judge["outlier_weight"])
        sure = seen.join(pattern_chances(model, patterns), list(PATTERN)).withColumn("weight", rule * F.col("n"))
        even = F.array_repeat(F.lit(1.0 / CLASSES), CLASSES)
        rest = unknown.select("id", even.alias("probabilities"), (F.lit(float(judge["null_weight"])) * F.col("n")).alias("weight"))
        judged = sure.select("id", "probabilities", "weight").unionByName(rest)
        return {"trial": number, "log_loss": log_loss(judged).first()[0], **config}

    try:
        with ThreadPoolExecutor(parallel) as pool:
            trials = list(pool.map(run_trial, range(len(configs)), configs))
    finally:
        for table in spent:
            table.unpersist()
    best = min(trials, key=lambda t: float("inf") if t["log_loss"] is None else t["log_loss"])
    columns = list(trials[0])
    results = spark.createDataFrame([tuple(t[c] for c in columns) for t in trials], columns).orderBy("log_loss")
    return results, {k: v for k, v in best.items() if k not in ("trial", "log_loss")}


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    """One JSON object, written where the executors can reach it."""
    spark.createDataFrame([tuple(config.values())], list(config)).write.mode("overwrite").json(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return spark.read.json(path).first().asDict()
