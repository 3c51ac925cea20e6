"""From the feature tables to the prediction file: preparation, search, final fit."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from shelfpace.operators import encoding, metadata, model
from shelfpace.operators import target as t
from shelfpace.plans.tables import Inputs, build_tables
from shelfpace.sources import lines
from shelfpace.sources.readers import read_panel, read_table
from shelfpace.sources.writers import write_predictions, write_table, write_trials

TRIALS = 20
SAMPLE_SHARE = 0.2


def prepare(spark: SparkSession, folder: str) -> None:
    """Model rows of both active frames and of the score list, the category codes and the maxima.

    Each is written, because the search and the final fit read it many times.
    """
    scored = read_table(spark, folder, "test")
    sides = {
        side: t.prepare_target(read_table(spark, folder, f"{side}_active"), scored) for side in ("train", "validation")
    }
    write_table(encoding.category_codes([*sides.values(), scored]), folder, "category_codes")
    codes = read_table(spark, folder, "category_codes")
    for side, rows in sides.items():
        write_table(t.narrow_types(encoding.encode(rows, codes), "bigint"), folder, f"model_{side}")
    items = t.log_score_targets(scored).select("monid", "sku", "target_stock", "item_domain_id")
    write_table(t.narrow_types(encoding.encode(items, codes), "bigint"), folder, "model_test")
    write_table(t.sku_max(sides["train"]), folder, "maxval")


def tune(
    spark: SparkSession, folder: str, trials: int = TRIALS, trees: int = 20, seed: int = 42, own_weights: bool = False
) -> dict:
    """Random search on a sample of the items; leaves the trials and the best configuration in ``folder``.

    ``own_weights`` judges each trial with its own weights, as the historical job did, instead of alike.
    """
    results, best = model.search(
        spark,
        read_table(spark, folder, "model_train"),
        read_table(spark, folder, "model_validation"),
        read_table(spark, folder, "maxval"),
        model.draw_configs(trials, seed),
        share=SAMPLE_SHARE,
        trees=trees,
        seed=seed,
        compat=own_weights,
    )
    write_trials(results, f"{folder}/results.csv")
    model.save_config(spark, best, f"{folder}/best_config.json")
    return best


def fit_and_predict(spark: SparkSession, folder: str, trees: int = 20, seed: int = 42) -> DataFrame:
    """Fit all scored items' rows with the best configuration; save the model, its scores on the later days and the
    predictions."""
    config = model.load_config(spark, f"{folder}/best_config.json")
    train, maxima = read_table(spark, folder, "model_train"), read_table(spark, folder, "maxval")
    fitted: PipelineModel = model.fit_days(model.weighted(train, maxima, config), config, trees, seed)
    fitted.write().overwrite().save(f"{folder}/model")
    late = model.weighted(read_table(spark, folder, "model_validation"), maxima, config)
    write_trials(model.evaluate(fitted, train, late), f"{folder}/scores.csv")
    predicted = model.predict_days(fitted, read_table(spark, folder, "model_test"))
    write_predictions(predicted, f"{folder}/out.csv")
    return predicted


def run_all(
    spark: SparkSession,
    panel: str,
    meta: str,
    score_items: str,
    out: str,
    trials: int = TRIALS,
    trees: int = 20,
    plain: bool = False,
    own_weights: bool = False,
) -> None:
    """The whole job from the three input files.

    The tables take the historical form (running maximum, character rule, key in the weekday denominator, -1 for
    missing) unless ``plain`` asks for the plain definitions. ``own_weights``: see ``tune``.

    Lines of the metadata and of the items to score that hold no record go to the table ``rejected_lines`` with
    their place, text and reason; items are scored in the order of their lines. Metadata with a repeated key is an
    error, because it would add lines to the predictions, which have no key.
    """
    write_table(lines.item_meta_lines(spark, meta), out, "meta_lines")
    write_table(lines.score_item_lines(spark, score_items), out, "item_lines")
    read = {name: read_table(spark, out, f"{name}_lines") for name in ("meta", "item")}
    rejected = lines.rejects(read["meta"], "metadata").unionByName(lines.rejects(read["item"], "score items"))
    write_table(rejected, out, "rejected_lines")
    item_meta = lines.records(read["meta"])
    repeated = metadata.duplicate_keys(item_meta).first()
    if repeated:
        raise ValueError(f"repeated key in the metadata: {repeated}")
    inputs = Inputs(read_panel(spark, panel), item_meta, lines.records(read["item"]))
    build_tables(spark, inputs, out, compat=not plain)
    prepare(spark, out)
    tune(spark, out, trials, trees, own_weights=own_weights)
    fit_and_predict(spark, out, trees)
