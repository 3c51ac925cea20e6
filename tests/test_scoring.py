import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from shelfpace.operators import model, scoring
from shelfpace.plans import queries
from shelfpace.sources.writers import probability_text


def _frame(spark, labels, probabilities, weights=None):
    rows = [(l, p, w) for l, p, w in zip(labels, probabilities, weights or [1.0] * len(labels))]
    return spark.createDataFrame(rows, "id int, probabilities array<double>, weight double")


def _random(seed=1, n=50, classes=30):
    rng = np.random.default_rng(seed)
    p = rng.random((n, classes))
    return [int(v) for v in rng.integers(1, classes + 1, n)], (p / p.sum(axis=1, keepdims=True)).tolist()


def test_ranked_score_by_hand(spark):
    frame = _frame(spark, [1, 3], [[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    assert scoring.ranked_probability_score(frame, classes=3).first()[0] == pytest.approx(0.58309518948453)


def test_ranked_score_of_a_perfect_forecast(spark):
    perfect = [[1.0 if k == label else 0.0 for k in range(1, 31)] for label in (1, 17, 30)]
    assert scoring.ranked_probability_score(_frame(spark, [1, 17, 30], perfect)).first()[0] == 0.0
    assert scoring.ranked_probability_score(_frame(spark, [1], perfect[:1])).first()[0] is None


def test_ranked_score_and_residuals_equal_numpy(spark):
    labels, p = _random()
    reached = np.clip(np.cumsum(p, axis=1), 0, 1)
    goal = (np.arange(1, 31)[None, :] >= np.array(labels)[:, None]).astype(float)
    frame = _frame(spark, labels, p)
    want = np.sqrt(((goal - reached) ** 2).sum() / (len(labels) - 1))
    assert scoring.ranked_probability_score(frame).first()[0] == pytest.approx(want)
    got = scoring.score_residuals(frame).collect()
    assert np.allclose([r["gradient"] for r in got], 2 * (reached - goal))
    assert all(r["curvature"] == [2.0] * 30 for r in got)


def test_weighted_log_loss(spark):
    labels, p = _random(2)
    w = [random.Random(3).random() for _ in labels]
    want = -sum(wi * np.log(pi[l - 1]) for wi, pi, l in zip(w, p, labels)) / sum(w)
    assert scoring.log_loss(_frame(spark, labels, p, w)).first()[0] == pytest.approx(want)
    zero = _frame(spark, [1], [[0.0, 1.0]])
    assert scoring.log_loss(zero, weight=None).first()[0] == pytest.approx(-np.log(1e-16))


def test_probability_text(spark):
    got = probability_text(_frame(spark, [1], [[0.123456, 0.5, 1e-9]]), classes=3).first()
    assert tuple(got) == ("0.1235", "0.5000", "0.0000")


def _model_rows(spark):
    rows = [(s, d, None if d % 5 == 0 else float(d) / (s % 3 + 1), s % 4) for s in range(20) for d in range(1, 31)]
    frame = spark.createDataFrame(rows, "sku int, id int, target_stock double, item_domain_id int")
    return frame, frame.groupBy("sku").agg({"target_stock": "max"}).toDF("sku", "target_stock")


def test_model_gives_thirty_probabilities_even_when_late_days_are_absent(spark):
    frame, maxima = _model_rows(spark)
    rows = model.weighted(frame.filter("id <= 20"), maxima, model.DEFAULT_CONFIG)
    fitted = model.fit_days(rows, model.DEFAULT_CONFIG, trees=3)
    got = model.predict_days(fitted, frame.drop("id")).collect()
    assert len(got) == 600
    assert all(len(r["probabilities"]) == 30 and abs(sum(r["probabilities"]) - 1) < 1e-9 for r in got)
    assert all(min(r["probabilities"]) > 0 for r in got)
    assert sum(r["target_stock"] is None for r in got) == 120


def test_fit_does_not_depend_on_the_partitions(spark):
    frame, maxima = _model_rows(spark)
    found = []
    for parts in (4, 7):
        rows = model.weighted(frame.repartition(parts), maxima, model.DEFAULT_CONFIG)
        fitted = model.fit_days(rows, model.DEFAULT_CONFIG, trees=3)
        found.append([r["probabilities"] for r in model.predict_days(fitted, frame).orderBy("sku", "id").collect()])
    assert np.allclose(*found, atol=1e-12)


def test_evaluation_beats_the_uniform_guess_and_the_shares(spark):
    frame, maxima = _model_rows(spark)
    rows = model.weighted(frame, maxima, model.DEFAULT_CONFIG)
    fitted = model.fit_days(rows, model.DEFAULT_CONFIG, trees=5)
    got = model.evaluate(fitted, frame, rows).first()
    assert got["uniform_loss"] == pytest.approx(np.log(30))
    assert got["known_loss"] < got["prior_loss"] < got["uniform_loss"]
    assert got["ranked_score"] > 0 and got["weighted_loss"] > 0


def test_days_at_risk(spark):
    rows = spark.createDataFrame([(1, 3, 0.5, 2), (2, 1, 0.1, 2), (3, 2, None, 2), (4, 31, 1.0, 2)], "sku int, id int, target_stock double, item_domain_id int")
    got = [(r["sku"], r["day"], r["event"]) for r in model.at_risk(rows).orderBy("sku", "day").collect()]
    assert got == [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 1.0), (2, 1, 1.0)]


def test_a_fit_has_as_many_rows_as_there_are_cells_whatever_the_size_of_the_table(spark):
    # The same rows under forty keys that share a bin with others: the rows at risk multiply, the cells they are counted into do not.
    def rows(keys):
        made = [(s, d, float(d % 7 + 1), 1, 1.0) for s in range(keys) for d in range(1, 31)]
        return spark.createDataFrame(made, "sku int, id int, target_stock double, item_domain_id int, weight double")

    small, large = rows(32), rows(32 * 40)
    edges = model.bin_edges(large)
    cells = [model.risk_cells(model.key_ranges(f), edges, "weight") for f in (small, large)]
    at_risk = [sum(range(1, 31)) * k for k in (32, 32 * 40)]
    assert [c.agg({"n": "sum"}).first()[0] for c in cells] == at_risk
    by_plain = {}
    for r in model.at_risk(small).collect():
        place = [sum(v >= e for e in s[1:-1]) for v, s in zip((r["sku"], r["stock_or_zero"], r["stock_per_day"], r["item_domain_id"]), edges.getSplitsArray())]
        key = (*place, r["day"], r["event"])
        by_plain[key] = by_plain.get(key, 0) + 1
    assert {(*[int(r[c]) for c in model.CELL], r["event"]): r["n"] for r in cells[0].collect()} == by_plain
    bins = 32 * 30 * 2 * 7
    assert cells[1].count() <= bins < at_risk[1]


def test_cuts_raised_to_the_next_bound_give_the_weights_of_the_trial(spark):
    frame, maxima = _model_rows(spark)
    config = {**model.draw_configs(1, seed=5)[0], "min_leaf_share": 0.0, "delta_inf": 1.0}
    results, best = model.search(spark, frame, frame, maxima, [config, {**config, "delta_inf": 2.0}], share=1.0, trees=2)
    got = {r["delta_inf"]: r["log_loss"] for r in results.collect()}
    alone = model.fit_days(model.weighted(frame, maxima, config), config, trees=2)
    judged = model.predict_days(alone, model.weighted(frame, maxima, {**config, **model.JUDGE_WEIGHTS}))
    assert got[1.0] == pytest.approx(scoring.log_loss(judged).first()[0])


def test_rows_of_one_pattern_fall_into_the_same_cells_on_all_days(spark):
    rng = random.Random(5)
    # Stocks on the borders that the days move, and beside them: the last bit decides.
    logs = [r[0] for r in spark.range(1, 31).select(F.ln("id")).collect()]
    borders = [0.5, 1.75, -math.log(3)]
    stocks = [x for b in borders for log in logs for x in (b + log, math.nextafter(b + log, 9), math.nextafter(b + log, -9))]
    stocks += [rng.uniform(-4, 6) for _ in range(300)] + [0.0]
    frame = spark.createDataFrame([(i % 5, x, i % 3) for i, x in enumerate(stocks)], "sku long, target_stock double, item_domain_id int")
    splits = {"sku": [2.5], "stock_or_zero": [0.0, 1.0], "stock_per_day": sorted(borders), "item_domain_id": [0.5]}
    edges = Bucketizer(splitsArray=[[-math.inf, *splits[c], math.inf] for c in model.BINNED], inputCols=list(model.BINNED), outputCols=list(model.CELL[:-1]))
    stepped = model.step_edges(edges, spark).transform(model.feature_rows(frame))
    cells = edges.transform(model.on_days(stepped, F.lit(30))).groupBy(*model.PATTERN, "day").agg(*[F.count_distinct(c).alias(c) for c in model.CELL[:-1]])
    assert cells.filter(" or ".join(f"{c} != 1" for c in model.CELL[:-1])).count() == 0
    assert stepped.select(*model.PATTERN).distinct().count() < 400 < frame.count()


def test_the_forest_looks_at_patterns_not_at_rows(spark, monkeypatch):
    frame = spark.range(400).select((F.col("id") % 40).alias("sku"), (F.col("id") % 30 + 1).cast("int").alias("id"), F.ln(F.col("id") % 7 + 1.0).alias("target_stock"), F.lit(1).alias("item_domain_id"), F.lit(1.0).alias("weight"))
    fitted = model.fit_days(frame, model.DEFAULT_CONFIG, trees=2)
    looked, plain = [], model.hazards
    monkeypatch.setattr(model, "hazards", lambda m, days: looked.append(days.count()) or plain(m, days))
    got = {n: model.predict_days(fitted, frame.crossJoin(spark.range(n).select(F.lit(0).alias("copy")))) for n in (1, 20)}
    assert [got[n].count() for n in (1, 20)] == [400, 8000]
    assert looked[0] == looked[1] <= 30 * 280
    monkeypatch.undo()
    # The chances are those that the forest gives each row by itself.
    one = {(r["sku"], r["target_stock"], r["day"]): r["hazard"] for r in model.hazards(fitted, model.on_days(model.feature_rows(frame), F.lit(30))).collect()}
    for r in got[1].limit(60).collect():
        left = 1.0
        for day, chance in enumerate(r["probabilities"], 1):
            hazard = 1.0 if day == 30 else one[r["sku"], r["target_stock"], day]
            assert abs(chance - (left * hazard * (1 - model.SMOOTHING) + model.SMOOTHING / 30)) < 1e-12
            left -= left * hazard


def test_calibration_follows_the_observed_shares(spark):
    frame, maxima = _model_rows(spark)
    rows = model.weighted(frame, maxima, model.DEFAULT_CONFIG)
    fitted = model.fit_days(rows, model.DEFAULT_CONFIG, trees=3)
    steps = model.calibrate(fitted, frame.filter("sku < 10 AND id < 29"))
    assert len(steps) == 30 and steps[29] == ([0.0, 1.0], [0.0, 1.0])
    assert all(a == sorted(a) and b == sorted(b) for a, b in steps)
    days = model.hazards(fitted, model.at_risk(frame.filter("sku < 10 AND id < 29")))
    for r in days.withColumn("after", model._calibrated(steps)).filter("day < 29").select("day", "hazard", "after").distinct().collect():
        assert r["after"] == pytest.approx(np.interp(r["hazard"], *steps[r["day"] - 1]))
    got = model.predict_days(fitted, frame, calibration=steps)
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and min(r["probabilities"]) > 0 for r in got.collect())
    table = {r["bin"]: r for r in model.reliability(got).collect()}
    known = [r for r in got.collect() if r["target_stock"] is not None]
    assert sum(r["n"] for r in table.values()) == 30 * len(known)
    chances = [(p, d + 1 == r["id"]) for r in known for d, p in enumerate(r["probabilities"])]
    for b, r in table.items():
        inside = [hit for p, hit in chances if min(int(p * 10), 9) == b]
        assert r["share"] == pytest.approx(np.mean(inside))


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_model_beats_even_chances_and_training_shares_on_all_later_rows(spark, scale):
    got = queries.model_scores(spark, f"/root/testdata/sf{scale}").first()
    assert got["weighted_loss"] < got["uniform_loss"] and got["weighted_loss"] < got["prior_weighted_loss"]
    assert got["known_loss"] < 0.6 * got["prior_loss"]


def test_calibration_does_not_lose_on_held_out_items(spark):
    got = queries.calibration_scores(spark, "/root/testdata/sf0.01").first()
    assert got["calibrated_loss"] <= got["raw_loss"]


def test_search_is_repeatable_and_sorted(spark):
    frame, maxima = _model_rows(spark)
    configs = [{**c, "min_leaf_share": 0.0} for c in model.draw_configs(2, seed=5)]
    assert model.draw_configs(2, seed=5) == model.draw_configs(2, seed=5) != model.draw_configs(2, seed=6)
    results, best = model.search(spark, frame, frame, maxima, configs, share=0.9, trees=2)
    losses = [r["log_loss"] for r in results.collect()]
    again, _ = model.search(spark, frame.repartition(5), frame, maxima, configs, share=0.9, trees=2)
    assert [r["trial"] for r in again.collect()] == [r["trial"] for r in results.collect()]
    assert np.allclose([r["log_loss"] for r in again.collect()], losses)
    assert losses == sorted(losses) and len(losses) == 2
    assert best["qq"] is not None and "log_loss" not in best


def test_draws_stay_in_their_ranges():
    for config in model.draw_configs(200):
        for name, (low, high, kind) in model.SEARCH_SPACE.items():
            assert isinstance(config[name], kind) and low <= config[name] <= high
        assert config["max_depth"] < 7 and config["min_leaf_share"] <= 0.01
