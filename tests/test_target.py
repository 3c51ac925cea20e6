import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfpace.functions.columns import log_stock
from shelfpace.operators import encoding, target
from tests.helpers import by


def test_log_stock_skips_sentinels(spark):
    values = [-1.0, 0.0, 5.0, float("nan"), None, -3.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(log_stock(F.col("v")).alias("x"))
    want = [None, math.log(0.001), math.log(5.001), None, None, None]
    assert [r["x"] for r in got.collect()] == pytest.approx(want)


def test_plateaus_keep_the_first_day(spark):
    rows = [(1, i + 1, v) for i, v in enumerate([1.0, 2.0, 2.0, 2.0, 3.0, 2.0, None, None])]
    random.Random(2).shuffle(rows)
    got = by(target.blank_plateaus(spark.createDataFrame(rows, "sku long, id int, target_stock double")), "id")
    assert [got[i]["target_stock"] for i in range(1, 9)] == [1.0, 2.0, None, None, 3.0, None, None, None]


def test_prepare_target_keeps_scored_items(spark):
    frame = spark.createDataFrame(
        [(1, 1, 4.0, "a"), (1, 2, -1.0, "a"), (2, 1, 4.0, "b")],
        "sku long, id int, rolling_cumsum_1 double, item_domain_id string",
    )
    got = target.prepare_target(frame, spark.createDataFrame([(1,), (1,)], "sku long"))
    assert sorted(map(tuple, got.select("sku", "id").collect())) == [(1, 1), (1, 2)]
    assert by(got, "id")[2]["target_stock"] is None


def test_narrow_types_raise_instead_of_wrapping(spark):
    frame = spark.createDataFrame([(2**40, 1)], "sku long, id int")
    assert target.narrow_types(frame).dtypes == [("sku", "int"), ("id", "tinyint")]
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        target.narrow_types(frame).collect()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.3, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("kind", ["distinct", "ties", "few", "one_hot"])
@pytest.mark.parametrize("fit", [1, 40, 10_000])
def test_exact_quantile_equals_numpy(spark, q, kind, fit):
    rng = random.Random(11)
    values = {
        "distinct": [rng.gauss(0, 1) for _ in range(997)],
        "ties": [float(rng.randint(0, 5)) for _ in range(500)],
        "few": [1.0, 2.0, 3.0, 10.0],
        "one_hot": [7.0] * 400 + [rng.random() * 20 for _ in range(801)],
    }[kind]
    rows = [(v,) for v in values] + [(None,)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "v double")
    # A coarse sketch, so that the bracket is narrow and its ends matter.
    got = target.exact_quantile(frame, "v", q, accuracy=50, fit=fit).first()[0]
    assert got == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantile_of_infinite_values_and_one_value(spark):
    inf = math.inf
    frame = spark.createDataFrame([(v,) for v in [-inf, -inf, 1.0, 2.0, inf]], "v double")
    assert [target.exact_quantile(frame, "v", q, accuracy=20, fit=1).first()[0] for q in (0.25, 0.5, 0.75, 1.0)] == [-inf, 1.0, 2.0, inf]
    assert target.exact_quantile(frame.filter("v = 1"), "v", 0.3, accuracy=20, fit=1).first()[0] == 1.0


def test_quantile_needs_no_window_and_no_sort_of_all(spark):
    plan = target.exact_quantile(spark.range(10).selectExpr("cast(id AS double) AS v"), "v", 0.5, fit=2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "Sort" not in text
    assert plan.first()[0] == 4.5


def test_quantile_of_nothing_is_null(spark):
    assert target.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.25).first()[0] is None


def test_weights(spark):
    frame = spark.createDataFrame(
        [(1, 9.0), (1, None), (2, 1.0), (3, None), (4, 5.0)], "sku long, target_stock double"
    )
    maxima = spark.createDataFrame([(1, 9.0), (2, 2.0), (3, None)], "sku long, target_stock double")
    got = target.sample_weights(frame, maxima, bound=2.0, null_weight=0.1, outlier_weight=0.4)
    weights = {(r["sku"], r["target_stock"]): r["weight"] for r in got.collect()}
    # above the bound, missing target, exactly at the bound, all missing, unknown maximum
    assert weights == {(1, 9.0): 1.0, (1, None): 0.1, (2, 1.0): 0.4, (3, None): 0.1, (4, 5.0): 0.4}


def test_sku_max_drops_null_keys(spark):
    frame = spark.createDataFrame([(None, 5.0), (1, 2.0), (1, 3.0), (2, None)], "sku long, target_stock double")
    assert {tuple(r) for r in target.sku_max(frame).collect()} == {(1, 3.0), (2, None)}


def test_category_codes_are_dense_and_sorted(spark):
    rng = random.Random(6)
    words = ["", "Z", "a", "ab", "abc", "abcd", "abcé", "ABC", "é", "zebra", "a b", "日本"]
    words += ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    one = spark.createDataFrame([(w,) for w in words], "item_domain_id string")
    two = spark.createDataFrame([("a",), ("zz",), (None,)], "item_domain_id string")
    got = encoding.category_codes([one, two]).collect()
    want = sorted({*words, "zz"}, key=lambda w: w.encode())
    assert {r["item_domain_id"]: r["code"] for r in got} == {w: i for i, w in enumerate(want)}


def test_category_codes_span_several_ranges(spark):
    words = spark.range(0, 50_000, numPartitions=8).select(F.format_string("w%05d", "id").alias("item_domain_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        codes = encoding.category_codes([words])
        assert codes.count() == 50_000
        assert codes.filter(F.col("code") != F.substring("item_domain_id", 2, 5).cast("int")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_encode_keeps_columns_and_rows(spark):
    frame = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "sku long, item_domain_id string")
    codes = encoding.category_codes([frame, spark.createDataFrame([("",)], "item_domain_id string")])
    got = encoding.encode(frame, codes)
    assert got.columns == frame.columns
    assert {tuple(r) for r in got.collect()} == {(1, 2), (2, 0), (3, 1)}
