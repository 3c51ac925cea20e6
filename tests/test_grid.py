import random

from pyspark.sql import functions as F

from shelfpace.operators import grid, metadata
from tests.helpers import by


def _frame(spark, rows):
    return spark.createDataFrame(rows, "sku long, id int, v double, c string")


def test_day_grid_is_complete(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,)], "sku long")
    got = grid.day_grid(keys)
    assert got.count() == 60 and got.distinct().count() == 60
    assert got.agg(F.min("id"), F.max("id")).first() == (1, 30)


def test_densify_equals_grid_left_join(spark):
    rng = random.Random(5)
    rows = []
    for sku in range(30):
        for i in rng.sample(range(1, 40), rng.randint(0, 20)):
            rows.append((sku, i, rng.choice([None, float(i)]), rng.choice([None, "a", "b"])))
    rows += [(1, 7, 1.5, "x"), (1, 7, 2.5, "y"), (2, 30, 1.0, "z"), (3, 1, 1.0, "z")]  # repeated days too
    frame = _frame(spark, rows)
    keys = spark.range(0, 35).withColumnRenamed("id", "sku")
    want = grid.day_grid(keys).join(frame, ["sku", "id"], "left")
    got = grid.densify(frame, keys)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_densify_on_its_own_keys(spark):
    got = grid.densify(_frame(spark, [(1, 2, 5.0, "a"), (2, 30, 6.0, "b")]), days=30)
    assert got.count() == 60
    assert got.filter("v is not null").count() == 2


def test_carry_in_densify_equals_carry_after_it(spark):
    frame = _frame(spark, [(1, 2, 5.0, None), (1, 4, None, "b"), (1, 9, 7.0, None), (2, 5, None, None)])
    keys = spark.createDataFrame([(1,), (2,), (3,)], "sku long")
    inside = grid.densify(frame, keys, days=12, carry=("v", "c"))
    after = grid.carry_forward(grid.densify(frame, keys, days=12), ["v", "c"])
    assert sorted(map(str, inside.collect())) == sorted(map(str, after.collect()))


def test_carry_forward_keeps_leading_nulls(spark):
    frame = _frame(spark, [(1, i + 1, v, None) for i, v in enumerate([None, 3.0, None, None, 4.0])])
    got = by(grid.carry_forward(frame, ["v"]), "id")
    assert [got[i]["v"] for i in range(1, 6)] == [None, 3.0, 3.0, 3.0, 4.0]


def test_mark_missing_replaces_null_and_nan(spark):
    frame = spark.createDataFrame([(1, None, None), (2, float("nan"), 1)], "sku long, cumsum double, is_active int")
    got = by(grid.mark_missing(frame), "sku")
    assert got[1] == {"sku": 1, "cumsum": -1.0, "is_active": -1}
    assert got[2]["cumsum"] == -1.0


def _meta(spark):
    rows = [(1, "A-B-CARS", "S"), (2, "plain", None), (3, None, "S"), (5, "X-1", "S"), (5, "X-2", "S")]
    return spark.createDataFrame(rows, "sku long, item_domain_id string, site_id string")


def test_clean_meta(spark):
    got = {(r["sku"], r["item_domain_id"], r["site_id"]) for r in metadata.clean_meta(_meta(spark)).collect()}
    assert got == {(1, "CARS", "S"), (2, "plain", ""), (3, "", "S"), (5, "1", "S"), (5, "2", "S")}


def test_inner_drops_and_left_keeps_unmatched(spark):
    frame = spark.createDataFrame([(1,), (4,), (5,)], "sku long")
    clean = metadata.clean_meta(_meta(spark))
    assert sorted(r["sku"] for r in metadata.with_meta(frame, clean).collect()) == [1, 5, 5]
    assert sorted(r["sku"] for r in metadata.with_meta(frame, clean, "left").collect()) == [1, 4, 5, 5]
    assert [tuple(r) for r in metadata.duplicate_keys(clean).collect()] == [(5, 2)]


def test_score_list_keeps_input_order(spark):
    items = spark.createDataFrame([(4, 1.0), (1, 2.0), (3, 3.0), (2, 4.0)], "sku long, target_stock double").coalesce(1)
    got = metadata.score_list(items, _meta(spark)).collect()
    assert [r["sku"] for r in got] == [4, 1, 3, 2]
    assert [r["item_domain_id"] for r in got] == ["", "CARS", "", "plain"]
