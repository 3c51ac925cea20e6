import random
import re

import pytest
from pyspark.sql import functions as F

from shelfpace.functions.windows import series_window
from shelfpace.operators import longseries, series
from shelfpace.sources import retail
from tests.helpers import by, day, panel, row

SF = "/root/testdata/sf0.001"


def test_selling_rate_and_flag(spark):
    rows = [row(1, 0, 6.0, 3.0), row(1, 1, 6.0, 0.0), row(1, 2, 6.0, None), row(1, 3, None, 3.0)]
    got = by(series.add_activity(panel(spark, rows)), "date")
    assert [got[day(n)]["selling_rate"] for n in range(4)] == [2.0, 0.0, 0.0, None]
    assert [got[day(n)]["is_active"] for n in range(4)] == [1, 0, 0, 1]


@pytest.mark.parametrize("length", [1, 30, 31, 65])
def test_split_and_numbering(spark, length):
    rows = [row(7, n) for n in range(length)]
    random.Random(1).shuffle(rows)
    got = by(series.number_days(panel(spark, rows)), "date")
    for n in range(length):
        assert got[day(n)]["is_train"] == (1 if n < 30 else 0)
        assert got[day(n)]["id"] == (n + 1 if n < 30 else n - 29)


def test_running_stock_starts_again_after_the_split(spark):
    rows = [row(1, n, float(n)) for n in range(5)]
    got = by(series.running_stock(series.number_days(panel(spark, rows), split_at=2)), "date")
    assert [got[day(n)]["cumsum"] for n in range(5)] == [0.0, 1.0, 2.0, 5.0, 9.0]
    assert [got[day(n)]["max"] for n in range(5)] == [2.0, 2.0, 10.0, 10.0, 10.0]
    assert got[day(3)]["cumsum_pc"] == 0.5


def test_running_maximum_differs_with_returns(spark):
    rows = [row(1, n, q) for n, q in enumerate([5.0, -3.0, 1.0])]
    days = series.number_days(panel(spark, rows))
    so_far = by(series.running_stock(days, running_max=True), "date")
    whole = by(series.running_stock(days), "date")
    assert [so_far[day(n)]["cumsum"] for n in range(3)] == [5.0, 2.0, 3.0]
    assert [so_far[day(n)]["max"] for n in range(3)] == [6.0, 6.0, 6.0]
    assert [whole[day(n)]["max"] for n in range(3)] == [6.0, 6.0, 6.0]
    rising = series.number_days(panel(spark, [row(1, n, 1.0) for n in range(3)]))
    got = by(series.running_stock(rising, running_max=True), "date")
    assert [got[day(n)]["cumsum_pc"] for n in range(3)] == [1 / 2, 2 / 3, 3 / 4]


def test_rows_of_one_day_share_the_running_sum(spark):
    got = series.running_stock(series.number_days(panel(spark, [row(1, 0, 2.0), row(1, 0, 3.0), row(1, 1, 1.0)])))
    assert sorted(r["cumsum"] for r in got.collect()) == [5.0, 5.0, 6.0]


def test_zero_maximum_gives_null(spark):
    got = series.running_stock(series.number_days(panel(spark, [row(1, 0, -1.0)]))).first()
    assert got["max"] == 0.0 and got["cumsum_pc"] is None


def test_rolling_means_average_lookback_plus_one_rows(spark):
    rows = [row(1, n, 1.0) for n in range(4)]
    got = by(series.labelled_series(panel(spark, rows), split_at=3), "date")
    assert [got[day(n)]["rolling_cumsum_1"] for n in range(4)] == [1.0, 1.5, 2.5, 1.0]
    assert [got[day(n)]["rolling_cumsum_5"] for n in range(4)] == [1.0, 1.5, 2.0, 1.0]


def test_rolling_means_equal_moving_frames(spark):
    rows = series.labelled_series(_long_input(spark, hot=80))
    for column in series.CURVES:
        for n in series.LOOKBACKS:
            frame = series_window(["sku", "is_train"], "id", rows=(-n, 0))
            gap = F.abs(F.avg(column).over(frame) - F.col(f"rolling_{column}_{n}"))
            mixed = F.avg(column).over(frame).isNull() != F.col(f"rolling_{column}_{n}").isNull()
            assert rows.select(gap.alias("gap"), mixed.alias("mixed")).filter("gap > 1e-9 or mixed").count() == 0


def test_whole_chain_needs_one_exchange_and_one_sort(spark):
    rows = panel(spark, [row(k, n) for k in range(3) for n in range(3)])
    plan = series.labelled_series(rows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hash", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_window_takes_one_frame():
    with pytest.raises(ValueError):
        series_window("sku", "id", rows=(-1, 0), values=(-1, 0))


def _long_input(spark, seed=3, hot=600, others=40):
    """One key with most of the rows, several short ones, negative and missing quantities."""
    rng = random.Random(seed)
    rows = []
    for sku, size in [(1, hot), *[(k, rng.randint(1, 60)) for k in range(2, others)]]:
        for n in rng.sample(range(3000), size):
            rows.append(row(sku, n, rng.choice([None, -2.0, 0.0, 1.0, 5.0])))
    return panel(spark, rows)


@pytest.mark.parametrize("running_max", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_curves_over_ranges_equal_plain_windows(spark, running_max, parts):
    rows = _long_input(spark)
    plain = series.labelled_series(rows, running_max=running_max)
    placed = longseries.place(series.add_activity(rows), "date", parts=parts)
    ranged = longseries.labelled_curve(placed, "date", running_max=running_max, block_rows=50)
    columns = ["sku", "date", "is_train", "id", "cumsum", "max", *[c for c in plain.columns if c.startswith("rolling")]]

    def flat(df):
        return sorted(
            tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()
        )

    assert flat(plain) == flat(ranged)


@pytest.mark.parametrize("parts", [1, 4])
def test_curves_over_ranges_keep_rows_with_null_key_or_time(spark, parts):
    rows = panel(spark, [row(None, 0, 2.0), row(None, 40, 3.0), row(1, None, 1.0), row(1, 3, 1.0)])
    got = longseries.labelled_curve(longseries.place(series.add_activity(rows), "date", parts=parts), "date")
    assert sorted((r["sku"] or 0, r["cumsum"]) for r in got.collect()) == [(0, 2.0), (0, 5.0), (1, 1.0), (1, 2.0)]


def test_repeated_times_over_ranges_share_the_running_sum(spark):
    rows = panel(spark, [row(k, n // 3, float(1 + n % 2)) for k in (1, 2) for n in range(240)])
    placed = longseries.place(series.add_activity(rows), "date", parts=9)
    assert placed.groupBy("sku", "date").agg(F.count_distinct("_part").alias("n")).filter("n > 1").count() == 0
    assert placed.filter("sku = 1").select("_part").distinct().count() > 2
    ties = ["sold_quantity"]
    got = longseries.running_stock(longseries.number_rows(placed, "date", ties), "date")
    position = F.row_number().over(series_window("sku", ["date", *ties]))
    sides = rows.withColumn("is_train", F.when(position <= 30, 1).otherwise(0))
    want = series.running_stock(sides)

    def flat(df):
        return sorted(tuple(r) for r in df.select("sku", "date", "sold_quantity", "is_train", "cumsum", "max").collect())

    assert flat(got) == flat(want)


def test_curves_over_ranges_of_an_empty_panel(spark):
    placed = longseries.place(series.add_activity(panel(spark, [])), "date")
    assert longseries.labelled_curve(placed, "date").count() == 0


def test_hot_series_lies_in_many_ranges_and_few_states_travel(spark):
    placed = longseries.place(_long_input(spark), "date", parts=12)
    sizes = placed.groupBy("_part").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 600
    assert placed.filter("sku = 1").select("_part").distinct().count() > 3
    ranges = placed.select("sku", "_part").distinct().groupBy("sku").count().filter("count > 1")
    assert ranges.agg(F.sum("count")).first()[0] <= 2 * (len(sizes) - 1)


def test_no_window_over_rows_holds_a_whole_hot_series(spark):
    plan = longseries.labelled_curve(longseries.place(_long_input(spark), "date", parts=4), "date")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    found = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)\)", text)
    assert found and all("_part" in spec for spec in found)
    lags = re.findall(r"lag\([^)]*\) windowspecdefinition\(([^)]*)\)", text)
    assert lags and all("_block" in spec for spec in lags)
    joins = re.findall(r"(\w+HashJoin|SortMergeJoin)", plan._jdf.queryExecution().executedPlan().toString())
    assert set(joins) == {"BroadcastHashJoin"}


def test_block_must_exceed_lookback(spark):
    with pytest.raises(ValueError):
        longseries.rolling_means(spark.range(1), block_rows=5)


def test_daily_panel_has_one_row_per_day_even_for_a_hot_item(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    hot = lines.withColumn("l_partkey", F.lit(0).cast("bigint"))
    hot.unionByName(hot).unionByName(lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    got = retail.sku_daily(spark, str(tmp_path), tuple(retail.CATEGORY_SOURCES))
    assert got.groupBy("sku", "date").count().filter("count > 1").count() == 0
    assert got.agg(F.sum("sold_quantity")).first()[0] == 3 * lines.agg(F.sum("l_quantity")).first()[0]
    days = lines.select(F.to_date("l_shipdate")).distinct().count()
    assert got.filter("sku = 0").count() == days


def test_category_columns_do_not_change_the_panel(spark):
    short = retail.sku_daily(spark, SF)
    full = retail.sku_daily(spark, SF, tuple(retail.CATEGORY_SOURCES)).select(*short.columns)
    assert short.exceptAll(full).count() == 0 and full.exceptAll(short).count() == 0
