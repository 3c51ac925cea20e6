import datetime as dt
import random

from shelfpace.operators import quality, sampling
from shelfpace.sources import retail
from tests.helpers import by, day, panel, row


def _runs(days):
    """Plain loop: every sorted pair one day apart."""
    known = sorted(d for d in days if d is not None)
    return all((b - a).days == 1 for a, b in zip(known, known[1:]))


def test_consecutive_dates_equal_a_plain_loop(spark):
    rng = random.Random(9)
    series = {1: [0, 1, 2], 2: [0, 2], 3: [0, 0, 1], 4: [2, 0, 1], 5: [4], 6: [None, 0, 1], 7: [None], 8: [0, 0, 2]}
    for sku in range(10, 150):
        series[sku] = [rng.randint(0, 5) for _ in range(rng.randint(1, 5))]
    rows = [row(sku, n) for sku, days in series.items() for n in days]
    got = by(quality.consecutive_dates(panel(spark, rows)), "sku")
    for sku, days in series.items():
        assert got[sku]["consecutive"] == _runs([None if n is None else day(n) for n in days]), sku
    assert {r["sku"] for r in quality.broken_series(panel(spark, rows)).collect()} == {
        sku for sku, v in got.items() if not v["consecutive"]
    }


def test_leading_zeros_follow_the_dates(spark):
    rng = random.Random(4)
    series = {1: [0, 0, 3, 0], 2: [1], 3: [0, 0], 4: [None, 0, 2], 5: [None], 6: [None, 1, 0]}
    for sku in range(10, 100):
        series[sku] = [rng.choice([0, 0, 1, None]) for _ in range(rng.randint(1, 6))]
    rows = [row(sku, n, minutes=None if v is None else float(v)) for sku, vs in series.items() for n, v in enumerate(vs)]
    rng.shuffle(rows)
    got = by(quality.leading_zeros(panel(spark, rows)), "sku")
    for sku, values in series.items():
        count = 0
        for v in (x for x in values if x is not None):
            if v != 0:
                break
            count += 1
        assert got[sku]["leading_zeros"] == count, sku


def test_leading_zeros_of_a_null_key(spark):
    rows = panel(spark, [row(None, 0, minutes=0.0), row(None, 1, minutes=2.0), row(None, 2, minutes=0.0)])
    assert [tuple(r) for r in quality.leading_zeros(rows).collect()] == [(None, 1)]


def test_histograms_and_shares(spark):
    rows = [row(k, n, minutes=float(n % 2)) for k, size in ((1, 40), (2, 40), (3, 10)) for n in range(size)]
    hist = quality.length_histogram(panel(spark, rows))
    assert [(r["number_of_items"], r["count"]) for r in hist.collect()] == [(10, 1), (40, 2)]
    assert abs(quality.share_over(hist, "number_of_items").first()[0] - 200 / 3) < 1e-9
    active = [tuple(r) for r in quality.active_histogram(panel(spark, rows)).collect()]
    assert [a[:2] for a in active] == [(5, 1), (20, 2)]
    by_value = [r["proportion"] for r in quality.active_histogram(panel(spark, rows), by_value=True).collect()]
    assert by_value == [20.0, 80.0]
    assert quality.share_over(quality.active_histogram(panel(spark, rows)), "counts").first()[0] == 0.0


def test_bounds_and_lengths(spark):
    rows = panel(spark, [row(1, 3), row(1, 0), row(2, 0), row(2, 9), row(2, 9)])
    got = by(quality.date_bounds(rows), "sku")
    assert (got[2]["first_date"], got[2]["last_date"]) == (day(0), day(9))
    assert quality.distinct_bounds(rows, "first_date").count() == 1
    assert quality.distinct_bounds(rows, "last_date").count() == 2
    assert quality.longest_series(rows) == 3
    assert quality.longest_series(rows.limit(0)) == 0
    assert [r["sku"] for r in quality.repeated_times(rows).collect()] == [2]


def test_samples_repeat_and_agree_between_frames(spark):
    keys = spark.range(5000).withColumnRenamed("id", "sku")
    first = {r[0] for r in sampling.group_sample(keys, 0.2, seed=1).collect()}
    again = {r[0] for r in sampling.group_sample(keys.repartition(7), 0.2, seed=1).collect()}
    other = {r[0] for r in sampling.group_sample(keys, 0.2, seed=2).collect()}
    assert first == again != other
    assert 0.17 < len(first) / 5000 < 0.23
    assert sampling.group_sample(keys, 1.0).count() == 5000
    picked = sampling.key_sample(keys.union(keys), 200)
    assert picked.count() == 200 == picked.distinct().count()
    assert sampling.rows_of(keys.union(keys), picked).count() == 400


def test_partitions_follow_the_lines_and_change_no_row(spark, tmp_path):
    lines = [(i % 7, dt.date(2021, 2, 1 + i % 11), float(i), i % 5 + 1, 2.0 * i, "NF"[i % 2], "AR"[i % 3 == 0], i % 40) for i in range(300)]
    names = "l_partkey long, l_shipdate date, l_quantity double, l_linenumber int, l_extendedprice double, l_linestatus string, l_returnflag string, l_orderkey long"
    spark.createDataFrame([*lines, (None, None, 1.0, 1, 1.0, "N", "A", 1)], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"{k % 3}-P") for k in range(40)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    events = [(i % 5, dt.datetime(2021, 2, 1 + i % 9, i % 24)) for i in range(200)]
    spark.createDataFrame(events, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    for make in (retail.sku_daily, retail.user_daily, lambda *a, **k: retail.sku_daily(*a, tuple(retail.CATEGORY_SOURCES), **k)):
        whole, spread = make(spark, str(tmp_path)), make(spark, str(tmp_path), task_rows=10)
        assert sorted(map(repr, spread.collect())) == sorted(map(repr, whole.collect()))
        assert spread.rdd.getNumPartitions() in (20, 31) and whole.rdd.getNumPartitions() <= 4
        # The layout by item serves the checks and windows behind it, without another exchange.
        assert sorted(map(repr, quality.broken_series(spread).collect())) == sorted(map(repr, quality.broken_series(whole).collect()))
        assert quality.broken_series(spread).rdd.getNumPartitions() == spread.rdd.getNumPartitions()
