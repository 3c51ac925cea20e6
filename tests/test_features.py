import pytest
from pyspark.sql import functions as F

from shelfpace.operators import features, series
from tests.helpers import by, panel, row


def _cats(spark, values):
    return panel(spark, [row(1, n, listing=v) for n, v in enumerate(values)])


def test_shares_sum_to_one(spark):
    got = features.category_share(_cats(spark, ["A", "A", "B", "AB"]), "listing_type").first()
    assert (got["A_prop"], got["B_prop"], got["AB_prop"]) == (0.5, 0.25, 0.25)


def test_odds_divide_by_the_other_categories(spark):
    got = features.category_share(_cats(spark, ["A", "A", "B", "AB"]), "listing_type", rule=features.ODDS).first()
    assert got["A_prop"] == 1.0
    assert got["B_prop"] == got["AB_prop"] == pytest.approx(1 / 3)


def test_character_rule(spark):
    rows = _cats(spark, ["A", "A", "B", "AB"])
    got = features.category_share(rows, "listing_type", rule=features.CHARACTER_RULE).first()
    assert got["A_prop"] == 1.0  # own one-character name leaves the denominator
    assert got["B_prop"] == pytest.approx(1 / 3)
    assert got["AB_prop"] == 1.0  # both one-character names leave, the name itself stays


def test_character_rule_is_a_share_for_long_names(spark):
    rows = _cats(spark, ["free", "free", "paid", "mixed"])
    clean = features.category_share(rows, "listing_type").first()
    compat = features.category_share(rows, "listing_type", rule=features.CHARACTER_RULE).first()
    assert clean == compat


def test_zero_denominator_gives_zero(spark):
    rows = _cats(spark, ["A", "A"])
    assert features.category_share(rows, "listing_type", ["A"], features.ODDS).first()["A_prop"] == 0.0
    assert features.category_share(rows, "listing_type", ["A"], features.CHARACTER_RULE).first()["A_prop"] == 0.0


def test_null_category_is_left_out_or_its_own_bucket(spark):
    rows = _cats(spark, ["A", None])
    assert features.category_share(rows, "listing_type").first().asDict() == {"sku": 1, "A_prop": 1.0}
    bucket = features.category_share(rows, "listing_type", null_bucket=True).first()
    assert (bucket["A_prop"], bucket["null_prop"]) == (0.5, 0.5)


def test_names_with_quotes_and_dots(spark):
    rows = _cats(spark, ["it's", "a.b", ""])
    got = features.category_share(rows, "listing_type").first().asDict()
    assert set(got) == {"sku", "it's_prop", "a.b_prop", "_prop"}


def test_drop_first_drops_in_sorted_order(spark):
    got = features.category_share(_cats(spark, ["B", "A"]), "listing_type", drop_first=True)
    assert got.columns == ["sku", "B_prop"]


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        features.category_share(_cats(spark, ["A"]), "listing_type", rule="other")


def test_features_are_one_aggregation(spark):
    rows = series.add_activity(panel(spark, [row(1, 0, 4.0, 2.0, 10.0), row(1, 1, 4.0, 0.0, 20.0), row(2, 0)]))
    got = by(features.sku_features(rows), "sku")
    assert (got[1]["minutes_active_avg"], got[1]["selling_rate_avg"], got[1]["price_avg"]) == (1.0, 1.0, 15.0)
    cats = features.category_values(rows)
    assert cats == {"listing_type": ["A"], "shipping_payment": ["F"], "shipping_logistic_type": ["long"]}
    plan = features.sku_features(rows, cats)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_weekday_profile_has_fixed_columns(spark):
    rows = panel(spark, [row(1, 0, 2.0), row(1, 2, 1.0), row(1, 5, 1.0), row(1, 7, 4.0)])  # Mon, Wed, Sat, Mon
    got = features.weekday_profile(rows).first()
    assert [got[f"day_{d}"] for d in range(7)] == [0.0, 0.75, 0.0, 0.125, 0.0, 0.0, 0.125]


def test_weekday_profile_without_sales_is_null(spark):
    got = features.weekday_profile(panel(spark, [row(1, 0, 0.0)])).first()
    assert got["day_1"] is None


def test_key_in_the_weekday_denominator(spark):
    rows = panel(spark, [row(k, n, 1.0) for k in (0, 1, 1_000_000) for n in range(7)])
    got = by(features.weekday_profile(rows, add_key=True), "sku")
    assert got[0]["day_0"] == pytest.approx(1 / 7)
    assert got[1]["day_0"] == pytest.approx(1 / 8)
    assert got[1_000_000]["day_0"] == pytest.approx(1 / 1_000_007)


def test_active_share(spark):
    rows = series.add_activity(panel(spark, [row(1, 0), row(1, 1, minutes=0.0), row(2, 0, minutes=None)]))
    got = by(features.active_share(rows), "sku")
    assert (got[1]["proportion_active"], got[2]["proportion_active"]) == (0.5, 0.0)


def test_too_many_categories_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CATEGORIES", 2)
    with pytest.raises(ValueError, match="categories"):
        features.category_values(_cats(spark, ["A", "B", "C"]), ["listing_type"])


def test_long_shares_agree_with_the_wide_ones(spark):
    rows = panel(spark, [row(1, 0, listing="A"), row(1, 1, listing="B"), row(1, 2, listing=None), row(2, 0, listing="odd 'name'"), row(3, 0, listing=None)])
    long = {(r["sku"], r["value"]): (r["n"], r["share"]) for r in features.category_share_long(rows, ["listing_type"]).collect()}
    assert long == {(1, "A"): (1, 0.5), (1, "B"): (1, 0.5), (2, "odd 'name'"): (1, 1.0)}
    wide = by(features.category_share(rows, "listing_type"), "sku")
    assert all(wide[sku][f"{value}_prop"] == share for (sku, value), (_, share) in long.items())
    many = spark.range(5000).select(F.col("id").alias("sku"), F.col("id").cast("string").alias("listing_type"))
    assert features.category_values_long(many, ["listing_type"]).count() == 5000
    assert features.category_share_long(many.limit(0), ["listing_type"]).count() == 0
