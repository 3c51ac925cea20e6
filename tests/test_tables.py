import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from shelfpace import session
from shelfpace.operators import metadata
from shelfpace.plans import modelling, oracle, queries, tables
from shelfpace.sources import lines, readers, retail

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"day_distribution", "config_search", "model_scores", "calibration_scores", "reliability"}


@pytest.fixture(scope="module")
def inputs(spark):
    panel = retail.sku_daily(spark, SF, tuple(retail.CATEGORY_SOURCES)).persist()
    yield tables.Inputs(panel, retail.item_meta(spark, SF), metadata.tag_input_order(retail.score_items(spark, SF)))
    panel.unpersist()


def _same(a, b):
    """Same rows with doubles compared to nine digits."""

    def flat(df):
        return sorted(
            tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.select(*a.columns).collect()
        )

    return sorted(a.columns) == sorted(b.columns) and flat(a) == flat(b)


def test_every_query_has_sql_or_is_a_model_fit():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == ROWS_ONLY
    assert set(oracle.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - {f"table_{n}" for n in tables.TABLE_NAMES}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = contract.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(str(v) for v in r) for r in result.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.select(*names).collect()) == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_written_tables_equal_the_lazy_ones(spark, inputs, tmp_path):
    paths = tables.build_tables(spark, inputs, str(tmp_path), compat=True, parts=3)
    assert tuple(paths) == tables.TABLE_NAMES
    lazy = tables.feature_tables(inputs, compat=True)
    for name in tables.TABLE_NAMES:
        assert _same(lazy[name](), readers.read_table(spark, str(tmp_path), name)), name
    assert not [d.name for d in spark.catalog.listDatabases() if d.name.startswith("shelfpace_")]


def test_series_over_many_ranges_give_the_same_tables(spark, inputs, tmp_path):
    tables.build_tables(spark, inputs, str(tmp_path), compat=True, parts=40)
    lazy = tables.feature_tables(inputs, compat=True)
    for name in ("train", "validation_active", "features_train_active", "dof_validation", "days_activity_train"):
        assert _same(lazy[name](), readers.read_table(spark, str(tmp_path), name)), name


def test_invariants_of_the_frames(spark, inputs):
    made = tables.feature_tables(inputs, compat=False)
    keys = inputs.panel.select("sku").distinct()
    known = keys.join(inputs.meta, "sku", "left_semi").count()
    for name in tables.FRAMES:
        frame = made[name]()
        assert frame.count() == 30 * known
        assert frame.select("sku", "id").distinct().count() == 30 * known
    shares = [c for c in made["features_train"]().columns if c in ("A_prop", "N_prop", "R_prop")]
    total = sum(F.col(c) for c in shares)
    assert made["features_train"]().filter(F.abs(total - 1) > 1e-9).count() == 0


def test_active_tables_really_use_active_days(spark, inputs):
    made = tables.feature_tables(inputs, compat=True)
    assert not _same(made["dof_train"](), made["dof_train_active"]())
    assert not _same(made["features_validation"](), made["features_validation_active"]())


def test_staged_tables_are_read_without_a_shuffle(spark, inputs, tmp_path):
    spark.sql("CREATE DATABASE stage_plan LOCATION '%s'" % tmp_path)
    try:
        frame = tables.label(inputs.panel.repartition(3, "sku"), active=False)
        frame.write.format("parquet").bucketBy(3, "sku").sortBy("sku", "id").saveAsTable("stage_plan.labelled")
        labelled = spark.table("stage_plan.labelled")
        made = tables.tables_from_labelled(
            lambda active: labelled, inputs.meta, inputs.score_items, labelled.select("sku").distinct(), {}, True
        )
        for name in ("features_train", "dof_train", "days_activity_validation"):
            assert "Exchange" not in made[name]()._jdf.queryExecution().executedPlan().toString(), name
        plan = made["train"]()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan
    finally:
        spark.sql("DROP DATABASE stage_plan CASCADE")


def test_whole_job_from_files(spark, inputs, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    typed = inputs.panel.withColumn("date", F.col("date").cast("string")).withColumn(
        "sold_quantity", F.col("sold_quantity").cast("long")
    )
    typed.write.parquet(f"{source}/panel")
    inputs.meta.withColumn("title", F.lit("never read")).write.json(f"{source}/meta")
    inputs.score_items.drop("monid").coalesce(1).write.csv(f"{source}/items", header=True)
    modelling.run_all(spark, f"{source}/panel", f"{source}/meta", f"{source}/items", out, trials=2, trees=2)
    scored = readers.read_score_items(spark, f"{source}/items").count()
    predicted = spark.read.csv(f"{out}/out.csv")
    assert predicted.count() == scored and len(predicted.columns) == 30
    first = predicted.first()
    assert all(len(v.split(".")[1]) == 4 for v in first)
    assert spark.read.csv(f"{out}/results.csv", header=True).count() == 2
    assert "known_loss" in spark.read.csv(f"{out}/scores.csv", header=True).columns
    assert spark.read.parquet(f"{out}/rejected_lines.parquet").count() == 0
    assert lines.checked_lines(spark, f"{out}/out.csv").count() == scored
    assert spark.read.parquet(f"{out}/maxval.parquet").columns == ["sku", "target_stock"]
    assert dict(readers.read_table(spark, out, "model_train").dtypes) == {
        "sku": "bigint",
        "id": "tinyint",
        "target_stock": "float",
        "item_domain_id": "int",
    }


def test_whole_job_by_plain_definitions(spark, inputs, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    inputs.panel.write.parquet(f"{source}/panel")
    inputs.meta.write.json(f"{source}/meta")
    inputs.score_items.drop("monid").coalesce(1).write.csv(f"{source}/items", header=True)
    files = [f"{source}/{name}" for name in ("panel", "meta", "items")]
    modelling.run_all(spark, *files, out, trials=1, trees=1, plain=True, own_weights=True)
    lazy = tables.feature_tables(inputs, compat=False)
    for name in ("validation_active", "features_train", "dof_train"):
        assert _same(lazy[name](), readers.read_table(spark, out, name)), name
    assert lines.checked_lines(spark, f"{out}/out.csv").count() == inputs.score_items.count()
    own = spark.read.csv(f"{out}/results.csv", header=True).first().asDict()
    modelling.tune(spark, out, trials=1, trees=1)
    alike = spark.read.csv(f"{out}/results.csv", header=True).first().asDict()
    assert own.pop("log_loss") != alike.pop("log_loss") and own == alike


def test_bad_text_in_the_score_list_is_null_not_an_error(spark, tmp_path):
    (tmp_path / "items.csv").write_text("sku,target_stock\n1,3\nx,4\n2,\n")
    rows = [tuple(r) for r in readers.read_score_items(spark, str(tmp_path / "items.csv")).collect()]
    assert rows == [(1, 3.0), (None, 4.0), (2, None)]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == named if named else session.shared_folder(spark)
    assert session.cut_lineage(spark.range(5)).count() == 5
