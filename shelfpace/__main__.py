"""Run the whole job: ``python -m shelfpace PANEL META ITEMS OUT``; on a cluster, submit this file with the package."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from shelfpace.plans.modelling import TRIALS, run_all
from shelfpace.session import tune


def main() -> None:
    parser = argparse.ArgumentParser(prog="shelfpace", description=__doc__)
    parser.add_argument("panel", help="Parquet: one row per item and day")
    parser.add_argument("meta", help="JSON lines: item metadata")
    parser.add_argument("items", help="CSV with header: sku, target_stock")
    parser.add_argument("out", help="folder for tables, model and predictions")
    parser.add_argument("--trials", type=int, default=TRIALS, help="configurations to try")
    parser.add_argument("--trees", type=int, default=20, help="trees per model")
    parser.add_argument("--plain", action="store_true", help="tables by the plain definitions, not the historical ones")
    parser.add_argument("--own-weights", action="store_true", help="judge each trial with its own weights, as the historical job did")
    args = parser.parse_args()
    spark = tune(SparkSession.builder.appName("shelfpace").getOrCreate())
    run_all(spark, args.panel, args.meta, args.items, args.out, args.trials, args.trees, args.plain, args.own_weights)


if __name__ == "__main__":
    main()
