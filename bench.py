"""Time the headline queries: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from shelfpace.plans.queries import queries
from shelfpace.session import local_session

HEADLINE = (
    "selling_rate",
    "stock_curve",
    "rolling_means",
    "rolling_means_active",
    "event_curve",
    "sku_features",
    "weekday_profile",
    "active_share",
    "dense_panel",
    "forward_filled",
    "panel_with_meta",
    "date_gaps",
    "length_histogram",
    "leading_zeros",
    "target_prep",
    "category_codes",
    "encoded_panel",
    "sample_weights",
    "group_sample",
    "rps_score",
    "log_loss",
    "day_distribution",
    "table_train",
    "table_validation_active",
    "table_features_train",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    registered = queries()
    # Start the executor threads and compile the common plan shapes before the clock runs.
    registered["selling_rate"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
