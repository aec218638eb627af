"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
GRID_SEEDS = 16

HEADLINE = (
    "monthly_source",
    "tidy_market",
    "standardized_market",
    "standardized_inputs",
    "standardized_hourly",
    "volatility_timed_momentum",
    "model_scores",
    "spanning_regression",
    "ar1_kendall",
    "summary_panel",
    "market_grid",
    "supplier_grid",
    "predictor_importance",
    "target_grid",
    "bootstrap_panel",
    "full_complexity_grid",
    "counterfactual_table",
    "default_grid",  # 15 predictors, the default 14 x 8 grid
    "default_importance",
    "wide_grid",
)


def default_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The default study grid (14 complexities x 8 shrinkages) on hourly series."""
    from panelgrid.config import StudyConfig
    from panelgrid.operators.standardize import standardize_panel
    from panelgrid.plans.study import run_study
    from pyspark.sql import functions as F
    from workload import inputs

    panel = inputs.hourly_panel(spark, folder).select("series_id", "t", F.col("total").alias("y"), "n", "mean")
    std = standardize_panel(panel, "y", ("n", "mean"), inputs.HOURS, check=False)
    config = StudyConfig(seeds=tuple(range(GRID_SEEDS)))
    return run_study(std, config, "y", ("n", "mean"), inputs.HOURS, on_bad_series="trust").averaged


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("panelgrid-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload.queries import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    jobs = {name: QUERIES[name] for name in HEADLINE}
    jobs["default_grid_hourly"] = default_grid
    only = sys.argv[1:]
    seconds = {}
    for name, fn in jobs.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        fn(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_wall_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(FOLDER).name.removeprefix("sf"),
    }
    if "default_grid_hourly" in seconds:
        # a window is one decision row of one series and seed, with every cell of the grid
        from workload.inputs import hourly_panel

        rows = [r["count"] for r in hourly_panel(spark, FOLDER).groupBy("series_id").count().collect()]
        windows = sum(n - 36 - 13 for n in rows) * GRID_SEEDS
        result["series_seed_windows_per_sec"] = round(windows / seconds["default_grid_hourly"], 1)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
