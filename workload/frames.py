"""Frames several queries share, built from the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelgrid.config import StudyConfig
from panelgrid.operators.blocks import MONTHS, over_time
from panelgrid.operators.standardize import standardize_panel, trim_to_sample
from panelgrid.operators.tidy import PREDICTORS, SHARED_PREDICTORS, TARGET, target_frame, tidy_panel, excess_returns
from panelgrid.operators.windows import lagged
from panelgrid.plans.study import Study, leave_one_out, run_study
from workload import inputs
from workload.inputs import SUPPLIER_PREDICTORS, sample_end

# The grid with a closed form: two features, so SQL can solve every window exactly.
SMALL_GRID = StudyConfig(p_grid=(2,), z_grid=(0.1, 10.0), seeds=(0, 1), ridgeless=False)
# Window 2: the dual system of any number of features is 2 x 2, so SQL can solve models far beyond the window. Eight
# features are decomposed as they are, more of them by their Gram matrix.
WIDE_GRID = StudyConfig(window=2, p_grid=(8, 24, 96), z_grid=(0.1, 10.0), seeds=(0, 1))
# Cells of the formula-based forecast table.
NAIVE_CELLS = tuple((s, p, z) for s in (0, 1, 2) for p in (2, 12) for z in (0.0, 10.0))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed precision, so equal results compare equal; no negative zero."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def market_tidy(spark: SparkSession, folder: str) -> DataFrame:
    source = inputs.monthly_source(spark, folder)
    index = inputs.index_returns(spark, folder)
    return tidy_panel(source, index, threshold=None, check=False)


def market_standardized(spark: SparkSession, folder: str) -> DataFrame:
    tidy = trim_to_sample(market_tidy(spark, folder), sample_end(spark, folder))
    return standardize_panel(
        tidy, TARGET, PREDICTORS, MONTHS, own_lag="lag_mkt_excess", date="date", check=False
    )


def supplier_standardized(spark: SparkSession, folder: str) -> DataFrame:
    panel = trim_to_sample(inputs.supplier_panel(spark, folder), sample_end(spark, folder))
    return standardize_panel(panel, "y", SUPPLIER_PREDICTORS, MONTHS, own_lag="own_lag", check=False)


def supplier_study(spark: SparkSession, folder: str, config: StudyConfig = SMALL_GRID) -> Study:
    panel = supplier_standardized(spark, folder)
    return run_study(panel, config, "y", SUPPLIER_PREDICTORS, date="date", on_bad_series="trust")


def market_study(spark: SparkSession, folder: str, config: StudyConfig = SMALL_GRID) -> Study:
    panel = market_standardized(spark, folder)
    return run_study(panel, config, TARGET, PREDICTORS, date="date", on_bad_series="trust")


def target_study_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Two bond-like excess returns on the market's shared predictors."""
    source = inputs.monthly_source(spark, folder)
    bonds = excess_returns(
        source, {"ltr_excess": "ltr", "corpr_excess": "corpr"}, "Rfree", ("series_id", "t", "date")
    )
    frame = target_frame(bonds, market_standardized(spark, folder), ("ltr_excess", "corpr_excess"))
    return trim_to_sample(frame, sample_end(spark, folder))


def target_study(spark: SparkSession, folder: str, config: StudyConfig = SMALL_GRID) -> Study:
    frame = target_study_frame(spark, folder)
    return run_study(
        frame, config, "y", ("own_lag", *SHARED_PREDICTORS), MONTHS.with_keys("target"), "date", "trust"
    )


def importance_study(spark: SparkSession, folder: str, config: StudyConfig = SMALL_GRID) -> Study:
    panel = supplier_standardized(spark, folder)
    return leave_one_out(panel, config.with_(z_grid=(10.0,)), "y", SUPPLIER_PREDICTORS, date="date", strict=False)


def naive_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """A forecast table by formula, one row per supplier, cell and month."""
    panel = over_time(
        inputs.supplier_panel(spark, folder).select("series_id", "t", "date", "y", "ltr"),
        MONTHS,
        {"_prev": lagged("y")},
        lookback=1,
    ).where(F.col("_prev").isNotNull())
    cells = F.array(
        *[
            F.struct(F.lit(s).cast("long").alias("seed"), F.lit(p).alias("P"), F.lit(z).alias("z"))
            for s, p, z in NAIVE_CELLS
        ]
    )
    forecast = F.col("_prev") * (F.col("seed") + 1) / F.col("P") - F.lit(0.1) * F.col("ltr") + F.col("z") * 0.001
    return (
        panel.withColumn("_c", F.explode(cells))
        .select("series_id", "t", F.col("date").alias("obs"), "_prev", "ltr", F.col("y").alias("realized"), "_c.*")
        .select(
            "series_id", "seed", "P", "z", "t", "obs", forecast.alias("forecast"), "realized",
            (forecast * F.col("realized")).alias("strategy"), F.abs(forecast).alias("beta_norm"),
        )
    )
