"""The registered queries: each takes (spark, folder of parquet tables)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelgrid import guards
from panelgrid.config import (
    CounterfactualConfig, StudyConfig, anchor_config, importance_config, market_config, target_config,
)
from panelgrid.functions import metrics
from panelgrid.functions.columns import complexity, label
from panelgrid.operators import scoring, windows
from panelgrid.operators.blocks import MONTHS, TimeAxis, dense_ordinal, over_time
from panelgrid.operators.counterfactual import calibrated_signal, plant_signal, wild_bootstrap
from panelgrid.operators.engine import default_predictors, rolling_forecasts, to_arrays
from panelgrid.operators.features import feature_columns, rff_features, rff_weights, scale_by_training_window
from panelgrid.operators.regressions import (
    ar1_residuals, ar1_table, fit_ar1, forecast_anatomy, pair_worlds, recovery, spanning,
)
from panelgrid.operators.standardize import (
    standardize_columns, standardize_panel, trim_to_sample, with_valid,
)
from panelgrid.operators.tidy import (
    PREDICTORS, TARGET, excess_returns, join_one_to_one, lookup,
)
from panelgrid.plans import reports
from panelgrid.plans.counterfactuals import diagnostics, prepare_inputs, run_counterfactuals
from panelgrid.plans.study import anchor_study, leave_one_out
from panelgrid.sources.landing import join_landed, land, landed, landed_between
from panelgrid.sources.sinks import DEFAULT_SAMPLE_END, artifact_path, materialize, new_path, write_artifact
from panelgrid.sources.tables import bounded, percent_factors, with_month_end
from workload import frames, inputs
from workload.frames import SMALL_GRID, WIDE_GRID, rounded
from workload.inputs import HOURS, SUPPLIER_PREDICTORS, sample_end, table

QUERIES: dict = {}
KEYS = ["series_id"]
CELL = ["series_id", "seed", "P", "z"]
STATS = ("r2", "mean_return", "volatility", "sharpe", "alpha", "information_ratio", "alpha_tstat")
SPAN = ("alpha", "beta_benchmark", "beta_market", "alpha_tstat", "information_ratio", "resid_std")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and projections -------------------------------------------------------


@query
def month_end_scan(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem", "l_shipdate", "l_quantity")
    landed = lines.select((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("yyyymm"), "l_quantity")
    return with_month_end(landed).groupBy("yyyymm", "date").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty")
    )


@query
def bounded_scan(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    rows = bounded(orders, "o_orderdate", "1996-01-31", "1999-06-30")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")


@query
def percent_factor_ingest(spark, folder):
    lines = table(spark, folder, "lineitem", "l_shipdate", "l_discount", "l_tax")
    daily = lines.groupBy("l_shipdate").agg(
        F.sum("l_discount").alias("Mkt-RF"), F.sum("l_tax").alias("RF"), F.count("*").alias("n")
    )
    rows = percent_factors(daily, F.col("l_shipdate"), {"Mkt-RF": "intl_mkt_excess", "RF": "rf"})
    return rounded(rows.groupBy("date").agg(F.sum("intl_mkt_excess").alias("intl_mkt_excess"), F.sum("rf").alias("rf")))


@query
def pruned_scan(spark, folder):
    return table(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_acctbal")


@query
def monthly_source(spark, folder):
    return rounded(inputs.monthly_source(spark, folder), 5)


@query
def stored_source(spark, folder):
    return rounded(materialize(inputs.flag_source(spark, folder)), 5)


@query
def period_artifacts(spark, folder):
    """One artifact of two sample periods: writing the second leaves the first as it was."""
    panel, base = inputs.supplier_panel(spark, folder), new_path(spark, "periods-")
    periods = ("1997-06", DEFAULT_SAMPLE_END)
    for end in periods:
        write_artifact(trim_to_sample(panel.select("series_id", "date", "y"), end), base, "panel", end)
    first, second = [
        spark.read.parquet(artifact_path(base, "panel", end)).withColumn("period", F.lit(end)) for end in periods
    ]
    return rounded(first.unionByName(second))


@query
def default_predictor_levels(spark, folder):
    """Every column that a study takes as a predictor unless told otherwise, with its rows and mean."""
    std = frames.supplier_standardized(spark, folder)
    names = default_predictors(std, "y", ("series_id", "t", "date"))
    long = std.unpivot([], names, "predictor", "value")
    return rounded(long.groupBy("predictor").agg(F.count("value").alias("n_rows"), F.avg("value").alias("mean")))


@query
def landed_bounds(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    stored = landed(spark, land(orders, new_path(spark, "orders-"), "o_orderdate"), orders.schema)
    rows = landed_between(stored, dt.date(1996, 1, 17), dt.date(1999, 6, 30), "o_orderdate")
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")


@query
def landed_revisions(spark, folder):
    """A first vintage of all orders, then a revision of the months from 1996 on."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    path = land(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), new_path(spark, "orders-"), "o_orderdate")
    land(orders.where("o_orderdate >= '1996-01-01'"), path, "o_orderdate")
    rows = landed(spark, path, orders.schema, ["o_orderkey", "o_orderdate", "o_totalprice"])
    return rounded(rows.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice"), 2)


@query
def landed_target_join(spark, folder):
    source = inputs.flag_source(spark, folder)
    stored = landed(spark, land(source, new_path(spark, "flags-")), source.schema)
    predictor = inputs.monthly_orders(spark, folder).where(F.month("date") % 6 == 0)
    return rounded(join_landed(stored.select("series_id", "date", "e12", "tbl", "landed_month"), predictor, ["date"]), 5)


@query
def tidy_market(spark, folder):
    return rounded(frames.market_tidy(spark, folder))


@query
def bond_excess_returns(spark, folder):
    source = inputs.flag_source(spark, folder)
    rows = excess_returns(
        source, {"ltr_excess": "ltr", "corpr_excess": "corpr"}, "Rfree", ("series_id", "date")
    )
    return rounded(rows)


@query
def sample_trim(spark, folder):
    rows = trim_to_sample(inputs.supplier_panel(spark, folder), "1999-12", check=True)
    return rounded(rows.select("series_id", "date", "y"))


@query
def analysis_start(spark, folder):
    """The standardized panel floored at a date: the burn-in is taken from the rows before it."""
    panel = trim_to_sample(inputs.supplier_panel(spark, folder), sample_end(spark, folder))
    std = standardize_panel(
        panel, "y", SUPPLIER_PREDICTORS, MONTHS, own_lag="own_lag", date="date", start="1999-06-30"
    )
    return rounded(std.select("series_id", "t", "date", "y", *SUPPLIER_PREDICTORS))


@query
def complete_rows(spark, folder):
    return rounded(inputs.monthly_source(spark, folder).na.drop(), 5)


@query
def source_span(spark, folder):
    return inputs.supplier_source(spark, folder).groupBy("series_id").agg(
        F.min("date").alias("first_month"), F.max("date").alias("last_month"), F.count("*").alias("n_rows")
    )


@query
def nonlinear_signal(spark, folder):
    panel = frames.supplier_standardized(spark, folder)
    return rounded(calibrated_signal(panel, MONTHS, calibration=24).select("series_id", "t", "g"))


@query
def display_labels(spark, folder):
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    named = rows.select(
        label(F.col("l_returnflag"), {"A": "Accepted", "R": "Returned"}).alias("flag"),
        label(F.col("l_linestatus"), {"O": "Open"}, keep_unknown=False).alias("status"),
        "l_quantity",
    )
    return named.groupBy("flag", "status").agg(F.sum("l_quantity").alias("qty"))


@query
def study_metadata(spark, folder):
    per_seed = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    means = scoring.average_statistics(per_seed, ["P", "z"])
    return rounded(
        reports.with_metadata(means, {"T": 12, "gamma": 2.0, "sample_end": sample_end(spark, folder)})
        .withColumn("c", complexity(F.col("P"), 12))
        .select("P", "z", "c", "T", "gamma", "sample_end", "sharpe")
    )


# --- joins -------------------------------------------------------------------------


@query
def one_to_one_left_join(spark, folder):
    source = inputs.monthly_source(spark, folder).select("date", "ret", "e12")
    joined = join_one_to_one(source, inputs.monthly_orders(spark, folder), ["date"])
    return rounded(joined.select("date", "ret", "turnover"), 4)


@query
def target_predictor_join(spark, folder):
    frame = frames.target_study_frame(spark, folder)
    return rounded(frame.select("target", "date", "y", "own_lag", "dp", "ltr", "ntis"))


@query
def key_ordered_lookup(spark, folder):
    wanted = frames.supplier_standardized(spark, folder).select("series_id", "t", "y")
    raw = inputs.supplier_panel(spark, folder).select("series_id", "t", F.col("y").alias("raw_y"))
    return rounded(lookup(wanted, raw, ["series_id", "t"], ["raw_y"]))


@query
def neighbour_rows(spark, folder):
    panel = inputs.hourly_panel(spark, folder)
    shifted = over_time(
        panel, HOURS, {"n_before": windows.lagged("n"), "n_after": windows.led("n")}, lookback=1, lookahead=1
    )
    return rounded(shifted.select("series_id", "t", "n", "n_before", "n_after"))


@query
def seed_config_product(spark, folder):
    """Rows of the kernel stage per configuration and seed: every series meets each."""
    forecasts = frames.importance_study(spark, folder).forecasts
    return forecasts.groupBy("excluded", "seed").agg(
        F.count("*").alias("n_rows"), F.count_distinct("series_id").alias("n_series")
    )


@query
def axis_difference(spark, folder):
    """Months present in one source only, by side."""
    both = inputs.monthly_source(spark, folder), inputs.monthly_orders(spark, folder)
    return guards.axis_differences(*both, ["date"]).withColumnRenamed("surplus", "side")


# --- aggregations ------------------------------------------------------------------


@query
def oos_r2(spark, folder):
    f = frames.naive_forecasts(spark, folder)
    return rounded(f.groupBy(*CELL).agg(metrics.oos_r2(F.col("forecast"), F.col("realized")).alias("r2")))


@query
def sharpe_ratio(spark, folder):
    f = frames.naive_forecasts(spark, folder)
    return rounded(f.groupBy(*CELL).agg(metrics.sharpe_ratio(F.col("strategy")).alias("sharpe")))


@query
def alpha_statistics(spark, folder):
    scored = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    return rounded(scored.select(*CELL, "alpha", "information_ratio", "alpha_tstat"))


@query
def alpha_by_residuals(spark, folder):
    return rounded(scoring.score_by_residuals(frames.naive_forecasts(spark, folder), CELL))


@query
def near_spanned_scores(spark, folder):
    """A strategy that is the market times a constant plus very little else."""
    f = frames.naive_forecasts(spark, folder).where("P = 2 AND z = 0.0")
    noise = F.lit(1e-6) * F.sin(F.col("t") * (F.col("seed") + 1))
    near = f.withColumn("forecast", F.lit(0.5) + noise).withColumn("strategy", F.col("forecast") * F.col("realized"))
    scored = scoring.score(near, CELL, strict=False)
    return rounded(scored.select(*CELL, (F.col("alpha") * 1e6).alias("alpha"), "information_ratio", "alpha_tstat"), 4)


@query
def model_scores(spark, folder):
    f = frames.naive_forecasts(spark, folder)
    return rounded(scoring.score(f, CELL, beta_norm="beta_norm", strict=False))


@query
def benchmark_scores(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    bench = windows.volatility_timed_momentum(panel, "y", SUPPLIER_PREDICTORS, MONTHS)
    return rounded(scoring.score(bench, KEYS, strict=False))


@query
def averaged_statistics(spark, folder):
    f = frames.naive_forecasts(spark, folder)
    per_seed = scoring.score(f, CELL, beta_norm="beta_norm", strict=False)
    return rounded(scoring.average_statistics(per_seed, ["series_id", "P", "z"]))


@query
def averages_with_seed_count(spark, folder):
    per_seed = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    return rounded(scoring.average_with_seed_count(per_seed, ["P", "z"]))


@query
def mean_of_rows(spark, folder):
    per_seed = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    return rounded(scoring.average_statistics(per_seed, [], drop=("seed", "P", "z")))


@query
def ensemble_forecasts(spark, folder):
    anchor = scoring.anchor_by_seed(frames.naive_forecasts(spark, folder))
    return rounded(scoring.ensemble(anchor, ["series_id", "obs"]))


@query
def anchor_paths(spark, folder):
    anchor = scoring.anchor_by_seed(frames.naive_forecasts(spark, folder))
    return rounded(anchor.select("series_id", "seed", "obs", "forecast", "realized"))


@query
def path_lengths(spark, folder):
    anchor = scoring.anchor_by_seed(frames.naive_forecasts(spark, folder))
    return anchor.groupBy("series_id", "seed").agg(F.count("*").alias("n_rows"), F.min("obs").alias("first_obs"))


@query
def summary_panel(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    return rounded(reports.summary_panel(panel, ("y", "dp", "ltr", "dfr", "svar"), MONTHS, {"y": "target", "dp": "d/p"}))


@query
def hourly_summary(spark, folder):
    """Hours with holes, a cell missing here and there, in short blocks: neighbours may be in other blocks."""
    cells = inputs.hourly_cells(spark, folder).withColumn("total", F.when(F.col("t") % 7 != 0, F.col("total")))
    return rounded(reports.summary_panel(cells, ("n", "total", "mean"), TimeAxis(("series_id",), "t", 64)))


@query
def market_summary(spark, folder):
    raw = trim_to_sample(frames.market_tidy(spark, folder), sample_end(spark, folder))
    std = frames.market_standardized(spark, folder)
    return rounded(reports.summary_table(raw, std, (TARGET, *PREDICTORS)))


@query
def source_cross_check(spark, folder):
    months = join_one_to_one(
        inputs.monthly_source(spark, folder), inputs.index_returns(spark, folder), ["series_id", "date"]
    )
    return rounded(guards.overlap_correlation(months, F.col("ret") - F.col("Rfree"), F.col("vwretd") - F.col("Rfree")))


@query
def spanning_regression(spark, folder):
    return rounded(spanning(_naive_with_benchmark(spark, folder), CELL))


@query
def spanning_collinear(spark, folder):
    """A benchmark that is twice the market: the coefficients of least length share the market's slope as 2 to 1."""
    rows = frames.naive_forecasts(spark, folder).withColumn("benchmark", F.lit(2.0) * F.col("realized"))
    return rounded(spanning(rows, CELL))


def _naive_with_benchmark(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    bench = windows.momentum(panel, "y", MONTHS).select(
        "series_id",
        (F.col("t") + 1).alias("t"),  # booked on the row after the decision
        F.col("strategy").alias("benchmark"),
        F.col("forecast").alias("benchmark_forecast"),
    )
    return frames.naive_forecasts(spark, folder).join(bench, ["series_id", "t"])


@query
def forecast_anatomy_two_lags(spark, folder):
    anatomy = _anatomy(spark, folder, 2)
    return rounded(
        anatomy.select(
            "series_id", "intercept", F.col("lag_weights")[0].alias("w0"), F.col("lag_weights")[1].alias("w1"), "r2"
        )
    )


@query
def forecast_anatomy_full(spark, folder):
    anatomy = _anatomy(spark, folder, 12)
    return rounded(
        anatomy.select("series_id", F.posexplode("lag_weights").alias("lag", "weight"), "intercept", "r2")
    )


def _anatomy(spark, folder, window):
    # a forecast booked at t was made at t-1
    made = scoring.ensemble(
        scoring.anchor_by_seed(frames.naive_forecasts(spark, folder)), ["series_id", "t"]
    ).withColumn("t", F.col("t") - 1)
    return forecast_anatomy(made, inputs.supplier_panel(spark, folder), "y", MONTHS, window)


@query
def ar1_kendall(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    names = ("dp", "ltr", "dfr", "svar")
    return rounded(ar1_table(fit_ar1(panel, names, MONTHS, strict=False), names))


@query
def ar1_kendall_bounded(spark, folder):
    panel = inputs.hourly_panel(spark, folder)
    names = ("n", "total", "mean")
    return rounded(ar1_table(fit_ar1(panel, names, HOURS, bound=0.05, strict=False), names))


@query
def ar1_innovations(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    names = ("dp", "ltr")
    return rounded(ar1_residuals(panel, fit_ar1(panel, names, MONTHS, strict=False), names, MONTHS))


def _twin_rows(spark, folder):
    """Formula-based forecasts of planted worlds: a lagged world return and the truth."""
    panel = frames.supplier_standardized(spark, folder).select("series_id", "t", "dp", "ltr", "dfr")
    worlds = plant_signal(
        panel, inputs.shocks_for(panel), {"easy": 0.20, "realistic": 0.02}, MONTHS, calibration=24
    )
    return worlds.withColumn("forecast", F.lit(0.8) * F.col("y") + F.lit(0.3) * F.col("dfr") * F.col("truth"))


@query
def twin_worlds(spark, folder):
    return rounded(_twin_rows(spark, folder).select("series_id", "t", "strength", "market", "truth", "planted", "y"))


@query
def recovery_statistics(spark, folder):
    pairs = pair_worlds(_twin_rows(spark, folder), ["series_id", "strength", "t"])
    return rounded(recovery(pairs, ["series_id", "strength"], strict=False))


@query
def twin_paths(spark, folder):
    pairs = pair_worlds(_twin_rows(spark, folder), ["series_id", "strength", "t"])
    return rounded(pairs.groupBy("strength", "t").agg(F.avg("truth").alias("truth"), F.avg("recovered").alias("recovered")))


# --- windows -----------------------------------------------------------------------


@query
def trailing_volatility(spark, folder):
    v = windows.trailing_uncentered_vol(inputs.supplier_panel(spark, folder), "y", MONTHS)
    return rounded(v.select("series_id", "t", "vol"))


@query
def trailing_volatility_hourly(spark, folder):
    v = windows.trailing_uncentered_vol(inputs.hourly_panel(spark, folder), "total", TimeAxis(block=100), 24)
    return rounded(v.select("series_id", "t", "vol"))


@query
def expanding_volatility(spark, folder):
    v = windows.expanding_vol(inputs.supplier_panel(spark, folder), {"sd_dp": "dp", "sd_ltr": "ltr"}, MONTHS)
    return rounded(v.select("series_id", "t", "sd_dp", "sd_ltr"))


@query
def expanding_volatility_hourly(spark, folder):
    v = windows.expanding_vol(inputs.hourly_panel(spark, folder), {"sd": "mean"}, TimeAxis(block=100), 48)
    return rounded(v.select("series_id", "t", "sd"))


@query
def standardized_inputs(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    scaled = standardize_columns(panel, "y", SUPPLIER_PREDICTORS, MONTHS, own_lag="own_lag")
    return rounded(with_valid(scaled, "y", SUPPLIER_PREDICTORS))


@query
def standardized_market(spark, folder):
    return rounded(frames.market_standardized(spark, folder))


@query
def standardized_hourly(spark, folder):
    panel = inputs.hourly_panel(spark, folder).select("series_id", "t", F.col("total").alias("y"), "n", "mean")
    return rounded(standardize_panel(panel, "y", ("n", "mean"), HOURS, window=24, min_periods=48, check=False))


@query
def contiguity_gaps(spark, folder):
    gaps = guards.gap_rows(inputs.hourly_cells(spark, folder), KEYS, "t")
    return gaps.select("series_id", "t")


@query
def series_health(spark, folder):
    health = guards.series_health(inputs.nation_months(spark, folder), KEYS, "t", ["value"])
    return health.withColumn("n_non_finite", F.col("n_non_finite").cast("long"))


@query
def non_finite_series(spark, folder):
    """Months without lines have no logarithm: their series are told apart from those that are only short."""
    source = inputs.supplier_source(spark, folder)
    logs = source.withColumn("log_rev", F.when(F.col("rev") > 0, F.log("rev")).otherwise(F.lit(float("-inf"))))
    found = guards.rejects(guards.series_health(logs, KEYS, "t", ["log_rev"]), min_rows=80)
    return found.withColumn("n_non_finite", F.col("n_non_finite").cast("long"))


@query
def rejected_series(spark, folder):
    good, bad = guards.split_healthy(inputs.nation_months(spark, folder), KEYS, "t", ["value"], min_rows=80)
    good = good.groupBy("series_id").agg(F.count("*").alias("n_rows")).withColumn("reason", F.lit("usable"))
    return good.unionByName(bad.select("series_id", "n_rows", "reason"))


@query
def dense_positions(spark, folder):
    cells = inputs.hourly_cells(spark, folder).withColumnRenamed("t", "hour")
    return dense_ordinal(cells, TimeAxis(), "hour", 100).select("series_id", "hour", "t")


@query
def weighted_momentum(spark, folder):
    return rounded(windows.momentum(inputs.supplier_panel(spark, folder), "y", MONTHS))


@query
def weighted_momentum_custom(spark, folder):
    panel = inputs.hourly_panel(spark, folder)
    return rounded(windows.momentum(panel, "n", HOURS, window=3, weights=(0.5, 0.3, 0.2)))


@query
def volatility_timed_momentum(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    return rounded(windows.volatility_timed_momentum(panel, "y", SUPPLIER_PREDICTORS, MONTHS))


@query
def moving_average_reversal(spark, folder):
    panel = inputs.supplier_panel(spark, folder).select("series_id", "t", "y")
    return rounded(windows.add_reversal(panel, "y", inputs.shocks_for(panel), MONTHS, name="y_reversed"))


@query
def reversal_inputs(spark, folder):
    """The reversal enters the raw return of the full series, own lag included, and the
    panel is standardized afterwards; the target stays raw."""
    raw = inputs.supplier_panel(spark, folder)
    out = prepare_inputs(
        raw, CounterfactualConfig(), "y", SUPPLIER_PREDICTORS, "own_lag", sample_end(spark, folder), MONTHS,
        shocks=inputs.shocks_for(raw), check=False,
    ).reversal.withColumnRenamed("y", "raw_y")
    return rounded(out.select("series_id", "t", "raw_y", *SUPPLIER_PREDICTORS))


@query
def training_window_scaling(spark, folder):
    features = _native_features(spark, folder)
    return rounded(scale_by_training_window(features, ["s1", "s2"], MONTHS).select("series_id", "t", "s1", "s2"))


@query
def training_window_scaling_uncentered(spark, folder):
    features = _native_features(spark, folder)
    scaled = scale_by_training_window(features, ["s1", "s2"], MONTHS, uncentered=True)
    return rounded(scaled.select("series_id", "t", "s1", "s2"))


def _native_features(spark, folder):
    panel = frames.supplier_standardized(spark, folder)
    return panel.withColumns(feature_columns(SUPPLIER_PREDICTORS, 0, 2))


# --- models ------------------------------------------------------------------------


@query
def rff_weight_table(spark, folder):
    """Weights for as many predictors as the panel has, per series seed."""
    series = inputs.supplier_panel(spark, folder).groupBy("series_id").agg(F.count("*").alias("n_rows"))
    weights = rff_weights(spark, range(3), 4, len(SUPPLIER_PREDICTORS))
    summed = weights.groupBy("seed").agg(F.sum("weight").alias("total"), F.count("*").alias("n_weights"))
    tagged = series.withColumn("seed", F.pmod(F.col("series_id").cast("long"), F.lit(3)))
    return rounded(tagged.join(F.broadcast(summed), "seed"))


@query
def fourier_features_native(spark, folder):
    panel = frames.supplier_standardized(spark, folder)
    columns = feature_columns(SUPPLIER_PREDICTORS, 1, 4)
    return rounded(panel.withColumns(columns).select("series_id", "t", *columns))


@query
def fourier_features_wide(spark, folder):
    panel = frames.supplier_standardized(spark, folder)
    arrays = panel.select("series_id", "t", F.array(*SUPPLIER_PREDICTORS).alias("x"))
    wide = rff_features(arrays, "x", seed=1, p=64)
    return rounded(wide.select("series_id", "t", F.posexplode("features").alias("k", "feature")))


@query
def ridge_forecasts(spark, folder):
    study = frames.supplier_study(spark, folder)
    return rounded(study.forecasts, 5)


@query
def uncentered_ridge_forecasts(spark, folder):
    config = SMALL_GRID.with_(uncentered=True, z_grid=(1.0,))
    return rounded(frames.supplier_study(spark, folder, config).forecasts, 5)


@query
def ridgeless_forecasts(spark, folder):
    config = SMALL_GRID.with_(z_grid=(), ridgeless=True)
    return rounded(frames.market_study(spark, folder, config).forecasts, 4)


@query
def market_grid_per_seed(spark, folder):
    return rounded(frames.market_study(spark, folder).per_seed, 5)


@query
def market_grid(spark, folder):
    return rounded(frames.market_study(spark, folder).averaged, 5)


@query
def supplier_grid_per_seed(spark, folder):
    return rounded(frames.supplier_study(spark, folder).per_seed, 5)


@query
def supplier_grid(spark, folder):
    return rounded(frames.supplier_study(spark, folder).averaged, 5)


@query
def forecast_export(spark, folder):
    return rounded(frames.market_study(spark, folder).export(), 5)


@query
def anchor_export(spark, folder):
    """Only the largest model of the grid, heavily shrunk and minimum norm."""
    panel = frames.supplier_standardized(spark, folder)
    study = anchor_study(
        panel, SMALL_GRID, "y", SUPPLIER_PREDICTORS, date="date", p=2, z=1000.0, on_bad_series="trust"
    )
    return rounded(study.export(), 4)


@query
def target_grid(spark, folder):
    return rounded(frames.target_study(spark, folder).averaged, 5)


@query
def predictor_importance(spark, folder):
    vi = scoring.importance(frames.importance_study(spark, folder).per_seed)
    return rounded(vi, 5)


@query
def importance_leaders(spark, folder):
    per_seed = frames.importance_study(spark, folder).per_seed
    pooled = per_seed.groupBy("excluded", "seed").agg(F.avg("r2").alias("r2"), F.avg("sharpe").alias("sharpe"))
    vi = scoring.importance(pooled.withColumn("series_id", F.lit("all")))
    return rounded(scoring.leaders(vi, 3).select("variable", "vi_r2", "vi_sharpe", "n_seeds"), 5)


@query
def wide_forecasts(spark, folder):
    """Ridge and minimum-norm models far beyond the training window, on both sides of the kernel's switch."""
    return rounded(frames.supplier_study(spark, folder, WIDE_GRID).forecasts, 2)


@query
def wide_grid(spark, folder):
    """Two training rows forecast wildly, so the R2 is shown on a compressed scale."""
    means = frames.supplier_study(spark, folder, WIDE_GRID).averaged
    return rounded(means.withColumn("r2_asinh", F.asinh("r2")).drop("r2", "beta_norm"), 3)


@query
def default_grid(spark, folder):
    """The default complexities and shrinkages on the market panel."""
    return rounded(frames.market_study(spark, folder, market_config(seeds=(0, 1))).averaged, 5)


@query
def default_anchor(spark, folder):
    """The export of the largest model, heavily shrunk and minimum norm, at its default size."""
    return rounded(frames.market_study(spark, folder, anchor_config(seeds=(0, 1))).export(), 5)


@query
def default_importance(spark, folder):
    """Leave-one-out at the default complexity and shrinkage, over all market predictors."""
    panel = frames.market_standardized(spark, folder)
    study = leave_one_out(panel, importance_config(seeds=(0,)), TARGET, PREDICTORS, date="date", strict=False)
    return rounded(scoring.importance(study.per_seed), 5)


@query
def default_targets(spark, folder):
    return rounded(frames.target_study(spark, folder, target_config(seeds=(0,))).averaged, 5)


@query
def ridgeless_wide(spark, folder):
    config = WIDE_GRID.with_(z_grid=(), p_grid=(48, 600), seeds=(3,))
    return rounded(frames.market_study(spark, folder, config).forecasts, 4)


@query
def full_complexity_grid(spark, folder):
    """A grid far beyond the training window, minimum norm included."""
    config = StudyConfig(p_grid=(2, 12, 48, 192, 600), seeds=(0, 1), seeds_per_task=1)
    return rounded(frames.supplier_study(spark, folder, config).averaged, 5)


@query
def hourly_grid(spark, folder):
    """Hourly series cut into chunks, as long series are."""
    panel = inputs.hourly_panel(spark, folder).select("series_id", "t", F.col("total").alias("y"), "n", "mean")
    std = standardize_panel(panel, "y", ("n", "mean"), HOURS, window=24, min_periods=48)
    arrays = to_arrays(std, "y", ("n", "mean"), ("series_id", "t"))
    forecasts = rolling_forecasts(arrays, SMALL_GRID.with_(window=24, chunk=64, z_grid=(1.0,)), HOURS)
    return rounded(scoring.score(forecasts, CELL, beta_norm="beta_norm", strict=False), 5)


@query
def anchor_selection(spark, folder):
    per_seed = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    means = scoring.average_statistics(per_seed, ["series_id", "P", "z"])
    return rounded(scoring.anchor_rows(means, by=["series_id"]).select("series_id", "P", "z", "sharpe", "alpha_tstat"))


@query
def ridge_panel_rows(spark, folder):
    means = frames.target_study(spark, folder, SMALL_GRID.with_(ridgeless=True)).averaged
    return rounded(reports.ridge_rows(means, ("target", "P", "z", "c", "r2", "sharpe")), 5)


@query
def grid_panel_rows(spark, folder):
    per_seed = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    means = scoring.average_statistics(
        per_seed.withColumn("c", complexity(F.col("P"), 12)), ["series_id", "P", "z"]
    ).withColumnRenamed("series_id", "target")
    return rounded(reports.panel_rows(means))


@query
def distinct_levels(spark, folder):
    return frames.naive_forecasts(spark, folder).select("z", "P").distinct()


@query
def sorted_paths(spark, folder):
    anchor = scoring.anchor_by_seed(frames.naive_forecasts(spark, folder))
    return rounded(anchor.select("seed", "obs", "series_id", "forecast").orderBy("seed", "obs", "series_id"))


@query
def union_of_studies(spark, folder):
    market = inputs.flag_source(spark, folder).select("series_id", "date", F.col("ret").alias("value"))
    orders = inputs.index_returns(spark, folder).select(
        F.lit("orders").alias("series_id"), "date", F.col("vwretd").alias("value")
    )
    return rounded(market.unionByName(orders).na.drop())


@query
def bootstrap_panel(spark, folder):
    panel = inputs.supplier_panel(spark, folder)
    names = ("dp", "ltr", "dfr")
    boot = wild_bootstrap(panel, names, seeds=(0, 1), axis=MONTHS, base_seed=2909)
    return rounded(
        boot.select("series_id", "seed", "t", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    )


@query
def bootstrap_innovation_sizes(spark, folder):
    """Sizes of the artificial innovations, which equal the fitted residuals' sizes."""
    panel = inputs.supplier_panel(spark, folder)
    fits = fit_ar1(panel, ("dp",), MONTHS, strict=False)
    boot = wild_bootstrap(panel, ("dp",), seeds=(3,), axis=MONTHS).select(
        "series_id", "t", F.col("x")[0].alias("dp")
    )
    return rounded(
        ar1_residuals(boot, fits, ("dp",), MONTHS).select("series_id", "t", F.abs("dp").alias("size"))
    )


@query
def counterfactual_table(spark, folder):
    result = run_counterfactuals(**_counterfactual_inputs(spark, folder))
    return rounded(result.counterfactuals, 5)


@query
def counterfactual_spanning(spark, folder):
    return rounded(run_counterfactuals(**_counterfactual_inputs(spark, folder)).counterfactual_spanning, 5)


@query
def twin_recovery_table(spark, folder):
    return rounded(run_counterfactuals(**_counterfactual_inputs(spark, folder), results=["twin_recovery"]).twin_recovery, 5)


@query
def twin_spanning_table(spark, folder):
    return rounded(run_counterfactuals(**_counterfactual_inputs(spark, folder), results=["twin_spanning"]).twin_spanning, 5)


@query
def twin_recovery_paths(spark, folder):
    return rounded(run_counterfactuals(**_counterfactual_inputs(spark, folder), results=["twin_paths"]).twin_paths, 5)


def _counterfactual_inputs(spark, folder):
    panel = materialize(inputs.supplier_panel(spark, folder))  # read for the shocks, both designs and their raw target
    shocks = inputs.shocks_for(panel)
    return dict(
        tidy=panel,
        config=CounterfactualConfig(anchor_p=64, n_seeds=2, calibration=24),
        target="y",
        predictors=SUPPLIER_PREDICTORS,
        own_lag="own_lag",
        sample_end=sample_end(spark, folder),
        axis=MONTHS,
        reversal_shocks=shocks,
        twin_shocks=shocks,
    )


def _two_feature_study(spark, folder, *results):
    """The fixed designs at two features on formula shocks, where SQL has the answer."""
    arguments = _counterfactual_inputs(spark, folder)
    arguments["config"] = CounterfactualConfig(anchor_p=2, n_seeds=2, calibration=24)
    return run_counterfactuals(**arguments, bootstrap=False, **({"results": results} if results else {}))


@query
def reversal_designs(spark, folder):
    rows = _two_feature_study(spark, folder).counterfactuals
    return rounded(rows.select("series_id", "experiment", "strategy", *STATS, "n_seeds"), 4)


@query
def reversal_design_spanning(spark, folder):
    rows = _two_feature_study(spark, folder).counterfactual_spanning
    return rounded(rows.select("series_id", "experiment", *SPAN, "n_seeds"), 4)


def _bootstrap_study(spark, folder):
    rows = run_counterfactuals(**{
        **_counterfactual_inputs(spark, folder), "config": CounterfactualConfig(anchor_p=2, n_seeds=2, calibration=24),
    }, experiments=["wild_bootstrap"])
    return rows.counterfactuals, rows.counterfactual_spanning


@query
def bootstrap_design(spark, folder):
    """Each seed's model on the predictors drawn for it, at two features, where SQL has the answer."""
    rows = _bootstrap_study(spark, folder)[0].where("experiment = 'wild_bootstrap'")
    return rounded(rows.select("series_id", "experiment", "strategy", *STATS, "n_seeds"), 4)


@query
def bootstrap_design_spanning(spark, folder):
    rows = _bootstrap_study(spark, folder)[1].where("experiment = 'wild_bootstrap'")
    return rounded(rows.select("series_id", "experiment", *SPAN, "n_seeds"), 4)


@query
def twin_design_recovery(spark, folder):
    rows = _two_feature_study(spark, folder, "twin_recovery").twin_recovery
    names = ("correlation", "intercept", "slope", "rmse", "nrmse", "bias")
    return rounded(rows.select("series_id", "predictor_set", "strength", *names, "n_seeds"), 4)


@query
def twin_design_spanning(spark, folder):
    rows = _two_feature_study(spark, folder, "twin_spanning").twin_spanning
    market = ("sharpe", "market_alpha", "market_alpha_tstat", "market_information_ratio")
    return rounded(rows.select("series_id", "predictor_set", "strength", "market", *market, *SPAN, "n_seeds"), 4)


@query
def twin_design_paths(spark, folder):
    rows = _two_feature_study(spark, folder, "twin_paths").twin_paths
    return rounded(
        rows.select("series_id", "predictor_set", "strength", "signal_r2", "oos_index", "obs", "truth", "recovered", "n_seeds"), 4
    )


@query
def study_diagnostics(spark, folder):
    return rounded(_diagnostics(spark, folder).metrics, 4)


@query
def study_anatomy(spark, folder):
    return rounded(_diagnostics(spark, folder).anatomy, 5)


@query
def study_spanning(spark, folder):
    """Without the twelve-lag projection, which ``study_anatomy`` holds."""
    return rounded(_diagnostics(spark, folder).spanning.drop("anatomy_r2", "anatomy_intercept"), 4)


def _diagnostics(spark, folder):
    panel = frames.supplier_standardized(spark, folder)
    config = SMALL_GRID.with_(z_grid=(10.0,), ridgeless=True)
    study = frames.supplier_study(spark, folder, config)
    export = materialize(study.export())  # diagnostics read a stored export several times
    return diagnostics(export, panel, "y", SUPPLIER_PREDICTORS, MONTHS, check=False)


# --- reports -----------------------------------------------------------------------


@query
def report_values(spark, folder):
    per_seed = scoring.score(frames.naive_forecasts(spark, folder), CELL, strict=False)
    means = materialize(scoring.average_statistics(per_seed, ["P", "z"]))
    last = F.last_day(F.to_date(F.lit(sample_end(spark, folder)), "yyyy-MM"))
    months = inputs.supplier_panel(spark, folder).groupBy("t", "date").agg(F.count("*").alias("n"))
    sizes = materialize(
        months.agg(
            F.count("*").cast("double").alias("months"),
            F.sum(F.when(F.col("date") <= last, F.col("n"))).cast("double").alias("rows"),
        )
    )
    return reports.key_values(
        [
            reports.value_row(scoring.anchor_rows(means), "MktSharpe", "sharpe", 2),
            reports.value_row(scoring.anchor_rows(means, z=10.0), "MktBestSharpe", "sharpe", 2),
            reports.value_row(scoring.anchor_rows(means), "MktAlphaT", "alpha_tstat", 2),
            reports.value_row(sizes, "Months", "months", 0),
            reports.value_row(sizes, "PanelRows", "rows", 0),
        ]
    )


@query
def comparison_panel(spark, folder):
    stats, span = _experiment_frames(spark, folder)
    return rounded(reports.counterfactual_panel(stats, span))


@query
def recovery_display(spark, folder):
    pairs = pair_worlds(_twin_rows(spark, folder), ["series_id", "strength", "t"]).withColumn(
        "predictor_set", F.lit("x14_shared")
    )
    stats = recovery(pairs, ["predictor_set", "strength", "series_id"], strict=False)
    means = scoring.average_statistics(stats, ["predictor_set", "strength"], drop=())
    return rounded(reports.recovery_panel(means))


@query
def twin_spanning_display(spark, folder):
    spanned = _two_feature_study(spark, folder, "twin_spanning").twin_spanning
    means = scoring.average_statistics(
        spanned.select("predictor_set", "strength", "market", *SPAN), ["predictor_set", "strength", "market"], drop=()
    )
    return rounded(reports.twin_spanning_panel(means), 4)


@query
def metrics_display(spark, folder):
    metrics = _diagnostics(spark, folder).metrics
    means = scoring.average_statistics(metrics, ["strategy"], drop=("n_seeds",))
    return rounded(reports.metrics_panel(means), 4)


def _experiment_frames(spark, folder):
    """Per-experiment statistics by formula: three cells stand for the designs."""
    names = {0: "historical", 1: "ma2_reversal", 2: "wild_bootstrap"}
    rows = _naive_with_benchmark(spark, folder).where((F.col("P") == 12) & (F.col("z") == 0.0))
    rows = rows.withColumn(
        "experiment", F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("seed").cast("int"))
    )
    model = scoring.score(rows, ["experiment", "series_id"], strict=False).withColumn("strategy", F.lit("RFF"))
    bench = scoring.score(
        rows.withColumn("forecast", F.col("benchmark_forecast")), ["experiment", "series_id"], strict=False
    ).withColumn("strategy", F.lit("Volatility-timed momentum"))
    stats = scoring.average_statistics(model.unionByName(bench), ["experiment", "strategy"], drop=())
    span = scoring.average_statistics(spanning(rows, ["experiment", "series_id"]), ["experiment"], drop=())
    return stats, span
