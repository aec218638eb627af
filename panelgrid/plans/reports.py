"""Report frames: the numbers behind tables, charts and prose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelgrid.functions.columns import decimals, label
from panelgrid.operators.blocks import MONTHS, TimeAxis, dense_ordinal, over_time
from panelgrid.operators.windows import lagged

# Names shown in reports.
EXPERIMENT_NAMES = {
    "historical": "Historical",
    "ma2_reversal": "MA(2) reversal",
    "wild_bootstrap": "Wild predictors",
}
INPUT_NAMES = {"x14_shared": "14 shared inputs", "x15_world_lag": "15 world inputs"}
SHORT_INPUT_NAMES = {"x14_shared": "14 shared", "x15_world_lag": "15 world"}
WORLD_NAMES = {"plus": "+", "minus": "-"}
SERIES_NAMES = {"mkt_excess": "mkt excess", "bm": "b/m", "lag_mkt_excess": "lag mkt"}
MODEL, BENCHMARK = "RFF", "Volatility-timed momentum"


def with_metadata(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Append the settings of a run as constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def summary_panel(
    panel: DataFrame, columns: Sequence[str], axis: TimeAxis = TimeAxis(), names: Mapping[str, str] | None = None
) -> DataFrame:
    """Count, mean, SD, extremes and first autocorrelation of each column of a series.

    Missing cells are dropped per column before the autocorrelation pairs neighbours,
    so a pair may straddle a hole; the columns are unpivoted and read once.
    """
    keys = list(axis.keys)
    long = panel.unpivot([*keys, axis.t], list(columns), "variable", "x").where(F.col("x").isNotNull())
    keyed = axis.with_keys("variable")
    if axis.block is not None:  # neighbours are those left after the drop, whatever block they are in
        long = dense_ordinal(long, keyed, axis.t, axis.block)
    paired = over_time(long, keyed, {"_before": lagged("x")}, lookback=1)
    # the autocorrelation uses complete pairs only
    pair_x = F.when(F.col("_before").isNotNull(), F.col("x"))
    stats = paired.groupBy(*keyed.keys).agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.covar_pop(pair_x, F.col("_before")).alias("_c"),
        F.stddev_pop(pair_x).alias("_s"),
        F.stddev_pop("_before").alias("_sb"),
    )
    shown = label(F.col("variable"), dict(names)) if names else F.col("variable")
    return stats.select(
        *keys,
        shown.alias("variable"),
        "count",
        "mean",
        "sd",
        "min",
        "max",
        F.try_divide("_c", F.col("_s") * F.col("_sb")).alias("ac1"),
    )


def summary_table(raw: DataFrame, standardized: DataFrame, columns: Sequence[str], axis: TimeAxis = MONTHS, date: str = "date") -> DataFrame:
    """The raw and the standardized panel side by side, each with its span."""
    parts = []
    for name, df in (("raw", raw), ("standardized", standardized)):
        span = df.groupBy(*axis.keys).agg(F.min(date).alias("first"), F.max(date).alias("last"))
        stats = summary_panel(df, columns, axis, SERIES_NAMES)
        parts.append(stats.join(span, list(axis.keys)).withColumn("panel", F.lit(name)))
    return parts[0].unionByName(parts[1])


def ridge_rows(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the shrunk models only, for charts that leave the minimum norm out."""
    return grid.where(F.col("z") > 0).select(*columns).orderBy("z", "c")


def panel_rows(grid: DataFrame) -> DataFrame:
    """All rows of a target study in chart order."""
    return grid.select("target", "P", "z", "c", "r2", "sharpe").orderBy("target", "z", "c")


def value_row(df: DataFrame, name: str, column: str, places: int, scale: float = 1.0) -> DataFrame:
    """One named number of a one-row frame, as value and printed text."""
    value = F.col(column).cast("double") * F.lit(float(scale))
    return df.select(F.lit(name).alias("name"), F.round(value, 6).alias("value"), decimals(value, places).alias("text"))


def key_values(rows: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rows)


def report_rows(
    grids: Mapping[str, DataFrame],
    importance: DataFrame,
    diagnostics: tuple[DataFrame, DataFrame],
    counterfactuals: tuple[DataFrame, DataFrame],
    twins: tuple[DataFrame, DataFrame],
) -> DataFrame:
    """Every number quoted in prose, as ``(name, value, text)`` rows; a name is its path, joined by dots.

    ``grids`` maps a name to an averaged grid. The numbers come from one pass
    over each small result table: rows are turned into names by expression and the
    wanted columns are unpivoted.
    """
    from panelgrid.operators.scoring import anchor_rows, leaders

    def named(df: DataFrame, name, columns: Sequence[str], places: int = 2) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.concat_ws(".", name, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
        return df.select(F.explode(pairs).alias("_p")).select(
            "_p.name", "_p.value", decimals(F.col("_p.value"), places).alias("text")
        )

    metrics, spanning = diagnostics
    stats, span = counterfactuals
    recovered, twin_span = twins
    part = lambda *columns: F.concat_ws(".", *columns)
    design = part(F.lit("design"), F.col("experiment"))
    twin = part(F.lit("twin"), F.col("strength"), F.col("predictor_set"))
    rows = [
        named(anchor_rows(grid), part(F.lit("grid"), F.lit(prefix)), ("sharpe", "information_ratio", "alpha_tstat"))
        for prefix, grid in grids.items()
    ]
    rows += [
        named(leaders(importance, 1).withColumn("vi_percent", 100 * F.col("vi_r2")), F.lit("importance.first"), ("vi_percent",), 1),
        named(metrics, part(F.lit("strategy"), F.col("strategy")), ("sharpe",)),
        named(spanning, F.lit("diagnostics"), ("alpha_tstat", "anatomy_r2")),
        named(stats.where(F.col("strategy") == MODEL), design, ("information_ratio", "alpha_tstat")),
        named(span, part(design, F.lit("spanned")), ("information_ratio", "alpha_tstat")),
        named(stats.agg(F.max("n_seeds").alias("n_seeds")), F.lit("design"), ("n_seeds",), 0),
        named(recovered, twin, ("correlation", "slope", "nrmse")),
        named(twin_span, part(twin, F.col("market")), ("alpha_tstat",)),
    ]
    return key_values(rows)


def metrics_panel(metrics: DataFrame) -> DataFrame:
    """The standardized-target comparison: one row per strategy."""
    return metrics.select("strategy", "sharpe", "alpha", "information_ratio", "alpha_tstat", "r2")


def counterfactual_panel(stats: DataFrame, span: DataFrame) -> DataFrame:
    """One row per experiment: model and benchmark statistics next to the spanned ones.

    The two strategies are folded into columns by conditional aggregation.
    """
    pick = lambda strategy, c: F.max(F.when(F.col("strategy") == strategy, F.col(c)))
    folded = stats.groupBy("experiment").agg(
        pick(MODEL, "information_ratio").alias("rff_ir"),
        pick(MODEL, "alpha_tstat").alias("rff_alpha_t"),
        pick(BENCHMARK, "information_ratio").alias("benchmark_ir"),
        pick(BENCHMARK, "alpha_tstat").alias("benchmark_alpha_t"),
    )
    spanned = span.select(
        "experiment",
        F.col("information_ratio").alias("spanned_ir"),
        F.col("alpha_tstat").alias("spanned_alpha_t"),
    )
    return folded.join(spanned, "experiment").withColumn(
        "experiment", label(F.col("experiment"), EXPERIMENT_NAMES)
    )


def recovery_panel(recovered: DataFrame) -> DataFrame:
    return recovered.select(
        label(F.col("predictor_set"), INPUT_NAMES).alias("inputs"),
        F.col("strength").alias("signal"),
        "correlation",
        "slope",
        "nrmse",
    )


def twin_spanning_panel(twin_span: DataFrame) -> DataFrame:
    return twin_span.select(
        label(F.col("predictor_set"), SHORT_INPUT_NAMES).alias("inputs"),
        F.col("strength").alias("signal"),
        label(F.col("market"), WORLD_NAMES).alias("twin"),
        "alpha_tstat",
        "information_ratio",
        "beta_benchmark",
    )
