"""Least-squares diagnostics from mergeable moments and triangular factors, one pass per fit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelgrid.operators.blocks import TimeAxis, over_time
from panelgrid.operators.triangles import COUNT, MEAN, combined, entry, least_squares, summaries
from panelgrid.operators.windows import lagged

FLAT = 1e-12  # fixed value: a truth path this flat cannot be recovered


def _required(condition: Column, value: Column, message: str, strict: bool) -> Column:
    if not strict:
        return F.when(condition, value)
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def spanning(
    rows: DataFrame,
    keys: Sequence[str],
    strategy: str = "strategy",
    benchmark: str = "benchmark",
    market: str = "realized",
    periods: int = 12,
) -> DataFrame:
    """Regress a payoff on an intercept, a benchmark payoff and the market.

    One pass by triangular factors. Where benchmark and market are collinear or constant the coefficients are those of
    least length and the standard error comes from the pseudo-inverse. A payoff that is spanned exactly has no
    t-statistic and no information ratio.
    """
    named = {"_b": benchmark, "_m": market, "_y": strategy}
    parts = summaries(rows.select(*keys, *[F.col(c).alias(k) for k, c in named.items()]), keys, list(named))
    return spanning_summaries(parts, keys, periods)


def spanning_summaries(
    parts: DataFrame, keys: Sequence[str], periods: int = 12, pick: Sequence[int] | None = None
) -> DataFrame:
    """``spanning`` from summaries that tasks have made; ``pick`` says where (benchmark, market, payoff) are in them."""
    names = ("alpha", "beta_benchmark", "beta_market", "alpha_tstat", "information_ratio", "resid_std")
    root = float(np.sqrt(periods))

    def finish(n: np.ndarray, mean: np.ndarray, factor: np.ndarray) -> dict:
        level, slopes, corner, left = least_squares(n, mean, factor)
        empty = n == 0
        over = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
        spread = np.sqrt(over(left, n.astype(float)))
        se = np.sqrt(over(left, np.maximum(n - 3, 0).astype(float)) * corner)
        values = (level, slopes[:, 0], slopes[:, 1], over(level, se), over(root * level, spread), spread)
        return {k: np.where(empty, np.nan, v) for k, v in zip(names, values)}

    return combined(parts, keys, finish, [T.StructField(c, T.DoubleType()) for c in names], pick)


def forecast_anatomy(
    forecasts: DataFrame,
    panel: DataFrame,
    target: str,
    axis: TimeAxis = TimeAxis(),
    window: int = 12,
    by: Sequence[str] = (),
) -> DataFrame:
    """Project forecasts on an intercept and the last ``window`` returns.

    One row per group: ``intercept``, ``lag_weights`` (newest first), ``r2``. Tasks reduce a group to its triangular
    factor; lags that repeat each other get the weights of least length. A forecast that does not vary has no ``r2``.
    """
    keys = [*axis.keys, *by]
    lags = [f"_x{k}" for k in range(window)]
    trailing = over_time(
        panel.select(*axis.keys, axis.t, target), axis, {x: lagged(target, k) for k, x in enumerate(lags)}, window
    ).select(*axis.keys, axis.t, *lags).where(F.col(lags[-1]).isNotNull())
    rows = forecasts.select(*keys, axis.t, "forecast").join(trailing, [*axis.keys, axis.t])

    def finish(n: np.ndarray, mean: np.ndarray, factor: np.ndarray) -> dict:
        level, slopes, _, left = least_squares(n, mean, factor)
        total = (factor[:, :, -1] ** 2).sum(axis=1)
        fit = 1.0 - np.divide(left, total, out=np.full(len(n), np.nan), where=total > 0)
        return {"intercept": level, "lag_weights": pa.array(list(slopes), pa.list_(pa.float64())), "r2": fit}

    fields = [
        T.StructField("intercept", T.DoubleType()),
        T.StructField("lag_weights", T.ArrayType(T.DoubleType())),
        T.StructField("r2", T.DoubleType()),
    ]
    return combined(summaries(rows, keys, [*lags, "forecast"]), keys, finish, fields)


def fit_ar1(
    panel: DataFrame,
    columns: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    bias_adjust: bool = True,
    bound: float | None = None,
    strict: bool = True,
) -> DataFrame:
    """Intercept AR(1) of every column with a small-sample correction of the slope.

    One row per series: ``t_min``, ``n`` and, per column in order, the arrays ``phi``,
    ``intercept``, ``phi_ols``, ``intercept_ols``. The corrected intercept keeps the
    mean of the series. See ``ar1_table`` for one row per column.
    """
    if bound is not None and not 0 < bound <= 1:
        raise ValueError(f"{bound} does not bound a persistence")
    prior = over_time(
        panel.select(*axis.keys, axis.t, *columns), axis, {f"_l_{c}": lagged(c) for c in columns}, lookback=1
    )
    fits = prior.groupBy(*axis.keys).agg(
        F.min(axis.t).alias("t_min"),
        F.count("*").alias("n"),
        F.array(*[F.regr_slope(c, f"_l_{c}") for c in columns]).alias("phi_ols"),
        F.array(*[F.regr_intercept(c, f"_l_{c}") for c in columns]).alias("intercept_ols"),
        F.array(*[F.avg(c) for c in columns]).alias("_mean"),
    )
    n = _required(F.col("n") >= 5, F.col("n"), "an AR(1) fit needs at least five rows", strict)
    fits = fits.withColumn("n", n)

    def corrected(phi: Column) -> Column:
        out = phi + (1 + 3 * phi) / (F.col("n") - 1) if bias_adjust else phi
        return F.greatest(F.least(out, F.lit(float(bound))), F.lit(-float(bound))) if bound is not None else out

    return (
        fits.withColumn("phi", F.transform("phi_ols", corrected))
        .withColumn("intercept", F.zip_with("phi", "_mean", lambda p, m: (1 - p) * m))
        .select(*axis.keys, "t_min", "n", "phi", "intercept", "phi_ols", "intercept_ols")
    )


def ar1_table(fits: DataFrame, columns: Sequence[str], axis: TimeAxis = TimeAxis()) -> DataFrame:
    """``fit_ar1`` as one row per series and column."""
    parts = ("phi", "intercept", "phi_ols", "intercept_ols")
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("predictor"), *parts)
    rows = fits.select(*axis.keys, "n", F.explode(zipped).alias("_r"))
    return rows.select(*axis.keys, F.col("_r.predictor").alias("predictor"), "n", *[F.col(f"_r.{p}").alias(p) for p in parts])


def ar1_residuals(panel: DataFrame, fits: DataFrame, columns: Sequence[str], axis: TimeAxis = TimeAxis()) -> DataFrame:
    """Residuals of the corrected fits, one column per predictor, first row dropped."""
    prior = over_time(
        panel.select(*axis.keys, axis.t, *columns), axis, {f"_l_{c}": lagged(c) for c in columns}, lookback=1
    )
    joined = prior.join(fits, list(axis.keys)).where(F.col(axis.t) > F.col("t_min"))
    return joined.select(
        *axis.keys,
        axis.t,
        *[
            (F.col(c) - F.col("intercept")[i] - F.col("phi")[i] * F.col(f"_l_{c}")).alias(c)
            for i, c in enumerate(columns)
        ],
    )


def recovery(rows: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Score ``recovered`` against ``truth``: both columns, grouped by ``keys``."""
    r, x = F.col("recovered"), F.col("truth")
    err = r - x
    mo = rows.groupBy(*keys).agg(
        F.count(err).alias("_n"),
        F.avg(r).alias("_mr"),
        F.avg(x).alias("_mx"),
        F.var_pop(r).alias("_vr"),
        F.var_pop(x).alias("_vx"),
        F.covar_pop(r, x).alias("_c"),
        F.avg(err * err).alias("_mse"),
        F.avg(err).alias("bias"),
    )
    ok = (F.col("_n") >= 3) & (F.sqrt("_vx") > FLAT)
    slope = F.try_divide("_c", F.col("_vx"))
    return mo.select(
        *keys,
        _required(
            ok,
            F.try_divide("_c", F.sqrt("_vr") * F.sqrt("_vx")),
            "recovery needs three rows and a truth that varies",
            strict,
        ).alias("correlation"),
        (F.col("_mr") - slope * F.col("_mx")).alias("intercept"),
        slope.alias("slope"),
        F.sqrt("_mse").alias("rmse"),
        F.try_divide(F.sqrt("_mse"), F.sqrt("_vx")).alias("nrmse"),
        "bias",
    )


def recovery_summaries(parts: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """``recovery`` from summaries of (truth, recovered) that tasks have made."""
    r = lambda i, j: entry(i, j, 2)
    n, mx, mr = F.col(COUNT), F.col(MEAN)[0], F.col(MEAN)[1]
    ok = (n >= 3) & (r(0, 0) / F.sqrt(n) > FLAT)
    slope = F.try_divide(r(0, 1), r(0, 0))
    gap = r(0, 1) - r(0, 0)
    rmse = F.sqrt((mr - mx) * (mr - mx) + F.try_divide(gap * gap + r(1, 1) * r(1, 1), n))
    return combined(parts, keys).select(
        *keys,
        _required(
            ok,
            F.try_divide(r(0, 1), F.sqrt(r(0, 1) * r(0, 1) + r(1, 1) * r(1, 1))),
            "recovery needs three rows and a truth that varies",
            strict,
        ).alias("correlation"),
        (mr - slope * mx).alias("intercept"),
        slope.alias("slope"),
        rmse.alias("rmse"),
        F.try_divide(rmse * F.sqrt(n), r(0, 0)).alias("nrmse"),
        (mr - mx).alias("bias"),
    )


def pair_worlds(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Half the difference of the plus and minus forecasts, one row per ``keys``."""
    pick = lambda world: F.max(F.when(F.col("market") == world, F.col("forecast")))
    return (
        forecasts.groupBy(*keys)
        .agg(pick("plus").alias("_p"), pick("minus").alias("_m"), F.first("truth").alias("truth"))
        .select(*keys, "truth", (F.lit(0.5) * (F.col("_p") - F.col("_m"))).alias("recovered"))
    )
