"""Backward-looking time-axis operators."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from panelgrid.operators.blocks import TimeAxis, over_time, prior_moments


def strictly_prior(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-rows, -1)


def prior_rms(c: str, rows: int):
    """sqrt(mean(x^2)) over the ``rows`` rows before, NULL unless all of them exist."""

    def column(w: WindowSpec) -> Column:
        frame = strictly_prior(w, rows)
        return F.when(F.count(c).over(frame) == rows, F.sqrt(F.avg(F.col(c) * F.col(c)).over(frame)))

    return column


def trailing_uncentered_vol(
    panel: DataFrame, column: str, axis: TimeAxis = TimeAxis(), window: int = 12, name: str = "vol"
) -> DataFrame:
    return over_time(panel, axis, {name: prior_rms(column, window)}, lookback=window)


def expanding_vol(
    panel: DataFrame, columns: Mapping[str, str], axis: TimeAxis = TimeAxis(), min_periods: int = 36
) -> DataFrame:
    """Sample SD of all earlier rows, NULL until ``min_periods`` non-null ones exist.

    ``columns`` maps output names to source columns.
    """
    moments = prior_moments(panel, axis, {f"_{out}": c for out, c in columns.items()})
    # one observation has no sample SD, whatever min_periods allows
    needed = max(int(min_periods), 2)
    return moments.select(
        *panel.columns,
        *[
            F.when(
                F.col(f"_{out}_n") >= needed, F.sqrt(F.col(f"_{out}_m2") / (F.col(f"_{out}_n") - 1))
            ).alias(out)
            for out in columns
        ],
    )


def lagged(c: str | Column, rows: int = 1):
    return lambda w: F.lag(c, rows).over(w)


def led(c: str | Column, rows: int = 1):
    return lambda w: F.lead(c, rows).over(w)


def declining_weights(window: int) -> list[float]:
    """Linearly declining weights, newest first, summing to one."""
    if window != int(window) or int(window) < 1:
        raise ValueError(f"window must be a positive integer; got {window!r}")
    total = window * (window + 1) / 2.0
    return [(window - k) / total for k in range(int(window))]


def fir(c: str | Column, weights: Sequence[float]):
    """Weighted sum of the current and earlier rows, newest weight first.

    NULL until every row it needs exists.
    """

    def column(w: WindowSpec) -> Column:
        terms = [
            F.lit(float(wt)) * (F.col(c) if isinstance(c, str) else c)
            if k == 0
            else F.lit(float(wt)) * F.lag(c, k).over(w)
            for k, wt in enumerate(weights)
        ]
        return reduce(lambda a, b: a + b, terms)

    return column


def position(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def _weights(window: int, weights: Sequence[float] | None) -> list[float]:
    if weights is None:
        return declining_weights(window)
    if len(weights) != window:
        raise ValueError(f"weights must have {window} entries")
    return [float(v) for v in weights]


def _decisions(panel: DataFrame, axis: TimeAxis, window: int, target: str, columns: dict) -> DataFrame:
    """Rows with ``window`` earlier rows and a next one, with their window columns.

    Adds ``realized`` (the next row's target) and ``oos_index``, the position of the
    decision row inside its series counted from zero.
    """
    wanted = {**columns, "realized": led(target), "_first": lagged(target, window)}
    if axis.block is None:
        # the series is one window partition: its first step is in the same frame
        wanted["_t0"] = lambda w: F.first(axis.t).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
    scored = over_time(panel, axis, wanted, lookback=window, lookahead=1).where(
        F.col("_first").isNotNull() & F.col("realized").isNotNull()
    )
    if axis.block is not None:
        start = panel.groupBy(*axis.keys).agg(F.min(axis.t).alias("_t0"))
        scored = scored.join(start, list(axis.keys))
    return scored.withColumn("oos_index", F.col(axis.t) - F.col("_t0"))


def momentum(
    panel: DataFrame,
    target: str,
    axis: TimeAxis = TimeAxis(),
    window: int = 12,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Weighted momentum of each decision row, booked against the next row's return.

    A decision row has ``window`` earlier rows and a next one.
    """
    weights = _weights(window, weights)
    scored = _decisions(panel, axis, window, target, {"forecast": fir(target, weights)})
    return scored.select(
        *axis.keys,
        axis.t,
        "oos_index",
        "forecast",
        "realized",
        (F.col("forecast") * F.col("realized")).alias("strategy"),
    )


def volatility_timed_momentum(
    panel: DataFrame,
    target: str,
    predictors: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    window: int = 12,
    weights: Sequence[float] | None = None,
    position_scale: float = 0.05,
    variance_floor: float = 1e-12,
) -> DataFrame:
    """Momentum divided by the mean predictor variance of the rows before the decision.

    The momentum leg includes the decision row, the variance leg does not.
    """
    refused = {
        "window": window if window < 2 or window % 1 else None,
        "position_scale": None if math.isfinite(position_scale) else position_scale,
        "variance_floor": None if 0 < variance_floor < math.inf else variance_floor,
    }
    if any(v is not None for v in refused.values()):
        raise ValueError(f"momentum cannot be timed with {({k: v for k, v in refused.items() if v is not None})}")
    weights = _weights(window, weights)

    def mean_variance(w: WindowSpec) -> Column:
        frame = strictly_prior(w, window)
        total = reduce(lambda a, b: a + b, [F.var_samp(c).over(frame) for c in predictors])
        return F.greatest(total / F.lit(float(len(predictors))), F.lit(variance_floor))

    columns = {"_momentum": fir(target, weights), "predictor_variance": mean_variance}
    scored = _decisions(panel, axis, window, target, columns).withColumn(
        "forecast", F.lit(position_scale) * F.col("_momentum") / F.col("predictor_variance")
    )
    return scored.select(
        *axis.keys,
        axis.t,
        "oos_index",
        "forecast",
        "realized",
        (F.col("forecast") * F.col("realized")).alias("strategy"),
        "predictor_variance",
    )


def add_reversal(
    panel: DataFrame,
    target: str,
    shocks: DataFrame,
    axis: TimeAxis = TimeAxis(),
    theta: Sequence[float] = (0.2, 0.2),
    name: str | None = None,
) -> DataFrame:
    """Add a two-lag moving-average reversal ``xi - th0 xi[-1] - th1 xi[-2]`` to ``target``.

    ``shocks`` holds ``(*keys, t, xi)`` and starts two steps before each series. The
    filter runs along the shock table, which is then joined to the panel.
    """
    if [math.isfinite(v) for v in theta] != [True, True]:
        raise ValueError(f"a reversal takes two finite lag weights, not {theta!r}")
    component = over_time(
        shocks.select(*axis.keys, axis.t, "xi"),
        axis,
        {"component": fir("xi", [1.0, -float(theta[0]), -float(theta[1])])},
        lookback=2,
    ).drop("xi")
    # merged, not broadcast: shocks may be generated after their shuffle, whose bytes then say nothing of their number
    joined = panel.join(component.hint("merge"), [*axis.keys, axis.t], "left")
    out = name or target
    kept = [c for c in panel.columns if c != out]
    return joined.select(*kept, (F.col(target) + F.col("component")).alias(out))
