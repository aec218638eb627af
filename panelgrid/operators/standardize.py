"""Backward-looking volatility standardization of a tidy panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelgrid.guards import require_contiguous, require_rows
from panelgrid.operators.blocks import TimeAxis, over_time
from panelgrid.operators.windows import expanding_vol, prior_rms
from panelgrid.sources.sinks import materialize


def standardize_columns(
    panel: DataFrame,
    target: str,
    predictors: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    own_lag: str | None = None,
    window: int = 12,
    min_periods: int = 36,
) -> DataFrame:
    """Divide the target by its trailing root mean square and every predictor by the
    sample SD of its earlier rows. Nothing is demeaned and no row is dropped.

    ``own_lag`` names a predictor that repeats the target on the same row; it gets the
    target's scale. A zero scale gives NULL.
    """
    ordinary = [c for c in predictors if c != own_lag]
    carried = [c for c in panel.columns if c not in {target, *predictors}]
    if axis.block is None:
        # both kinds of frame share one exchange and one sort
        scale = {"_scale": prior_rms(target, window)}
        for c in ordinary:
            scale[f"_sd_{c}"] = _prior_sd(c, min_periods)
        scaled = over_time(panel, axis, scale)
    else:
        scaled = over_time(panel, axis, {"_scale": prior_rms(target, window)}, lookback=window)
        scaled = expanding_vol(scaled, {f"_sd_{c}": c for c in ordinary}, axis, min_periods)
    standardized = F.try_divide(F.col(target), F.col("_scale"))
    return scaled.select(
        *carried,
        standardized.alias(target),
        *[
            (standardized if c == own_lag else F.try_divide(F.col(c), F.col(f"_sd_{c}"))).alias(c)
            for c in predictors
        ],
    )


def _prior_sd(c: str, min_periods: int):
    def column(w):
        frame = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.when(F.count(c).over(frame) >= min_periods, F.stddev_samp(c).over(frame))

    return column


def with_valid(panel: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """Add ``valid``: every standardized value of the row exists."""
    present = F.lit(True)
    for c in (target, *predictors):
        present = present & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return panel.withColumn("valid", present)


def standardize_panel(
    panel: DataFrame,
    target: str,
    predictors: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    own_lag: str | None = None,
    window: int = 12,
    min_periods: int = 36,
    date: str | None = None,
    start=None,
    check: bool = True,
) -> DataFrame:
    """The analysis-ready panel: standardized, burn-in dropped, floored at ``start``.

    Dropping incomplete rows may trim only the head of a series; ``check`` raises when
    it would splice non-adjacent steps together. The panel is computed once: ``check`` writes it, reads only keys and
    ordinals back to look for gaps, and returns the written rows.
    """
    scaled = standardize_columns(panel, target, predictors, axis, own_lag, window, min_periods)
    complete = scaled.na.drop(subset=[target, *predictors])
    if check:
        complete = materialize(complete)
        require_contiguous(complete.select(*axis.keys, axis.t, *([date] if date else [])), axis.keys, axis.t, date)
    if start is not None:
        complete = complete.where(F.col(date) >= F.lit(start).cast("date"))
    carried = [c for c in complete.columns if c not in {target, *predictors}]
    return complete.select(*carried, target, *predictors)


def trim_to_sample(df: DataFrame, sample_end: str, date: str = "date", check: bool = False) -> DataFrame:
    """Rows up to the last day of the month ``sample_end`` (``yyyy-MM``)."""
    trimmed = df.where(F.col(date) <= F.last_day(F.to_date(F.lit(sample_end), "yyyy-MM")))
    return require_rows(trimmed, f"sample through {sample_end}") if check else trimmed
