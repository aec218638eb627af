"""From raw source tables to the tidy panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelgrid.functions.columns import log_ratio
from panelgrid.guards import ContractError, require_correlated, require_unique
from panelgrid.operators.blocks import MONTHS, TimeAxis, over_time
from panelgrid.operators.windows import lagged
from panelgrid.sources.sinks import materialize_counted

# The predictors of the tidy panel, in output order.
PREDICTORS = (
    "dfy", "infl", "svar", "de", "lty", "tms", "tbl", "dfr",
    "dp", "dy", "ltr", "ep", "bm", "ntis", "lag_mkt_excess",
)
SHARED_PREDICTORS = PREDICTORS[:-1]  # every predictor but the own lag
TARGET = "mkt_excess"


def join_one_to_one(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", check: bool = True
) -> DataFrame:
    """Equi-join that refuses repeated keys on either side."""
    if check:
        require_unique(left, on, "left side")
        require_unique(right, on, "right side")
    return left.join(right, list(on), how)


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str], check: bool = True) -> DataFrame:
    """Fetch ``values`` from ``right`` by key; every left key must exist there.

    ``check`` writes the joined rows, counts the lost ones in that same pass, and returns the written rows.
    """
    marked = right.select(*on, *values, F.lit(True).alias("_hit"))
    joined = left.join(marked, list(on), "left")
    if check:
        joined, seen = materialize_counted(joined, {"lost": F.col("_hit").isNull()})
        if seen["lost"]:
            lost = joined.where(F.col("_hit").isNull()).select(*on).limit(5).collect()
            raise ContractError(f"no match for {[tuple(r) for r in lost]}")
    return joined.drop("_hit")


def tidy_panel(
    source: DataFrame,
    index: DataFrame | None = None,
    axis: TimeAxis = MONTHS,
    threshold: float | None = 0.98,
    check: bool = True,
) -> DataFrame:
    """The target and its predictors, one row per series and month.

    ``source`` has ``(*keys, t, date)`` and the raw columns; ``index`` has
    ``(*keys, date, vwretd)`` from an independent source. The prior-row price is taken
    before rows are dropped. Row t holds what is known at t: the own lag repeats the
    target and nothing is shifted. ``threshold`` is the smallest accepted correlation
    of the two sources (None: no cross-check).
    """
    raw = over_time(source, axis, {"_prior_price": lagged("price")}, lookback=1)
    if index is not None:
        raw = join_one_to_one(raw, index, [*axis.keys, "date"], check=check)
    excess = F.col("ret") - F.col("Rfree")
    if index is not None and threshold is not None:
        require_correlated(raw, excess, F.col("vwretd") - F.col("Rfree"), threshold)
    kept = raw.where(F.col("ret").isNotNull())
    if index is not None:
        kept = kept.where(F.col("vwretd").isNotNull())
    built = {
        "dfy": F.col("BAA") - F.col("AAA"),
        "infl": F.col("infl"),
        "svar": F.col("svar"),
        "de": log_ratio(F.col("d12"), F.col("e12")),
        "lty": F.col("lty"),
        "tms": F.col("lty") - F.col("tbl"),
        "tbl": F.col("tbl"),
        "dfr": F.col("corpr") - F.col("ltr"),
        "dp": log_ratio(F.col("d12"), F.col("price")),
        "dy": log_ratio(F.col("d12"), F.col("_prior_price")),
        "ltr": F.col("ltr"),
        "ep": log_ratio(F.col("e12"), F.col("price")),
        "bm": F.col("bm"),
        "ntis": F.col("ntis"),
        "lag_mkt_excess": excess,
    }
    return kept.select(
        *axis.keys,
        axis.t,
        "date",
        excess.alias(TARGET),
        *[built[name].alias(name) for name in PREDICTORS],
    )


def excess_returns(source: DataFrame, returns: dict[str, str], free: str, carry: Sequence[str]) -> DataFrame:
    """``{output: return column}`` less the risk-free column; incomplete rows dropped."""
    return source.select(
        *carry, *[(F.col(c) - F.col(free)).alias(out) for out, c in returns.items()]
    ).na.drop(subset=list(returns))


def target_frame(
    targets: DataFrame,
    predictors: DataFrame,
    target_columns: Sequence[str],
    axis: TimeAxis = MONTHS,
    shared: Sequence[str] = SHARED_PREDICTORS,
    window: int = 12,
) -> DataFrame:
    """Study rows of several targets on one shared predictor table.

    Each target becomes a series: ``target`` (its name), ``y`` (scaled by its trailing
    root mean square), ``own_lag`` (the same value) and the shared predictors, joined
    on the time axis; incomplete rows are dropped. The targets are unpivoted before
    the join, so the predictors are read once for all of them.
    """
    from panelgrid.operators.windows import prior_rms

    long = targets.unpivot([*axis.keys, axis.t, "date"], list(target_columns), "target", "raw")
    scaled = over_time(
        long, axis.with_keys("target"), {"_scale": prior_rms("raw", window)}, lookback=window
    ).select(*axis.keys, "target", axis.t, "date", F.try_divide("raw", "_scale").alias("y"))
    joined = scaled.join(predictors.select(*axis.keys, axis.t, *shared), [*axis.keys, axis.t], "inner")
    return joined.na.drop(subset=["y", *shared]).select(
        *axis.keys, "target", axis.t, "date", "y", F.col("y").alias("own_lag"), *shared
    )
