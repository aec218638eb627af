"""Scoring forecasts and averaging finished statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelgrid.functions.metrics import score_columns
from panelgrid.guards import ContractError, require_unique
from panelgrid.operators.triangles import combined, summaries
from panelgrid.sources.sinks import materialize_counted


SCORED = ("_realized", "_strategy", "_forecast")  # the columns of a score's triangular factor


def score(
    forecasts: DataFrame,
    keys: Sequence[str],
    periods: int = 12,
    beta_norm: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """One row of statistics per group, from one pass over its rows.

    Tasks reduce their rows to triangular factors before anything is shuffled (see ``triangles``), so a
    strategy that the market nearly spans keeps the digits of its residual. Rows without a forecast or a realized
    return count for nothing. ``strict`` raises for a group of fewer than three rows or with a constant market;
    otherwise its regression statistics are NULL.
    """
    f, r = F.col("forecast"), F.col("realized")
    columns = dict(zip(SCORED, (r, f * r, f))) | ({"_norm": F.col(beta_norm)} if beta_norm else {})
    rows = forecasts.select(*keys, *[c.alias(name) for name, c in columns.items()])
    parts = summaries(rows, keys, SCORED, ["_norm"] if beta_norm else [])
    return score_summaries(parts, keys, periods, beta_norm is not None, strict)


def score_summaries(
    parts: DataFrame, keys: Sequence[str], periods: int = 12, with_norm: bool = True, strict: bool = True,
    pick: Sequence[int] | None = None,
) -> DataFrame:
    """``score`` from summaries that tasks have made; ``pick`` says where (realized, strategy, forecast) are in them."""
    return combined(parts, keys, pick=pick).select(*keys, *score_columns(periods, with_norm, strict))


def score_by_residuals(forecasts: DataFrame, keys: Sequence[str], periods: int = 12) -> DataFrame:
    """Alpha statistics from explicit residuals: the fitted line is joined back and residuals are squared row by row."""
    strategy = F.col("forecast") * F.col("realized")
    line = forecasts.groupBy(*keys).agg(
        F.regr_slope(strategy, F.col("realized")).alias("_slope"),
        F.regr_intercept(strategy, F.col("realized")).alias("alpha"),
        F.avg("realized").alias("_mx"),
        F.regr_sxx(strategy, F.col("realized")).alias("_sxx"),
        F.count("*").alias("_n"),
    )
    residual = strategy - F.col("alpha") - F.col("_slope") * F.col("realized")
    fitted = forecasts.join(line, list(keys)).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("alpha", "_mx", "_sxx", "_n")],
        F.sum(residual * residual).alias("_ssr"),
        F.stddev_pop(residual).alias("_sd"),
    )
    se = F.sqrt(F.col("_ssr") / (F.col("_n") - 2) * (1 / F.col("_n") + F.col("_mx") ** 2 / F.col("_sxx")))
    return fitted.select(
        *keys,
        "alpha",
        F.try_divide(F.sqrt(F.lit(float(periods))) * F.col("alpha"), F.col("_sd")).alias("information_ratio"),
        F.try_divide(F.col("alpha"), se).alias("alpha_tstat"),
    )


def statistic_columns(df: DataFrame, keys: Sequence[str], drop: Sequence[str] = ("seed",)) -> list[str]:
    """Every numeric column that is neither a key nor dropped."""
    skip = {*keys, *drop}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def average_statistics(per_seed: DataFrame, keys: Sequence[str], drop: Sequence[str] = ("seed",)) -> DataFrame:
    """Mean over seeds of every finished statistic; forecasts are never averaged first."""
    return per_seed.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in statistic_columns(per_seed, keys, drop)])


def average_with_seed_count(per_seed: DataFrame, keys: Sequence[str], seed: str = "seed") -> DataFrame:
    """Means of the numeric columns and the number of distinct seeds behind them.

    Two aggregation levels (per seed first) replace a distinct count, so a hot group
    is reduced to one row per seed before it is shuffled by its key.
    """
    stats = statistic_columns(per_seed, keys, (seed,))
    partial = per_seed.groupBy(*keys, seed).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in stats], *[F.count(c).alias(f"_n_{c}") for c in stats]
    )
    return partial.groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(c) for c in stats],
        F.count(seed).alias("n_seeds"),
    )


def anchor_rows(df: DataFrame, by: Sequence[str] = (), z: float = 0.0, p: str = "P") -> DataFrame:
    """Rows at shrinkage ``z`` and the largest complexity (of each ``by`` group)."""
    level = df.where(F.col("z") == F.lit(float(z)))
    if not by:
        return level.where(F.col(p) == level.agg(F.max(p)).scalar())
    top = level.groupBy(*by).agg(F.max(p).alias(p))
    return level.join(top, [*by, p], "left_semi").select(*df.columns)


def anchor_by_seed(
    forecasts: DataFrame, keys: Sequence[str] = ("series_id",), obs: str = "obs", check: bool = True
) -> DataFrame:
    """The minimum-norm forecasts of the largest model, one path per series and seed.

    ``check`` refuses forecasts without that level and repeated ones. It writes the level's rows first, so lazy forecasts are
    solved once.
    """
    if not check:
        return anchor_rows(forecasts, by=keys)
    level, seen = materialize_counted(forecasts.where(F.col("z") == F.lit(0.0)), {})
    if not seen["n_rows"]:
        raise ContractError("ridgeless (z=0) forecasts has no rows")
    return require_unique(anchor_rows(level, by=keys), [*keys, "seed", obs], "anchor forecasts")


def require_full_paths(anchor: DataFrame, expected: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Each seed path must have exactly the ``n_oos`` rows its series allows.

    ``expected`` holds ``(*keys, n_oos)``.
    """
    counts = anchor.groupBy(*keys, "seed").agg(F.count("*").alias("n"))
    bad = counts.join(expected, list(keys), "left").where(~F.col("n").eqNullSafe(F.col("n_oos"))).limit(5).collect()
    if bad:
        raise ContractError(f"forecast paths do not match the out-of-sample rows: {[tuple(r) for r in bad]}")
    return anchor


def ensemble(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Across-seed mean forecast, realized return and payoff per observation."""
    return forecasts.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in ("forecast", "realized", "strategy") if c in forecasts.columns]
    )


def importance(per_seed: DataFrame, keys: Sequence[str] = ("series_id",), full: str = "none") -> DataFrame:
    """Loss of performance without each predictor: full-model mean less its own mean.

    ``per_seed`` is read once: means by two levels (seed first, so seeds are counted without a
    distinct), then the full model's mean is picked over the few rows of a series.
    """
    means = average_with_seed_count(per_seed.select(*keys, "excluded", "seed", "r2", "sharpe"), [*keys, "excluded"])
    series = Window.partitionBy(*keys)
    base = lambda c: F.max(F.when(F.col("excluded") == full, F.col(c))).over(series)
    return (
        means.withColumns({"_r2": base("r2"), "_sharpe": base("sharpe")})
        .where((F.col("excluded") != full) & F.col("_r2").isNotNull())
        .select(
            *keys,
            F.col("excluded").alias("variable"),
            (F.col("_r2") - F.col("r2")).alias("vi_r2"),
            (F.col("_sharpe") - F.col("sharpe")).alias("vi_sharpe"),
            "n_seeds",
        )
    )


def leaders(vi: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most important predictors; ties fall back to the name."""
    return vi.orderBy(F.desc("vi_r2"), F.asc("variable")).limit(k)
