"""Forecast statistics as expressions over mergeable moments and triangular factors.

Both merge, so a group is reduced in every task before the shuffle and a statistic over a
series split into chunks equals the one over the whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelgrid.operators.triangles import COUNT, MEAN, SUMS, entry

MIN_ROWS = 3  # fewer observations leave no degree of freedom for the alpha regression


def oos_r2(forecast: Column, realized: Column) -> Column:
    """1 - var(error)/var(realized), both centred: a constant forecast scores zero."""
    return F.lit(1.0) - F.try_divide(F.var_pop(realized - forecast), F.var_pop(realized))


def sharpe_ratio(returns: Column, periods: int = 12) -> Column:
    return F.try_divide(F.sqrt(F.lit(float(periods))) * F.avg(returns), F.stddev_pop(returns))


def score_columns(periods: int = 12, with_norm: bool = True, strict: bool = True) -> list[Column]:
    """Statistics from the triangular factor of (realized, strategy, forecast), see ``operators.triangles``: least
    squares of the strategy on the market, and the variance of the forecast's error."""
    r = lambda i, j: entry(i, j, 3)
    n, mx, my = F.col(COUNT), F.col(MEAN)[0], F.col(MEAN)[1]
    some = F.when(n > 0, n)
    defined = (n >= MIN_ROWS) & (r(0, 0) > 0)
    slope = F.try_divide(r(0, 1), r(0, 0))
    alpha = my - slope * mx
    residual_var = F.when(defined, F.try_divide(r(1, 1) * r(1, 1), n))
    volatility = F.sqrt(F.try_divide(r(0, 1) * r(0, 1) + r(1, 1) * r(1, 1), some))
    gap = r(0, 0) - r(0, 2)
    error = gap * gap + r(1, 2) * r(1, 2) + r(2, 2) * r(2, 2)
    lever = 1.0 / some + F.try_divide(mx * mx, r(0, 0) * r(0, 0))
    alpha_se = F.sqrt(F.try_divide(r(1, 1) * r(1, 1), n - 2) * lever)
    root = F.sqrt(F.lit(float(periods)))

    def checked(c: Column) -> Column:
        if not strict:
            return F.when(defined, c)
        problem = F.raise_error(
            F.concat(
                F.lit("scoring needs at least 3 rows and a market that varies; rows: "), n.cast("string")
            )
        )
        return F.when(defined, c).otherwise(problem)

    return [
        (F.lit(1.0) - F.try_divide(error, F.when(some.isNotNull(), r(0, 0) * r(0, 0)))).alias("r2"),
        *([F.try_divide(F.col(SUMS)[0], F.col(SUMS)[1]).alias("beta_norm")] if with_norm else []),
        F.when(some.isNotNull(), my).alias("mean_return"),
        volatility.alias("volatility"),
        F.try_divide(root * my, volatility).alias("sharpe"),
        checked(alpha).alias("alpha"),
        F.try_divide(root * alpha, F.sqrt(residual_var)).alias("information_ratio"),
        F.when(defined, F.try_divide(alpha, alpha_se)).alias("alpha_tstat"),
    ]
