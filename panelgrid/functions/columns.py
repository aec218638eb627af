"""Scalar expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the sources. Spark aggregates skip NULL but spread NaN."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not doubles:
        return df
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in doubles})


def month_end(c: Column) -> Column:
    return F.last_day(c)


def month_end_of_yyyymm(c: Column) -> Column:
    return F.last_day(F.to_date(c.cast("string"), "yyyyMM"))


def month_ordinal(c: Column) -> Column:
    """Months since year zero: consecutive months differ by exactly one."""
    return (F.year(c) * 12 + F.month(c)).cast("long")


def hour_ordinal(c: Column) -> Column:
    """Hours since 1970 on the wall clock of the column, whatever the session's zone."""
    return (F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)).cast("long")


def log_ratio(a: Column, b: Column) -> Column:
    """ln a - ln b; NULL when either side is not positive."""
    return F.ln(a) - F.ln(b)


def growth(now: Column, before: Column) -> Column:
    return F.try_divide(now, before) - F.lit(1.0)


def complexity(p: Column, window: int) -> Column:
    return p / F.lit(float(window))


def label(c: Column, names: dict[str, str], keep_unknown: bool = True) -> Column:
    """Display names for keys; unknown keys stay as they are unless told otherwise."""
    mapping = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    found = F.try_element_at(mapping, c)
    return F.coalesce(found, c) if keep_unknown else found


def curved_signal(dp: Column, ltr: Column, dfr: Column) -> Column:
    """The planted rule before calibration: curved valuation plus an interaction."""
    return F.lit(0.6) * F.cos(dp) + F.lit(0.4) * F.sin(ltr) * F.sin(dfr)


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def decimals(c: Column, places: int) -> Column:
    """Fixed-point text with thousands separators, as reports print numbers."""
    return F.format_number(c, places)
