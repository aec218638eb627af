"""Data contracts. Each guard is one aggregate job and raises with the offenders.

Guards are eager on purpose: a lazy assertion on a column nobody selects is pruned.
They look only at the columns they need, so a guard on a columnar table is a narrow
scan. Guard a materialized frame (see ``panelgrid.sources.sinks.materialize``) when
deriving it is expensive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelgrid.operators.blocks import TimeAxis, over_time

SHOWN = 5  # offenders quoted in an error message


class ContractError(ValueError):
    """An input breaks a data contract of the operator it was given to."""


def non_finite(column: str | Column) -> Column:
    """True where a double cell is NULL, NaN or infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")


def require_rows(df: DataFrame, what: str = "frame") -> DataFrame:
    if df.isEmpty():
        raise ContractError(f"{what} has no rows")
    return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "frame") -> DataFrame:
    found = duplicates(df, keys).limit(SHOWN).collect()
    if found:
        raise ContractError(f"{what} is not unique by {list(keys)}: {[tuple(r) for r in found]}")
    return df


def axis_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that the frames do not hold equally often, with ``surplus`` rows on the left (negative: on the right)."""
    counted = lambda df, sign: df.select(*keys).withColumn("_n", F.lit(sign))
    both = counted(left, 1).unionByName(counted(right, -1))
    return both.groupBy(*keys).agg(F.sum("_n").cast("long").alias("surplus")).where("surplus <> 0")


def require_same_axis(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Both frames must hold exactly the same keys, each key equally often."""
    bad = axis_differences(left, right, keys).limit(SHOWN).collect()
    if bad:
        raise ContractError(f"axes differ at {[tuple(r) for r in bad]}")


def series_health(
    panel: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], arrays: Sequence[str] = ()
) -> DataFrame:
    """One row per series: span, row count, missing ordinals, non-finite cells."""
    bad = F.lit(0)
    for c in columns:
        bad = bad + non_finite(c).cast("int")
    for c in arrays:
        bad = bad + F.when(F.col(c).isNull(), 1).otherwise(
            F.size(F.filter(c, non_finite))
        )
    return panel.groupBy(*keys).agg(
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        F.count("*").alias("n_rows"),
        (F.max(t) - F.min(t) + 1 - F.count("*")).alias("n_missing"),
        F.sum(bad).alias("n_non_finite"),
    )


def rejects(health: DataFrame, min_rows: int) -> DataFrame:
    """Series that break a contract of the engine, with the reason."""
    reason = (
        F.when(F.col("n_non_finite") > 0, "non-finite cells")
        .when(F.col("n_missing") > 0, "gap in the time axis")
        .when(F.col("n_missing") < 0, "duplicate time steps")
        .when(F.col("n_rows") < min_rows, f"fewer than {min_rows} rows")
    )
    return health.withColumn("reason", reason).where(F.col("reason").isNotNull())


def require_healthy(
    panel: DataFrame,
    keys: Sequence[str],
    t: str,
    columns: Sequence[str],
    arrays: Sequence[str] = (),
    min_rows: int = 1,
) -> DataFrame:
    found = rejects(series_health(panel, keys, t, columns, arrays), min_rows).limit(SHOWN).collect()
    if found:
        shown = [{**{k: r[k] for k in keys}, "reason": r["reason"]} for r in found]
        raise ContractError(f"series rejected: {shown}")
    return panel


def split_healthy(
    panel: DataFrame,
    keys: Sequence[str],
    t: str,
    columns: Sequence[str],
    arrays: Sequence[str] = (),
    min_rows: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(rows of the usable series, one row per rejected series with its reason)."""
    bad = rejects(series_health(panel, keys, t, columns, arrays), min_rows)
    return panel.join(bad.select(*keys), list(keys), "left_anti"), bad


def gap_rows(panel: DataFrame, keys: Sequence[str], t: str, block: int | None = 4096) -> DataFrame:
    """Rows that resume a series after missing time steps.

    A row without the step before it starts a stretch; every stretch but the first of
    its series resumes after a gap. The test needs one neighbour, so it runs in time
    blocks, and only the few stretch heads are compared with their series' first.
    """
    axis = TimeAxis(tuple(keys), t, block)
    heads = over_time(panel, axis, {"_before": lambda w: F.lag(t).over(w)}, lookback=1).where(
        F.col("_before").isNull() | (F.col("_before") < F.col(t) - 1)
    ).drop("_before")
    first = heads.groupBy(*keys).agg(F.min(t).alias("_first"))
    return heads.join(first, list(keys)).where(F.col(t) > F.col("_first")).drop("_first")


def require_contiguous(panel: DataFrame, keys: Sequence[str], t: str, label: str | None = None) -> DataFrame:
    found = gap_rows(panel, keys, t).limit(SHOWN).collect()
    if found:
        at = [(*(r[k] for k in keys), r[label or t]) for r in found]
        raise ContractError(f"the time axis has gaps before {at}")
    return panel


def overlap_correlation(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Correlation of two series over the rows where both exist, and their number."""
    both = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    # a constant side has no correlation; dividing by its zero spread is an error
    spread = both.agg(
        F.count("*").alias("n_overlap"),
        F.covar_pop("a", "b").alias("_c"),
        F.stddev_pop("a").alias("_sa"),
        F.stddev_pop("b").alias("_sb"),
    )
    return spread.select(
        F.try_divide(F.col("_c"), F.col("_sa") * F.col("_sb")).alias("correlation"), "n_overlap"
    )


def require_correlated(df: DataFrame, a: Column, b: Column, threshold: float) -> DataFrame:
    row = overlap_correlation(df, a, b).first()
    if row["correlation"] is None or not row["correlation"] > threshold:
        raise ContractError(
            f"the two sources diverge: correlation {row['correlation']} over {row['n_overlap']} rows "
            f"is not above {threshold}"
        )
    return df
