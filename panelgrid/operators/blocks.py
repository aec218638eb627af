"""Time blocks: backward windows that split one long series over many tasks.

A window partitioned by series alone puts a whole series into one task. Here a series
is cut into blocks of ``block`` consecutive ordinals and windows are partitioned by
(series, block). Rows a block needs from its neighbours are copied into it as a halo
before the shuffle (1 + lookback/block copies of a row on average) and dropped again
after the window is evaluated. Statistics over all prior rows merge block summaries
with a running statistic inside the block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

BLOCK, OWN = "_block", "_own"


@dataclass(frozen=True)
class TimeAxis:
    """Keys of a series, its ordinal column (consecutive integers) and the block length.

    ``block=None`` keeps each series in one window partition. That is right only where
    the calendar bounds a series, as for monthly panels (1,200 rows a century).
    """

    keys: tuple = ("series_id",)
    t: str = "t"
    block: int | None = 4096

    def with_keys(self, *extra: str) -> "TimeAxis":
        return TimeAxis(tuple(self.keys) + extra, self.t, self.block)


MONTHS = TimeAxis(block=None)


def block_of(axis: TimeAxis, shift: int = 0) -> Column:
    return F.floor((F.col(axis.t) + F.lit(shift)) / F.lit(axis.block)).cast("long")


def spread(panel: DataFrame, axis: TimeAxis, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Copy every row to each block that reads it; ``_own`` marks its home block."""
    if lookback == 0 and lookahead == 0:
        return panel.withColumns({BLOCK: block_of(axis), OWN: F.lit(True)})
    return panel.withColumn(
        BLOCK, F.explode(F.sequence(block_of(axis, -lookahead), block_of(axis, lookback)))
    ).withColumn(OWN, F.col(BLOCK) == block_of(axis))


def over_time(
    panel: DataFrame,
    axis: TimeAxis,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    lookback: int = 0,
    lookahead: int = 0,
) -> DataFrame:
    """Add window columns. ``lookback``/``lookahead`` bound the rows any of them reads.

    All columns share one exchange and one sort.
    """
    kept = [c for c in panel.columns if c not in columns]
    if axis.block is None:
        w = Window.partitionBy(*axis.keys).orderBy(axis.t)
        return panel.select(*kept, *[fn(w).alias(name) for name, fn in columns.items()])
    w = Window.partitionBy(*axis.keys, BLOCK).orderBy(axis.t)
    return (
        spread(panel, axis, lookback, lookahead)
        .select(*kept, OWN, *[fn(w).alias(name) for name, fn in columns.items()])
        .where(OWN)
        .drop(OWN)
    )


def dense_ordinal(df: DataFrame, axis: TimeAxis, order: str, bucket: int) -> DataFrame:
    """Add ``axis.t``: the 0-based row position of each series ordered by ``order``.

    ``order`` is an integer axis (an epoch, a sequence number), possibly with holes.
    Rows are counted per bucket of ``bucket`` axis units, bucket counts are summed
    along each series, and positions inside a bucket are added to that offset, so no
    task sees more than one bucket of a series.
    """
    keys = list(axis.keys)
    tagged = df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(bucket)).cast("long"))
    ahead = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, BLOCK)
        .agg(F.count("*").alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order)
    return (
        tagged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*keys, BLOCK])
        .withColumn(axis.t, (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop(BLOCK, "_offset", "_row")
    )


def prior_moments(panel: DataFrame, axis: TimeAxis, columns: Mapping[str, str]) -> DataFrame:
    """Count, mean and centred sum of squares of all strictly earlier non-null rows.

    ``columns`` maps a prefix to a source column; the result carries ``<prefix>_n``,
    ``<prefix>_mean`` and ``<prefix>_m2``.
    """
    keys = list(axis.keys)
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if axis.block is None:
        w = frame(Window.partitionBy(*keys).orderBy(axis.t))
        added = {}
        for p, c in columns.items():
            added[f"{p}_n"] = F.count(c).over(w)
            added[f"{p}_mean"] = F.avg(c).over(w)
            added[f"{p}_m2"] = F.var_pop(c).over(w) * F.count(c).over(w)
        return panel.withColumns(added)

    tagged = panel.withColumn(BLOCK, block_of(axis))
    inside = frame(Window.partitionBy(*keys, BLOCK).orderBy(axis.t))
    along = Window.partitionBy(*keys).orderBy(BLOCK)

    summary = tagged.groupBy(*keys, BLOCK).agg(
        *[F.count(c).alias(f"{p}_bn") for p, c in columns.items()],
        *[F.avg(c).alias(f"{p}_bmean") for p, c in columns.items()],
        *[(F.var_pop(c) * F.count(c)).alias(f"{p}_bm2") for p, c in columns.items()],
    )
    # Sums are taken around the mean of the first non-empty block: it depends on the
    # past only and keeps the squares small when the level is far from zero.
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = summary.withColumns(
        {f"{p}_pivot": F.first(f"{p}_bmean", ignorenulls=True).over(so_far) for p in columns}
    )
    before = frame(along)
    offsets = []
    for p in columns:
        n, d = F.col(f"{p}_bn"), F.col(f"{p}_bmean") - F.col(f"{p}_pivot")
        offsets += [
            F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{p}_an"),
            F.coalesce(F.sum(n * d).over(before), F.lit(0.0)).alias(f"{p}_as"),
            F.coalesce(F.sum(F.col(f"{p}_bm2") + n * d * d).over(before), F.lit(0.0)).alias(f"{p}_aq"),
        ]
    offsets = summary.select(
        *keys, BLOCK, *[F.coalesce(f"{p}_pivot", F.lit(0.0)).alias(f"{p}_pivot") for p in columns], *offsets
    )

    running = {}
    for p, c in columns.items():
        running[f"{p}_in"] = F.count(c).over(inside)
        running[f"{p}_imean"] = F.avg(c).over(inside)
        running[f"{p}_iv"] = F.var_pop(c).over(inside)
    joined = tagged.withColumns(running).join(offsets, [*keys, BLOCK])
    merged = []
    for p in columns:
        na, nb = F.col(f"{p}_an"), F.col(f"{p}_in")
        mean_a = F.col(f"{p}_pivot") + F.coalesce(F.try_divide(f"{p}_as", na), F.lit(0.0))
        m2_a = F.col(f"{p}_aq") - F.coalesce(F.try_divide(F.col(f"{p}_as") * F.col(f"{p}_as"), na), F.lit(0.0))
        mean_b = F.coalesce(f"{p}_imean", F.lit(0.0))
        m2_b = F.coalesce(F.col(f"{p}_iv") * nb, F.lit(0.0))
        gap = mean_b - mean_a
        n = na + nb
        merged += [
            n.alias(f"{p}_n"),
            F.try_divide(na * mean_a + nb * mean_b, n).alias(f"{p}_mean"),
            F.when(
                n > 0, F.greatest(m2_a + m2_b + gap * gap * F.try_divide(na * nb, n), F.lit(0.0))
            ).alias(f"{p}_m2"),
        ]
    return joined.select(*panel.columns, *merged)
