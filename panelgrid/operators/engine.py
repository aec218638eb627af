"""Rolling forecasts of a whole panel as one grouped-map job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelgrid.config import TASK_FEATURES, StudyConfig
from panelgrid.operators.blocks import BLOCK, TimeAxis, spread
from panelgrid.operators.kernel import solve_windows
from panelgrid.operators.triangles import codes, reduced, summary_columns, summary_fields

SEED_BLOCK = "_seeds"
BATCH_ROWS = 1 << 14  # rows of whole groups that a task solves together, one group at least
BATCH_VALUES = 1 << 18  # and results of these rows


def to_arrays(
    panel: DataFrame, target: str | Sequence[str], predictors: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """Kernel input: ``carry`` columns, ``y`` and ``x`` as arrays of doubles."""
    targets = [target] if isinstance(target, str) else list(target)
    return panel.select(
        *carry,
        F.array(*[F.col(c).cast("double") for c in targets]).alias("y"),
        F.array(*[F.col(c).cast("double") for c in predictors]).alias("x"),
    )


def default_predictors(df: DataFrame, target: str, skip: Sequence[str]) -> list[str]:
    """Every column that is neither the target nor a key, ordinal or date."""
    return [c for c in df.columns if c != target and c not in skip]


def pin_blas(spark) -> None:
    """One BLAS thread per task: Spark already runs one task per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")


def _matrix(column: pa.ChunkedArray, n: int, order: np.ndarray | slice = slice(None)) -> np.ndarray:
    values = column.combine_chunks()
    if values.null_count or values.flatten().null_count:
        raise ValueError("the panel has missing cells")
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if flat.size % n:
        raise ValueError("rows of one series differ in width")
    return np.ascontiguousarray(flat.reshape(n, -1)[order])


def seed_blocks(config: StudyConfig) -> list[list[int]]:
    return [list(config.seeds[i : i + config.seed_block]) for i in range(0, len(config.seeds), config.seed_block)]


@dataclass(frozen=True)
class Designs:
    """Choices of predictors that are solved side by side: the places in ``x`` of each, by its name in the column ``key``."""

    key: str
    columns: Mapping[str, Sequence[int]]


def design_blocks(config: StudyConfig, designs: Designs | None) -> list[list[tuple[str | None, list[int] | None]]]:
    """Designs of one kernel call, as many as make ``TASK_FEATURES`` features with its seeds: a block of them costs a copy of
    the panel."""
    if designs is None:
        return [[(None, None)]]
    named = [(name, list(columns)) for name, columns in designs.columns.items()]
    seeds = min(config.seed_block, len(config.seeds))
    size = max(1, TASK_FEATURES // (config.chunk * config.p_grid[-1] * seeds))
    return [named[i : i + size] for i in range(0, len(named), size)]


def chunked_panel(
    panel: DataFrame, config: StudyConfig, axis: TimeAxis, n_blocks: int, beside: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Rows of every (series, chunk, block of seeds), dealt to the partitions of the kernel stage; and the group's columns.

    A chunk has a halo of ``window`` rows before and one after. The partition count is given explicitly: the stage is
    bound by arithmetic, and partitions coalesced by their byte size would serialise it. Rows of ``beside`` go to their group.
    """
    spark = panel.sparkSession
    pin_blas(spark)
    chunked = spread(panel, TimeAxis(axis.keys, axis.t, config.chunk), lookback=config.window, lookahead=1).drop("_own")
    if n_blocks > 1:
        chunked = chunked.withColumn(SEED_BLOCK, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    else:
        chunked = chunked.withColumn(SEED_BLOCK, F.lit(0))
    group = [*axis.keys, BLOCK, SEED_BLOCK]
    if beside is not None:
        chunked = chunked.unionByName(beside, allowMissingColumns=True)
    tasks = config.tasks or max(
        4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return chunked.repartition(tasks, *group), group


def in_batches(
    dealt: DataFrame, group: Sequence[str], t: str, apart: Sequence[str], kernel: Callable[[pa.Table], pa.Table | None],
    schema: T.StructType, per_row: int,
) -> DataFrame:
    """``kernel`` over tables of whole groups, a group's rows in time order, in partitions that hold whole groups.

    A short series is too little work for a call of its own, so the rows of many are solved together: up to
    ``BATCH_ROWS``, or as many as make ``BATCH_VALUES`` results where a row makes ``per_row``. Groups that differ in the
    columns ``apart`` or in the width of ``x`` come in tables of their own. Rows without a ``t`` come first in their group.
    """
    arrow, least = to_arrow_schema(schema), max(1, min(BATCH_ROWS, BATCH_VALUES // per_row))

    def solved(table: pa.Table, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(which))))
        width = pc.list_value_length(table["x"]).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        wide = np.maximum.reduceat(width, first)[owner]
        odd = (width != wide) & table[t].is_valid().to_numpy()
        if odd.any():
            raise ValueError("the panel has missing cells" if (width[odd] < 0).any() else "rows of one series differ in width")
        kind = codes(table, apart) * (int(wide.max()) + 2) + wide
        for k in np.unique(kind):
            found = kernel(table if (kind == k).all() else table.filter(pa.array(kind == k)))
            if found is not None:
                yield from found.select(arrow.names).cast(arrow).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, limit = [], 0, least
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            while size >= limit:
                table = pa.Table.from_batches(waiting).combine_chunks()
                which = codes(table, group)
                ends = np.flatnonzero(which[1:] != which[:-1]) + 1  # the last group may go on
                if not len(ends):
                    waiting, limit = table.to_batches(), 2 * size
                    break
                cut = int(ends[max(np.searchsorted(ends, least, side="right") - 1, 0)])
                yield from solved(table.slice(0, cut), which[:cut])
                table = table.slice(cut)
                waiting, size, limit = table.to_batches(), table.num_rows, least
        if size:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from solved(table, codes(table, group))

    return dealt.sortWithinPartitions(*dict.fromkeys([*apart, *group, t])).mapInArrow(run, schema)


@dataclass
class Chunks:
    """Rows of groups, one group after the other, in time order. ``decisions`` are the places of the decision rows that
    belong to their chunk; those of each group that has any begin at ``first``, and ``head`` is a row of that group."""

    steps: np.ndarray
    x: np.ndarray
    y: np.ndarray
    decisions: np.ndarray
    first: np.ndarray
    head: np.ndarray
    window: int

    @property
    def starts(self) -> np.ndarray:
        """Where the windows of the own decisions begin."""
        return self.decisions - self.window

    def firsts(self, times: int) -> np.ndarray:
        """``first`` of the decisions repeated ``times``."""
        return (np.arange(times)[:, None] * len(self.decisions) + self.first).reshape(-1)


def open_chunks(table: pa.Table, keys: Sequence[str], t: str, window: int, chunk: int) -> Chunks:
    """The rows of whole groups, refused where they have gaps or cells that are missing or not finite."""
    n, steps, home = table.num_rows, table[t].to_numpy(), table[BLOCK].to_numpy()
    where = lambda i: {k: table[k][int(i)].as_py() for k in keys}
    which = codes(table, [*keys, BLOCK])
    begins = np.concatenate([[True], which[1:] != which[:-1]])
    begin = np.flatnonzero(begins)
    gap = np.flatnonzero((np.diff(steps) != 1) & ~begins[1:])
    if len(gap):
        raise ValueError(f"time steps of {where(gap[0])} are not consecutive")
    x, y = _matrix(table["x"], n), _matrix(table["y"], n)
    wrong = np.flatnonzero(~(np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)))
    if len(wrong):
        raise ValueError(f"non-finite cells in {where(wrong[0])}")
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    place, last = np.arange(n), np.append(begin[1:], n)[owner] - 1
    decisions = np.flatnonzero((place - begin[owner] >= window) & (place < last) & (steps // chunk == home))
    own = owner[decisions]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    return Chunks(steps, x, y, decisions, first, begin[own[first]], window)


def _rolling(
    panel: DataFrame, config: StudyConfig, axis: TimeAxis, date: str | None, targets: Sequence[str] | None,
    seed_key: str | None, reduce: bool, designs: Designs | None = None,
) -> DataFrame:
    keys, t = list(axis.keys), axis.t
    window, z_labels, p_grid, chunk = config.window, config.z_labels, config.p_grid, config.chunk
    blocks = [
        (seeds, part) for seeds in (seed_blocks(config) if seed_key is None else [[0]]) for part in design_blocks(config, designs)
    ]
    carried = [*keys, t, "y", "x"] + ([date] if date else [])
    chunked, group = chunked_panel(panel.select(*carried), config, axis, len(blocks))

    fields = [panel.schema[k] for k in keys if k != seed_key]
    if designs is not None:
        fields.append(T.StructField(designs.key, T.StringType(), False))
    if targets is not None:
        fields.append(T.StructField("target", T.StringType()))
    fields += [
        T.StructField("seed", T.LongType()),
        T.StructField("P", T.IntegerType()),
        T.StructField("z", T.DoubleType()),
    ]
    if reduce:
        fields += summary_fields()
    else:
        fields.append(T.StructField(t, T.LongType()))
        if date:
            fields.append(T.StructField("obs", panel.schema[date].dataType))
        fields += [T.StructField(c, T.DoubleType()) for c in ("forecast", "realized", "beta_norm")]
    names = None if targets is None else list(targets)
    design_key = None if designs is None else designs.key
    solve = dict(
        window=window, p_grid=p_grid, z_labels=z_labels, gamma=config.gamma, uncentered=config.uncentered
    )
    cells_p = np.repeat(np.array(p_grid, dtype=np.int32), len(z_labels))
    cells_z = np.tile(np.array(z_labels), len(p_grid))

    def kernel(table: pa.Table) -> pa.Table | None:
        c = open_chunks(table, keys, t, window, chunk)
        n_own, m = len(c.decisions), c.y.shape[1]
        if names is not None and m != len(names):
            raise ValueError(f"{m} targets for {len(names)} names")
        if names is None and m != 1:
            raise ValueError("name the targets of a panel with more than one")
        if not n_own:
            return None
        ids, part = blocks[table[SEED_BLOCK][0].as_py()]
        if seed_key is not None:
            ids = [table[seed_key][0].as_py()]
        seen = [c.x if columns is None else np.ascontiguousarray(c.x[:, columns]) for _, columns in part]
        found = [solve_windows(x, c.y, seed=s, starts=c.starts, **solve) for x in seen for s in ids]
        reps, cells, groups = len(found), len(cells_p), len(c.first)
        if reduce:  # layout: design, seed, P, z, target, series
            inner, held, target = m * groups, np.tile(c.head, m), np.repeat(np.arange(m), groups)
        else:  # layout: design, seed, P, z, decision, target
            inner, held, target = n_own * m, np.repeat(c.decisions, m), np.tile(np.arange(m), n_own)
        per_cell = lambda values: np.tile(values, reps * cells)
        take = lambda column, at: column.combine_chunks().take(pa.array(per_cell(at)))
        data = {k: take(table[k], held) for k in keys if k != seed_key}
        if design_key is not None:
            data[design_key] = pa.array([name for name, _ in part]).take(pa.array(np.repeat(np.arange(len(part)), len(ids) * cells * inner)))
        if names is not None:
            data["target"] = pa.array(names, pa.string()).take(pa.array(per_cell(target)))
        data["seed"] = np.repeat(np.tile(np.array(ids, dtype=np.int64), len(part)), cells * inner)
        data["P"] = np.tile(np.repeat(cells_p, inner), reps)
        data["z"] = np.tile(np.repeat(cells_z, inner), reps)
        if reduce:
            part = lambda i: np.concatenate([f[i].transpose(0, 1, 3, 2).reshape(-1, n_own) for f in found])
            forecast, norm = part(0), part(1)
            realized = np.tile(c.y[c.decisions + 1].T, (reps * cells, 1))
            values = np.stack([realized, forecast * realized, forecast], axis=-1).reshape(-1, 3)
            summary = reduced(values, c.firsts(len(forecast)))
            sums = np.stack([np.add.reduceat(norm, c.first, axis=1).reshape(-1), summary[0].astype(float)], axis=1)
            return pa.table(data | summary_columns(*summary, sums))
        flat = lambda part: np.concatenate([f[part].reshape(-1) for f in found])
        data[t] = per_cell(np.repeat(c.steps[c.decisions], m)).astype(np.int64)
        if date:
            data["obs"] = take(table[date], np.repeat(c.decisions + 1, m))
        data["forecast"] = flat(0)
        data["realized"] = per_cell(c.y[c.decisions + 1].reshape(-1))
        data["beta_norm"] = flat(1)
        return pa.table(data)

    apart = [SEED_BLOCK] if seed_key is None else [SEED_BLOCK, seed_key]
    per_row = max(len(seeds) * len(part) for seeds, part in blocks) * len(cells_p)
    return in_batches(chunked, group, t, apart, kernel, T.StructType(fields), per_row)


def rolling_forecasts(
    panel: DataFrame,
    config: StudyConfig,
    axis: TimeAxis = TimeAxis(),
    date: str | None = None,
    targets: Sequence[str] | None = None,
    seed_key: str | None = None,
    designs: Designs | None = None,
) -> DataFrame:
    """Forecast every decision row of every series for every seed, complexity and z.

    ``panel`` holds ``(*keys, t, y ARRAY<DOUBLE>, x ARRAY<DOUBLE>)`` with gapless,
    finite rows (see ``to_arrays``). Output rows are ``(*keys, seed, P, z, t, forecast,
    realized, beta_norm)``; with ``date`` also ``obs``, the date of the forecast row
    t+1; with ``targets`` a ``target`` column naming the entries of ``y``, which share
    one set of features. ``seed_key`` names a key that holds the seed of a series, for
    panels whose rows were themselves drawn per seed; ``config.seeds`` is then unused. With
    ``designs`` every model is solved on each choice of the entries of ``x``, named in a column after the keys.

    Decision rows are cut into chunks of ``config.chunk`` and seeds into blocks, so neither a long series nor a
    long seed list ends up in one task. Weights are drawn from the seed inside the task and never shuffled.
    """
    return _rolling(panel, config, axis, date, targets, seed_key, False, designs)


def rolling_summaries(
    panel: DataFrame, config: StudyConfig, axis: TimeAxis = TimeAxis(), targets: Sequence[str] | None = None,
    designs: Designs | None = None,
) -> DataFrame:
    """What ``score_summaries`` needs of ``rolling_forecasts``: one row for each chunk, seed, P and z (and target).

    Forecasts are reduced to their triangular factors inside the kernel task and never leave it.
    """
    return _rolling(panel, config, axis, None, targets, None, True, designs)
