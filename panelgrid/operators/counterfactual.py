"""Artificial panels: seeded shocks, planted signals, wild bootstrap."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pyspark.sql.pandas.types import to_arrow_schema

from panelgrid.config import StudyConfig
from panelgrid.functions.columns import curved_signal
from panelgrid.guards import require_columns
from panelgrid.operators.blocks import BLOCK, TimeAxis, over_time, spread
from panelgrid.operators.engine import SEED_BLOCK, _matrix, chunked_panel, in_batches, open_chunks, pin_blas, seed_blocks
from panelgrid.operators.kernel import solve_windows, window_spread
from panelgrid.operators.regressions import fit_ar1
from panelgrid.operators.triangles import codes, mean_columns, reduced, summary_columns, summary_fields
from panelgrid.operators.windows import declining_weights, lagged
from panelgrid.sources.sinks import materialize

SHOCK_ROWS = 65536  # rows that a task hands on at a time
SEEDS_AT_ONCE = 64  # seeds whose paths one task draws together
ONE_BLOCK = 1 << 40  # steps of the only block of a series that the calendar bounds


def seeded_shocks(
    panel: DataFrame, seed: int, axis: TimeAxis = TimeAxis(), scale: float = 1.0, lead_in: int = 0
) -> DataFrame:
    """A Gaussian shock table ``(*keys, t, xi)`` for every series of a panel.

    Every series gets the same path, the stream of ``default_rng(seed)`` counted from its own first step (less
    ``lead_in``), so a path is the same whatever its series' length. A stream has to be drawn in order: a task walks
    a series and hands on batches, so its memory does not grow with the series. Where that walk is too long, pass a shock table.
    """
    keys = list(axis.keys)
    span = panel.groupBy(*keys).agg(F.min(axis.t).alias("_lo"), F.max(axis.t).alias("_hi"))
    schema = T.StructType(
        [panel.schema[k] for k in keys] + [T.StructField(axis.t, T.LongType()), T.StructField("xi", T.DoubleType())]
    )

    def draw(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                rng = np.random.default_rng(seed)
                stop = int(row["_hi"]) + 1
                for first in range(int(row["_lo"]) - lead_in, stop, SHOCK_ROWS):
                    steps = np.arange(first, min(first + SHOCK_ROWS, stop))
                    constant = {k: [row[k]] * len(steps) for k in keys}
                    yield pd.DataFrame({**constant, axis.t: steps, "xi": rng.normal(scale=scale, size=len(steps))})

    return span.mapInPandas(draw, schema)


def calibrated_signal(
    panel: DataFrame,
    axis: TimeAxis = TimeAxis(),
    calibration: int = 120,
    inputs: Sequence[str] = ("dp", "ltr", "dfr"),
    name: str = "g",
) -> DataFrame:
    """The planted rule, centred and scaled on the first ``calibration`` rows only.

    Extending a series never revises the signal of its earlier rows.
    """
    require_columns(panel, inputs)
    if int(calibration) < 2:
        raise ValueError(f"no variance can be measured over {calibration} calibration rows")
    keys = list(axis.keys)
    raw = panel.withColumn("_raw", curved_signal(*[F.col(c) for c in inputs]))
    start = panel.groupBy(*keys).agg(F.min(axis.t).alias("_t0"))
    head = raw.select(*keys, axis.t, "_raw").join(start, keys).where(
        F.col(axis.t) < F.col("_t0") + F.lit(int(calibration))
    )
    moments = head.groupBy(*keys).agg(F.avg("_raw").alias("_center"), F.stddev_samp("_raw").alias("_sd"))
    usable = F.col("_sd") > 1e-12
    scale = F.when(usable, F.col("_sd")).otherwise(
        F.raise_error(F.lit("the signal is degenerate on its calibration rows"))
    )
    return (
        raw.join(moments, keys)
        .withColumn(name, (F.col("_raw") - F.col("_center")) / scale)
        .drop("_raw", "_center", "_sd")
    )


def amplitude(share: float) -> float:
    """Signal size that explains ``share`` of the variance next to unit shocks."""
    if not math.isfinite(share) or not 0 < share < 1:
        raise ValueError(f"a signal cannot carry a share of {share} of the variance")
    return math.sqrt(share / (1.0 - share))


def signal_rows(
    panel: DataFrame, shocks: DataFrame, axis: TimeAxis = TimeAxis(), calibration: int = 120,
    inputs: Sequence[str] = ("dp", "ltr", "dfr"),
) -> DataFrame:
    """The panel with ``epsilon``, ``g`` and ``planted``, from which every world follows."""
    signal = calibrated_signal(panel, axis, calibration, inputs)
    lagged_signal = over_time(signal, axis, {"_before": lagged("g")}, lookback=1)
    # merged, not broadcast (see ``add_reversal``)
    return lagged_signal.join(
        shocks.select(*axis.keys, axis.t, F.col("xi").alias("epsilon")).hint("merge"), [*axis.keys, axis.t]
    ).withColumn("planted", F.coalesce("_before", F.lit(0.0))).drop("_before")


def plant_signal(
    panel: DataFrame,
    shocks: DataFrame,
    strengths: Mapping[str, float],
    axis: TimeAxis = TimeAxis(),
    calibration: int = 120,
    inputs: Sequence[str] = ("dp", "ltr", "dfr"),
) -> DataFrame:
    """Plus and minus worlds of every strength on one shared shock path.

    Adds ``epsilon``, ``g``, ``planted`` (the signal of the row before, 0 on the first
    row) and, per copy of a row, ``strength``, ``signal_r2``, ``market``, ``truth``
    (amplitude times g) and ``y`` (the world's return).
    """
    joined = signal_rows(panel, shocks, axis, calibration, inputs)
    worlds = F.array(
        *[
            F.struct(
                F.lit(name).alias("strength"),
                F.lit(float(share)).alias("signal_r2"),
                F.lit(market).alias("market"),
                F.lit(sign * amplitude(share)).alias("signed"),
                F.lit(amplitude(share)).alias("size"),
            )
            for name, share in strengths.items()
            for market, sign in (("plus", 1.0), ("minus", -1.0))
        ]
    )
    return (
        joined.withColumn("_w", F.explode(worlds))
        .select(
            *panel.columns,
            "epsilon",
            "g",
            "planted",
            "_w.strength",
            "_w.signal_r2",
            "_w.market",
            (F.col("_w.size") * F.col("g")).alias("truth"),
            (F.col("epsilon") + F.col("_w.signed") * F.col("planted")).alias("y"),
        )
    )


def sign_stream(seed: int, start: int, count: int) -> np.ndarray:
    """``count`` random signs of a seed's stream from position ``start``.

    The generator spends one 32-bit half of a 64-bit word per sign, so any part of the
    stream is reached by jumping over whole words.
    """
    bits = np.random.PCG64(seed)
    bits.advance(start // 2)
    skip = start % 2
    drawn = np.random.Generator(bits).integers(0, 2, size=count + skip)
    return 2.0 * drawn[skip:] - 1.0


@dataclass(frozen=True)
class Bootstrap:
    """What a task needs to draw artificial predictors: rows by (series, block, block of seeds), see ``bootstrap_plan``."""

    plan: DataFrame
    base_seed: int


def signs_of(seeds: Sequence[int], base_seed: int, n: int, first: int, count: int, width: int) -> np.ndarray:
    """``(seeds, count, width)``: the signs of the moves ``first`` to ``first + count - 1`` of a series of ``n`` rows."""
    drawn = [[sign_stream(base_seed + s, j * (n - 1) + first, count) for j in range(width)] for s in seeds]
    return np.array(drawn).transpose(0, 2, 1)


def drawn_paths(
    x: np.ndarray, steps: np.ndarray, first: np.ndarray, plans: Sequence[dict], seeds: Sequence[int], base_seed: int
) -> np.ndarray:
    """``(seeds, rows, predictors)``: the artificial rows of groups of consecutive ``steps`` that begin at ``first`` and whose
    fitted rows are ``x``. A group runs from the state at its first row (``plans`` has its row of a ``Bootstrap``'s plan), or from
    the series' own first row. Groups move on together, a step at a time; those that need the same signs share their draw.
    """
    n, width = x.shape
    length = np.diff(np.append(first, n))
    owner = np.repeat(np.arange(len(first)), length)
    phi, level = np.array([p["phi"] for p in plans]), np.array([p["intercept"] for p in plans])
    out, sharing = np.zeros((len(seeds), n, width)), {}
    for g, (at, plan) in enumerate(zip(first, plans)):
        if steps[at] == plan["t_min"]:
            out[:, at] = x[at]
        elif plan["start"] is None:
            raise ValueError("a block of artificial rows has no state to start from")
        else:
            out[:, at] = np.array(plan["start"]).reshape(len(seeds), width)
        if length[g] > 1:
            sharing.setdefault((plan["n"], int(steps[at] - plan["t_min"]), int(length[g]) - 1), []).append(at)
    moves = np.zeros_like(out)
    for (rows, start, count), begins in sharing.items():
        at = np.array(begins)[:, None] + np.arange(1, count + 1)
        moves[:, at] = signs_of(seeds, base_seed, rows, start, count, width)[:, None]
    moves[:, 1:] *= x[1:] - level[owner[1:]] - phi[owner[1:]] * x[:-1]
    longest = np.argsort(-length, kind="stable")
    for i in range(1, int(length.max())):
        on = longest[: np.searchsorted(-length[longest], -i)]  # groups of more than i rows
        at = first[on] + i
        out[:, at] = level[on] + moves[:, at] + phi[on] * out[:, at - 1]
    return out


def bootstrap_plan(
    panel: DataFrame, predictors: Sequence[str], blocks: Sequence[Sequence[int]], axis: TimeAxis, block: int, lookback: int,
    base_seed: int = 0, bias_adjust: bool = True, bound: float | None = None,
) -> Bootstrap:
    """The fitted AR(1)s of every series and, for each block and block of seeds, the paths' state where the block's halo begins.

    Every row moves the state by an affine map, so the rows between two halos make one map: a product of slopes, equal
    for all seeds, and an offset for each seed. Tasks reduce their rows to such maps, one small row for each block of
    rows and of seeds; these are chained from the first row on. Panel rows are never copied per seed. ``start`` is NULL where a halo
    begins with, or before, the series' first row.
    """
    pin_blas(panel.sparkSession)
    keys, t, names = list(axis.keys), axis.t, list(predictors)
    width = len(names)
    fits = fit_ar1(panel, names, axis, bias_adjust, bound).select(*keys, "t_min", "n", "phi", "intercept")
    vectors = panel.select(*keys, t, F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    at = lambda c: F.floor(c / F.lit(block)).cast("long")
    t_max = F.col("t_min") + F.col("n") - 1
    number_seeds = F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1)))
    if block == ONE_BLOCK:  # every path begins with its series
        plan = fits.withColumn(SEED_BLOCK, number_seeds).withColumns(
            {BLOCK: F.lit(0).cast("long"), "start": F.lit(None).cast("array<double>")}
        )
        return Bootstrap(plan, base_seed)
    first = vectors.groupBy(*keys).agg(F.min_by("x", t).alias("x0"))
    series = materialize(fits.join(first, keys))
    # the rows after the start of a block's halo, up to that of the next, with the row before them
    piece = lambda c: at(c + F.lit(lookback - 1))
    long = series.where(at(F.col("t_min")) < at(t_max))  # a series of one block begins its path in it
    moved = vectors.join(long.select(*keys), keys).withColumn(
        BLOCK, F.explode(F.sequence(piece(F.col(t)), piece(F.col(t) + 1)))
    )
    known = long.withColumn(BLOCK, F.explode(F.sequence(piece(F.col("t_min") + 1), piece(t_max))))
    key_fields = [panel.schema[k] for k in keys]
    doubles = T.ArrayType(T.DoubleType())
    number = [T.StructField(BLOCK, T.LongType()), T.StructField(SEED_BLOCK, T.IntegerType())]
    map_schema = T.StructType(key_fields + number + [T.StructField("rows", T.LongType()), T.StructField("offset", doubles)])
    groups = [list(map(int, b)) for b in blocks]

    def reduce(left: pa.Table, right: pa.Table) -> pa.Table:
        offsets, count, row = [], 0, right.slice(0, 1).to_pylist()[0] if right.num_rows else None
        if left.num_rows and row is not None:
            steps = left[t].to_numpy()
            order = np.argsort(steps)
            steps = steps[order]
            if len(steps) > 1 and (np.diff(steps) != 1).any():
                raise ValueError("time steps are not consecutive")
            x = _matrix(left["x"], len(steps), order)
            own = np.flatnonzero(((steps + lookback - 1) // block == row[BLOCK]) & (steps > row["t_min"]))
            count = len(own)
            phi, level = np.array(row["phi"]), np.array(row["intercept"])
            residual = x[own] - level - phi * x[own - 1]
            for seeds in groups:
                state = np.zeros((len(seeds), width))
                if count:
                    moves = residual * signs_of(seeds, base_seed, row["n"], int(steps[own[0]] - row["t_min"] - 1), count, width)
                    for i in range(count):
                        state = level + moves[:, i] + phi * state
                offsets.append(state.reshape(-1).tolist())
        where = {k: [row[k]] * len(offsets) if row else [] for k in keys}
        return pa.table(where | {
            BLOCK: pa.array([row[BLOCK]] * len(offsets) if row else [], pa.int64()),
            SEED_BLOCK: pa.array(range(len(offsets)), pa.int32()), "rows": pa.array([count] * len(offsets), pa.int64()),
            "offset": pa.array(offsets, pa.list_(pa.float64())),
        }, schema=to_arrow_schema(map_schema))

    maps = moved.groupBy(*keys, BLOCK).cogroup(known.groupBy(*keys, BLOCK)).applyInArrow(reduce, map_schema)
    start_schema = T.StructType(key_fields + number + [T.StructField("start", doubles)])

    def chain(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return to_arrow_schema(start_schema).empty_table()
        row = right.slice(0, 1).to_pylist()[0]
        left = left.sort_by(BLOCK)
        phi, state, starts = np.array(row["phi"]), None, []
        for n, offset in zip(left["rows"].to_pylist(), left["offset"].to_pylist()):
            offset = np.array(offset).reshape(-1, width)
            state = np.tile(row["x0"], (len(offset), 1)) if state is None else state
            starts.append(state.reshape(-1).tolist())
            state = phi**n * state + offset
        out = left.select([*keys, BLOCK, SEED_BLOCK]).append_column("start", pa.array(starts, pa.list_(pa.float64())))
        return out.cast(to_arrow_schema(start_schema))

    per_seeds = series.withColumn(SEED_BLOCK, number_seeds)
    chained = long.withColumn(SEED_BLOCK, number_seeds)
    starts = maps.groupBy(*keys, SEED_BLOCK).cogroup(chained.groupBy(*keys, SEED_BLOCK)).applyInArrow(chain, start_schema)
    plan = per_seeds.drop("x0").withColumn(BLOCK, F.explode(F.sequence(at(F.col("t_min")), at(t_max))))
    return Bootstrap(plan.join(starts, [*keys, BLOCK, SEED_BLOCK], "left"), base_seed)


def wild_bootstrap(
    panel: DataFrame,
    predictors: Sequence[str],
    seeds: Sequence[int],
    axis: TimeAxis = TimeAxis(),
    base_seed: int = 0,
    bias_adjust: bool = True,
    bound: float | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Artificial predictors per seed: fitted AR(1)s with randomly signed residuals.

    Output ``(*keys, seed, t, x ARRAY<DOUBLE>)``; replicate ``seed`` draws from the
    stream ``base_seed + seed``, column after column. Residual sizes are kept, and the
    first row of a series starts its path. Rows are copied once for ``SEEDS_AT_ONCE`` seeds, and the seeds' own rows appear only as
    the result of the task that draws them. Studies draw them inside the kernel instead (``design_summaries``).
    """
    keys, t = list(axis.keys), axis.t
    names, seeds = list(predictors), [int(s) for s in seeds]
    groups = [seeds[i : i + SEEDS_AT_ONCE] for i in range(0, len(seeds), SEEDS_AT_ONCE)]
    block = axis.block or ONE_BLOCK
    found = bootstrap_plan(panel, names, groups, axis, block, 1, base_seed, bias_adjust, bound)
    rows = spread(
        panel.select(*keys, t, F.array(*[F.col(c).cast("double") for c in names]).alias("x")),
        TimeAxis(axis.keys, t, block), lookback=1,
    ).drop("_own").withColumn(SEED_BLOCK, F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))))
    group = [*keys, BLOCK, SEED_BLOCK]
    rows = rows.repartition(tasks or 4 * panel.sparkSession.sparkContext.defaultParallelism, *group)
    schema = T.StructType(
        [panel.schema[k] for k in keys]
        + [T.StructField("seed", T.LongType()), T.StructField(t, T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
    )

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return to_arrow_schema(schema).empty_table()
        row = right.slice(0, 1).to_pylist()[0]
        steps = left[t].to_numpy()
        order = np.argsort(steps)
        steps = steps[order]
        if len(steps) > 1 and (np.diff(steps) != 1).any():
            raise ValueError("time steps are not consecutive")
        own = groups[row[SEED_BLOCK]]
        path = drawn_paths(_matrix(left["x"], len(steps), order), steps, np.zeros(1, dtype=int), [row], own, base_seed)
        home = np.flatnonzero(steps // block == row[BLOCK])
        path, count = path[:, home], len(own) * len(home)
        values = pa.array(np.ascontiguousarray(path).reshape(-1))
        return pa.table({k: pa.repeat(left[k][0], count) for k in keys} | {
            "seed": np.repeat(np.array(own, dtype=np.int64), len(home)), t: np.tile(steps[home].astype(np.int64), len(own)),
            "x": pa.FixedSizeListArray.from_arrays(values, len(names)).cast(pa.list_(pa.float64())),
        })

    return rows.groupBy(*group).cogroup(found.plan.groupBy(*group)).applyInArrow(draw, schema)


DESIGN = ("realized", "strategy", "forecast", "benchmark", "bench_forecast")  # the columns of a design's factor
MODEL_COLUMNS, BENCH_COLUMNS, SPAN_COLUMNS = (0, 1, 2), (0, 3, 4), (3, 0, 1)  # scores, and the payoff on benchmark and market


def timed_momentum(
    x: np.ndarray, y: np.ndarray, window: int, scale: float = 0.05, floor: float = 1e-12, starts: np.ndarray | None = None
) -> np.ndarray:
    """``volatility_timed_momentum`` of the decision rows ``window`` to n - 2 of one series, from its rows; with ``starts``
    of those whose windows begin there."""
    starts = np.arange(len(y) - window - 1) if starts is None else starts
    weights = np.array(declining_weights(window))
    newest = sum(w * y[starts + window - k] for k, w in enumerate(weights))  # rows i-window+1 .. i
    _, spread = window_spread(np.ascontiguousarray(x.T), window, starts)  # rows i-window .. i-1
    variance = spread.mean(axis=0) / (window - 1)
    return scale * newest / np.maximum(variance, floor)


def design_summaries(
    panel: DataFrame, config: StudyConfig, axis: TimeAxis = TimeAxis(), bootstrap: Bootstrap | None = None
) -> DataFrame:
    """``(*keys, seed, summary of DESIGN)``: minimum-norm forecasts and their momentum benchmark, reduced in the kernel task.

    ``panel`` is as for ``rolling_forecasts``, with one target; the grid has one complexity and one shrinkage. The benchmark uses the predictors
    that the model sees, so it is worked out beside it, and neither rows of forecasts nor of benchmarks are joined. With ``bootstrap`` (planned for
    ``config.chunk``, ``config.window`` and ``seed_blocks(config)``) each seed sees artificial predictors, drawn inside the task.
    """
    keys, t = list(axis.keys), axis.t
    window, chunk, blocks = config.window, config.chunk, seed_blocks(config)
    base_seed = bootstrap.base_seed if bootstrap else None
    if len(config.p_grid) != 1 or len(config.z_labels) != 1:
        raise ValueError("a design has one complexity and one shrinkage")
    plan = None
    if bootstrap is not None:  # a group's plan travels as its first row
        number = [*keys, BLOCK, SEED_BLOCK]
        named = [c for c in bootstrap.plan.columns if c not in number]
        plan = bootstrap.plan.select(*number, F.struct(*named).alias("_plan"))
    chunked, group = chunked_panel(panel.select(*keys, t, "y", "x"), config, axis, len(blocks), plan)
    schema = T.StructType([panel.schema[k] for k in keys] + [T.StructField("seed", T.LongType())] + summary_fields())
    solve = dict(
        window=window, p_grid=config.p_grid, z_labels=config.z_labels, gamma=config.gamma, uncentered=config.uncentered
    )

    def solved(table: pa.Table) -> pa.Table | None:
        planned = None
        if base_seed is not None:
            planned, table = table.filter(table[t].is_null()), table.filter(table[t].is_valid())
        if not table.num_rows:
            return None
        c = open_chunks(table, keys, t, window, chunk)
        if c.y.shape[1] != 1:
            raise ValueError("a design has one target")
        if not len(c.decisions):
            return None
        seeds = blocks[table[SEED_BLOCK][0].as_py()]
        paths = [c.x] * len(seeds) if base_seed is None else drawn(table, planned, c, seeds)
        realized, y, values, bench = c.y[c.decisions + 1, 0], c.y[:, 0], [], None
        for s, x in zip(seeds, paths):
            forecast = solve_windows(x, c.y, seed=s, starts=c.starts, **solve)[0][0, 0, :, 0]
            if base_seed is not None or bench is None:
                bench = timed_momentum(x, y, window, starts=c.starts)
            values.append(np.stack([realized, forecast * realized, forecast, bench * realized, bench], axis=1))
        summary = reduced(np.concatenate(values), c.firsts(len(seeds)))
        held = pa.array(np.tile(c.head, len(seeds)))
        data = {k: table[k].combine_chunks().take(held) for k in keys}
        data["seed"] = np.repeat(np.array(seeds, dtype=np.int64), len(c.head))
        return pa.table(data | summary_columns(*summary, np.empty((len(held), 0))))

    def drawn(table: pa.Table, planned: pa.Table, c, seeds: Sequence[int]) -> np.ndarray:
        """``(seeds, rows, predictors)``: the artificial rows of the groups that have decisions."""
        number = lambda found: list(zip(*[found[k].to_pylist() for k in (*keys, BLOCK)]))
        plan = dict(zip(number(planned), planned["_plan"].to_pylist()))
        which = codes(table, [*keys, BLOCK])
        begins = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        some = np.isin(begins, c.head)
        named = number(table.take(pa.array(c.head)))
        for key in named:
            if key not in plan:
                raise ValueError(f"no plan of artificial rows for {key}")
        rows = np.repeat(some, np.diff(np.append(begins, len(which))))
        paths = np.repeat(c.x[None], len(seeds), axis=0)
        first = np.searchsorted(np.flatnonzero(rows), c.head)
        paths[:, rows] = drawn_paths(c.x[rows], c.steps[rows], first, [plan[key] for key in named], seeds, base_seed)
        return paths

    return in_batches(chunked, group, t, [SEED_BLOCK], solved, schema, max(map(len, blocks)))


SHARED_SET, OWN_SET = "x14_shared", "x15_world_lag"  # fixed values: names of the twin designs
RECOVERED = ("truth", "recovered")  # the columns of a recovery's factor
WORLDS, RECOVERIES, PATHS = TWIN_KINDS = ("worlds", "recoveries", "paths")  # the kinds of rows that twins are reduced to


def twin_summaries(
    panel: DataFrame, config: StudyConfig, strengths: Mapping[str, float], axis: TimeAxis = TimeAxis(), date: str = "date",
    kinds: Sequence[str] = TWIN_KINDS,
) -> DataFrame:
    """Both twin designs of every strength, solved and reduced in the kernel task.

    ``panel`` holds ``(*keys, t, date, y, x)`` with ``y`` = (epsilon, planted, g). Worlds are made inside the task, so no row is copied per world. With shared
    predictors the minimum-norm forecast is linear in the target: shock and unit signal are solved together, and every
    strength and sign is a combination of the two. With the world's own return among the predictors each world is solved by itself.

    Rows are ``(*keys, predictor_set, strength, market, seed, t, obs, summary)`` of three kinds: a world's DESIGN for each chunk and seed; with
    a NULL market its RECOVERED columns; with a NULL seed the mean path over the chunk's seeds at ``t``, whose means are RECOVERED, whose count
    is that of the seeds and whose factor is NULL. Only the ``kinds`` asked for are worked out.
    """
    keys, t = list(axis.keys), axis.t
    window, chunk, blocks = config.window, config.chunk, seed_blocks(config)
    if len(config.p_grid) != 1 or len(config.z_labels) != 1:
        raise ValueError("a design has one complexity and one shrinkage")
    if not kinds or set(kinds) - set(TWIN_KINDS):
        raise ValueError(f"twins are reduced to {TWIN_KINDS}, not {tuple(kinds)}")
    sizes = {name: amplitude(share) for name, share in strengths.items()}
    chunked, group = chunked_panel(panel.select(*keys, t, date, "y", "x"), config, axis, len(blocks))
    text = T.StringType()
    schema = T.StructType(
        [panel.schema[k] for k in keys]
        + [T.StructField(c, text) for c in ("predictor_set", "strength", "market")]
        + [T.StructField("seed", T.LongType()), T.StructField(t, T.LongType()), T.StructField("obs", panel.schema[date].dataType)]
        + summary_fields()
    )
    solve = dict(
        window=window, p_grid=config.p_grid, z_labels=config.z_labels, gamma=config.gamma, uncentered=config.uncentered
    )

    def kernel(table: pa.Table) -> pa.Table | None:
        c = open_chunks(table, keys, t, window, chunk)
        if c.y.shape[1] != 3:
            raise ValueError("twins are made of a shock, a planted signal and the signal itself")
        n, groups = len(c.decisions), len(c.head)
        if not n:
            return None
        at, arrow = c.decisions, to_arrow_schema(schema)
        epsilon, planted, g = c.y.T
        seeds = blocks[table[SEED_BLOCK][0].as_py()]
        labels = table[date].combine_chunks().take(pa.array(at + 1))
        held = {k: table[k].combine_chunks() for k in keys}
        tables = []

        def add(rows: np.ndarray, summary: dict, **columns) -> None:
            count = len(rows)
            data = {k: v.take(pa.array(rows)) for k, v in held.items()} | summary
            data |= {k: pa.repeat(v, count) if isinstance(v, str) else v for k, v in columns.items()}
            tables.append(pa.table([
                v.cast(f.type) if isinstance(v := data.get(f.name, pa.nulls(count, f.type)), pa.Array) else pa.array(v, f.type) for f in arrow
            ], schema=arrow))

        one = lambda x, y, s: solve_windows(x, y, seed=s, starts=c.starts, **solve)[0][0, 0]
        parts = [one(c.x, c.y[:, :2], s) for s in seeds]
        factor = lambda values, firsts: summary_columns(*reduced(values, firsts), np.empty((len(firsts), 0)))
        starts, rows, by_seed = c.firsts(len(seeds)), np.tile(c.head, len(seeds)), np.repeat(np.array(seeds), groups)
        tile = lambda v: np.tile(v, (len(seeds), 1))
        for strength, size in sizes.items():
            truth = size * g[at]
            worlds = {m: epsilon + sign * size * planted for m, sign in (("plus", 1.0), ("minus", -1.0))}
            for name in (SHARED_SET, OWN_SET):
                made = {}
                for market, sign in (("plus", 1.0), ("minus", -1.0)):
                    y = worlds[market]
                    if name == SHARED_SET:
                        x = c.x
                        made[market] = np.stack([p[:, 0] + sign * size * p[:, 1] for p in parts])
                    else:
                        x = np.column_stack([c.x, y])
                        made[market] = np.stack([one(x, y[:, None], s)[:, 0] for s in seeds])
                    if WORLDS not in kinds:
                        continue
                    bench, realized = timed_momentum(x, y, window, starts=c.starts), y[at + 1]
                    f = made[market]
                    values = np.stack([tile(realized), f * realized, f, tile(bench * realized), tile(bench)], axis=-1)
                    add(rows, factor(values.reshape(-1, 5), starts), predictor_set=name, strength=strength, market=market, seed=by_seed)
                found = 0.5 * (made["plus"] - made["minus"])
                if RECOVERIES in kinds:
                    both = np.stack([tile(truth), found], axis=-1).reshape(-1, 2)
                    add(rows, factor(both, starts), predictor_set=name, strength=strength, seed=by_seed)
                if PATHS in kinds:
                    mean = np.stack([truth, found.mean(axis=0)], axis=1)
                    add(
                        at, mean_columns(np.full(n, len(seeds)), mean), predictor_set=name, strength=strength, obs=labels,
                        **{t: c.steps[at].astype(np.int64)},
                    )
        return pa.concat_tables(tables)

    return in_batches(chunked, group, t, [SEED_BLOCK], kernel, schema, 4 * len(sizes) * max(map(len, blocks)))
