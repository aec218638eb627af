"""Counterfactual studies: reversal, wild bootstrap, planted twins, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelgrid.config import CounterfactualConfig
from panelgrid.guards import require_same_axis
from panelgrid.operators.blocks import TimeAxis, over_time
from panelgrid.operators.counterfactual import (
    BENCH_COLUMNS, MODEL_COLUMNS, PATHS, RECOVERIES, SPAN_COLUMNS, TWIN_KINDS, WORLDS, bootstrap_plan, design_summaries,
    seeded_shocks, signal_rows, twin_summaries,
)
from panelgrid.operators.engine import seed_blocks, to_arrays
from panelgrid.operators.regressions import forecast_anatomy, recovery_summaries, spanning, spanning_summaries
from panelgrid.operators.scoring import (
    anchor_by_seed, average_with_seed_count, ensemble, require_full_paths, score, score_summaries,
)
from panelgrid.operators.standardize import standardize_panel, trim_to_sample
from panelgrid.operators.triangles import COUNT, MEAN
from panelgrid.operators.windows import add_reversal, declining_weights, led, volatility_timed_momentum
from panelgrid.plans.reports import BENCHMARK, MODEL, with_metadata
from panelgrid.sources.sinks import materialize, write_artifact


@dataclass
class Prepared:
    """Raw-scale targets next to standardized predictors, before and after reversal."""

    original: DataFrame
    reversal: DataFrame


def prepare_inputs(
    tidy: DataFrame,
    config: CounterfactualConfig,
    target: str,
    predictors: Sequence[str],
    own_lag: str,
    sample_end: str,
    axis: TimeAxis,
    shocks: DataFrame | None = None,
    start=None,
    check: bool = True,
    **standardizing,
) -> Prepared:
    """Target ``y`` in raw units on the dates of the standardized predictors.

    The reversal is added to the whole raw series, own lag included, and that panel is
    then standardized anew.
    """
    keys, t = list(axis.keys), axis.t
    if shocks is None:
        shocks = seeded_shocks(tidy, config.simulation_seed, axis, config.innovation_variance**0.5, lead_in=2)
    reversed_ = add_reversal(tidy, target, shocks, axis, config.theta).withColumn(own_lag, F.col(target))

    def prepared(raw: DataFrame) -> DataFrame:
        # the raw target is carried along: no row has to be looked up again
        std = standardize_panel(
            raw.withColumn("_raw", F.col(target)), target, predictors, axis, own_lag=own_lag, date="date", start=start,
            check=check, **standardizing,
        )
        return trim_to_sample(std, sample_end).select(*keys, t, "date", F.col("_raw").alias("y"), *predictors)

    original, reversal = prepared(tidy), prepared(reversed_)
    if check:
        require_same_axis(original, reversal, [*keys, t])
    return Prepared(original, reversal)


def _booked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("strategy_return", F.col("forecast") * F.col("realized"))


def _benchmark(panel: DataFrame, predictors: Sequence[str], axis: TimeAxis, window: int) -> DataFrame:
    bench = volatility_timed_momentum(panel, "y", predictors, axis, window)
    return bench.select(
        *axis.keys, axis.t, F.col("forecast").alias("bench_forecast"), F.col("strategy").alias("benchmark"),
        F.col("realized").alias("bench_realized"),
    )


def _same_market(c: str = "realized") -> Column:
    """The market leg, failing when model and benchmark book different returns."""
    gap = F.abs(F.col(c) - F.col("bench_realized"))
    tolerance = F.lit(1e-7) * F.abs("bench_realized") + F.lit(1e-12)
    return F.when(gap <= tolerance, F.col(c)).otherwise(
        F.raise_error(F.lit("benchmark and model book different returns"))
    )


HISTORICAL, REVERSAL, BOOTSTRAP = EXPERIMENTS = ("historical", "ma2_reversal", "wild_bootstrap")


def direct_summaries(
    panels: Mapping[str, DataFrame],
    config: CounterfactualConfig,
    predictors: Sequence[str],
    axis: TimeAxis,
) -> DataFrame:
    """``(*keys, experiment, seed, summary)`` of the experiments that ``panels`` names, each with its prepared panel.

    The design is a group key: the fixed ones run in the same kernel stage. Bootstrap paths are drawn and used
    inside the kernel task of their seed. Tasks return one row for each chunk and seed (see ``design_summaries``).
    """
    keys, t = list(axis.keys), axis.t
    study = config.study()
    design = lambda df, name: df.withColumn("experiment", F.lit(name))
    fixed, found = [design(df, name) for name, df in panels.items() if name != BOOTSTRAP], []
    if fixed:
        keyed = axis.with_keys("experiment")
        rows = to_arrays(reduce(DataFrame.unionByName, fixed), "y", predictors, [*keyed.keys, t])
        found.append(design_summaries(rows, study, keyed))
    if BOOTSTRAP in panels:
        panel = panels[BOOTSTRAP]
        plan = bootstrap_plan(panel, predictors, seed_blocks(study), axis, study.chunk, study.window, config.bootstrap_seed)
        drawn = design_summaries(to_arrays(panel, "y", predictors, [*keys, t]), study, axis, plan)
        found.append(design(drawn, BOOTSTRAP))
    return reduce(DataFrame.unionByName, found)


def twin_designs(
    original: DataFrame,
    config: CounterfactualConfig,
    shared: Sequence[str],
    axis: TimeAxis,
    shocks: DataFrame | None = None,
    inputs: Sequence[str] = ("dp", "ltr", "dfr"),
    kinds: Sequence[str] = TWIN_KINDS,
) -> DataFrame:
    """Both twin designs and their benchmarks, reduced in the kernel task (see ``twin_summaries``)."""
    keys, t = list(axis.keys), axis.t
    base = original.select(*keys, t, "date", *shared)
    if shocks is None:
        shocks = seeded_shocks(base, config.shock_seed, axis)
    rows = signal_rows(base, shocks, axis, config.calibration, inputs)
    arrays = to_arrays(rows, ["epsilon", "planted", "g"], shared, [*keys, t, "date"])
    return twin_summaries(arrays, config.study(), config.strengths, axis, kinds=kinds)


RESULTS = ("counterfactuals", "counterfactual_spanning", "twin_recovery", "twin_spanning", "twin_paths")
TWINS_OF = {"twin_recovery": RECOVERIES, "twin_spanning": WORLDS, "twin_paths": PATHS}


@dataclass
class Counterfactuals:
    """All designs of a panel. Each result is built when first asked for.

    Designs are made, solved and reduced inside the kernel task to one summary for each chunk and seed (and the twins' mean
    paths), stored in the shared folder and read back by every result. Per-seed statistics come first, then their means.
    Twins are reduced to what ``results`` need, and a panel that none of the results asked for reads is not prepared.
    """

    tidy: DataFrame
    config: CounterfactualConfig
    target: str
    predictors: Sequence[str]
    own_lag: str
    sample_end: str
    axis: TimeAxis
    reversal_shocks: DataFrame | None
    twin_shocks: DataFrame | None
    inputs: Sequence[str]
    bootstrap: bool
    check: bool
    standardizing: dict
    results: Sequence[str] = RESULTS
    experiments: Sequence[str] = EXPERIMENTS

    @cached_property
    def found(self) -> Prepared:
        return prepare_inputs(
            self.tidy, self.config, self.target, self.predictors, self.own_lag, self.sample_end, self.axis,
            self.reversal_shocks, check=self.check, **self.standardizing,
        )

    @cached_property
    def original(self) -> DataFrame:
        return materialize(self.found.original)

    @cached_property
    def prepared(self) -> Prepared:
        return Prepared(self.original, materialize(self.found.reversal))

    @cached_property
    def direct(self) -> DataFrame:
        names = [e for e in self.experiments if e != BOOTSTRAP or self.bootstrap]
        if not names or set(names) - set(EXPERIMENTS):
            raise ValueError(f"the experiments are {EXPERIMENTS}, not {tuple(self.experiments)}")
        panels = {e: self.prepared.reversal if e == REVERSAL else self.original for e in names}
        return materialize(direct_summaries(panels, self.config, self.predictors, self.axis))

    @cached_property
    def twins(self) -> DataFrame:
        shared = [c for c in self.predictors if c != self.own_lag]
        kinds = [TWINS_OF[name] for name in self.results if name in TWINS_OF]
        return materialize(
            twin_designs(self.original, self.config, shared, self.axis, self.twin_shocks, self.inputs, kinds)
        )

    def _twins_for(self, name: str) -> DataFrame:
        if name not in self.results:
            raise ValueError(f"{name} is not among the results asked for: {tuple(self.results)}")
        return self.twins

    def _with_share(self, df: DataFrame) -> DataFrame:
        shares = [F.lit(v) for name, share in self.config.strengths.items() for v in (name, float(share))]
        return df.withColumn("signal_r2", F.element_at(F.create_map(*shares), F.col("strength")))

    @property
    def _design(self) -> list[str]:
        return [*self.axis.keys, "predictor_set", "strength"]

    def _described(self, df: DataFrame, direct: bool) -> DataFrame:
        c = self.config
        values = {"T": c.window, "P": c.anchor_p, "z": 0.0, "gamma": c.gamma, "sample_end": self.sample_end}
        if direct:
            values |= {
                "target_scale": "raw decimal return",
                "simulation_seed": c.simulation_seed,
                "bootstrap_seed": c.bootstrap_seed,
                "innovation_variance": c.innovation_variance,
            }
        else:
            values["shock_seed"] = c.shock_seed
        return with_metadata(df, values)

    @cached_property
    def counterfactuals(self) -> DataFrame:
        by = [*self.axis.keys, "experiment", "seed"]
        scored = [
            score_summaries(self.direct, by, with_norm=False, strict=self.check, pick=pick).withColumn("strategy", F.lit(name))
            for name, pick in ((MODEL, MODEL_COLUMNS), (BENCHMARK, BENCH_COLUMNS))
        ]
        means = average_with_seed_count(scored[0].unionByName(scored[1]), [*self.axis.keys, "experiment", "strategy"])
        return self._described(means, True)

    @cached_property
    def counterfactual_spanning(self) -> DataFrame:
        keys = [*self.axis.keys, "experiment"]
        per_seed = spanning_summaries(self.direct, [*keys, "seed"], pick=SPAN_COLUMNS)
        return self._described(average_with_seed_count(per_seed, keys), True)

    @cached_property
    def twin_recovery(self) -> DataFrame:
        parts = self._twins_for("twin_recovery").where("market IS NULL AND seed IS NOT NULL")
        per_seed = self._with_share(recovery_summaries(parts, [*self._design, "seed"], strict=self.check))
        return self._described(average_with_seed_count(per_seed, self._design), False)

    @cached_property
    def twin_spanning(self) -> DataFrame:
        world = [*self._design, "market", "seed"]
        parts = self._twins_for("twin_spanning").where("market IS NOT NULL")
        market = score_summaries(parts, world, with_norm=False, strict=self.check, pick=MODEL_COLUMNS).select(
            *world,
            "sharpe",
            F.col("alpha").alias("market_alpha"),
            F.col("alpha_tstat").alias("market_alpha_tstat"),
            F.col("information_ratio").alias("market_information_ratio"),
        )
        per_seed = self._with_share(market.join(spanning_summaries(parts, world, pick=SPAN_COLUMNS), world))
        return self._described(average_with_seed_count(per_seed, [*self._design, "market"]), False)

    @cached_property
    def twin_paths(self) -> DataFrame:
        keys, t = list(self.axis.keys), self.axis.t
        paths = self._twins_for("twin_paths").where("seed IS NULL")
        if len(seed_blocks(self.config.study())) == 1:  # one kernel call has seen all seeds of a step
            paths = paths.select(
                *self._design, t, "obs", F.col(MEAN)[0].alias("truth"), F.col(MEAN)[1].alias("recovered"),
                F.col(COUNT).alias("n_seeds"),
            )
        else:
            mean = lambda i: F.try_divide(F.sum(F.col(COUNT) * F.col(MEAN)[i]), F.sum(COUNT))
            paths = paths.groupBy(*self._design, t, "obs").agg(
                mean(0).alias("truth"), mean(1).alias("recovered"), F.sum(COUNT).alias("n_seeds")
            )
        start = self.original.groupBy(*keys).agg(F.min(t).alias("_t0"))
        placed = self._with_share(paths.join(start, keys)).select(
            *self._design, "signal_r2", (F.col(t) - F.col("_t0")).alias("oos_index"), "obs", "truth", "recovered", "n_seeds"
        )
        return self._described(placed, False)

    def write(self, base: str, sample_end: str | None = None) -> dict[str, DataFrame]:
        """One parquet table per result, keyed by the period; the stored frames."""
        end = sample_end or self.sample_end
        return {name: write_artifact(getattr(self, name), base, name, end) for name in RESULTS if name in self.results}


def run_counterfactuals(
    tidy: DataFrame,
    config: CounterfactualConfig,
    target: str,
    predictors: Sequence[str],
    own_lag: str,
    sample_end: str,
    axis: TimeAxis = TimeAxis(),
    reversal_shocks: DataFrame | None = None,
    twin_shocks: DataFrame | None = None,
    inputs: Sequence[str] = ("dp", "ltr", "dfr"),
    bootstrap: bool = True,
    check: bool = False,
    results: Sequence[str] = RESULTS,
    experiments: Sequence[str] = EXPERIMENTS,
    **standardizing,
) -> Counterfactuals:
    """Set up all designs of a raw panel with a ``date`` (see ``Counterfactuals``).

    Every predictor but ``own_lag`` is shared between twin worlds. Shock tables default
    to seeded ones; without ``bootstrap`` the wild-bootstrap design is left out. With
    ``check`` data contracts are verified eagerly; without it the kernel tasks still
    refuse gaps and non-finite cells. ``results`` names those that will be read, ``experiments`` the direct
    designs among them; no others are worked out.
    """
    return Counterfactuals(
        tidy, config, target, tuple(predictors), own_lag, sample_end, axis, reversal_shocks, twin_shocks,
        tuple(inputs), bootstrap, check, standardizing, tuple(results), tuple(experiments),
    )


@dataclass
class Diagnostics:
    metrics: DataFrame
    anatomy: DataFrame
    spanning: DataFrame


def diagnostics(
    forecasts: DataFrame,
    panel: DataFrame,
    target: str,
    predictors: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    window: int = 12,
    date: str = "date",
    model_name: str = "RFF (ridgeless)",
    scale_name: str = "standardized",
    check: bool = True,
) -> Diagnostics:
    """Score exported anchor forecasts of a standardized panel.

    ``forecasts`` is a forecast export (``obs`` dates the forecast row). Statistics are
    computed per seed and then averaged; only the anatomy uses the across-seed mean
    forecast. ``check`` verifies the export against the panel first.
    """
    keys, t = list(axis.keys), axis.t
    anchor = anchor_by_seed(forecasts, keys, check=check)
    if check:
        expected = panel.groupBy(*keys).agg((F.count("*") - F.lit(window + 1)).alias("n_oos"))
        require_full_paths(anchor, expected, keys)
    dated = panel.withColumnRenamed(target, "y")
    # the decision row of an observation is the row before its date
    steps = over_time(
        dated.select(*keys, t, date), axis, {"obs": led(date)}, lookahead=1
    ).select(*keys, t, "obs")
    bench = _benchmark(dated, predictors, axis, window)
    rows = _booked(
        anchor.join(steps, [*keys, "obs"]).join(bench, [*keys, t])
    ).withColumn("realized", _same_market())

    by = [*keys, "seed"]
    per_seed = score(rows, by, strict=check)
    model = average_with_seed_count(per_seed, keys).withColumn("strategy", F.lit(model_name))
    own = score(
        bench.withColumnsRenamed({"bench_forecast": "forecast", "bench_realized": "realized"}), keys, strict=check
    ).withColumns({"strategy": F.lit(BENCHMARK), "n_seeds": F.lit(1).cast("long")})
    metrics = model.unionByName(own).withColumn("target_scale", F.lit(scale_name))

    mean_path = ensemble(rows, [*keys, t])
    fit = forecast_anatomy(mean_path, dated, "y", axis, window)
    reference = F.array(*[F.lit(w) for w in declining_weights(window)])
    anatomy = fit.select(*keys, F.posexplode("lag_weights").alias("_i", "projection_weight")).select(
        *keys,
        (F.col("_i") + 1).alias("lag"),
        "projection_weight",
        F.col("projection_weight").alias("lag_weight"),
        F.element_at(reference, F.col("_i") + 1).alias("benchmark_weight"),
    )
    span = average_with_seed_count(spanning(rows, by, "strategy_return"), keys)
    spanned = span.join(
        fit.select(*keys, F.col("r2").alias("anatomy_r2"), F.col("intercept").alias("anatomy_intercept")), keys
    ).withColumns(
        {"aggregation": F.lit("mean of per-seed statistics"), "target_scale": F.lit(scale_name)}
    )
    return Diagnostics(metrics, anatomy, spanned)
