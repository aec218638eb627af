"""The grid study: forecasts, per-seed statistics, across-seed averages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from panelgrid.config import ANCHOR_P, ANCHOR_Z, StudyConfig
from panelgrid.functions.columns import complexity
from panelgrid.guards import non_finite, require_healthy, split_healthy
from panelgrid.operators.blocks import TimeAxis
from panelgrid.operators.engine import Designs, default_predictors, rolling_forecasts, rolling_summaries, to_arrays
from panelgrid.operators.scoring import average_statistics, score_summaries
from panelgrid.sources.sinks import materialize, materialize_counted, write_artifact


@dataclass
class Study:
    """Lazy results of one study. Nothing runs until a frame is consumed.

    ``averaged`` reads ``per_seed``; call ``cut()`` (or write ``per_seed`` and read it
    back) when both are wanted, or the kernel runs twice.
    """

    arrays: DataFrame
    config: StudyConfig
    axis: TimeAxis
    date: str | None = None
    rejected: DataFrame | None = None
    strict: bool = True
    designs: Designs | None = None  # its key is the last of the axis, and no column of ``arrays``

    @property
    def keys(self) -> tuple:
        return tuple(self.axis.keys)

    @property
    def _panel_axis(self) -> TimeAxis:
        own = tuple(k for k in self.axis.keys if self.designs is None or k != self.designs.key)
        return TimeAxis(own, self.axis.t, self.axis.block)

    @cached_property
    def forecasts(self) -> DataFrame:
        return rolling_forecasts(self.arrays, self.config, self._panel_axis, self.date, designs=self.designs)

    @cached_property
    def per_seed(self) -> DataFrame:
        by = [*self.keys, "seed", "P", "z"]
        parts = rolling_summaries(self.arrays, self.config, self._panel_axis, designs=self.designs)
        scored = score_summaries(parts, by, strict=self.strict)
        return scored.withColumn("c", complexity(F.col("P"), self.config.window))

    @cached_property
    def averaged(self) -> DataFrame:
        return average_statistics(self.per_seed, [*self.keys, "P", "z"])

    def cut(self) -> "Study":
        """Store the per-seed statistics (small) so the averages read them back."""
        self.__dict__["per_seed"] = materialize(self.per_seed)
        self.__dict__.pop("averaged", None)
        return self

    def export(self, start: DataFrame | None = None) -> DataFrame:
        """Long forecast rows with the booked payoff, for a forecast sink.

        ``obs`` is the date of the forecast row, or its out-of-sample position when
        the panel has no dates; then ``start`` gives ``(*keys, t_min)``.
        """
        rows = self.forecasts
        if "obs" not in rows.columns:
            if start is None:
                raise ValueError("a panel without dates needs the first step of each series")
            rows = rows.join(start.select(*self.keys, "t_min"), list(self.keys)).withColumn(
                "obs", F.col("t") - F.col("t_min") - F.lit(self.config.window)
            )
        return rows.select(
            *self.keys,
            "seed",
            "P",
            "z",
            "obs",
            "forecast",
            "realized",
            (F.col("forecast") * F.col("realized")).alias("strategy"),
        )

    def write(self, base: str, name: str, sample_end: str) -> tuple[DataFrame, DataFrame]:
        """Write the per-seed table, then average the stored copy."""
        per_seed = write_artifact(self.per_seed, base, f"{name}_per_seed", sample_end)
        averaged = write_artifact(average_statistics(per_seed, [*self.keys, "P", "z"]), base, name, sample_end)
        return per_seed, averaged

    def write_forecasts(self, base: str, name: str, sample_end: str, start: DataFrame | None = None) -> DataFrame:
        return write_artifact(self.export(start), base, f"forecasts_{name}", sample_end, ["P", "z"])


def run_study(
    panel: DataFrame,
    config: StudyConfig,
    target: str = "y",
    predictors: Sequence[str] | None = None,
    axis: TimeAxis = TimeAxis(),
    date: str | None = None,
    on_bad_series: str = "raise",
) -> Study:
    """Run the grid on every series of a standardized panel.

    Predictors default to every column besides keys, ordinal, date and target.
    ``on_bad_series``: ``raise`` names the bad series; ``skip`` drops them and reports them in ``Study.rejected``. Both
    write the kernel's input once, count rows with cells that are not finite in that same pass, and then read keys and
    ordinals alone, or the cells too where some are bad. ``trust``
    leaves the checks of finite and consecutive rows to the kernel tasks and scores a
    series with fewer than three forecasts as NULL.
    """
    keys = list(axis.keys)
    skip = {*keys, axis.t} | ({date} if date else set())
    names = list(predictors) if predictors is not None else default_predictors(panel, target, skip)
    rejected = None
    if on_bad_series not in ("raise", "skip", "trust"):
        raise ValueError(f"on_bad_series must be raise, skip or trust; got {on_bad_series!r}")
    carry = [*keys, axis.t] + ([date] if date else [])
    arrays = to_arrays(panel, target, names, carry)
    if on_bad_series != "trust":
        bad = F.exists("y", non_finite) | F.exists("x", non_finite)
        arrays, seen = materialize_counted(arrays, {"bad": bad})
        health = dict(keys=keys, t=axis.t, columns=[], arrays=["y", "x"] if seen["bad"] else [], min_rows=config.min_rows)
        if on_bad_series == "raise":
            require_healthy(arrays, **health)
        else:
            arrays, rejected = split_healthy(arrays, **health)
    return Study(arrays, config, axis, date, rejected, on_bad_series != "trust")


def anchor_study(
    panel: DataFrame,
    config: StudyConfig,
    target: str,
    predictors: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    date: str | None = None,
    p: int = ANCHOR_P,
    z: float = ANCHOR_Z,
    on_bad_series: str = "raise",
) -> Study:
    """Only the largest model at heavy shrinkage and its minimum-norm limit."""
    return run_study(
        panel, config.with_(p_grid=(p,), z_grid=(z,), ridgeless=True), target, predictors, axis, date, on_bad_series
    )


def leave_one_out(
    panel: DataFrame,
    config: StudyConfig,
    target: str,
    predictors: Sequence[str],
    axis: TimeAxis = TimeAxis(),
    date: str | None = None,
    full: str = "none",
    strict: bool = True,
) -> Study:
    """The full model and one model without each predictor, all in one job.

    The configuration is a key of the results (``excluded``). The kernel task takes the predictor out of its arrays, as many
    configurations as fit one call, so rows are copied only where the models are large enough to be worth a task each.
    Weights follow the shorter array and are drawn anew.
    """
    names = list(predictors)
    carry = [*axis.keys, axis.t] + ([date] if date else [])
    arrays = to_arrays(panel, target, names, carry)
    every = range(len(names))
    choices = {full: list(every)} | {name: [i for i in every if i != left] for left, name in enumerate(names)}
    return Study(arrays, config, axis.with_keys("excluded"), date, strict=strict, designs=Designs("excluded", choices))
