"""Contracts that are checked on the pass that computes the result."""

import pytest
from pyspark.sql import functions as F

from panelgrid.config import StudyConfig
from panelgrid.guards import ContractError
from panelgrid.operators.blocks import MONTHS
from panelgrid.operators.scoring import anchor_by_seed
from panelgrid.operators.standardize import standardize_panel
from panelgrid.operators.tidy import lookup
from panelgrid.plans.study import run_study
from panelgrid.sources.sinks import materialize_counted
from tests.helpers import make_panel

X = ("x0", "x1", "x2")
CONFIG = StudyConfig(p_grid=(2,), seeds=(1,))


def counted(df):
    """``df`` and an accumulator of the rows that were computed of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def through(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return df.mapInPandas(through, df.schema), seen


def test_counts_are_observed_while_writing(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")))
    once, seen = counted(df)
    stored, counts = materialize_counted(once, {"lost": F.col("v").isNull(), "big": F.col("v") > 96})
    assert counts == {"n_rows": 100, "lost": 10, "big": 3}
    assert stored.count() == 100 and seen.value == 100
    for none in (df.where("id < 0"), df.where("false")):
        assert materialize_counted(none, {"lost": F.col("v").isNull()})[1] == {"n_rows": 0, "lost": 0}


def test_a_checked_panel_is_computed_once(spark):
    panel, _ = make_panel(spark, n=80)
    once, seen = counted(panel)
    got = standardize_panel(once, "y", X, MONTHS)
    assert got.count() == standardize_panel(panel, "y", X, MONTHS, check=False).count()
    assert got.toPandas().notna().all().all() and seen.value == panel.count()
    with pytest.raises(ContractError, match="gaps"):
        standardize_panel(panel.withColumn("x1", F.when(F.col("t") != 60, F.col("x1"))), "y", X, MONTHS)


@pytest.mark.parametrize("mode", ["raise", "skip"])
def test_a_checked_study_reads_its_panel_once(spark, mode):
    panel, _ = make_panel(spark, n=40)
    once, seen = counted(panel)
    study = run_study(once, CONFIG, "y", X, on_bad_series=mode)
    plain = run_study(panel, CONFIG, "y", X, on_bad_series="trust")
    assert sorted(map(tuple, study.per_seed.collect())) == sorted(map(tuple, plain.per_seed.collect()))
    assert seen.value == panel.count()


@pytest.mark.parametrize("cell", [None, float("nan"), float("inf"), float("-inf")])
@pytest.mark.parametrize("column", ["y", "x1"])
def test_bad_cells_are_named(spark, cell, column):
    panel, _ = make_panel(spark, n=40)
    bad = panel.withColumn(column, F.when(F.col("t") == 20, F.lit(cell).cast("double")).otherwise(F.col(column)))
    with pytest.raises(ContractError, match="non-finite"):
        run_study(bad, CONFIG, "y", X)


def test_lazy_forecasts_are_solved_once(spark):
    rows = [("s", seed, p, z, obs, 0.1 * obs) for seed in (0, 1) for p in (2, 8) for z in (0.0, 1.0) for obs in range(5)]
    df = spark.createDataFrame(rows, "series_id string, seed long, P int, z double, obs long, forecast double")
    once, seen = counted(df)
    got = anchor_by_seed(once)
    assert sorted((r["seed"], r["P"], r["z"], r["obs"]) for r in got.collect()) == [(s, 8, 0.0, o) for s in (0, 1) for o in range(5)]
    assert seen.value == len(rows)
    with pytest.raises(ContractError, match="no rows"):
        anchor_by_seed(df.where("z > 0"))
    with pytest.raises(ContractError, match="not unique"):
        anchor_by_seed(df.unionByName(df.where("obs = 3")))


def test_a_lookup_joins_once_and_names_lost_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(1, 0.5), (2, None)], "k long, w double")
    once, seen = counted(left)
    assert sorted(map(tuple, lookup(once, right, ["k"], ["w"]).collect())) == [(1, "a", 0.5), (2, "b", None)]
    assert seen.value == 2
    with pytest.raises(ContractError, match="no match"):
        lookup(left, right.where("k = 1"), ["k"], ["w"])
