import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from helpers import brute_forecasts, brute_scores, by_cell, make_panel
from panelgrid.config import StudyConfig
from panelgrid.guards import ContractError
from panelgrid.operators import engine
from panelgrid.operators.blocks import TimeAxis
from panelgrid.operators.engine import rolling_forecasts, to_arrays
from panelgrid.operators.scoring import importance
from panelgrid.plans.study import anchor_study, leave_one_out, run_study

CONFIG = StudyConfig(p_grid=(2, 8, 96), z_grid=(1e-2, 1.0), seeds=(707, 708), chunk=1000, tasks=4)
X = ("x0", "x1", "x2")


def collect(df):
    return df.toPandas()


def test_forecasts_match_brute_force(spark):
    panel, arrays = make_panel(spark)
    got = collect(rolling_forecasts(to_arrays(panel, "y", X, ("series_id", "t")), CONFIG))
    assert len(got) == 2 * 2 * 3 * 3 * (60 - 13)
    for sid, (y, x) in arrays.items():
        for seed in CONFIG.seeds:
            brute = brute_forecasts(x, y, seed, 12, CONFIG.p_grid, CONFIG.z_labels)
            for (p, z), g in by_cell(got[(got.series_id == sid) & (got.seed == seed)], ("P", "z")).items():
                np.testing.assert_array_equal(g["t"], np.arange(12, 59))
                np.testing.assert_allclose(g["forecast"], brute[p, z][0], rtol=1e-7, atol=1e-9)
                np.testing.assert_allclose(g["beta_norm"], brute[p, z][1], rtol=1e-7, atol=1e-9)
                np.testing.assert_array_equal(g["realized"], y[13:])


@pytest.mark.parametrize("chunk,per_task,tasks", [(1, 1, 7), (5, 2, 3), (17, 1, 4)])
def test_chunks_blocks_and_tasks_do_not_change_results(spark, chunk, per_task, tasks):
    panel, _ = make_panel(spark, n=40)
    arrays = to_arrays(panel, "y", X, ("series_id", "t"))
    order = ["series_id", "seed", "P", "z", "t"]
    base = collect(rolling_forecasts(arrays, CONFIG)).sort_values(order, ignore_index=True)
    other_config = CONFIG.with_(chunk=chunk, seeds_per_task=per_task, tasks=tasks)
    other = collect(rolling_forecasts(arrays, other_config)).sort_values(order, ignore_index=True)
    assert base[order].equals(other[order])
    np.testing.assert_allclose(base["forecast"], other["forecast"], rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose(base["beta_norm"], other["beta_norm"], rtol=1e-8, atol=1e-10)


def test_no_lookahead_across_chunk_borders(spark):
    panel, _ = make_panel(spark, n=50, series=("a",))
    cut = 31
    shifted = panel.withColumns(
        {c: F.when(F.col("t") >= cut, F.col(c) + 5.0).otherwise(F.col(c)) for c in ("y", *X)}
    )
    config = CONFIG.with_(chunk=8, seeds=(1,), p_grid=(8,), z_grid=(1.0,), ridgeless=False)
    run = lambda df: collect(
        rolling_forecasts(to_arrays(df, "y", X, ("series_id", "t")), config)
    ).set_index("t")["forecast"].sort_index()
    before, after = run(panel), run(shifted)
    # row 31 carries new predictors and a new training return; decisions before it do not
    np.testing.assert_allclose(before[before.index < cut], after[after.index < cut], rtol=1e-10)
    assert (np.abs(before[before.index >= cut] - after[after.index >= cut]) > 1e-8).all()


def test_dates_label_the_forecast_row(spark):
    panel, _ = make_panel(spark, n=30, series=("a",), with_date=True)
    config = CONFIG.with_(seeds=(1,), p_grid=(2,), z_grid=(1.0,), ridgeless=False, chunk=7)
    got = collect(rolling_forecasts(to_arrays(panel, "y", X, ("series_id", "t", "date")), config, date="date"))
    dates = dict(panel.select("t", "date").collect())
    assert all(row.obs == dates[row.t + 1] for row in got.itertuples())


def test_study_scores_and_averages(spark):
    panel, arrays = make_panel(spark)
    study = run_study(panel, CONFIG, "y", X)
    per_seed = collect(study.per_seed)
    assert len(per_seed) == 2 * 2 * 9
    assert not per_seed.duplicated(["series_id", "seed", "P", "z"]).any()
    assert np.isfinite(per_seed.select_dtypes("number")).all().all()
    y, x = arrays["a"]
    brute = brute_forecasts(x, y, 707, 12, CONFIG.p_grid, CONFIG.z_labels)
    for (p, z), (f, b) in brute.items():
        row = per_seed[(per_seed.series_id == "a") & (per_seed.seed == 707) & (per_seed.P == p) & (per_seed.z == z)]
        for name, value in brute_scores(f, y[13:], b).items():
            np.testing.assert_allclose(row[name].iloc[0], value, rtol=1e-6, atol=1e-9)
        assert row["c"].iloc[0] == p / 12
    averaged = collect(study.averaged).set_index(["series_id", "P", "z"]).sort_index()
    mean = per_seed.groupby(["series_id", "P", "z"]).mean(numeric_only=True).drop(columns="seed")
    np.testing.assert_allclose(averaged[mean.columns], mean.sort_index(), rtol=1e-10)


def test_default_predictors_and_positions(spark):
    panel, _ = make_panel(spark, n=30, series=("a",))
    config = CONFIG.with_(seeds=(1,), p_grid=(8,))
    named = collect(run_study(panel, config, "y", X).per_seed)
    found = collect(run_study(panel, config, "y").per_seed)
    np.testing.assert_allclose(named.sort_values("z")["sharpe"], found.sort_values("z")["sharpe"], rtol=1e-12)
    start = panel.groupBy("series_id").agg(F.min("t").alias("t_min"))
    export = collect(run_study(panel, config, "y").export(start))
    assert sorted(export["obs"].unique()) == list(range(30 - 13))
    np.testing.assert_allclose(export["strategy"], export["forecast"] * export["realized"])


def test_export_agrees_with_scores(spark):
    panel, _ = make_panel(spark, n=40, series=("a",), with_date=True)
    study = run_study(panel, CONFIG.with_(p_grid=(8,)), "y", X, date="date")
    export, per_seed = collect(study.export()), collect(study.per_seed)
    for (seed, z), g in export.groupby(["seed", "z"]):
        sharpe = np.sqrt(12) * g["strategy"].mean() / g["strategy"].std(ddof=0)
        row = per_seed[(per_seed.seed == seed) & (per_seed.z == z)]
        np.testing.assert_allclose(row["sharpe"].iloc[0], sharpe, rtol=1e-9)


def test_anchor_study_has_two_cells(spark):
    panel, _ = make_panel(spark, n=30, series=("a",))
    rows = collect(anchor_study(panel, CONFIG, "y", X, p=64).per_seed)
    assert set(zip(rows.P, rows.z)) == {(64, 1000.0), (64, 0.0)}


def test_leave_one_out_matches_separate_runs(spark):
    panel, _ = make_panel(spark, n=40, series=("a",))
    config = CONFIG.with_(p_grid=(8,), z_grid=(1.0,), ridgeless=False)
    study = leave_one_out(panel, config, "y", X)
    got = collect(study.per_seed)
    assert set(got["excluded"]) == {"none", *X}
    alone = collect(run_study(panel, config, "y", ("x0", "x2")).per_seed)
    mine = got[got.excluded == "x1"].sort_values("seed")
    np.testing.assert_allclose(mine["r2"], alone.sort_values("seed")["r2"], rtol=1e-9)
    vi = collect(importance(study.per_seed)).set_index("variable")
    means = got.groupby("excluded")["r2"].mean()
    np.testing.assert_allclose(vi.loc["x1", "vi_r2"], means["none"] - means["x1"], rtol=1e-9)
    assert (vi["n_seeds"] == 2).all()


def test_shared_features_for_several_targets(spark):
    panel, _ = make_panel(spark, n=40, series=("a",))
    panel = panel.withColumn("v", F.sin("t"))
    config = CONFIG.with_(p_grid=(8,), seeds=(1,))
    two = collect(
        rolling_forecasts(to_arrays(panel, ["y", "v"], X, ("series_id", "t")), config, targets=["y", "v"])
    )
    for name in ("y", "v"):
        one = collect(rolling_forecasts(to_arrays(panel, name, X, ("series_id", "t")), config))
        mine = two[two.target == name].sort_values(["z", "t"])
        np.testing.assert_allclose(mine["forecast"], one.sort_values(["z", "t"])["forecast"], rtol=1e-9)


def test_seed_as_a_key(spark):
    panel, _ = make_panel(spark, n=40, series=("a",))
    copies = panel.withColumn("seed", F.explode(F.array(F.lit(3), F.lit(4)).cast("array<long>")))
    config = CONFIG.with_(p_grid=(8,), seeds=(3, 4))
    keyed = TimeAxis(("series_id", "seed"))
    a = collect(
        rolling_forecasts(to_arrays(copies, "y", X, ("series_id", "seed", "t")), config, keyed, seed_key="seed")
    )
    b = collect(rolling_forecasts(to_arrays(panel, "y", X, ("series_id", "t")), config))
    order = ["seed", "z", "t"]
    np.testing.assert_allclose(a.sort_values(order)["forecast"], b.sort_values(order)["forecast"], rtol=1e-12)


def test_bad_series_raise_or_are_skipped(spark):
    panel, _ = make_panel(spark, n=30, series=("good", "hole", "short", "nan"))
    bad = panel.where(
        ~((F.col("series_id") == "hole") & (F.col("t") == 9))
        & ~((F.col("series_id") == "short") & (F.col("t") > 10))
    ).withColumn(
        "x1",
        F.when((F.col("series_id") == "nan") & (F.col("t") == 5), F.lit(float("nan"))).otherwise(F.col("x1")),
    )
    config = CONFIG.with_(p_grid=(2,), seeds=(1,))
    with pytest.raises(ContractError, match="rejected"):
        run_study(bad, config, "y", X)
    study = run_study(bad, config, "y", X, on_bad_series="skip")
    reasons = {r["series_id"]: r["reason"] for r in study.rejected.collect()}
    assert set(reasons) == {"hole", "short", "nan"}
    assert "gap" in reasons["hole"] and "fewer" in reasons["short"] and "finite" in reasons["nan"]
    assert {r["series_id"] for r in study.per_seed.collect()} == {"good"}
    with pytest.raises(PythonException, match="consecutive"):
        run_study(bad.where("series_id = 'hole'"), config, "y", X, on_bad_series="trust").forecasts.collect()
    with pytest.raises(PythonException, match="finite"):
        run_study(bad.where("series_id = 'nan'"), config, "y", X, on_bad_series="trust").forecasts.collect()


@pytest.mark.parametrize(
    "bad",
    [
        dict(window=0),
        dict(window=2.5),
        dict(window=1),
        dict(p_grid=(3,)),
        dict(p_grid=()),
        dict(p_grid=(2.5,)),
        dict(p_grid=(0, 2)),
        dict(z_grid=(0.0,)),
        dict(z_grid=(float("inf"),)),
        dict(z_grid=(-1.0,)),
        dict(z_grid=(), ridgeless=False),
        dict(seeds=()),
    ],
)
def test_config_rules(bad):
    with pytest.raises(ValueError):
        StudyConfig(**bad)


def test_config_normalises_grids():
    c = StudyConfig(p_grid=(8, 2, 8), z_grid=(1.0, 0.1, 1.0), seeds=(3, 1, 3), window=12.0)
    assert (c.p_grid, c.z_grid, c.seeds, c.window) == ((2, 8), (1.0, 0.1), (3, 1), 12)
    assert c.z_labels == (1.0, 0.1, 0.0)
    assert StudyConfig(window=1, uncentered=True).window == 1


def test_importance_runs_the_kernel_once(spark):
    panel, _ = make_panel(spark, n=40)
    study = leave_one_out(panel, CONFIG.with_(z_grid=(1.0,)), "y", X, strict=False)
    plan = importance(study.per_seed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_small_designs_share_a_task_and_large_ones_have_their_own(spark, monkeypatch):
    panel, _ = make_panel(spark, n=40)
    config = CONFIG.with_(p_grid=(8,), z_grid=(1.0,), ridgeless=False)
    study = leave_one_out(panel, config, "y", X, strict=False)
    dealt, keep = [], engine.chunked_panel
    monkeypatch.setattr(engine, "chunked_panel", lambda *a, **k: dealt.append(keep(*a, **k)[0]) or keep(*a, **k))
    order = ["series_id", "excluded", "seed"]
    together = collect(study.per_seed).sort_values(order, ignore_index=True)
    assert dealt[0].select(engine.SEED_BLOCK).distinct().count() == 1  # no row is copied for a configuration
    monkeypatch.setattr(engine, "TASK_FEATURES", 1)
    single = leave_one_out(panel, config.with_(seeds_per_task=1), "y", X, strict=False)
    apart = collect(single.per_seed).sort_values(order, ignore_index=True)
    assert dealt[1].count() == dealt[0].count() * len(config.seeds) * (len(X) + 1)
    pd.testing.assert_frame_equal(together, apart)
