import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import (
    brute_ar1, brute_bootstrap, brute_forecasts, brute_momentum, brute_scores, brute_spanning, make_panel, month_end,
)
from panelgrid.config import CounterfactualConfig, StudyConfig
from panelgrid.guards import ContractError
from panelgrid.operators import counterfactual
from panelgrid.operators.blocks import MONTHS, TimeAxis
from panelgrid.operators.counterfactual import (
    amplitude, bootstrap_plan, calibrated_signal, drawn_paths, plant_signal, seeded_shocks, sign_stream, signs_of, wild_bootstrap,
)
from panelgrid.operators.windows import declining_weights
from panelgrid.plans import counterfactuals
from panelgrid.plans.counterfactuals import diagnostics, run_counterfactuals
from panelgrid.plans.study import run_study

NAMES = ("dp", "ltr", "dfr", "other")


def walk_panel(spark, n=80, d=3, seed=9, series=("a", "b")):
    rng = np.random.default_rng(seed)
    names = NAMES[:d]
    rows, arrays = [], {}
    for s in series:
        x = np.cumsum(rng.standard_normal((n, d)), axis=0) * 0.3
        arrays[s] = x
        rows += [(s, 1000 + t, *map(float, x[t])) for t in range(n)]
    schema = "series_id string, t long, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(rows, schema), arrays


@pytest.mark.parametrize("start,count", [(0, 10), (1, 9), (79, 80), (80, 3), (333, 62)])
def test_sign_stream_is_addressable(start, count):
    rng = np.random.default_rng(77)
    parts = [rng.choice(np.array([-1.0, 1.0]), size=79) for _ in range(5)]
    np.testing.assert_array_equal(sign_stream(77, start, count), np.concatenate(parts)[start : start + count])


@pytest.mark.parametrize("axis", [MONTHS, TimeAxis(block=7), TimeAxis(block=32), TimeAxis()])
def test_bootstrap_matches_recursion(spark, axis):
    panel, arrays = walk_panel(spark)
    got = wild_bootstrap(panel, NAMES[:3], (0, 4), axis, base_seed=100, tasks=5).toPandas()
    assert len(got) == 2 * 2 * 80
    for sid, x in arrays.items():
        for seed in (0, 4):
            g = got[(got.series_id == sid) & (got.seed == seed)].sort_values("t")
            np.testing.assert_allclose(np.stack(g["x"]), brute_bootstrap(x, 100 + seed), rtol=1e-7, atol=1e-8)


def test_bootstrap_keeps_innovation_sizes(spark):
    panel, arrays = walk_panel(spark, d=1, series=("a",))
    got = wild_bootstrap(panel, ("dp",), (1,), TimeAxis(block=16)).orderBy("t").toPandas()
    path, x = np.stack(got["x"])[:, 0], arrays["a"][:, 0]
    a, phi, _, _, resid = brute_ar1(x)
    np.testing.assert_allclose(np.abs(path[1:] - a - phi * path[:-1]), np.abs(resid), rtol=1e-6, atol=1e-8)
    assert path[0] == x[0]


def test_shocks_are_one_stream_however_they_are_handed_on(spark, monkeypatch):
    from panelgrid.operators import counterfactual

    panel, _ = make_panel(spark, n=50, series=("a", "b"))
    want = np.random.default_rng(12).standard_normal(50)
    for rows in (counterfactual.SHOCK_ROWS, 20):
        monkeypatch.setattr(counterfactual, "SHOCK_ROWS", rows)
        got = seeded_shocks(panel, 12).orderBy("series_id", "t").collect()
        np.testing.assert_array_equal([r["xi"] for r in got], np.tile(want, 2))


def signal_of(x, calibration):
    raw = 0.6 * np.cos(x[:, 0]) + 0.4 * np.sin(x[:, 1]) * np.sin(x[:, 2])
    return (raw - raw[:calibration].mean()) / raw[:calibration].std(ddof=1)


def test_planted_worlds(spark):
    panel, arrays = make_panel(spark, n=60, series=("a",))
    panel = panel.withColumnsRenamed({"x0": "dp", "x1": "ltr", "x2": "dfr"}).drop("y")
    x = arrays["a"][1]
    g = signal_of(x, 20)
    for axis in (MONTHS, TimeAxis(block=9)):
        shocks = seeded_shocks(panel, 12, axis)
        got = plant_signal(panel, shocks, {"easy": 0.2}, axis, calibration=20).toPandas()
        eps = np.random.default_rng(12).standard_normal(60)
        size = math.sqrt(0.2 / 0.8)
        for market, sign in (("plus", 1), ("minus", -1)):
            w = got[got.market == market].sort_values("t")
            np.testing.assert_allclose(w["g"], g, rtol=1e-9)
            np.testing.assert_allclose(w["truth"], size * g, rtol=1e-9)
            planted = np.concatenate([[0.0], g[:-1]])
            np.testing.assert_allclose(w["y"], eps + sign * size * planted, rtol=1e-8, atol=1e-10)
    head = calibrated_signal(panel.where("t < 40"), calibration=20).orderBy("t").toPandas()
    np.testing.assert_allclose(head["g"], g[:40], rtol=1e-9)  # a longer sample revises nothing


def test_signal_contracts(spark):
    panel, _ = make_panel(spark, n=30, series=("a",))
    with pytest.raises(ContractError, match="missing columns"):
        calibrated_signal(panel)
    flat = panel.withColumns({c: F.lit(1.0) for c in ("dp", "ltr", "dfr")})
    with pytest.raises(PySparkException, match="degenerate"):
        calibrated_signal(flat).collect()
    with pytest.raises(ValueError):
        calibrated_signal(flat, calibration=1)
    for share in (0.0, 1.0, float("nan")):
        with pytest.raises(ValueError):
            amplitude(share)
    for bad in (dict(n_seeds=0), dict(strengths={"x": 1.0}), dict(theta=(0.1,)), dict(innovation_variance=-1.0)):
        with pytest.raises(ValueError):
            CounterfactualConfig(**bad)


# --- the whole study against a loop -------------------------------------------------

N, T, P, CAL = 70, 12, 16, 20
PRED = (*NAMES, "own")


def raw_market(spark):
    rng = np.random.default_rng(31)
    x, y = rng.standard_normal((N, 4)), 0.05 * rng.standard_normal(N)
    rows = [("m", t, month_end(t), float(y[t]), *map(float, x[t]), float(y[t])) for t in range(N)]
    schema = "series_id string, t long, date date, ret double, " + ", ".join(f"{c} double" for c in PRED)
    return spark.createDataFrame(rows, schema), y, x


def standardized(y, x):
    scale = pd.Series(y).pow(2).rolling(12).mean().pow(0.5).shift(1).to_numpy()
    sd = np.column_stack([pd.Series(c).expanding(min_periods=20).std().shift(1) for c in x.T])
    return np.column_stack([x / sd, y / scale])[20:]


def loop(y, x, seeds, config):
    """The direct and twin designs by plain loops over seeds."""
    f1 = lambda g, r, s: brute_forecasts(g, r, s, T, (P,), (0.0,))[P, 0.0][0]
    xi = np.random.default_rng(config.simulation_seed).normal(scale=0.1, size=N + 2)
    y_rev = y + xi[2:] - 0.2 * xi[1:-1] - 0.2 * xi[:-2]
    orig, rev = standardized(y, x), standardized(y_rev, x)
    direct, direct_span = [], []
    shared = orig[:, :4]
    eps = np.random.default_rng(config.shock_seed).standard_normal(len(shared))
    g = signal_of(shared, CAL)
    rec, span, paths = [], [], []
    for s in seeds:
        designs = {
            "historical": (y[20:], orig),
            "ma2_reversal": (y_rev[20:], rev),
            "wild_bootstrap": (y[20:], brute_bootstrap(orig, config.bootstrap_seed + s)),
        }
        for name, (r, g_) in designs.items():
            f = f1(g_, r, s)
            bf, realized = brute_momentum(r, g_, T)
            direct.append(dict(experiment=name, strategy="RFF", **brute_scores(f, realized)))
            direct.append(dict(experiment=name, strategy="Volatility-timed momentum", **brute_scores(bf, realized)))
            direct_span.append(dict(experiment=name, **brute_spanning(f * realized, bf * realized, realized)))
        for strength, r2 in config.strengths.items():
            a = math.sqrt(r2 / (1 - r2))
            planted = np.concatenate([[0.0], a * g[:-1]])
            truth = a * g[T:-1]
            for design in ("x14_shared", "x15_world_lag"):
                fs = {}
                for market, sign in (("plus", 1), ("minus", -1)):
                    r = eps + sign * planted
                    g_ = shared if design == "x14_shared" else np.column_stack([shared, r])
                    fs[market] = f1(g_, r, s)
                    bf, realized = brute_momentum(r, g_, T)
                    m = brute_scores(fs[market], realized)
                    span.append(
                        dict(predictor_set=design, strength=strength, market=market, sharpe=m["sharpe"],
                             market_alpha=m["alpha"], market_information_ratio=m["information_ratio"],
                             **brute_spanning(fs[market] * realized, bf * realized, realized))
                    )
                got = 0.5 * (fs["plus"] - fs["minus"])
                slope, level = np.polyfit(truth, got, 1)
                rmse = np.sqrt(((got - truth) ** 2).mean())
                rec.append(
                    dict(predictor_set=design, strength=strength, correlation=np.corrcoef(got, truth)[0, 1],
                         slope=slope, intercept=level, rmse=rmse, nrmse=rmse / truth.std(), bias=(got - truth).mean())
                )
                paths += [
                    dict(predictor_set=design, strength=strength, oos_index=T + i, truth=truth[i], recovered=got[i])
                    for i in range(len(got))
                ]
    mean = lambda rows, keys: pd.DataFrame(rows).groupby(keys).mean(numeric_only=True).sort_index()
    return {
        "counterfactuals": mean(direct, ["experiment", "strategy"]),
        "counterfactual_spanning": mean(direct_span, ["experiment"]),
        "twin_recovery": mean(rec, ["predictor_set", "strength"]),
        "twin_spanning": mean(span, ["predictor_set", "strength", "market"]),
        "twin_paths": mean(paths, ["predictor_set", "strength", "oos_index"]),
    }


def test_counterfactual_study_matches_loops(spark, tmp_path):
    raw, y, x = raw_market(spark)
    config = CounterfactualConfig(window=T, anchor_p=P, n_seeds=2, calibration=CAL, chunk=16, tasks=4)
    result = run_counterfactuals(
        raw, config, "ret", PRED, "own", "2000-12", TimeAxis(block=25), check=True, min_periods=20
    )
    want = loop(y, x, range(2), config)
    for name, frame in want.items():
        got = getattr(result, name).toPandas().set_index(list(frame.index.names)).sort_index()
        assert len(got) == len(frame), name
        assert (got["n_seeds"] == 2).all() and (got["T"] == T).all() and (got["P"] == P).all()
        for c in frame.columns:
            np.testing.assert_allclose(got[c], frame[c], rtol=1e-5, atol=1e-7, err_msg=f"{name}.{c}")
    stored = result.write(str(tmp_path), "2024-12")
    assert (tmp_path / "twin_paths_2024-12.parquet").exists()
    assert stored["twin_paths"].count() == len(want["twin_paths"])


def test_diagnostics_of_an_export(spark):
    panel, arrays = make_panel(spark, n=50, series=("a",), with_date=True)
    y, x = arrays["a"]
    predictors = ("x0", "x1", "x2")
    config = StudyConfig(p_grid=(2, 16), z_grid=(1.0,), seeds=(0, 1), chunk=20, tasks=4)
    export = run_study(panel, config, "y", predictors, date="date").export()
    got = diagnostics(export, panel, "y", predictors)
    paths = [brute_forecasts(x, y, s, 12, (16,), (0.0,))[16, 0.0][0] for s in (0, 1)]
    bench, realized = brute_momentum(y, x)
    metrics = got.metrics.toPandas().set_index("strategy")
    model = pd.DataFrame([brute_scores(f, realized) for f in paths]).mean()
    for c, v in model.items():
        assert math.isclose(metrics.loc["RFF (ridgeless)", c], v, rel_tol=1e-6), c
    for c, v in brute_scores(bench, realized).items():
        assert math.isclose(metrics.loc["Volatility-timed momentum", c], v, rel_tol=1e-6), c
    assert list(metrics["n_seeds"].sort_values()) == [1, 2]
    span = got.spanning.first().asDict()
    for c, v in pd.DataFrame([brute_spanning(f * realized, bench * realized, realized) for f in paths]).mean().items():
        assert math.isclose(span[c], v, rel_tol=1e-6), c
    mean = np.mean(paths, axis=0)
    steps = np.arange(12, 49)
    design = np.column_stack([np.ones(37), y[steps[:, None] - np.arange(12)]])
    coef = np.linalg.lstsq(design, mean, rcond=None)[0]
    anatomy = got.anatomy.orderBy("lag").toPandas()
    np.testing.assert_allclose(anatomy["projection_weight"], coef[1:], rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(anatomy["benchmark_weight"], declining_weights(12))
    assert list(anatomy["lag"]) == list(range(1, 13))
    assert math.isclose(span["anatomy_r2"], 1 - (mean - design @ coef).var() / mean.var(), rel_tol=1e-6)
    short = export.where(F.col("obs") < F.lit("1933-06-30").cast("date"))
    with pytest.raises(ContractError, match="out-of-sample"):
        diagnostics(short, panel, "y", predictors)


def test_series_are_drawn_together_and_share_their_signs(monkeypatch):
    rng = np.random.default_rng(12)
    lengths, seeds = (30, 17, 30, 1, 25), (0, 1, 2)
    steps = np.concatenate([np.arange(n) + (40 if i == 4 else 0) for i, n in enumerate(lengths)])
    x, first = rng.standard_normal((len(steps), 2)), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    state = rng.standard_normal((3, 2))
    plans = [
        dict(phi=[0.5 + 0.05 * i, 0.1], intercept=[0.2, 0.01 * i], t_min=0, n=65 if i == 4 else n, start=state.ravel() if i == 4 else None)
        for i, n in enumerate(lengths)
    ]
    asked = []
    monkeypatch.setattr(counterfactual, "signs_of", lambda *a: asked.append(a) or signs_of(*a))
    found = drawn_paths(x, steps, first, plans, seeds, 9)
    assert len(asked) == 3  # one draw for the two series of 30 rows
    for i, n in enumerate(lengths):
        own = slice(first[i], first[i] + n)
        start, phi, level = int(steps[first[i]]), np.array(plans[i]["phi"]), np.array(plans[i]["intercept"])
        for k, seed in enumerate(seeds):
            path = [state[k] if i == 4 else x[first[i]]]
            for t in range(1, n):
                signs = [sign_stream(9 + seed, j * (plans[i]["n"] - 1) + start + t - 1, 1)[0] for j in range(2)]
                path.append(level + (x[own][t] - level - phi * x[own][t - 1]) * signs + phi * path[-1])
            np.testing.assert_array_equal(found[k, own], path)
    plans[4]["start"] = None
    with pytest.raises(ValueError, match="no state"):
        drawn_paths(x, steps, first, plans, seeds, 9)


def test_only_the_results_asked_for_are_worked_out(spark, monkeypatch):
    """Mean paths read neither the reversed panel nor the worlds' summaries, and a step seen by one task is not grouped again."""
    raw = raw_market(spark)[0]
    config = CounterfactualConfig(window=T, anchor_p=2, n_seeds=2, calibration=CAL, tasks=4)
    arguments = (raw, config, "ret", PRED, "own", "2000-12", TimeAxis(block=25))
    whole = run_counterfactuals(*arguments, min_periods=20)
    one = run_counterfactuals(*arguments, min_periods=20, results=["twin_paths"])
    stored = []
    keep = counterfactuals.materialize
    monkeypatch.setattr(counterfactuals, "materialize", lambda df: stored.append(df.columns) or keep(df))
    found = one.twin_paths
    assert len(stored) == 2  # the panel and the paths
    assert one.twins.where("seed IS NOT NULL").isEmpty()
    key = ["series_id", "predictor_set", "strength", "oos_index"]
    frames = [df.toPandas().sort_values(key).reset_index(drop=True) for df in (found, whole.twin_paths)]
    pd.testing.assert_frame_equal(*frames)
    with pytest.raises(ValueError, match="not among"):
        one.twin_recovery


def test_one_experiment_prepares_no_panel_of_another(spark, monkeypatch):
    config = CounterfactualConfig(window=T, anchor_p=2, n_seeds=2, calibration=CAL, tasks=4)
    arguments = (raw_market(spark)[0], config, "ret", PRED, "own", "2000-12", TimeAxis(block=25))
    whole = run_counterfactuals(*arguments, min_periods=20).counterfactual_spanning.where("experiment = 'wild_bootstrap'").toPandas()
    stored, keep = [], counterfactuals.materialize
    monkeypatch.setattr(counterfactuals, "materialize", lambda df: stored.append(df.columns) or keep(df))
    one = run_counterfactuals(*arguments, min_periods=20, experiments=["wild_bootstrap"])
    pd.testing.assert_frame_equal(one.counterfactual_spanning.toPandas(), whole)
    assert len(stored) == 2  # the panel and the summaries, no reversed panel
    with pytest.raises(ValueError, match="experiments are"):
        run_counterfactuals(*arguments, min_periods=20, experiments=["other"]).counterfactual_spanning
