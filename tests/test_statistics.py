import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import brute_ar1, brute_scores, brute_spanning, make_panel
from panelgrid.functions import metrics
from panelgrid.guards import ContractError
from panelgrid.operators import scoring
from panelgrid.operators.blocks import MONTHS, TimeAxis
from panelgrid.operators.regressions import (
    ar1_residuals, ar1_table, fit_ar1, forecast_anatomy, pair_worlds, recovery, spanning,
)
from panelgrid.operators.windows import declining_weights
from panelgrid.plans.reports import summary_panel


def frame(spark, columns):
    rows = list(zip(*[map(float, v) for v in columns.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


def test_hand_values(spark):
    realized = [1.0, -1.0, 1.0, -1.0]
    df = frame(spark, {"forecast": [0.5 * v for v in realized], "realized": realized})
    r2 = df.agg(metrics.oos_r2(F.col("forecast"), F.col("realized"))).first()[0]
    assert math.isclose(r2, 0.75)
    constant = df.agg(metrics.oos_r2(F.lit(3.0), F.col("realized"))).first()[0]
    assert math.isclose(constant, 0.0, abs_tol=1e-12)
    sharpe = frame(spark, {"r": [1.0, 3.0]}).agg(metrics.sharpe_ratio(F.col("r"))).first()[0]
    assert math.isclose(sharpe, math.sqrt(12) * 2.0)


def test_scores_match_least_squares(spark):
    rng = np.random.default_rng(0)
    f, y = rng.standard_normal(80), rng.standard_normal(80)
    df = frame(spark, {"forecast": f, "realized": y, "beta_norm": np.abs(f)}).withColumn("k", F.lit("a"))
    got = scoring.score(df, ["k"], beta_norm="beta_norm").first().asDict()
    for name, value in brute_scores(f, y, np.abs(f)).items():
        assert math.isclose(got[name], value, rel_tol=1e-9), name
    plain = scoring.score(df, ["k"]).first().asDict()
    assert "beta_norm" not in plain and plain["sharpe"] == got["sharpe"]
    quarterly = scoring.score(df, ["k"], periods=4).first()
    assert math.isclose(quarterly["sharpe"], brute_scores(f, y, periods=4)["sharpe"], rel_tol=1e-9)
    exact = scoring.score_by_residuals(df, ["k"]).first()
    assert math.isclose(exact["alpha_tstat"], got["alpha_tstat"], rel_tol=1e-9)


def test_scores_of_chunks_merge(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, {"forecast": rng.standard_normal(500), "realized": 5 + rng.standard_normal(500)})
    df = df.withColumn("k", F.lit(1))
    one, many = (scoring.score(df.repartition(n), ["k"]).first() for n in (1, 13))
    np.testing.assert_allclose(list(one), list(many), rtol=1e-9)


def test_undefined_scores_raise_or_are_null(spark):
    flat = frame(spark, {"forecast": [1.0, 2.0, 3.0], "realized": [2.0, 2.0, 2.0]}).withColumn("k", F.lit(1))
    short = flat.where("forecast < 3").withColumn("realized", F.col("forecast"))
    for bad in (flat, short):
        with pytest.raises(PySparkException, match="at least 3 rows"):
            scoring.score(bad, ["k"]).collect()
        assert scoring.score(bad, ["k"], strict=False).first()["alpha"] is None


def per_seed_frame(spark):
    rows = [("a", s, p, z, float(s + p) * (1 + z), float(s)) for s in (1, 2, 5) for p in (2, 12) for z in (0.0, 1.0)]
    return spark.createDataFrame(rows, "series_id string, seed long, P int, z double, r2 double, sharpe double")


def test_averages_and_seed_counts(spark):
    df = per_seed_frame(spark)
    means = scoring.average_statistics(df, ["P", "z"]).toPandas()
    want = df.toPandas().groupby(["P", "z"])[["r2", "sharpe"]].mean()
    got = means.set_index(["P", "z"]).sort_index()
    np.testing.assert_allclose(got[["r2", "sharpe"]], want)
    counted = scoring.average_with_seed_count(df.unionByName(df), ["P", "z"]).toPandas()
    assert (counted["n_seeds"] == 3).all()
    np.testing.assert_allclose(counted.set_index(["P", "z"]).sort_index()[["r2", "sharpe"]], want)
    extra = scoring.average_statistics(df.withColumn("turnover", F.lit(2.0)), ["P", "z"])
    assert "turnover" in extra.columns  # added statistics flow through


def test_anchor_rules(spark):
    df = per_seed_frame(spark).withColumn("target", F.when(F.col("P") == 2, "x").otherwise("y"))
    assert {(r["P"], r["z"]) for r in scoring.anchor_rows(df).collect()} == {(12, 0.0)}
    each = {(r["target"], r["P"]) for r in scoring.anchor_rows(df, by=["target"]).collect()}
    assert each == {("x", 2), ("y", 12)}
    export = df.withColumn("obs", F.lit(1)).select("series_id", "seed", "P", "z", "obs")
    assert scoring.anchor_by_seed(export).count() == 3
    with pytest.raises(ContractError, match="no rows"):
        scoring.anchor_by_seed(export.where("z > 0"))
    with pytest.raises(ContractError, match="not unique"):
        scoring.anchor_by_seed(export.unionByName(export))
    expected = spark.createDataFrame([("a", 2)], "series_id string, n_oos long")
    with pytest.raises(ContractError, match="out-of-sample"):
        scoring.require_full_paths(scoring.anchor_by_seed(export), expected)


def test_importance_ranks_losses(spark):
    rows = [(e, s, r, r) for s in (0, 1) for e, r in (("none", 0.5), ("u", 0.1), ("v", 0.45), ("w", 0.6))]
    df = spark.createDataFrame(rows, "excluded string, seed long, r2 double, sharpe double").withColumn(
        "series_id", F.lit("a")
    )
    top = scoring.leaders(scoring.importance(df), 2).collect()
    assert [r["variable"] for r in top] == ["u", "v"]
    assert math.isclose(top[0]["vi_r2"], 0.4) and top[0]["n_seeds"] == 2


def test_spanning_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    b, m = rng.standard_normal(90), 0.3 + rng.standard_normal(90)
    y = 0.1 + 0.5 * b - 0.2 * m + 0.1 * rng.standard_normal(90)
    df = frame(spark, {"strategy": y, "benchmark": b, "realized": m}).withColumn("k", F.lit(1))
    got = spanning(df, ["k"]).first().asDict()
    for name, value in brute_spanning(y, b, m).items():
        assert math.isclose(got[name], value, rel_tol=1e-8), name
    collinear = spanning(df.withColumn("benchmark", 2 * F.col("realized")), ["k"]).first()
    for name, value in brute_spanning(y, 2 * m, m).items():  # the shortest coefficients
        assert math.isclose(collinear[name], value, rel_tol=1e-8), name


@pytest.mark.parametrize("axis", [MONTHS, TimeAxis(block=9)])
def test_anatomy_recovers_weights(spark, axis):
    panel, arrays = make_panel(spark, n=150, series=("a",))
    y, _ = arrays["a"]
    w = np.array(declining_weights(12))
    f = [(int(t), float(0.3 + y[t - np.arange(12)] @ w)) for t in range(12, 149)]
    made = spark.createDataFrame([("a", *r) for r in f], "series_id string, t long, forecast double")
    got = forecast_anatomy(made, panel, "y", axis).first()
    np.testing.assert_allclose(got["lag_weights"], w, atol=1e-9)
    assert math.isclose(got["intercept"], 0.3, abs_tol=1e-9) and math.isclose(got["r2"], 1.0, abs_tol=1e-9)
    flat = forecast_anatomy(made.withColumn("forecast", F.lit(1.0)), panel, "y", axis).first()
    assert flat["r2"] is None


@pytest.mark.parametrize("axis", [MONTHS, TimeAxis(block=9)])
def test_ar1_matches_least_squares(spark, axis):
    rng = np.random.default_rng(8)
    walk = np.cumsum(rng.standard_normal((50, 2)), axis=0)
    panel = spark.createDataFrame(
        [("a", t, float(walk[t, 0]), float(walk[t, 1])) for t in range(50)], "series_id string, t long, u double, v double"
    )
    fits = fit_ar1(panel, ("u", "v"), axis)
    table = ar1_table(fits, ("u", "v"), axis).toPandas().set_index("predictor")
    resid = ar1_residuals(panel, fits, ("u", "v"), axis).orderBy("t").toPandas()
    assert len(resid) == 49
    for j, c in enumerate(("u", "v")):
        a, phi, a_ols, p_ols, e = brute_ar1(walk[:, j])
        for name, value in (("intercept", a), ("phi", phi), ("intercept_ols", a_ols), ("phi_ols", p_ols)):
            assert math.isclose(table.loc[c, name], value, rel_tol=1e-8), name
        np.testing.assert_allclose(resid[c], e, rtol=1e-8, atol=1e-10)
    raw = fit_ar1(panel, ("u",), axis, bias_adjust=False).first()
    assert raw["phi"] == raw["phi_ols"]
    assert fit_ar1(panel, ("u",), axis, bound=0.5).first()["phi"][0] == 0.5
    with pytest.raises(PySparkException, match="five rows"):
        fit_ar1(panel.where("t < 4"), ("u",), axis).collect()
    with pytest.raises(ValueError):
        fit_ar1(panel, ("u",), axis, bound=2.0)


def test_recovery_hand_values(spark):
    truth = np.linspace(-2, 2, 101)
    shared = np.sin(np.arange(101))
    rows = [(t, m, float(s * (1.5 * v + 0.25) + c), float(v)) for t, (v, c) in enumerate(zip(truth, shared)) for m, s in (("plus", 1), ("minus", -1))]
    df = spark.createDataFrame(rows, "t long, market string, forecast double, truth double").withColumn("k", F.lit(1))
    got = recovery(pair_worlds(df, ["k", "t"]), ["k"]).first()
    assert math.isclose(got["correlation"], 1.0, rel_tol=1e-9)
    assert math.isclose(got["slope"], 1.5, rel_tol=1e-9) and math.isclose(got["intercept"], 0.25, rel_tol=1e-9)
    error = 0.5 * truth + 0.25
    assert math.isclose(got["nrmse"], np.sqrt((error**2).mean()) / truth.std(), rel_tol=1e-9)
    assert math.isclose(got["bias"], 0.25, rel_tol=1e-9)
    with pytest.raises(PySparkException, match="recovery needs"):
        recovery(df.select("k", F.lit(1.0).alias("recovered"), F.lit(0.0).alias("truth")), ["k"]).collect()


def test_summary_matches_pandas(spark):
    panel, arrays = make_panel(spark, n=50, series=("a",))
    panel = panel.withColumn("x0", F.when(F.col("t") >= 5, F.col("x0")))
    for axis in (MONTHS, TimeAxis(block=8)):
        got = summary_panel(panel, ("y", "x0"), axis, {"y": "target"}).toPandas().set_index("variable")
        for name, s in (("target", pd.Series(arrays["a"][0])), ("x0", pd.Series(arrays["a"][1][5:, 0]))):
            want = [len(s), s.mean(), s.std(), s.min(), s.max(), s.autocorr(1)]
            np.testing.assert_allclose(got.loc[name, ["count", "mean", "sd", "min", "max", "ac1"]].astype(float), want, rtol=1e-9)


def test_summary_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, None if t in (7, 15, 16, 23) else float(rng.standard_normal())) for k in "ab" for t in range(32) if t != 11]
    panel = spark.createDataFrame(rows, "series_id string, t long, y double")
    found = [
        {(r["series_id"], r["variable"]): r["ac1"] for r in summary_panel(panel, ("y",), TimeAxis(block=block)).collect()}
        for block in (None, 8, 16, 4096)
    ]
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-12)
    left = [v for k, t, v in rows if k == "a" and v is not None]
    assert found[0]["a", "y"] == pytest.approx(np.corrcoef(left[1:], left[:-1])[0, 1])


def test_each_series_has_its_own_largest_model(spark):
    rows = [("a", 0, p, 0.0, t, 0.1, 0.2) for p in (2, 12) for t in range(3)] + [("b", 0, 2, 0.0, t, 0.1, 0.2) for t in range(3)]
    df = spark.createDataFrame(rows, "series_id string, seed long, P int, z double, obs long, forecast double, realized double")
    assert {(r["series_id"], r["P"]) for r in scoring.anchor_by_seed(df).collect()} == {("a", 12), ("b", 2)}


@pytest.mark.parametrize("noise", [1e-3, 1e-6, 1e-8])
def test_nearly_spanned_strategies_keep_their_digits(spark, noise):
    from fractions import Fraction

    t = np.arange(60)
    realized, forecast = np.sin(t * 1.7) + 0.1, 0.5 + noise * np.sin(t * 0.9)
    df = spark.createDataFrame([(1, float(f), float(r)) for f, r in zip(forecast, realized)], "k int, forecast double, realized double")
    got = scoring.score(df, ["k"], strict=False).first()
    y = [Fraction(float(f) * float(r)) for f, r in zip(forecast, realized)]
    x = [Fraction(float(r)) for r in realized]
    mx, my = sum(x) / 60, sum(y) / 60
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    alpha = my - slope * mx
    variance = sum((b - alpha - slope * a) ** 2 for a, b in zip(x, y)) / 60
    assert got["information_ratio"] == pytest.approx(math.sqrt(12 * float(alpha * alpha / variance)) * (1 if alpha > 0 else -1), rel=1e-5)
