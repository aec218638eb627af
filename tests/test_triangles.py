"""Triangular factors: merging, missing cells, collinear and constant columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrid.operators.blocks import TimeAxis
from panelgrid.operators.regressions import forecast_anatomy, spanning
from panelgrid.operators.scoring import score
from panelgrid.operators.triangles import combined, least_squares, merged, reduced, summaries


def test_factors_of_parts_merge_to_the_factor_of_all():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(500, 4)) @ draw.normal(size=(4, 4)) + [3.0, -1e3, 0.0, 1e-3]
    n, mean, factor = reduced(x, np.array([0]))
    for cuts in ([0, 250], [0, 1, 2, 3, 499], list(range(0, 500, 7))):
        parts = reduced(x, np.array(cuts))
        total, common, again = merged(*parts, np.array([0]))
        assert total.tolist() == [500]
        np.testing.assert_allclose(common, mean, rtol=1e-13)
        np.testing.assert_allclose(np.abs(again), np.abs(factor), rtol=1e-9, atol=1e-10)
    centered = x - x.mean(axis=0)
    np.testing.assert_allclose(factor[0].T @ factor[0], centered.T @ centered, rtol=1e-9)


def test_constant_and_repeated_columns_stay_exactly_so():
    x = np.full((1000, 3), 0.1)
    x[:, 1] = np.sin(np.arange(1000))
    x[:, 2] = 3 * x[:, 1] + 0.7
    for cuts in ([0], [0, 400, 800], list(range(0, 1000, 9))):
        _, _, factor = merged(*reduced(x, np.array(cuts)), np.array([0]))
        assert factor[0, 0, 0] == 0.0 and factor[0, 2, 2] == 0.0 and factor[0, 1, 1] > 20


@pytest.mark.parametrize("design", ["full", "collinear", "constant", "both"])
def test_least_squares_of_least_length(design):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, 2)) + 0.3
    if design in ("collinear", "both"):
        x[:, 1] = 2 * x[:, 0] + (0.0 if design == "both" else 1.0)
    if design in ("constant", "both"):
        x[:, 0] = 0.25
        x[:, 1] = x[:, 1] if design == "constant" else 0.5
    y = draw.normal(size=60)
    level, slopes, corner, left = least_squares(*merged(*reduced(np.column_stack([x, y]), np.array([0, 20, 45])), np.array([0])))
    full = np.column_stack([np.ones(60), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    np.testing.assert_allclose([level[0], *slopes[0]], want, rtol=1e-9, atol=1e-12)
    assert left[0] == pytest.approx(((y - full @ want) ** 2).sum(), rel=1e-10)
    assert corner[0] == pytest.approx(np.linalg.pinv(full.T @ full)[0, 0], rel=1e-9)


def rows_of(spark, seed=2):
    draw = np.random.default_rng(seed)
    rows = []
    for k in ("a", "b", None):
        for i in range(70):
            rows.append((k, i % 2, float(draw.normal()), float(draw.normal() + 1), float(draw.normal()) if i % 9 else None))
    rows.append(("only missing", 0, 1.0, 1.0, None))
    return rows, spark.createDataFrame(rows, "k string, s int, b double, m double, y double")


def test_rows_with_missing_cells_count_for_nothing_and_null_keys_are_keys(spark):
    rows, df = rows_of(spark)
    parts = summaries(df.repartition(9), ["k", "s"], ["b", "m", "y"], ["y", "b"])
    got = {(r["k"], r["s"]): r for r in combined(parts, ["k", "s"]).collect()}
    assert set(got) == {(k, s) for k, s, *_ in rows}
    for key, r in got.items():
        own = np.array([x for k, s, *x in rows if (k, s) == key and x[2] is not None], dtype=float).reshape(-1, 3)
        assert r["_n"] == len(own)
        every = [x for k, s, *x in rows if (k, s) == key]
        assert r["_sums"] == pytest.approx([own[:, 2].sum(), len(own), sum(x[0] for x in every), len(every)])
        if len(own):
            np.testing.assert_allclose(r["_mean"], own.mean(axis=0), rtol=1e-12)


@pytest.mark.parametrize("partitions", [1, 7])
def test_spanning_equals_least_squares(spark, partitions):
    rows, df = rows_of(spark)
    df = df.withColumnsRenamed({"y": "strategy", "b": "benchmark", "m": "realized"}).repartition(partitions)
    got = {r["k"]: r for r in spanning(df, ["k"]).collect()}
    assert got["only missing"]["alpha"] is None and got["only missing"]["alpha_tstat"] is None
    for key in ("a", "b", None):
        own = np.array([x for k, _, *x in rows if k == key and x[2] is not None])
        full, y = np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2]
        beta = np.linalg.lstsq(full, y, rcond=None)[0]
        left = y - full @ beta
        se = np.sqrt(left @ left / (len(y) - 3) * np.linalg.pinv(full.T @ full)[0, 0])
        want = [*beta, beta[0] / se, np.sqrt(12) * beta[0] / left.std(), left.std()]
        assert [got[key][c] for c in ("alpha", "beta_benchmark", "beta_market", "alpha_tstat", "information_ratio", "resid_std")] == pytest.approx(want, rel=1e-9)


def test_collinear_benchmark_gets_the_shortest_coefficients(spark):
    _, df = rows_of(spark)
    df = df.where("y IS NOT NULL AND k = 'a'").select("k", F.col("y").alias("strategy"), F.col("m").alias("realized"), (F.col("m") * 2).alias("benchmark"))
    got, own = spanning(df.repartition(4), ["k"]).first(), np.array(df.select("benchmark", "realized", "strategy").collect())
    full, y = np.column_stack([np.ones(len(own)), own[:, :2]]), own[:, 2]
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    left = y - full @ beta
    se = np.sqrt(left @ left / (len(y) - 3) * np.linalg.pinv(full.T @ full)[0, 0])
    assert [got["alpha"], got["beta_benchmark"], got["beta_market"], got["alpha_tstat"]] == pytest.approx([*beta, beta[0] / se], rel=1e-8)
    exact = spanning(df.withColumn("strategy", F.col("realized") * 0.5), ["k"]).first()
    assert exact["beta_market"] == pytest.approx(0.1) and exact["alpha_tstat"] is None and exact["information_ratio"] is None


def test_anatomy_of_repeating_returns_has_the_shortest_weights(spark):
    returns = [0.5, -0.25, 1.0, 0.125] * 20
    draw = np.random.default_rng(8)
    panel = spark.createDataFrame([("a", t, v) for t, v in enumerate(returns)], "series_id string, t long, y double")
    made = [("a", t, float(draw.normal())) for t in range(12, 79)]
    got = forecast_anatomy(spark.createDataFrame(made, "series_id string, t long, forecast double"), panel, "y", TimeAxis(), 12).first()
    lags = np.array([[returns[t - k] for k in range(12)] for _, t, _ in made])
    full, y = np.column_stack([np.ones(len(lags)), lags]), np.array([f for *_, f in made])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert [got["intercept"], *got["lag_weights"]] == pytest.approx(list(want), abs=1e-9)
    left = y - full @ want
    assert got["r2"] == pytest.approx(1 - left.var() / y.var(), rel=1e-9)


def test_scores_of_many_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        draw = np.random.default_rng(5)
        rows = [(i % 5, float(a), float(b)) for i, (a, b) in enumerate(draw.normal(size=(400, 2)))]
        df = spark.createDataFrame(rows, "k int, forecast double, realized double")
        many = {r["k"]: r["alpha_tstat"] for r in score(df.repartition(6), ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = {r["k"]: r["alpha_tstat"] for r in score(df.coalesce(1), ["k"]).collect()}
    assert many == pytest.approx(one, rel=1e-10) and len(many) == 5


def test_rows_with_more_columns_than_their_key_merge_over_batches(spark):
    """A key goes on from one batch to the next, and its rows hold columns that the key does not name."""
    parts = summaries(rows_of(spark)[1].repartition(7), ["k", "s"], ["b", "y"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    read = lambda rows: sorted(combined(rows, ["k"]).collect(), key=lambda r: str(r["k"]))
    want = read(parts.drop("s").coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = read(parts.withColumn("other", F.lit("x")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r["k"], r["_n"]) for r in found] == [(r["k"], r["_n"]) for r in want]
    for one, two in zip(found, want):
        np.testing.assert_allclose(one["_mean"], two["_mean"], rtol=1e-12)
        np.testing.assert_allclose(np.abs(one["_factor"]), np.abs(two["_factor"]), rtol=1e-9, atol=1e-12)
