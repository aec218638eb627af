import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import make_panel, month_end
from panelgrid import guards
from panelgrid.config import StudyConfig
from panelgrid.functions.columns import decimals, label
from panelgrid.guards import ContractError
from panelgrid.operators.blocks import MONTHS
from panelgrid.operators.tidy import (
    PREDICTORS, SHARED_PREDICTORS, excess_returns, join_one_to_one, lookup, target_frame, tidy_panel,
)
from panelgrid.plans import reports
from panelgrid.plans.study import run_study
from panelgrid.sources.sinks import artifact_path, materialize, write_artifact
from panelgrid.sources.tables import bounded, percent_factors, read_table, with_month_end

RAW = ("price", "d12", "e12", "bm", "tbl", "AAA", "BAA", "lty", "ntis", "Rfree", "infl", "ltr", "corpr", "svar", "ret")


def raw_source(spark, n=30, seed=0):
    rng = np.random.default_rng(seed)
    values = np.exp(rng.standard_normal((n, len(RAW))) * 0.2)
    rows = [("m", 12 * 1930 + 1 + i, month_end(i), *map(float, values[i])) for i in range(n)]
    schema = "series_id string, t long, date date, " + ", ".join(f"{c} double" for c in RAW)
    return spark.createDataFrame(rows, schema), {c: values[:, j] for j, c in enumerate(RAW)}


def test_tidy_columns(spark):
    source, v = raw_source(spark)
    index = source.select("series_id", "date", (F.col("ret") + 1e-3 * F.sin("t")).alias("vwretd")).where("t > 23162")
    got = tidy_panel(source, index).orderBy("t").toPandas()
    assert list(got.columns) == ["series_id", "t", "date", "mkt_excess", *PREDICTORS]
    assert len(got) == 28  # rows without an index return are gone, the price lag is not
    s = slice(2, None)
    want = {
        "mkt_excess": v["ret"] - v["Rfree"],
        "dfy": v["BAA"] - v["AAA"],
        "tms": v["lty"] - v["tbl"],
        "dfr": v["corpr"] - v["ltr"],
        "dp": np.log(v["d12"] / v["price"]),
        "de": np.log(v["d12"] / v["e12"]),
        "ep": np.log(v["e12"] / v["price"]),
        "infl": v["infl"],
        "bm": v["bm"],
    }
    for name, values in want.items():
        np.testing.assert_allclose(got[name], values[s], rtol=1e-9, err_msg=name)
    np.testing.assert_allclose(got["dy"], np.log(v["d12"][2:] / v["price"][1:-1]), rtol=1e-9)
    np.testing.assert_array_equal(got["lag_mkt_excess"], got["mkt_excess"])


def test_tidy_contracts(spark):
    source, _ = raw_source(spark)
    unrelated = source.select("series_id", "date", F.cos(F.col("t") * 7).alias("vwretd"))
    with pytest.raises(ContractError, match="diverge"):
        tidy_panel(source, unrelated)
    assert tidy_panel(source, unrelated, threshold=None).count() == 30
    constant = unrelated.withColumn("vwretd", F.lit(1.0)).join(source.select("date", "Rfree"), "date")
    constant = constant.select("series_id", "date", F.col("Rfree").alias("vwretd"))
    with pytest.raises(ContractError, match="diverge"):
        tidy_panel(source, constant)
    good = source.select("series_id", "date", F.col("ret").alias("vwretd"))
    with pytest.raises(ContractError, match="not unique"):
        tidy_panel(source, good.unionByName(good))


def test_targets_share_one_predictor_table(spark):
    source, v = raw_source(spark, n=40)
    bonds = excess_returns(source, {"gov": "ltr", "corp": "corpr"}, "Rfree", ("series_id", "t", "date"))
    predictors = tidy_panel(source).select("series_id", "t", *SHARED_PREDICTORS)
    got = target_frame(bonds, predictors, ("gov", "corp")).toPandas()
    assert set(got["target"]) == {"gov", "corp"} and len(got) == 2 * 28
    raw = v["ltr"] - v["Rfree"]
    scale = [math.sqrt((raw[i - 12 : i] ** 2).mean()) for i in range(12, 40)]
    gov = got[got.target == "gov"].sort_values("t")
    np.testing.assert_allclose(gov["y"], raw[12:] / scale, rtol=1e-9)
    np.testing.assert_array_equal(gov["y"], gov["own_lag"])


def test_join_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10.0), (3, 30.0)], "k int, w double")
    joined = {r["k"]: r["w"] for r in join_one_to_one(a, b, ["k"]).collect()}
    assert joined == {1: 10.0, 2: None}
    with pytest.raises(ContractError, match="left side"):
        join_one_to_one(a.unionByName(a), b, ["k"])
    with pytest.raises(ContractError, match="no match"):
        lookup(a, b, ["k"], ["w"])
    assert lookup(a.where("k = 1"), b, ["k"], ["w"]).first()["w"] == 10.0
    guards.require_same_axis(a, a, ["k"])
    with pytest.raises(ContractError, match="axes differ"):
        guards.require_same_axis(a, b, ["k"])
    with pytest.raises(ContractError):
        guards.require_rows(a.where("k > 9"))


def test_scans(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [(192601, 1.0, float("nan")), (192602, 2.0, 5.0), (202402, 3.0, 7.0)]
    spark.createDataFrame(rows, "yyyymm int, a double, b double").write.parquet(path)
    df = with_month_end(read_table(spark, path))
    assert [r["date"] for r in df.orderBy("yyyymm").collect()] == [
        dt.date(1926, 1, 31), dt.date(1926, 2, 28), dt.date(2024, 2, 29),
    ]
    assert df.columns == ["yyyymm", "a", "b", "date"]
    assert df.where("b is null").count() == 1
    assert read_table(spark, path, columns=["a"]).columns == ["a"]
    assert bounded(df, "date", "1926-01-31", "1926-02-28").count() == 2
    pct = percent_factors(df, F.col("date"), {"a": "intl", "b": "rf"}).orderBy("date").collect()
    assert pct[1]["intl"] == 0.02 and pct[1]["rf"] == 0.05
    df.select("yyyymm", "a").write.csv(str(tmp_path / "text"))
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, str(tmp_path / "text"), fmt="csv")
    assert read_table(spark, str(tmp_path / "text"), "yyyymm int, a double", fmt="csv").count() == 3


def test_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("timestamp").alias("caldt"), "id").write.parquet(path)
    df = bounded(read_table(spark, path, columns=["caldt"]), "caldt", "1970-01-01 00:00:02", "1970-01-01 00:00:05")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(caldt), GreaterThanOrEqual" in plan and "ReadSchema: struct<caldt:" in plan
    assert df.count() == 4


def test_artifacts_of_two_periods_coexist(spark, tmp_path):
    base = str(tmp_path)
    assert artifact_path(base, "grid") == f"{base}/grid.parquet"
    one = spark.createDataFrame([(1, 2.0)], "P int, v double")
    write_artifact(one, base, "grid")
    write_artifact(one.withColumn("v", F.lit(9.0)), base, "grid", "2024-12", partition_by=["P"])
    assert spark.read.parquet(f"{base}/grid.parquet").first()["v"] == 2.0
    assert spark.read.parquet(f"{base}/grid_2024-12.parquet").first()["v"] == 9.0


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(100).select("id", F.array(F.col("id") * 0.5).alias("x"))
    kept = materialize(df)
    assert kept.dtypes == df.dtypes
    assert kept.exceptAll(df).isEmpty() and kept.count() == 100


def test_study_writes_and_exports(spark, tmp_path):
    panel, _ = make_panel(spark, n=25, series=("a",), with_date=True)
    config = StudyConfig(p_grid=(2,), z_grid=(1.0,), seeds=(0,), tasks=2)
    study = run_study(panel, config, "y", ("x0", "x1", "x2"), date="date")
    per_seed, averaged = study.write(str(tmp_path), "oos_grid_T12", "2020-12")
    assert per_seed.count() == 2 and averaged.count() == 2
    forecasts = study.write_forecasts(str(tmp_path), "market", "2024-12")
    assert (tmp_path / "forecasts_market_2024-12.parquet" / "P=2").exists()
    assert set(forecasts.columns) == {"series_id", "seed", "P", "z", "obs", "forecast", "realized", "strategy"}
    assert forecasts.count() == 2 * 12


def test_labels_and_text(spark):
    df = spark.createDataFrame([("bm", 1234.5), ("dp", -0.005)], "k string, v double")
    got = df.select(label(F.col("k"), {"bm": "b/m"}).alias("k"), decimals(F.col("v"), 2).alias("v")).collect()
    assert [tuple(r) for r in got] == [("b/m", "1,234.50"), ("dp", "-0.01")]


def test_report_frames(spark):
    make = spark.createDataFrame
    stats = make(
        [(e, s, 0.1, 1.0 + i, 2.0 + i, 0.2, 25) for i, e in enumerate(("historical", "ma2_reversal", "wild_bootstrap"))
         for s in (reports.MODEL, reports.BENCHMARK)],
        "experiment string, strategy string, alpha double, information_ratio double, alpha_tstat double, sharpe double, n_seeds long",
    )
    span = make([(e, 0.5, 0.6) for e in ("historical", "ma2_reversal", "wild_bootstrap")],
                "experiment string, information_ratio double, alpha_tstat double")
    panel = reports.counterfactual_panel(stats, span).toPandas().set_index("experiment")
    assert panel.loc["MA(2) reversal", "rff_ir"] == 2.0 and panel.loc["Historical", "spanned_alpha_t"] == 0.6
    recovery = make([(d, s, 0.9, 1.1, 0.4) for d in reports.INPUT_NAMES for s in ("easy", "realistic")],
                    "predictor_set string, strength string, correlation double, slope double, nrmse double")
    twin = make([(d, s, m, 1.5, 0.3, 0.2) for d in reports.INPUT_NAMES for s in ("easy", "realistic") for m in ("plus", "minus")],
                "predictor_set string, strength string, market string, alpha_tstat double, information_ratio double, beta_benchmark double")
    assert reports.recovery_panel(recovery).where("inputs = '14 shared inputs'").count() == 2
    assert {r["twin"] for r in reports.twin_spanning_panel(twin).collect()} == {"+", "-"}
    grid = make([(2, 0.0, 0.1, 0.2, 0.3), (4, 0.0, 0.4, 0.5, 0.6), (4, 1.0, 0.7, 0.8, 0.9)],
                "P int, z double, sharpe double, information_ratio double, alpha_tstat double")
    vi = make([("u", 0.021), ("v", 0.01)], "variable string, vi_r2 double")
    metrics = make([("RFF (ridgeless)", 0.43), (reports.BENCHMARK, 0.37)], "strategy string, sharpe double")
    spanning = make([(2.1, 0.16)], "alpha_tstat double, anatomy_r2 double")
    rows = reports.report_rows({"Mkt": grid, "Intl": grid}, vi, (metrics, spanning), (stats, span), (recovery, twin)).collect()
    values = {r["name"]: r["text"] for r in rows}
    assert len(values) == len(rows)
    assert values["grid.Mkt.sharpe"] == "0.40" and values["importance.first.vi_percent"] == "2.1"
    assert values["strategy.RFF (ridgeless).sharpe"] == "0.43" and values["design.ma2_reversal.spanned.information_ratio"] == "0.50"
    assert values["twin.easy.x14_shared.correlation"] == "0.90"
    assert values["twin.realistic.x15_world_lag.minus.alpha_tstat"] == "1.50"
    assert values["design.n_seeds"] == "25"
