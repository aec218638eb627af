"""Tables landed by month: which partitions are opened, what a second landing replaces."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from panelgrid.guards import ContractError
from panelgrid.sources.landing import MONTH, join_landed, land, landed, landed_between

DAY = dt.date


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def days(spark, first=DAY(2000, 1, 1), n=120, value=0):
    rows = [(i, first + dt.timedelta(days=i), float(value + i)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, date date, v double")


def test_bounds_choose_months_and_rows(spark, tmp_path):
    df = days(spark)
    stored = landed(spark, land(df, f"{tmp_path}/t"), df.schema)
    got = landed_between(stored, DAY(2000, 1, 20), DAY(2000, 3, 5))
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == list(range(19, 65))
    scan = plan(got)
    filters = scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "200001" in filters and "200003" in filters
    assert "date,2000-01-20" in scan.split("PushedFilters:")[1]
    assert len(got.inputFiles()) > 0 and landed_between(stored, DAY(2001, 1, 1), DAY(2001, 2, 1)).count() == 0


def test_columns_are_pruned(spark, tmp_path):
    df = days(spark)
    got = landed(spark, land(df, f"{tmp_path}/t"), df.schema, ["v"]).drop(MONTH)
    assert "ReadSchema: struct<v:double>" in plan(got)


def test_second_landing_replaces_its_months_only(spark, tmp_path):
    path = land(days(spark), f"{tmp_path}/t")
    stamps = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    before = stamps()
    new = days(spark, DAY(2000, 4, 1), 60, value=1000)  # april again, without its old rows, and may
    land(new, path)
    old = {f for f in before if "200004" not in f}
    assert {f: before[f] for f in old} == {f: t for f, t in stamps().items() if f in old}
    got = {(r["date"], r["v"]) for r in landed(spark, path, new.schema).collect()}
    kept = {(r["date"], r["v"]) for r in days(spark).collect() if r["date"] < DAY(2000, 4, 1)}
    assert got == kept | {(r["date"], r["v"]) for r in new.collect()}
    land(new.limit(0), path)  # an empty batch holds no months
    assert landed(spark, path, new.schema).count() == len(got)


def test_rows_without_a_date_are_kept_apart(spark, tmp_path):
    df = days(spark, n=3).unionByName(spark.createDataFrame([(9, None, 9.0), (9, None, 9.0)], "id long, date date, v double"))
    stored = landed(spark, land(df, f"{tmp_path}/t"), df.schema)
    assert stored.count() == 5 and stored.where(F.col(MONTH).isNull()).count() == 2
    assert landed_between(stored, DAY(1900, 1, 1), DAY(2100, 1, 1)).count() == 3


def test_join_prunes_by_the_months_of_the_other_side(spark, tmp_path):
    df = days(spark)
    stored = landed(spark, land(df, f"{tmp_path}/t"), df.schema)
    days(spark).withColumnRenamed("v", "w").write.parquet(f"{tmp_path}/other")
    other = spark.read.parquet(f"{tmp_path}/other").where("w in (3, 70)").select("date", "w")
    got = join_landed(stored, other, ["date"])
    assert "dynamicpruning" in plan(got)
    assert sorted((r["id"], r["w"]) for r in got.collect()) == [(3, 3.0), (70, 70.0)]
    assert got.columns == ["date", "id", "v", "w"]


def test_refusals(spark, tmp_path):
    df = days(spark)
    with pytest.raises(ContractError, match="missing"):
        land(df, f"{tmp_path}/t", "day")
    with pytest.raises(ContractError, match=MONTH):
        land(df.withColumn(MONTH, F.lit(1)), f"{tmp_path}/t")
    with pytest.raises(ContractError, match="lacks date"):
        join_landed(df, df, ["id"])
