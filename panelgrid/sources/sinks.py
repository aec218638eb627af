"""Parquet sinks, period-keyed paths and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

DEFAULT_SAMPLE_END = "2020-12"  # fixed value: the period whose artifacts carry no suffix


def artifact_path(base: str, name: str, sample_end: str = DEFAULT_SAMPLE_END) -> str:
    """``base/name`` for the default period, ``base/name_<period>`` for any other."""
    suffix = "" if sample_end == DEFAULT_SAMPLE_END else f"_{sample_end}"
    return f"{base.rstrip('/')}/{name}{suffix}.parquet"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_artifact(
    df: DataFrame,
    base: str,
    name: str,
    sample_end: str = DEFAULT_SAMPLE_END,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write one artifact of a period and return it read back from storage."""
    path = write_table(df, artifact_path(base, name, sample_end), partition_by)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-panelgrid-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_folder(spark).rstrip('/')}/panelgrid-{name}{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so several consumers share one computation and a lost executor
    costs a re-read instead of a recomputation. Parquet keeps column pruning and
    gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, conditions: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` and, observed by the same pass, the rows in all (``n_rows``) and those that meet each condition."""
    watch = Observation()
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    stored = materialize(df.observe(watch, F.count(F.lit(1)).alias("n_rows"), *counts))
    seen = watch.get
    return stored, {name: seen.get(name) or 0 for name in ("n_rows", *conditions)}
