"""Scans of landed tables: declared schemas, pushed-down bounds, month-end dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelgrid.functions.columns import month_end, month_end_of_yyyymm, nan_to_null


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    fmt: str = "parquet",
    **options,
) -> DataFrame:
    """A landed table. ``columns`` prunes the scan; NaN in a double column becomes NULL.

    Text formats need ``schema``: nothing is inferred from data.
    """
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"a {fmt} source needs an explicit schema")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if columns is not None:
        df = df.select(*columns)
    return nan_to_null(df)


def with_month_end(df: DataFrame, yyyymm: str = "yyyymm", date: str = "date") -> DataFrame:
    """Add a month-end date parsed from a yyyymm column; every raw column stays."""
    return df.withColumn(date, month_end_of_yyyymm(F.col(yyyymm)))


def bounded(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows with ``start <= column <= end``; the bounds reach the file or JDBC scan."""
    dtype = df.schema[column].dataType
    return df.where(F.col(column).between(F.lit(start).cast(dtype), F.lit(end).cast(dtype)))


def percent_factors(
    df: DataFrame, date: Column, factors: dict[str, str], date_name: str = "date"
) -> DataFrame:
    """Rename percent columns (``{source: output}``) to decimals on a month-end axis."""
    return df.select(
        month_end(date).alias(date_name),
        *[(F.col(source) / F.lit(100.0)).alias(out) for source, out in factors.items()],
    )
