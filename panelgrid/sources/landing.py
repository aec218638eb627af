"""Tables landed by calendar month: a bounded or joined read opens the months it needs and no other.

The month of a row's date is its partition. Landing a batch again replaces the months that the batch holds and leaves
all others as they are, so a longer sample costs its new months. Rows without a date have a partition of their own,
which bounded and joined reads never open.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelgrid.guards import ContractError, require_columns
from panelgrid.sources.tables import bounded

MONTH = "landed_month"  # yyyymm


def month_number(date: Column) -> Column:
    """``yyyymm`` as an integer."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def land(df: DataFrame, path: str, date: str = "date") -> str:
    """Write ``df`` by the month of ``date``; months that ``df`` holds replace those landed before.

    The months are spread by size: a small one is written by one task, a month that holds most of the rows by many. An
    empty frame leaves the table as it is.
    """
    require_columns(df, [date])
    if MONTH in df.columns:
        raise ContractError(f"a landed table adds the column {MONTH}, which the frame has already")
    rows = df.withColumn(MONTH, month_number(F.col(date))).hint("rebalance", MONTH)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return path


def landed(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """The landed table under the ``schema`` of its rows (``land`` adds the month), pruned to ``columns`` and the month."""
    df = spark.read.schema(T.StructType([*schema, T.StructField(MONTH, T.IntegerType())])).parquet(path)
    return df if columns is None else df.select(*columns, MONTH)


def landed_between(df: DataFrame, start: Date, end: Date, date: str = "date") -> DataFrame:
    """Rows with ``start <= date <= end`` read from the months between them."""
    months = [d.year * 100 + d.month for d in (start, end)]
    return bounded(df.where(F.col(MONTH).between(*months)), date, start, end).drop(MONTH)


def join_landed(df: DataFrame, other: DataFrame, on: Sequence[str], date: str = "date") -> DataFrame:
    """Rows of a landed table with those of ``other`` that agree ``on`` the date and further columns.

    The month joins too, so that the months found in a small filtered ``other`` choose the partitions while the query
    runs. A larger one is joined as the optimizer sees fit.
    """
    if date not in on:
        raise ContractError(f"a landed table is joined on its date; {list(on)} lacks {date}")
    return df.join(other.withColumn(MONTH, month_number(F.col(date))), [MONTH, *on]).drop(MONTH)
