"""Study inputs derived from the supplied tables by ordinary aggregation.

Every input aggregates a whole table. Aggregation is partial before its shuffle, so a
hot key costs no more than any other, and the results are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelgrid.functions.columns import growth, hour_ordinal, month_ordinal
from panelgrid.operators.blocks import MONTHS, TimeAxis, over_time
from panelgrid.operators.windows import lagged
from panelgrid.sources.tables import read_table

HOURS = TimeAxis(("series_id",), "t", 4096)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", columns=columns or None)


def sample_end(spark: SparkSession, folder: str) -> str:
    """``yyyy-MM`` of the last month that lineitem covers to its last day."""
    next_day = F.date_add(F.max(F.col("l_shipdate").cast("date")), 1)
    month = F.date_format(F.add_months(next_day, -1), "yyyy-MM")
    return table(spark, folder, "lineitem", "l_shipdate").agg(month).first()[0]


def _source_measures() -> list:
    price, discount, tax, quantity = (
        F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")
    )
    return [
        F.avg(price / quantity).alias("price"),
        F.sum(price * tax).alias("d12"),
        F.sum(price * (1 - discount)).alias("e12"),
        (F.sum(price * discount) / F.sum(price)).alias("bm"),
        F.avg(F.when(F.col("l_returnflag") == "A", discount)).alias("AAA"),
        F.avg(F.when(F.col("l_returnflag") == "R", discount)).alias("BAA"),
        F.avg(tax).alias("lty"),
        F.avg(discount).alias("tbl"),
        F.var_samp(discount).alias("svar"),
        (F.avg(discount) / 100).alias("Rfree"),
        F.sum(F.when(F.col("l_linestatus") == "O", quantity)).alias("_qo"),
        F.sum(F.when(F.col("l_linestatus") == "F", quantity)).alias("_qf"),
        F.sum(quantity).alias("_q"),
        F.count("*").cast("double").alias("_n"),
    ]


def _with_growth(months: DataFrame) -> DataFrame:
    changes = {"ret": "e12", "ltr": "_qo", "corpr": "_qf", "infl": "_q", "ntis": "_n"}
    prior = over_time(months, MONTHS, {f"_p{c}": lagged(c) for c in changes.values()}, lookback=1)
    return prior.withColumns({out: growth(F.col(c), F.col(f"_p{c}")) for out, c in changes.items()}).select(
        "series_id", "t", "date", "price", "d12", "e12", "bm", "AAA", "BAA", "lty", "tbl", "svar",
        "ret", "ltr", "corpr", "Rfree", "infl", "ntis",
    )


def _months(lines: DataFrame, series) -> DataFrame:
    return (
        lines.groupBy(series.alias("series_id"), F.last_day("l_shipdate").alias("date"))
        .agg(*_source_measures())
        .withColumn("t", month_ordinal(F.col("date")))
    )


LINE_COLUMNS = (
    "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def monthly_source(spark: SparkSession, folder: str) -> DataFrame:
    """One market-wide series of raw monthly source columns."""
    lines = table(spark, folder, "lineitem", *LINE_COLUMNS)
    return _with_growth(_months(lines, F.lit("market")))


def flag_source(spark: SparkSession, folder: str) -> DataFrame:
    """The same columns per return flag: three series."""
    lines = table(spark, folder, "lineitem", *LINE_COLUMNS)
    return _with_growth(_months(lines, F.col("l_returnflag")))


def monthly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A second, independent monthly source: order value per month."""
    return (
        table(spark, folder, "orders", "o_orderdate", "o_totalprice")
        .groupBy(F.last_day("o_orderdate").alias("date"))
        .agg(F.sum("o_totalprice").alias("turnover"))
    )


def index_returns(spark: SparkSession, folder: str) -> DataFrame:
    """``vwretd``: monthly growth of order value, on its own axis."""
    months = monthly_orders(spark, folder).select(
        F.lit("market").alias("series_id"), month_ordinal(F.col("date")).alias("t"), "date", "turnover"
    )
    prior = over_time(months, MONTHS, {"_p": lagged("turnover")}, lookback=1)
    return prior.select("series_id", "date", growth(F.col("turnover"), F.col("_p")).alias("vwretd"))


SUPPLIER_PREDICTORS = ("dp", "ltr", "dfr", "svar", "own_lag")


def supplier_source(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly activity per supplier; months without lines between the first and the
    last are present with zeros. The number of series grows with the table."""
    lines = table(
        spark, folder, "lineitem",
        "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag",
    )
    cells = (
        lines.groupBy(
            F.col("l_suppkey").cast("string").alias("series_id"), F.last_day("l_shipdate").alias("date")
        )
        .agg(
            F.count("*").alias("n"),
            F.sum("l_quantity").alias("qty"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("rqty"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        )
        .withColumn("t", month_ordinal(F.col("date")))
    )
    # Missing months are generated from the row before the gap: no calendar join, and
    # a series has at most one row per calendar month here.
    nxt = F.coalesce(F.lead("t").over(Window.partitionBy("series_id").orderBy("t")) - 1, F.col("t"))
    filled = cells.withColumn("_upto", nxt).withColumn("_t", F.explode(F.sequence("t", "_upto")))
    real = F.col("_t") == F.col("t")
    zero = lambda c: F.when(real, F.col(c)).otherwise(F.lit(0)).cast("double").alias(c)
    return filled.select(
        "series_id",
        F.col("_t").alias("t"),
        F.last_day(F.add_months("date", (F.col("_t") - F.col("t")).cast("int"))).alias("date"),
        *[zero(c) for c in ("n", "qty", "rqty", "rev", "tax")],
    )


def supplier_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Raw target and predictors per supplier and month (first month dropped)."""
    source = supplier_source(spark, folder)
    step = {f"_p{c}": lagged(c) for c in ("rev", "qty", "rqty")}
    prior = over_time(source, MONTHS, step, lookback=1).where(F.col("_prev").isNotNull())
    change = lambda c: F.log1p(c) - F.log1p(f"_p{c}")
    return prior.select(
        "series_id",
        "t",
        "date",
        change("rev").alias("y"),
        (F.log1p("tax") - F.log1p("rev")).alias("dp"),
        change("qty").alias("ltr"),
        (change("rqty") - change("qty")).alias("dfr"),
        F.col("n").alias("svar"),
        change("rev").alias("own_lag"),
    )


def hourly_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Event counts and values per event type and hour, holes left in."""
    return (
        table(spark, folder, "events", "ts", "event_type", "value")
        .groupBy(F.col("event_type").alias("series_id"), hour_ordinal(F.col("ts")).alias("t"))
        .agg(
            F.count("*").cast("double").alias("n"),
            F.sum("value").alias("total"),
            F.avg("value").alias("mean"),
        )
    )


def hourly_panel(spark: SparkSession, folder: str) -> DataFrame:
    """``hourly_cells`` on a gapless hour axis, missing hours filled with zeros.

    The axis is generated from each series' own first and last hour; the cells join it
    on (series, hour), which spreads a long series over all tasks.
    """
    cells = hourly_cells(spark, folder)
    hours = (
        cells.groupBy("series_id")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        .select("series_id", F.explode(F.sequence("lo", "hi")).alias("t"))
    )
    filled = hours.join(cells, ["series_id", "t"], "left")
    return filled.select(
        "series_id", "t", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n", "total", "mean")]
    )


def nation_months(spark: SparkSession, folder: str) -> DataFrame:
    """Order value per customer nation and month, holes left in.

    Orders are aggregated per customer and month first, so the join to customers
    carries one row per customer-month.
    """
    spend = (
        table(spark, folder, "orders", "o_custkey", "o_orderdate", "o_totalprice")
        .groupBy("o_custkey", F.last_day("o_orderdate").alias("date"))
        .agg(F.sum("o_totalprice").alias("value"), F.count("*").alias("n"))
    )
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    return (
        spend.join(customers, spend["o_custkey"] == customers["c_custkey"])
        .groupBy(F.col("c_nationkey").cast("string").alias("series_id"), "date")
        .agg(F.sum("value").alias("value"), F.sum("n").cast("double").alias("n"))
        .withColumn("t", month_ordinal(F.col("date")))
    )


def shocks_for(panel: DataFrame) -> DataFrame:
    """A deterministic shock path per series, from two steps before its first row."""
    span = panel.groupBy("series_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    steps = span.select(
        "series_id", "lo", F.explode(F.sequence(F.col("lo") - 2, F.col("hi"))).alias("t")
    )
    return steps.select("series_id", "t", F.sin(F.lit(12.9898) * (F.col("t") - F.col("lo"))).alias("xi"))
