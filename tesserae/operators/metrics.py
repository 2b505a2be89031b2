"""Figures of equity curves: rows of market, date_utc and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import series


def with_returns(curve: DataFrame, value: str, name: str = "r") -> DataFrame:
    """One-bar returns; 0 at the first bar and after a value of 0."""
    return curve.withColumn(name, F.coalesce(F.try_divide(F.col(value), series.lag(F.col(value), 1)) - 1, F.lit(0.0)))


def ratio(x: Column, bars_a_year: float) -> Column:
    """Mean over population deviation, by the year; null without deviation."""
    deviation = F.stddev_pop(x)
    return F.when(deviation > 0, F.avg(x) / deviation * bars_a_year**0.5)


def sortino(x: Column, bars_a_year: float) -> Column:
    """Mean over the deviation of the negative returns about their own mean."""
    deviation = F.stddev_pop(F.when(x < 0, x))
    return F.when(deviation > 0, F.avg(x) / deviation * bars_a_year**0.5)


def summary(curve: DataFrame, value: str, bars_a_year: float) -> DataFrame:
    """bars, total_return, cagr, max_drawdown (negative percent), sharpe, sortino and calmar by market."""
    peak = F.max(value).over(series.along().rowsBetween(Window.unboundedPreceding, 0))
    rows = with_returns(curve, value).withColumn("_down", F.try_divide(F.col(value), peak) - 1)
    first, last, n = F.min_by(value, "date_utc"), F.max_by(value, "date_utc"), F.count("*")
    out = rows.groupBy("market").agg(
        n.alias("bars"),
        (F.try_divide(last, first) - 1).alias("total_return"),
        F.when((first > 0) & (n > 1), F.pow(last / first, bars_a_year / F.nullif(n - 1, F.lit(0))) - 1).alias("cagr"),
        (100 * F.min("_down")).alias("max_drawdown"),
        ratio(F.col("r"), bars_a_year).alias("sharpe"),
        sortino(F.col("r"), bars_a_year).alias("sortino"),
    )
    return out.withColumn("calmar", F.try_divide(F.col("cagr"), F.abs("max_drawdown") / 100))


def recoveries(curve: DataFrame, value: str) -> DataFrame:
    """longest and second: bars from a peak to the next one, over recovered drawdowns only."""
    peak = F.max(value).over(series.along().rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("_n", F.row_number().over(series.along())).where(F.col(value).isNotNull())
    rows = rows.withColumn("_peak", peak).where(F.col(value) >= F.col("_peak"))
    rows = rows.withColumn("_gap", F.col("_n") - F.lag("_n").over(series.along()))
    place = F.row_number().over(Window.partitionBy("market").orderBy(F.col("_gap").desc_nulls_last(), "date_utc"))
    rows = rows.withColumn("_place", place).withColumn("_gap", F.when(F.col("_gap") > 1, F.col("_gap")))
    return rows.groupBy("market").agg(F.max(F.when(F.col("_place") == 1, F.col("_gap"))).alias("longest"), F.max(F.when(F.col("_place") == 2, F.col("_gap"))).alias("second"))


def information_ratio(curve: DataFrame, reference: DataFrame, value: str, bars_a_year: float) -> DataFrame:
    """Of the returns in excess of a reference curve (date_utc, value) on the bars both have."""
    other = with_returns(reference.withColumn("market", F.lit("")), value, "b").select("date_utc", "b")
    rows = with_returns(curve, value).join(other, "date_utc").withColumn("excess", F.col("r") - F.col("b"))
    return rows.groupBy("market").agg(F.count("*").alias("bars"), ratio(F.col("excess"), bars_a_year).alias("air"))


def excess(curve: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Adds excess returns over a reference curve (date_utc, value), and their product since the first common bar."""
    other = with_returns(reference.withColumn("market", F.lit("")), value, "b").select("date_utc", "b")
    rows = with_returns(curve, value).join(other, "date_utc").withColumn("excess", F.col("r") - F.col("b"))
    so_far = series.along().rowsBetween(Window.unboundedPreceding, 0)
    lost = F.min("excess").over(so_far) <= -1
    return rows.withColumn("excess_curve", F.when(lost, 0.0).otherwise(F.exp(F.sum(F.ln(1 + F.greatest("excess", F.lit(-0.999999)))).over(so_far))))


def rolling_information(rows: DataFrame, n: int, bars_a_year: float, name: str = "rolling_air") -> DataFrame:
    """The information ratio of n bars of excess returns, by the year."""
    over = series.trailing(n)
    deviation = F.stddev_pop("excess").over(over)
    return rows.withColumn(name, series.full(F.col("excess"), n, F.when(deviation > 0, F.avg("excess").over(over) / deviation * bars_a_year**0.5)))


def rolling_summary(rows: DataFrame, name: str = "rolling_air") -> DataFrame:
    x = F.col(name)
    positive = F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))
    return rows.groupBy("market").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.25)).alias("q25"), positive.alias("positive"), F.min(x).alias("least"), F.max(x).alias("most"))


def recent(curve: DataFrame, years: int) -> DataFrame:
    """The rows of each market from `years` before its last bar on."""
    last = F.max("date_utc").over(Window.partitionBy("market"))
    begins = F.add_months(last.cast("date"), -12 * years).cast("timestamp_ntz") + (last - F.date_trunc("day", last).cast("timestamp_ntz"))
    return curve.withColumn("_begins", begins).where(F.col("date_utc") >= F.col("_begins")).drop("_begins")


def deepest(curve: DataFrame, value: str) -> DataFrame:
    """peak_at, trough_at and recovered_at (null: not yet) of each market's deepest drawdown."""
    so_far = series.along().rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_peak", F.max(value).over(so_far)).withColumn("_down", F.try_divide(F.col(value), F.col("_peak")) - 1)
    rows = rows.withColumn("_trough", F.min(F.struct("_down", "date_utc", "_peak")).over(Window.partitionBy("market")))
    at, top = F.col("_trough.date_utc"), F.col("_trough._peak")
    return rows.groupBy("market").agg(
        F.min(F.when((F.col(value) == top) & (F.col("date_utc") <= at), F.col("date_utc"))).alias("peak_at"),
        F.min(at).alias("trough_at"),
        F.min(F.when((F.col(value) >= top) & (F.col("date_utc") > at), F.col("date_utc"))).alias("recovered_at"),
        F.min(F.col("_trough._down")).alias("drawdown"),
    )
