"""Scans over all bars of a panel in two levels: within ranges of time, then over the ranges.

A window without keys puts every row into one task. Here rows are scanned within calendar ranges, each range leaves one row
(its number, sum or last value), those few rows are scanned, and what comes before a range is added to its rows.
Rows of a range meet in one task, so a range bounds the memory, not the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The range of a scan: a unit of date_trunc.
RANGE = "month"


def in_range(unit: str = RANGE) -> Column:
    """The range a row lies in."""
    return F.date_trunc(unit, F.col("date_utc")).cast("timestamp_ntz")


def _by(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_range") if keys else Window.orderBy("_range")  # one row a range


def _scanned(rows: DataFrame, keys: list[str], own: Column, of_range: Column, before: Column, combine, name: str, unit: str) -> DataFrame:
    """Adds name: combine(what the ranges before leave, own), with `own` a window column over the rows of the range.

    of_range summarises a range from its rows, `before` what the ranges before leave from those, over a window of them."""
    rows = rows.withColumn("_range", in_range(unit)).withColumn("_own", own)
    ranges = rows.groupBy(*keys, "_range").agg(of_range.alias("_sum")).select(*keys, "_range", before.alias("_before"))
    same = F.col("l._range") == F.col("r._range")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = rows.alias("l").join(ranges.alias("r"), same).select("l.*", "r._before")
    return joined.withColumn(name, combine(F.col("_before"), F.col("_own"))).drop("_range", "_own", "_before")


def numbered(bars: DataFrame, name: str = "number", unit: str = RANGE) -> DataFrame:
    """Adds the place, from 1 on, of each of the bars (one row each) by date_utc."""
    own = F.row_number().over(Window.partitionBy("_range").orderBy("date_utc"))
    before = F.sum("_sum").over(_by([]).rowsBetween(Window.unboundedPreceding, -1))
    return _scanned(bars, [], own, F.count("*"), before, lambda b, o: F.coalesce(b, F.lit(0)) + o, name, unit)


def last_known(bars: DataFrame, column: str, name: str | None = None, unit: str = RANGE) -> DataFrame:
    """The last value that is not null up to each bar (one row each)."""
    own = F.last(column, True).over(Window.partitionBy("_range").orderBy("date_utc").rowsBetween(Window.unboundedPreceding, 0))
    latest = F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("date_utc")))
    before = F.last("_sum", True).over(_by([]).rowsBetween(Window.unboundedPreceding, -1))
    return _scanned(bars, [], own, latest, before, lambda b, o: F.coalesce(o, b), name or column, unit)


def sum_before(rows: DataFrame, keys: list[str], value: Column, name: str, unit: str = RANGE) -> DataFrame:
    """The sum of a value over the rows of the same keys with a smaller date_utc; 0 for none. One row per keys and bar."""
    own = F.coalesce(F.sum("_value").over(Window.partitionBy(*keys, "_range").orderBy("date_utc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = F.coalesce(F.sum("_sum").over(_by(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = _scanned(rows.withColumn("_value", value), keys, own, F.coalesce(F.sum("_value"), F.lit(0.0)), before, lambda b, o: b + o, name, unit)
    return out.drop("_value")


def lagged(bars: DataFrame, column: str, n: int, name: str, unit: str = RANGE) -> DataFrame:
    """The value n bars before (one row each), by the bars' numbers."""
    rows = numbered(bars, "_number", unit)
    source = rows.select((F.col("_number") + n).alias("_number"), F.col(column).alias(name))
    return rows.join(source, "_number", "left").drop("_number")


def alive(markets: DataFrame, bars: DataFrame, unit: str = RANGE) -> DataFrame:
    """(market, date_utc) for every bar from each market's first on; markets: (market, _from).

    Bars of a range meet the markets that are alive in it by equality of the range; only a market's first range holds bars
    before its first."""
    bars = bars.select("date_utc").distinct().withColumn("_range", in_range(unit))
    last = bars.agg(F.max("_range").alias("_last"))  # one row
    begins = F.date_trunc(unit, F.col("_from")).cast("date")
    ranges = F.explode(F.sequence(begins, F.col("_last").cast("date"), F.expr(f"interval 1 {unit}")))
    lives = markets.join(F.broadcast(last)).where(begins <= F.col("_last").cast("date")).select("market", "_from", ranges.alias("_day"))
    lives = lives.select("market", "_from", F.col("_day").cast("timestamp_ntz").alias("_range"))
    return lives.join(bars, "_range").where(F.col("date_utc") >= F.col("_from")).select("market", "date_utc")
