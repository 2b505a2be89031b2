"""Values that hold for a while, such as warnings of markets, as intervals joined to bars.

A value that is told at some times holds until it is told anew. Told times become intervals without repeats, and an
interval is filed under every calendar month it reaches into, so that a bar finds its interval among those of its market
and month by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONTH = "month"


def intervals(told: DataFrame, value: str, key: str = "market", at: str = "date_utc") -> DataFrame:
    """key, value, begins, ends (null: not ended) from rows that tell the value at a time; a time at which the value is told
    again as it was begins nothing. Null is a value too. Of one key and time there is one row."""
    order = Window.partitionBy(key).orderBy(at)
    changed = F.lag(F.struct(value)).over(order)
    rows = told.select(key, value, at).withColumn("_before", changed).where(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value)))
    return rows.select(key, value, F.col(at).alias("begins"), F.lead(at).over(order).alias("ends"))


def with_value_at(bars: DataFrame, held: DataFrame, value: str, key: str = "market") -> DataFrame:
    """Adds the value of the interval that a bar's date_utc lies in; null before the first one. held: see intervals."""
    month = lambda c: F.date_trunc(MONTH, c).cast("date")
    last = bars.agg(F.max("date_utc").alias("_last"))  # one row
    reach = held.join(F.broadcast(last)).where(F.col("begins") <= F.col("_last"))
    until = F.least(F.coalesce("ends", "_last"), F.col("_last"))
    filed = reach.select(key, F.col(value).alias("_value"), "begins", "ends", F.explode(F.sequence(month(F.col("begins")), month(until), F.expr("interval 1 month"))).alias("_month"))
    rows = bars.drop(value).withColumn("_month", month(F.col("date_utc")))
    inside = (F.col("d.date_utc") >= F.col("i.begins")) & (F.col("i.ends").isNull() | (F.col("d.date_utc") < F.col("i.ends")))
    on = (F.col(f"d.{key}") == F.col(f"i.{key}")) & (F.col("d._month") == F.col("i._month")) & inside
    columns = [c for c in bars.columns if c != value]
    return rows.alias("d").join(filed.alias("i"), on, "left").select(*[F.col(f"d.`{c}`") for c in columns], F.col("i._value").alias(value))
