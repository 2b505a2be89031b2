"""Functions across the markets of one bar. Ranks run over non-null values; ties go by market name."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def across():
    return Window.partitionBy("date_utc")


def cross_rank(x: Column, descending: bool = True) -> Column:
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    return F.when(x.isNotNull(), F.row_number().over(across().orderBy(order, F.col("market"))).cast("double"))


def cross_count(x: Column) -> Column:
    return F.count(x).over(across())


def cross_percentile(x: Column, descending: bool = True) -> Column:
    """(rank - 1) / (n - 1), turned so that the first rank has 1; a market alone has 1."""
    n = cross_count(x)
    return F.when(x.isNotNull(), F.when(n == 1, 1.0).otherwise((cross_rank(x, descending) - 1) / (n - 1)))


def average_percentile(x: Column) -> Column:
    """Average rank over count, ascending."""
    ties = F.count(x).over(Window.partitionBy("date_utc", x))
    return F.when(x.isNotNull(), (F.rank().over(across().orderBy(x.asc_nulls_last())) + (ties - 1) / 2) / cross_count(x))


def bucket(rank: Column, n: Column, quantiles: int) -> Column:
    """1 + floor((rank - 1) * quantiles / n): not ntile, which puts the larger buckets first."""
    return (1 + F.floor((rank - 1) * quantiles / n)).cast("int")


def percentile_bucket(share: Column, buckets: int) -> Column:
    return F.least(F.greatest(F.ceil(share * buckets), F.lit(1)), F.lit(buckets)).cast("int")
