"""Bars from tables of observations: one row per market and time, long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(rows: DataFrame, market: Column, at: Column, value: Column, order: Column, volume: Column | None = None) -> DataFrame:
    """market, date_utc, opening_price, high_price, low_price, trade_price, volume, turnover."""
    rows = rows.select(market.alias("market"), at.cast("timestamp_ntz").alias("date_utc"), value.alias("v"), order.alias("k"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("q"))
    return rows.groupBy("market", "date_utc").agg(
        F.min_by("v", "k").alias("opening_price"),
        F.max("v").alias("high_price"),
        F.min("v").alias("low_price"),
        F.max_by("v", "k").alias("trade_price"),
        F.sum("q").alias("volume"),
        F.sum("v").alias("turnover"),
    )


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type by hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bars(events, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.col("ts"))


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_brand by week of l_shipdate. Lines meet their parts first (how, is for the plan to choose by the parts' size), since
    parts and weeks have nearly as many groups as there are lines. A line's place is one number, so that the groups hash:
    order keys below 2**43, line numbers below 2**20."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    place = F.shiftleft(F.col("l_orderkey").cast("bigint"), 20) + F.col("l_linenumber")
    return bars(joined, F.col("p_brand"), F.date_trunc("week", "l_shipdate"), F.col("l_extendedprice"), place, F.col("l_quantity"))


def read_candles(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of candle CSV files, one per market."""
    schema = (
        "market string, korean_name string, english_name string, market_warning string, date_utc timestamp_ntz, date_kst timestamp_ntz, opening_price double, high_price double, "
        "low_price double, trade_price double, candle_acc_trade_volume double, candle_acc_trade_price double, timestamp bigint"
    )
    return spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
