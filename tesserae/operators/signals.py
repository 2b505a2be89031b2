"""Signals of many strategies at the last bar, from the names of their runs.

A name is parsed into a family and its windows by patterns; each asset's moving averages are computed once for all windows that
any name has, in one pass over its bars, and a name meets only the bars its family looks back on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import series

# The names of runs, by family, after the asset in small letters. Groups: windows, then persistence.
NAMES = {
    "ma_cross": r"_ma_60m_(\d+)_(\d+)_every_bar_fee5bp",
    "ma_cross_persist": r"_ma_60m_(\d+)_(\d+)_persist(\d+)_every_bar_fee5bp",
    "ma_cross_exit_persist": r"_ma_60m_(\d+)_(\d+)_exit_persist(\d+)_stateful_fee5bp",
    "ma_stack": r"_ma_stack_60m_(\d+)_(\d+)_(\d+)_every_bar_fee5bp",
}


def parsed(names: DataFrame) -> DataFrame:
    """Adds numbers (an array, empty where the name is not one of its family) and error to rows of asset, strategy_family and
    run_name."""
    numbers, known = F.array().cast("array<int>"), F.lit(False)
    for family, pattern in NAMES.items():
        whole = F.concat(F.lit("^"), F.lower("asset"), F.lit(pattern + "$"))
        groups = F.array(*[F.nullif(F.regexp_extract("run_name", pattern + "$", i + 1), F.lit("")).cast("int") for i in range(pattern.count("("))])
        at = F.col("strategy_family") == family
        numbers, known = F.when(at & F.rlike("run_name", whole), groups).otherwise(numbers), known | at
    out = names.withColumn("numbers", F.filter(numbers, lambda n: n.isNotNull()))
    error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unsupported_strategy_family:"), F.coalesce("strategy_family", F.lit(""))))
    return out.withColumn("error", error.when(F.size("numbers") == 0, F.concat(F.lit("unsupported_"), "strategy_family", F.lit("_run_name"))))


def current(bars: DataFrame, names: DataFrame, price: str = "trade_price") -> DataFrame:
    """asset, strategy_family, run_name, supported, error, latest_at, latest_price, signal_on, target_weight of each name at
    the last bar of the market of its asset. A name's windows are a bounded list: they become columns."""
    told = parsed(names)
    windows = F.when(F.col("strategy_family") == "ma_stack", F.col("numbers")).otherwise(F.slice("numbers", 1, 2))
    lengths = [r[0] for r in told.where("error IS NULL").select(F.explode(windows).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    x = F.col(price)
    means = bars.where(x.isNotNull()).select(
        F.lower("market").alias("_asset"),
        "date_utc",
        x.alias("latest_price"),
        F.row_number().over(series.along()).alias("_n"),
        F.row_number().over(Window.partitionBy("market").orderBy(F.desc("date_utc"))).alias("_back"),
        F.map_from_entries(F.array(*[F.struct(F.lit(n), series.rolling_mean(x, n)) for n in lengths])).alias("_means") if lengths else F.create_map().cast("map<int,double>").alias("_means"),
    )
    last = F.element_at("numbers", -1)
    # How many bars back a family looks; a state looks back on all.
    reach = F.when(F.col("strategy_family") == "ma_cross_persist", last).when(F.col("strategy_family") == "ma_cross_exit_persist", F.lit(1 << 30)).otherwise(F.lit(1))
    wanted = told.where("error IS NULL").withColumn("_reach", F.greatest(reach, F.lit(1))).withColumn("_asset", F.lower("asset"))
    rows = wanted.join(means, "_asset").where(F.col("_back") <= F.col("_reach"))

    def mean(i: int) -> Column:
        return F.try_element_at("_means", F.get("numbers", F.lit(i)))

    above = F.coalesce(mean(0) > mean(1), F.lit(False))
    stacked = above & F.coalesce(mean(1) > mean(2), F.lit(False))
    key = ["asset", "strategy_family", "run_name"]
    below = F.coalesce(mean(0) <= mean(1), F.lit(False))
    since = F.max(F.when(~below, F.col("_n"))).over(Window.partitionBy(*key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_above": above, "_stacked": stacked, "_for": F.col("_n") - F.coalesce(since, F.lit(0)), "_need": last})
    at_last = F.col("_back") == 1
    signals = rows.groupBy(*key).agg(
        F.max(F.when(at_last, F.col("date_utc"))).alias("latest_at"),
        F.max(F.when(at_last, F.col("latest_price"))).alias("latest_price"),
        F.max(F.when(at_last, F.col("_above"))).alias("ma_cross"),
        F.max(F.when(at_last, F.col("_stacked"))).alias("ma_stack"),
        (F.count(F.when(F.col("_above"), 1)) >= F.max("_need")).alias("ma_cross_persist"),
        (F.coalesce(F.max(F.when(F.col("_above"), F.col("_n"))), F.lit(0)) > F.coalesce(F.max(F.when(F.col("_for") >= F.col("_need"), F.col("_n"))), F.lit(0))).alias("ma_cross_exit_persist"),
    )
    on = reduce(lambda out, family: out.when(F.col("strategy_family") == family, F.col(family)), NAMES, F.when(F.lit(False), F.lit(False)))
    out = told.drop("numbers").join(signals.select(*key, "latest_at", "latest_price", on.alias("signal_on")), key, "left")
    error = F.coalesce("error", F.when(F.col("latest_at").isNull(), F.lit("no_prices")))
    return out.withColumn("error", error).select(*key, F.col("error").isNull().alias("supported"), "error", "latest_at", "latest_price", "signal_on", F.when(F.col("signal_on"), 1.0).when(~F.col("signal_on"), 0.0).alias("target_weight"))
