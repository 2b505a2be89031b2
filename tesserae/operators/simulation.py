"""Accounts of several markets that share cash, and what is read off their curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import series
from tesserae.operators import timeline

#: Turns of the fixed point for the cost of a trade; each adds as many digits as the fee has zeros.
_TURNS = 10


def shared_cash(rows: DataFrame, keys: list[str], price: str, weight: str, fee: float | str = 0.0005, slippage: float = 0.0, cash: float = 1000.0) -> DataFrame:
    """keys, date_utc, equity of accounts that trade to target shares of their equity at the bars that have weights.

    rows: one per key, bar and market. A bar at which any market has a weight is on the schedule; there a market
    without one goes to 0. Between such bars units are held. Fees (a number, or a column that is one for each key) and
    slippage are a share of what is traded, paid such that the shares are met after costs; a market without a price keeps
    its last one.

    Shares after a trade are known, so what an account grows by until the next trade, and what share of it the next trade costs,
    depend on prices and weights only: equity is a running product over bars, and no bar waits for the one before.
    """
    along = Window.partitionBy(*keys, "market").orderBy("date_utc")
    so_far, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    rate = (F.col(fee) if isinstance(fee, str) else F.lit(fee)) + slippage
    rows = rows.select(*keys, "market", "date_utc", rate.alias("_rate"), F.last(price, True).over(so_far).alias("_p"), F.col(weight).cast("double").alias("_w"))
    rows = rows.withColumn("_on", F.max(F.col("_w").isNotNull()).over(Window.partitionBy(*keys, "date_utc")))
    rows = rows.withColumn("_w", F.when(F.col("_on"), F.when(F.col("_p").isNotNull(), F.coalesce("_w", F.lit(0.0))).otherwise(0.0)))
    rows = rows.withColumn("_last_w", F.coalesce(F.last("_w", True).over(before), F.lit(0.0))).withColumn("_last_p", F.last(F.when(F.col("_on"), F.col("_p")), True).over(before))
    rows = rows.withColumn("_held", F.when(F.col("_last_w") != 0, F.col("_last_w") * F.col("_p") / F.col("_last_p")).otherwise(0.0))
    moves = F.collect_list(F.when(F.col("_on") & ((F.col("_w") != 0) | (F.col("_held") != 0)), F.struct(F.col("_w").alias("w"), F.col("_held").alias("h"))))
    bars = rows.groupBy(*keys, "date_utc").agg(F.max("_on").alias("_on"), (1 - F.sum("_last_w") + F.sum("_held")).alias("_grown"), moves.alias("_moves"), F.first("_rate").alias("_rate"))
    rate, grown = F.col("_rate"), F.col("_grown")

    def traded(left):
        return F.aggregate("_moves", F.lit(0.0), lambda total, m: total + F.abs(m["w"] * left - m["h"] / grown))

    left = F.aggregate(F.sequence(F.lit(1), F.lit(_TURNS)), F.lit(1.0), lambda left, _: 1 - rate * traded(left))
    bars = bars.withColumn("_left", F.when(F.col("_on") & (grown > 0), left).otherwise(F.lit(1.0))).drop("_moves")
    bars = timeline.sum_before(bars, keys, F.when(F.col("_on") & (grown > 0), F.ln(grown * F.col("_left"))), "_base")
    return bars.select(*keys, "date_utc", (cash * F.exp("_base") * grown * F.col("_left")).alias("equity"))


def trimmed(rows: DataFrame, keys: list[str], weight: str = "target_weight") -> DataFrame:
    """The bars from the first one on at which some weight is not 0; none if there is no such bar."""
    first = rows.where(F.abs(F.coalesce(F.col(weight), F.lit(0.0))) > 0).groupBy(*keys).agg(F.min("date_utc").alias("_first"))
    joined = rows.join(first, keys) if keys else rows.join(F.broadcast(first))  # without keys one row
    return joined.where(F.col("date_utc") >= F.col("_first")).drop("_first").select(*rows.columns)


def bought_and_held(rows: DataFrame, market: str, price: str, cash: float = 1000.0) -> DataFrame:
    """date_utc, value of cash put into one market at its first bar."""
    curve = rows.where((F.col("market") == market) & F.col(price).isNotNull())
    return curve.select("date_utc", (cash * F.col(price) / F.first(price).over(series.along())).alias("value"))


def window_return(curve: DataFrame, value: str, begins, ends) -> DataFrame:
    """The return in percent of each market's curve from its first to its last row within the times, both included."""
    rows = curve.where(F.col("date_utc").between(F.lit(begins).cast("timestamp_ntz"), F.lit(ends).cast("timestamp_ntz")))
    return rows.groupBy("market").agg((100 * (F.try_divide(F.max_by(value, "date_utc"), F.min_by(value, "date_utc")) - 1)).alias("return_pct"))


def episodes(curve: DataFrame, value: str) -> DataFrame:
    """Every recovered drawdown: market, peak_at, trough_at, recovered_at, depth (positive share), bars down and in all.

    Rows at or above the running peak cut the curve; what lies between two of them is an episode.
    """
    so_far = series.along().rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(series.along())).withColumn("_peak", F.max(value).over(so_far))
    at_peak = F.col(value) >= F.col("_peak")
    rows = rows.withColumn("_island", F.sum(at_peak.cast("int")).over(so_far)).withColumn("_top", at_peak)
    own = rows.groupBy("market", "_island").agg(
        F.min("date_utc").alias("peak_at"), F.min("_n").alias("_first"), F.max("_peak").alias("_height"), F.count("*").alias("_rows"),
        F.min(F.when(~F.col("_top"), F.struct(value, "date_utc", "_n"))).alias("_low"),
    )
    after = Window.partitionBy("market").orderBy("_island")
    own = own.withColumn("recovered_at", F.lead("peak_at").over(after)).where((F.col("_rows") > 1) & F.col("recovered_at").isNotNull())
    return own.select("market", "peak_at", F.col("_low.date_utc").alias("trough_at"), "recovered_at", (1 - F.col(f"_low.{value}") / F.col("_height")).alias("depth"), (F.col("_low._n") - F.col("_first")).alias("bars_down"), F.col("_rows").alias("bars"))
