"""Recursions along the bars of a market: smoothings, the directional index, one market's account, incremental scores.

Linear recurrences are added up within blocks of bars, and what a block starts from comes from the few blocks before it. A score that is held within bounds is composed block by block likewise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import cross_section, series
from tesserae.operators import backtest

#: A block is so long that what came before it counts a thousandth at its end; seven blocks back are beyond double precision.
_FADE, _BLOCKS = 1000.0, 7


def recurrence(rows: DataFrame, number: str, keep: float, step: Column, name: str) -> DataFrame:
    """Adds name: keep times its value at the market's row before, plus step; 0 before row 1. Rows without a number have none.

    Numbers go up by one, so at the first row of a block the ends of the blocks before are whole blocks back. All windows
    are within a market: rows dealt by market once serve any number of recurrences, in one pass over them.
    """
    size = max(1, int(math.log(_FADE) / -math.log(keep))) if 0 < keep < 1 else 1
    rows = rows.withColumn("_step", step).withColumn("_block", F.floor((F.col(number) - 1) / size)).withColumn("_place", (F.col(number) - 1) % size)
    inside = Window.partitionBy("market", "_block").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.pow(F.lit(keep), "_place") * F.sum(F.col("_step") * F.pow(F.lit(keep), -F.col("_place"))).over(inside))
    known = Window.partitionBy("market", F.col(number).isNull()).orderBy(number)
    ends = (F.coalesce(F.lag("_local", 1 + size * back).over(known), F.lit(0.0)) * keep ** (size * back) for back in range(_BLOCKS))
    rows = rows.withColumn("_carry", F.when(F.col("_place") == 0, sum(ends, F.lit(0.0)))).withColumn("_carry", F.first("_carry").over(inside))
    level = F.col("_local") + F.pow(F.lit(keep), F.col("_place") + 1) * F.col("_carry")
    return rows.withColumn(name, F.when(F.col(number).isNotNull(), level)).drop("_step", "_block", "_place", "_local", "_carry")


def _seeded(rows: DataFrame, column: str, n: int, keep: float, gain: float, name: str, seed: str = "avg", skip: int = 0) -> DataFrame:
    """A recurrence over the values of a column that starts at the n-th one after `skip` with their mean or sum."""
    x = F.col(column)
    rows = rows.withColumn("_number", F.when(x.isNotNull(), F.count(x).over(series.along().rowsBetween(Window.unboundedPreceding, 0))))
    first = {"avg": F.avg(x), "sum": F.sum(x)}[seed].over(series.trailing(n, x))
    number = F.col("_number") - skip
    rows = rows.withColumn("_first", first)
    rows = recurrence(rows, "_number", keep, F.when(number < n, 0.0).when(number == n, F.col("_first")).otherwise(gain * x), name)
    return rows.withColumn(name, F.when(number >= n, F.col(name))).drop("_number", "_first")


def ewma(df: DataFrame, column: str, n: int, name: str = "ewma", nulls: str = "skip") -> DataFrame:
    """Exponential mean with weight 2 / (n + 1), from the mean of the first n values on; nulls are passed over. With
    nulls="strict" a market with a null among its first n bars has none."""
    out = _seeded(df, column, n, 1 - 2 / (n + 1), 2 / (n + 1), name)
    if nulls == "strict":
        out = out.withColumn("_bar", F.row_number().over(series.along()))
        whole = F.count(F.when((F.col("_bar") <= n), F.col(column))).over(Window.partitionBy("market")) == n
        out = out.withColumn(name, F.when(whole, F.col(name))).drop("_bar")
    return out


def wilder(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Wilder's smoothing: the sum of the first n, then each loses an n-th and gains the value."""
    return _seeded(df, column, n, 1 - 1 / n, 1.0, name, seed="sum")


def _ranges(df: DataFrame) -> DataFrame:
    """Adds true range, upward and downward movement; the latter two are 0 at the first bar."""
    high, low = F.col("high_price"), F.col("low_price")
    df = df.withColumn("_true", series.true_range(high, low, F.col("trade_price")))
    df = df.withColumn("_up", F.coalesce(high - series.lag(high, 1), F.lit(0.0))).withColumn("_down", F.coalesce(series.lag(low, 1) - low, F.lit(0.0)))
    up, down = F.col("_up"), F.col("_down")
    return df.withColumn("_plus", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_minus", F.when((down > up) & (down > 0), down).otherwise(0.0)).drop("_up", "_down")


def atr(df: DataFrame, n: int, name: str = "atr") -> DataFrame:
    """Wilder's average true range."""
    out = wilder(_ranges(df), "_true", n, name)
    return out.withColumn(name, F.col(name) / n).drop("_true", "_plus", "_minus")


def adx(df: DataFrame, n: int, name: str = "adx") -> DataFrame:
    """Wilder's average directional index: the first is the mean of n directional indexes."""
    out = _ranges(df)
    for column in ("_true", "_plus", "_minus"):
        out = wilder(out, column, n, f"{column}_s")
    plus, minus = (F.try_divide(100 * F.col(c), F.col("_true_s")) for c in ("_plus_s", "_minus_s"))
    index = F.coalesce(F.try_divide(100 * F.abs(plus - minus), plus + minus), F.lit(0.0))
    out = out.withColumn("_index", F.when(F.col("_true_s").isNotNull(), index))
    out = _seeded(out, "_index", n, 1 - 1 / n, 1 / n, name)
    return out.drop("_true", "_plus", "_minus", "_true_s", "_plus_s", "_minus_s", "_index")


def simulate(df: DataFrame, price: str, weight: str, fee: float = 0.0005, cash: float = 1000.0) -> DataFrame:
    """equity, cash and units of a single-market account that trades to its target share at every bar, after fees. A null
    weight is 0; shares are held between 0 and 1; a bar without a price above 0 trades nothing and has no figures."""
    priced = df.where(F.col(price) > 0)
    share = F.least(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = backtest.equity(backtest.net_growth(priced, price, weight, ["market"], fee), ["market"], cash).withColumn("_share", share)
    rows = rows.withColumn("cash", F.col("equity") * (1 - F.col("_share"))).withColumn("units", F.col("equity") * F.col("_share") / F.col(price)).drop("growth", "_share")
    rest = df.where(~F.coalesce(F.col(price) > 0, F.lit(False)))
    return rows.unionByName(rest, allowMissingColumns=True)


#: Bars of a block whose steps are composed in one task.
_STEPS = 256


def _stepped(score: Column, on: Column, up: float, down: float, least: float, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), score + F.when(on, F.lit(up)).otherwise(F.lit(-down))))


def incremental_scores(df: DataFrame, signal: str, up: float, down: float, least: float = 0.0, most: float = 1.0, name: str = "score", block: int = _STEPS) -> DataFrame:
    """A score that rises by `up` while the signal is on and falls by `down` while it is off, within bounds, from 0 on.

    A step within bounds is a function min(high, max(low, x + shift)), and such functions are closed under composition: low
    and high are where the steps lead from below and above all bounds, shift is their sum. So a block of a market's bars is one function of
    the score it starts from. Where low equals high the block forgets its start, which most blocks do: a block starts from
    what the blocks since the last such one make of its result. Then each block walks its own bars.
    """
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    rows = df.withColumn("_n", F.row_number().over(series.along()) - 1)
    on = F.coalesce(F.col(signal).cast("double") != 0, F.lit(False)) & ~F.coalesce(F.isnan(F.col(signal).cast("double")), F.lit(False))
    blocks = rows.groupBy("market", F.floor(F.col("_n") / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_n", on.alias("_on"), F.struct(*df.columns).alias("_row")))).alias("_bars"))
    step = lambda x, bar: _stepped(x, bar["_on"], up, down, float(least), float(most))
    shift = F.aggregate("_bars", F.lit(0.0), lambda x, bar: x + F.when(bar["_on"], F.lit(float(up))).otherwise(F.lit(-float(down))))
    blocks = blocks.withColumns({"_low": F.aggregate("_bars", low, step), "_high": F.aggregate("_bars", high, step), "_shift": shift})
    order = Window.partitionBy("market").orderBy("_block")
    blocks = blocks.withColumn("_same", F.coalesce(F.lag(F.when(F.col("_low") == F.col("_high"), 1).otherwise(0)).over(order), F.lit(0)))
    blocks = blocks.withColumn("_island", F.sum("_same").over(order)).withColumn("_given", F.when(F.col("_same") == 1, F.lag("_low").over(order)))
    since = Window.partitionBy("market", "_island").orderBy("_block")
    functions = F.collect_list(F.struct("_low", "_high", "_shift")).over(since.rowsBetween(Window.unboundedPreceding, -1))
    given = F.coalesce(F.first("_given").over(since.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    start = F.aggregate("_before", F.col("_given"), lambda x, f: F.least(f["_high"], F.greatest(f["_low"], x + f["_shift"])))
    blocks = blocks.withColumn("_before", functions).withColumn("_given", given).withColumn("_start", start)
    # The scores so far, the newest last.
    scores = F.aggregate("_bars", F.array("_start"), lambda so_far, bar: F.concat(so_far, F.array(step(F.element_at(so_far, -1), bar))))
    pairs = F.arrays_zip(F.transform("_bars", lambda bar: bar["_row"]).alias("row"), F.slice(scores, 2, F.greatest(F.size("_bars"), F.lit(1))).alias("score"))
    return blocks.select(F.explode(pairs).alias("_at")).select("_at.row.*", F.col("_at.score").alias(name))


def incremental_weights(df: DataFrame, signal: str, up: float, down: float, least: float = 0.0, most: float = 1.0, gross: float = 1.0) -> DataFrame:
    """Adds score and target_weight: gross times score over the number of markets of the bar with a score above 0."""
    rows = incremental_scores(df, signal, up, down, least, most)
    active = F.count(F.when(F.col("score") > 0, 1)).over(cross_section.across())
    return rows.withColumn("target_weight", F.when(active > 0, gross * F.col("score") / active).otherwise(0.0))
