"""Universe, weights and equity curves over bars with features."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import cross_section, series
from tesserae.operators import shared, timeline


def holding_state(df: DataFrame, entry: str, leave: str, name: str = "state") -> DataFrame:
    """1.0 while held: off and entry turns on, on and exit turns off, both at once toggle; a null row is null and carries
    the state past. Entry alone sets on, exit alone sets off, so the state after a row is that of the last row with
    one of them, toggled by the rows with both since."""
    known = F.col(entry).isNotNull() & F.col(leave).isNotNull()
    on, off = known & (F.col(entry) != 0), known & (F.col(leave) != 0)
    anchor = F.when(on & ~off, 1).when(off & ~on, 0)
    so_far = series.along().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_anchor", anchor).withColumn("_toggle", F.when(on & off, 1).otherwise(0))
    df = df.withColumn("_group", F.count("_anchor").over(so_far))
    inside = Window.partitionBy("market", "_group").orderBy("date_utc").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.max("_anchor").over(inside), F.lit(0))
    state = (base + F.sum("_toggle").over(inside)) % 2
    return df.withColumn(name, F.when(known, state.cast("double"))).drop("_anchor", "_toggle", "_group")


def universe(df: DataFrame, feature: str, *, lag: int = 1, quantiles: int | None = None, buckets: tuple[int, ...] = (), top: int | None = None, eligible: Column | None = None) -> DataFrame:
    """The markets selected at each bar by a lagged feature: filter, rank, bucket, select."""
    value = series.lag(F.col(feature), lag) if lag else F.col(feature)
    rows = df.withColumn("feature_value", value)
    rows = rows.where(F.col("feature_value").isNotNull() if eligible is None else F.col("feature_value").isNotNull() & eligible)
    rows = rows.withColumn("rank", cross_section.cross_rank(F.col("feature_value")).cast("int")).withColumn("cross_section_size", cross_section.cross_count(F.col("feature_value")))
    if quantiles:
        rows = rows.withColumn("bucket", cross_section.bucket(F.col("rank"), F.col("cross_section_size"), quantiles)).where(F.col("bucket").isin(*buckets))
    if top:
        rows = rows.where(F.col("rank") <= top)
    return rows.withColumn("selected_rank", F.row_number().over(cross_section.across().orderBy("rank")))


def weights(selected: DataFrame, weighting: str = "equal", gross: float = 1.0, *, power: float = 1.0, fixed: float = 0.1, scale: float = 1.0, most: int | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Adds target_weight by bar: equal, fixed, rank (1 / selected_rank ** power, normalised) or feature_value (scores
    within bounds over the number of positive ones, so that weak scores leave cash)."""
    if most:
        selected = selected.where(F.col("selected_rank") <= most)
    over = cross_section.across()
    if weighting == "fixed":
        return selected.withColumn("target_weight", F.lit(float(fixed)))
    if weighting == "equal":
        return selected.withColumn("target_weight", F.lit(gross) / F.count("*").over(over))
    if weighting == "rank":
        raw = F.pow(F.col("selected_rank"), F.lit(-power))
        return selected.withColumn("target_weight", raw * gross / F.sum(raw).over(over))
    score = F.least(F.greatest(F.col("feature_value") / scale, F.lit(low)), F.lit(high))
    positive = F.count(F.when(score > 0, 1)).over(over)
    return selected.withColumn("target_weight", F.when(positive > 0, score * gross / positive).otherwise(F.lit(0.0)))


def rebalance_bars(df: DataFrame, unit: str) -> DataFrame:
    """date_utc of the first bar of every day, week or month that has bars."""
    return df.groupBy(series.period_start(unit).alias("_period")).agg(F.min("date_utc").alias("date_utc")).select("date_utc")


def every(df: DataFrame, k: int) -> DataFrame:
    """date_utc of every k-th bar of the panel, the first one on."""
    bars = timeline.numbered(df.select("date_utc").distinct(), "_n")
    return bars.where((F.col("_n") - 1) % k == 0).select("date_utc")


def carried(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """The rows of the last bar that has some, up to and with each bar of the schedule, dated by the schedule."""
    rows = shared.materialised(rows)
    bars = rows.select("date_utc").distinct().withColumn("_has", F.col("date_utc")).unionByName(schedule.select("date_utc", F.lit(None).cast("timestamp_ntz").alias("_has")))
    bars = bars.groupBy("date_utc").agg(F.max("_has").alias("_has"))
    bars = timeline.last_known(bars, "_has")
    named = schedule.join(bars, "date_utc").where(F.col("_has").isNotNull()).select(F.col("date_utc").alias("_at"), F.col("_has").alias("date_utc"))
    return rows.join(named, "date_utc").drop("date_utc").withColumnRenamed("_at", "date_utc").select(*rows.columns)


def on_schedule(panel: DataFrame, weights: DataFrame, schedule: DataFrame, explicit: bool = True) -> DataFrame:
    """target_weight at every row of the panel: at bars of the schedule the weight or 0, null (hold) at others. Bars that
    the weights name are on the schedule too; with explicit=False weights of bars off it are left out."""
    on = schedule.select("date_utc")
    if explicit:
        on = on.unionByName(weights.select("date_utc"))
    on = on.distinct().withColumn("_on", F.lit(True))
    rows = panel.join(on, "date_utc", "left").join(weights.select("date_utc", "market", F.col("target_weight").alias("_w")), ["date_utc", "market"], "left")
    return rows.withColumn("target_weight", F.when(F.col("_on"), F.coalesce("_w", F.lit(0.0)))).drop("_on", "_w")


def by_precedence(parts: list[DataFrame]) -> DataFrame:
    """date_utc, market, target_weight of several sources, each with a calendar of its own: at a bar the rows of the first
    source that names it hold, so that explicit dates placed before a schedule's weights replace them."""
    rows = [p.select("date_utc", "market", "target_weight", F.lit(i).alias("_source")) for i, p in enumerate(parts)]
    rows = shared.materialised(functools.reduce(DataFrame.unionByName, rows))
    first = rows.groupBy("date_utc").agg(F.min("_source").alias("_source"))
    return rows.join(first, ["date_utc", "_source"]).drop("_source")


def scheduled(df: DataFrame, selected: str, unit: str, gross: float = 1.0) -> DataFrame:
    """target_weight at all bars: equal shares and 0 on the schedule, null (hold) between."""
    on = F.coalesce(F.col(selected), F.lit(0)) != 0
    share = gross / F.nullif(F.count(F.when(on, 1)).over(cross_section.across()), F.lit(0))
    rows = df.join(rebalance_bars(df, unit).withColumn("_on", F.lit(True)), "date_utc", "left")
    return rows.withColumn("target_weight", F.when(F.col("_on"), F.when(on, share).otherwise(0.0))).drop("_on")


def changes_only(rows: DataFrame, weight: str = "target_weight") -> DataFrame:
    """The bars at which some market's weight differs from its last one."""
    before = F.lag(weight).over(series.along())
    rows = rows.withColumn("_new", (~F.col(weight).eqNullSafe(before)).cast("int"))
    return rows.withColumn("_new", F.max("_new").over(cross_section.across())).where("_new = 1").drop("_new")


def capped(rows: DataFrame, cap: str, weight: str = "target_weight", redistribute: bool = False) -> DataFrame:
    """Weights held to a cap column (null: none). What is cut off stays cash, or goes to the others in proportion, again
    within their caps: markets fill in the order of cap over weight until the level that uses everything up."""
    if not redistribute:
        return rows.withColumn(weight, F.least(weight, F.coalesce(cap, F.col(weight))))
    w, limit = F.col(weight), F.coalesce(F.col(cap), F.lit(float("inf")))
    over = cross_section.across()
    order = over.orderBy(F.col("_at"), "market")
    rows = rows.withColumn("_at", F.when(w > 0, limit / w).otherwise(float("inf"))).withColumn("_limit", limit)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    used, free = F.coalesce(F.sum("_limit").over(before), F.lit(0.0)), F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", F.try_divide(F.sum(w).over(over) - used, free))
    # The first market whose cap is not reached at its level sets the level of all.
    level = F.min(F.when(F.col("_at") >= F.col("_level"), F.struct("_at", "market", "_level")))
    rows = rows.withColumn("_level", level.over(over)["_level"])
    return rows.withColumn(weight, F.when(w > 0, F.least(F.col("_limit"), F.coalesce(w * F.col("_level"), F.col("_limit")))).otherwise(0.0)).drop("_at", "_limit", "_level")


def breadth(df: DataFrame, driver: str, signal: str, top: int | None = None, name: str = "breadth", *, quantiles: int | None = None, buckets: tuple[int, ...] = (), descending: bool = True) -> DataFrame:
    """Share of the first markets (or of buckets) by driver whose signal is on, on each row of the bar. Null where no
    market has both; 0 where some have, but none is picked."""
    both = F.col(driver).isNotNull() & F.col(signal).isNotNull()
    value = F.when(both, F.col(driver))
    rows = df.withColumn("_place", cross_section.cross_rank(value, descending)).withColumn("_valid", cross_section.cross_count(value))
    picked = F.col("_place") <= top if top is not None else cross_section.bucket(F.col("_place"), F.col("_valid"), quantiles).isin(*buckets)
    share = F.avg(F.when(picked, (F.col(signal) != 0).cast("double"))).over(cross_section.across())
    return rows.withColumn(name, F.when(F.col("_valid") > 0, F.coalesce(share, F.lit(0.0)))).drop("_place", "_valid")


def order_plan(weights: DataFrame, prices: DataFrame, balances: DataFrame, least: float, cash: str = "KRW") -> DataFrame:
    """What to trade to reach target weights: market, price, quantity, value, target_weight, target_value, delta, action.

    weights: (market, target_weight) of the last bar; prices: (market, price); balances: (currency, balance, locked). A
    currency is held as the market CASH-CURRENCY. Equity is cash and what is held of the markets with a weight or a price; holdings of
    others are unmanaged and left alone. Less than `least` is held.
    """
    own = balances.groupBy(F.upper("currency").alias("currency")).agg(F.sum(F.coalesce("balance", F.lit(0.0)) + F.coalesce("locked", F.lit(0.0))).alias("quantity"))
    money = own.agg(F.coalesce(F.sum(F.when(F.col("currency") == cash, F.col("quantity"))), F.lit(0.0)).alias("_cash"))  # one row
    held = own.where((F.col("currency") != cash) & (F.col("quantity") > 0)).select(F.concat(F.lit(f"{cash}-"), "currency").alias("market"), "quantity", F.lit(True).alias("_held"))
    rows = weights.select("market", "target_weight").join(prices.select("market", "price"), "market", "full").withColumn("_managed", F.lit(True)).join(held, "market", "full")
    rows = rows.withColumn("value", F.coalesce("quantity", F.lit(0.0)) * F.col("price")).withColumn("target_weight", F.coalesce("target_weight", F.lit(0.0)))
    rows = shared.materialised(rows)  # one row a market
    equity = rows.where("_managed").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_sum"))  # one row
    rows = rows.join(F.broadcast(money)).join(F.broadcast(equity)).withColumn("target_value", (F.col("_cash") + F.col("_sum")) * F.col("target_weight"))
    rows = rows.withColumn("delta", F.when(F.col("_managed"), F.col("target_value") - F.coalesce("value", F.lit(0.0))))
    action = F.when(F.col("_managed").isNull(), "unmanaged").when(F.col("price").isNull(), "no price").when(F.abs("delta") < least, "hold").when(F.col("delta") > 0, "buy").otherwise("sell")
    return rows.select("market", "price", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), "value", "target_weight", "target_value", "delta", action.alias("action"))


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the last bar."""
    last = rows.agg(F.max("date_utc").alias("date_utc"))  # one row
    return rows.join(F.broadcast(last), "date_utc", "left_semi")


def rescaled(rows: DataFrame, total: float) -> DataFrame:
    """Weights of each bar in proportion such that they add up to `total` (at most 1); a bar of no weight stays so."""
    share = F.try_divide(F.col("target_weight") * min(total, 1.0), F.sum("target_weight").over(cross_section.across()))
    return rows.withColumn("target_weight", F.coalesce(share, F.lit(0.0)))


def drawdowns(curve: DataFrame, value: str) -> DataFrame:
    """Adds peak and drawdown (0 at a peak, negative below) along each market's curve."""
    peak = F.max(value).over(series.along().rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col(value), F.col("peak")) - 1)


def allocated(sleeves: list[tuple[DataFrame, float]], caps: dict[str, float] | None = None, *, normalise: bool = False, redistribute_inactive: bool = False, redistribute_cut: bool = False) -> DataFrame:
    """allocate, then the capital of inactive sleeves to the active ones, if asked for, then caps by market."""
    out = allocate(sleeves, normalise)
    if redistribute_inactive:
        out = rescaled(out, sum(max(c, 0.0) for _, c in sleeves))
    if caps:
        cap = F.lit(None).cast("double")
        for market, most in caps.items():
            cap = F.when(F.col("market") == market, float(most)).otherwise(cap)
        out = capped(out.withColumn("_cap", cap), "_cap", redistribute=redistribute_cut).drop("_cap")
    return out


def allocate(sleeves: list[tuple[DataFrame, float]], normalise: bool = False) -> DataFrame:
    """(date_utc, market, target_weight) of sleeves, each (date_utc, market, target_weight) with its share of the capital.

    A sleeve holds its last weights at the bars it does not name; at a bar that it names, markets left out have 0.
    """
    rows = bars = None
    for number, (frame, capital) in enumerate(sleeves):
        own = frame.groupBy("date_utc", "market").agg((F.sum("target_weight") * max(capital, 0.0)).alias("w"))
        if normalise:
            own = own.withColumn("w", F.coalesce(F.try_divide(F.col("w") * max(capital, 0.0), F.sum("w").over(cross_section.across())), F.lit(0.0)))
        own = own.withColumn("sleeve", F.lit(number))
        rows = own if rows is None else rows.unionByName(own)
    rows = shared.materialised(rows)
    days = rows.select("date_utc", "sleeve").distinct()
    # Every bar for every sleeve, marked where the sleeve names it; its last named bar is then an equality key.
    bars = days.groupBy("date_utc").agg(F.collect_set("sleeve").alias("named"))
    bars = bars.select("date_utc", "named", F.explode(F.sequence(F.lit(0), F.lit(len(sleeves) - 1))).alias("sleeve"))
    since = F.max(F.when(F.array_contains("named", F.col("sleeve")), F.col("date_utc"))).over(Window.partitionBy("sleeve").orderBy("date_utc"))
    bars = bars.select("sleeve", F.col("date_utc").alias("bar"), since.alias("date_utc"))
    return bars.join(rows, ["sleeve", "date_utc"]).groupBy(F.col("bar").alias("date_utc"), "market").agg(F.sum("w").alias("target_weight"))
