"""Universes in stages, and studies of factors over bars and markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import cross_section, series
from tesserae.operators import orderstats, portfolio, shared, timeline


def started(rows: DataFrame, base: Column, least: int) -> DataFrame:
    """The bars from the first one on at which `least` markets or more are eligible: once open, the gate stays open."""
    per_bar = rows.groupBy("date_utc").agg(F.count(F.when(base, 1)).alias("_n"))
    opens = per_bar.where(F.col("_n") >= least).agg(F.min("date_utc").alias("_opens"))
    # One row: the time at which the gate opens.
    return rows.join(F.broadcast(opens), F.col("date_utc") >= F.col("_opens")).drop("_opens")


def rank_filter(rows: DataFrame, feature: str, candidate: str, name: str, *, top: int | None = None, quantiles: int | None = None, buckets: tuple[int, ...] = (), descending: bool = True, scope: str | None = None) -> DataFrame:
    """Adds name: whether a candidate is among the first by a feature. The rank is taken among the markets of `scope`, a
    boolean column; without one, among the candidates."""
    among = F.col(scope or candidate) & F.col(feature).isNotNull()
    value = F.when(among, F.col(feature))
    rank = cross_section.cross_rank(value, descending)
    keep = rank <= top if top else cross_section.bucket(rank, cross_section.cross_count(value), quantiles).isin(*buckets)
    return rows.withColumn(name, F.col(candidate) & among & F.coalesce(keep, F.lit(False)))


def filter_stage(rows: DataFrame, filters: list[dict], candidate: str, mode: str = "sequential") -> DataFrame:
    """Narrows a boolean column. sequential: each filter ranks what the ones before it left; and: all rank the same set.
    A filter is the arguments of rank_filter."""
    if mode == "sequential":
        for f in filters:
            rows = rank_filter(rows, candidate=candidate, name=candidate, **f)
        return rows
    names = [f"_f{n}" for n in range(len(filters))]
    for f, name in zip(filters, names, strict=True):
        rows = rank_filter(rows, candidate=candidate, name=name, **f)
    every = F.col(candidate)
    for name in names:
        every = every & F.col(name)
    return rows.withColumn(candidate, every).drop(*names)


def dense(rows: DataFrame, *columns: str) -> DataFrame:
    """Every market at every bar of the panel, nulls where it has no row, from its first bar to the last of all."""
    rows = shared.materialised(rows.select("market", "date_utc", *columns))
    every = timeline.alive(rows.groupBy("market").agg(F.min("date_utc").alias("_from")), rows)
    return every.join(rows.select("market", "date_utc", *columns), ["market", "date_utc"], "left")


def rank_change(rows: DataFrame, feature: str, n: int, name: str = "rank_change") -> DataFrame:
    """The change of a market's percentile over n bars of the panel, also where the market misses some of them."""
    x = F.col(feature)
    rows = dense(rows.withColumn("_share", cross_section.average_percentile(x)), feature, "_share")
    return rows.withColumn(name, F.col("_share") - series.lag(F.col("_share"), n)).drop("_share")


def _valid(rows: DataFrame, factors: list[str], forward: str, least: int, eligible: str | None, gate_all: bool) -> DataFrame:
    """Rows with a forward return and all factors, of bars that have `least` markets with a forward return, or with all."""
    every = F.col(forward).isNotNull()
    if eligible:
        every = every & F.col(eligible)
    for f in factors:
        every = every & F.col(f).isNotNull()
    gate = every if gate_all else (F.col(forward).isNotNull() & F.col(eligible) if eligible else F.col(forward).isNotNull())
    rows = rows.withColumn("_gate", F.count(F.when(gate, 1)).over(cross_section.across()))
    return rows.where(every & (F.col("_gate") >= least)).drop("_gate")


def _figures(forward: str) -> list[Column]:
    y = F.col(forward)
    return [F.count("*").alias("n"), F.avg(y).alias("mean"), F.percentile(y, F.lit(0.5)).alias("median"), F.stddev_pop(y).alias("deviation"), F.avg((y > 0).cast("double")).alias("positive")]


def bucket_summary(rows: DataFrame, factor: str, forward: str, quantiles: int, least: int = 0, eligible: str | None = None) -> DataFrame:
    """Of each bucket of a factor's average percentile: count, mean and median forward return, deviation, share above 0 and
    mean percentile. Empty buckets have a count of 0; bars with fewer than `least` markets are left out."""
    share = cross_section.average_percentile(F.col(factor))
    both = _valid(rows.withColumn("_share", share).withColumn("bucket", cross_section.percentile_bucket(F.col("_share"), quantiles)), [factor], forward, least, eligible, gate_all=False)
    found = both.groupBy("bucket").agg(*_figures(forward), F.avg("_share").alias("mean_percentile"))
    every = rows.sparkSession.range(1, quantiles + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def factor_cells(rows: DataFrame, factors: list[str], forward: str, quantiles: int, least: int = 0, eligible: str | None = None) -> DataFrame:
    """The figures of each combination of the factors' buckets (columns <factor>_bucket), empty ones included. Markets have
    all factors and a forward return, and bars `least` such markets."""
    names = [f"{f}_bucket" for f in factors]
    for f, name in zip(factors, names, strict=True):
        rows = rows.withColumn("_share", cross_section.average_percentile(F.col(f))).withColumn(name, cross_section.percentile_bucket(F.col("_share"), quantiles)).drop("_share")
    found = _valid(rows, factors, forward, least, eligible, gate_all=True).groupBy(*names).agg(*_figures(forward))
    every = rows.sparkSession.range(quantiles ** len(factors)).select(*[(F.floor(F.col("id") / quantiles**k) % quantiles + 1).cast("int").alias(n) for k, n in enumerate(names)])
    return every.join(found, names, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def factor_matrix(cells: DataFrame, first: str, second: str, figure: str, quantiles: int) -> DataFrame:
    """A table of one figure: a row for each bucket of the first factor, a column (b1, b2, ...) for each of the second."""
    wide = cells.groupBy(f"{first}_bucket").pivot(f"{second}_bucket", list(range(1, quantiles + 1))).agg(F.first(figure))
    return wide.select(f"{first}_bucket", *[F.col(str(k)).alias(f"b{k}") for k in range(1, quantiles + 1)])


def snapshot(rows: DataFrame, anchor: str, columns: list[str]) -> DataFrame:
    """Of each market the columns at its last bar that has the anchor."""
    picked = F.max_by(F.struct("date_utc", anchor, *[c for c in columns if c != anchor]), "date_utc").alias("_row")
    return rows.where(F.col(anchor).isNotNull()).groupBy("market").agg(picked).select("market", "_row.*")


def listed_for(rows: DataFrame, price: str, hours: int, name: str = "listed") -> DataFrame:
    """Adds whether a market's first price is `hours` or more before the bar."""
    first = F.min(F.when(F.col(price).isNotNull(), F.col("date_utc"))).over(Window.partitionBy("market"))
    return rows.withColumn("_first", first).withColumn(name, F.coalesce(F.col("date_utc") >= F.col("_first") + F.make_interval(hours=F.lit(hours)), F.lit(False))).drop("_first")


def selection_stats(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with weights, and the mean, least and largest number of markets held at them."""
    bars = weights.where(F.col("target_weight").isNotNull()).groupBy(*keys, "date_utc").agg(F.count(F.when(F.abs("target_weight") > 0, 1)).alias("_n"))
    figures = [F.count("*").alias("rebalances"), F.avg("_n").alias("mean_selected"), F.min("_n").alias("least_selected"), F.max("_n").alias("most_selected")]
    return bars.groupBy(*keys).agg(*figures)


def turnover_momentum(rows: DataFrame, *, turnover_bars: int, lookback: int, momentum_bars: int, quantiles: int, buckets: tuple[int, ...], every_bars: int, reference: str | None = None, weighted: bool = False, beta_bars: int = 0,
                      least_age: int = 0, least_markets: int = 0, positive: bool = False, low: float = 0.0, high: float = 1.0, lag: int = 0, most: int = 0, gross: float = 1.0) -> DataFrame:
    """Weights of a strategy: markets whose turnover stands high against their own past and among the others, the first of
    them by momentum, in equal shares every so many bars of the panel.

    Momentum is the simple return, weighted by turnover, or what a reference market leaves of it (reference with
    beta_bars). Lags count bars of the panel, so the panel is made dense first.
    """
    price, x = F.col("trade_price"), F.col("turnover")
    rows = rows.withColumn("_sum", series.rolling_sum(x, turnover_bars)).withColumn("_r", series.simple_return(price, 1))
    rows = orderstats.rolled(rows, "_sum", lookback, {"_score": "percentile"})
    if weighted:
        rows = rows.withColumn("momentum", series.weighted_return(F.col("_r"), x, momentum_bars))
    else:
        rows = rows.withColumn("momentum", series.simple_return(price, momentum_bars))
        if reference:
            at = F.col("market") == reference
            for c, name in (("_r", "_ref_r"), ("momentum", "_ref_m")):
                rows = rows.withColumn(name, F.max(F.when(at, F.col(c))).over(cross_section.across()))
            rows = rows.withColumn("_beta", series.beta(F.col("_r"), F.col("_ref_r"), beta_bars)).withColumn("momentum", F.col("momentum") - F.col("_beta") * F.col("_ref_m"))
    rows = rows.withColumn("_age", series.age(price)).withColumn("_share", cross_section.average_percentile(F.col("_score"))).withColumn("_rank", cross_section.average_percentile(F.col("momentum")))
    aged = F.coalesce(F.col("_age") >= least_age, F.lit(False))
    ready = F.count(F.when(F.col("_score").isNotNull() & F.col("momentum").isNotNull() & aged, 1)).over(cross_section.across())
    chosen = cross_section.percentile_bucket(F.col("_share"), quantiles).isin(*buckets) & aged
    if positive:
        chosen = chosen & (F.col("momentum") > 0)
    if low > 0:
        chosen = chosen & (F.col("_rank") >= low)
    if high < 1:
        chosen = chosen & (F.col("_rank") <= high)
    rows = rows.withColumn("_ready", ready).withColumn("_chosen", F.coalesce(chosen, F.lit(False)) & (F.col("_ready") >= least_markets))
    rows = shared.materialised(rows.select("market", "date_utc", "momentum", "_chosen"))
    schedule = portfolio.every(rows, every_bars)
    rows = dense(rows, "momentum", "_chosen")
    if lag:
        rows = rows.withColumn("momentum", series.lag(F.col("momentum"), lag)).withColumn("_chosen", series.lag(F.col("_chosen"), lag))
    rows = rows.join(schedule, "date_utc", "left_semi").where("_chosen")
    rows = rows.withColumn("selected_rank", F.row_number().over(cross_section.across().orderBy(F.col("momentum").desc_nulls_last(), "market")))
    rows = rows.where(F.col("selected_rank") <= most) if most else rows
    return rows.select("date_utc", "market", F.col("momentum").alias("feature_value"), "selected_rank", (gross / F.count("*").over(cross_section.across())).alias("target_weight"))


def against_own_past(rows: DataFrame, column: str, n: int, mode: str, name: str) -> DataFrame:
    """Adds a market's value against its own n bars: percentile, ratio or (by the sample's deviation) zscore."""
    if mode == "percentile":
        return orderstats.rolled(rows, column, n, {name: "percentile"})
    x = F.col(column)
    return rows.withColumn(name, {"ratio": series.rolling_ratio(x, n), "zscore": series.rolling_zscore(x, n, sample=True)}[mode])


def calendar_rolling(rows: DataFrame, column: str, unit: str, n: int, how: str = "mean", name: str = "calendar_rolling") -> DataFrame:
    """The last value of each day, week or month, its mean or sum over n such periods that have one, on each bar of the period."""
    key = ["market", "_period"]
    rows = rows.withColumn("_period", series.period_start(unit))
    last = rows.where(F.col(column).isNotNull()).groupBy(*key).agg(F.max_by(column, "date_utc").alias("_v"))
    over = Window.partitionBy("market").orderBy("_period").rowsBetween(1 - n, 0)
    value = {"mean": F.avg("_v"), "sum": F.sum("_v")}[how].over(over)
    rolled = last.select(*key, F.when(F.count("_v").over(over) == n, value).alias(name))
    return rows.join(rolled, key, "left").drop("_period")


def market_wide(rows: DataFrame, feature: str) -> DataFrame:
    """(date_utc, scale) of a feature that is the same for all markets of a bar; where it is not, that is an error."""
    bars = rows.groupBy("date_utc").agg(F.min(feature).alias("_low"), F.max(feature).alias("_high"))
    same = F.col("_high") - F.col("_low") <= 1e-12
    scale = F.when(F.col("_low").isNull() | same, F.col("_low")).otherwise(F.raise_error(F.lit(f"{feature} differs between the markets of a bar")).cast("double"))
    return bars.select("date_utc", scale.alias("scale"))


def exposure(weights: DataFrame, scale: DataFrame, lag: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Weights times a series (date_utc, scale) that is lagged by bars of its own and held within bounds; null is 0."""
    if lag:
        scale = timeline.lagged(scale, "scale", lag, "_before").drop("scale").withColumnRenamed("_before", "scale")
    before = F.col("scale")
    held = scale.select("date_utc", F.when(before.isNotNull(), F.least(F.greatest(before, F.lit(low)), F.lit(high))).otherwise(0.0).alias("_scale"))
    return weights.join(held, "date_utc", "left").withColumn("target_weight", F.col("target_weight") * F.coalesce("_scale", F.lit(0.0))).drop("_scale")


def listed_rescale(weights: DataFrame, bars: DataFrame, assets: int) -> DataFrame:
    """Weights times `assets` over the number of markets that have a bar."""
    listed = bars.groupBy("date_utc").agg(F.countDistinct("market").alias("_n"))
    return weights.join(listed, "date_utc").withColumn("target_weight", F.col("target_weight") * assets / F.col("_n")).drop("_n")


def tail(rows: DataFrame, n: int, price: str | None = None) -> DataFrame:
    """The last n bars of each market; with a price, the last n that have one and what lies between them."""
    order = Window.partitionBy("market").orderBy(F.desc("date_utc"))
    place = F.row_number().over(order) if price is None else F.when(F.col(price).isNotNull(), F.count(price).over(order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def head(rows: DataFrame, n: int) -> DataFrame:
    """The first n bars of each market."""
    return rows.withColumn("_place", F.row_number().over(series.along())).where(F.col("_place") <= n).drop("_place")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; of a market and bar that both have, the new one."""
    return old.join(new.select("market", "date_utc").distinct(), ["market", "date_utc"], "left_anti").unionByName(new)


def recalculated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old before the first bar of new, then new."""
    cut = new.agg(F.min("date_utc").alias("_cut"))  # one row
    kept = old.join(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col("date_utc") < F.col("_cut"))).drop("_cut")
    return kept.unionByName(new)


def first_seen(rows: DataFrame, *columns: str) -> DataFrame:
    """Of each market the first non-null value of the columns."""
    return rows.groupBy("market").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date_utc"))).alias(c) for c in columns])
