"""Analytic functions along the bars of a market.

Windows count bars. With nulls="skip" (the default) only bars with a value count, and a bar without one has none; with
nulls="strict" all bars count, and a window that holds a null is null. A window that is not full is null either way.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def along(apart: Column | None = None):
    """The bars of a market in order; with a column, those where it is null and the others apart."""
    return (Window.partitionBy("market") if apart is None else Window.partitionBy("market", apart.isNull())).orderBy("date_utc")


def trailing(n: int, apart: Column | None = None):
    return along(apart).rowsBetween(1 - n, 0)


def counted(x: Column, nulls: str) -> Column | None:
    """What is set apart in windows over x."""
    if nulls not in ("skip", "strict"):
        raise ValueError(f"nulls are skipped or strict, not {nulls}")
    return x if nulls == "skip" else None


def full(x: Column, n: int, value: Column, nulls: str = "strict") -> Column:
    return F.when(F.count(x).over(trailing(n, counted(x, nulls))) == n, value)


def lag(x: Column, n: int, nulls: str = "strict") -> Column:
    before = F.lag(x, n).over(along(counted(x, nulls)))
    return F.when(x.isNotNull(), before) if nulls == "skip" else before


def log(x: Column, mode: str = "log") -> Column:
    """log of what is above 0, or log1p of what is not below 0."""
    if mode not in ("log", "log1p"):
        raise ValueError(f"unknown logarithm {mode}")
    return F.when(x > 0, F.ln(x)) if mode == "log" else F.when(x >= 0, F.log1p(x))


def gaussian_signed(x: Column) -> Column:
    return x * F.exp(-0.5 * x * x)


def momentum(x: Column, n: int, nulls: str = "skip") -> Column:
    return log(x) - log(lag(x, n, nulls))


def simple_return(x: Column, n: int, nulls: str = "skip") -> Column:
    return F.try_divide(x, lag(x, n, nulls)) - 1


def forward_return(x: Column, n: int, nulls: str = "skip") -> Column:
    return F.try_divide(F.lead(x, n).over(along(counted(x, nulls))), x) - 1


def delta(x: Column, n: int = 1, nulls: str = "skip") -> Column:
    return x - lag(x, n, nulls)


def rolling_mean(x: Column, n: int, nulls: str = "skip") -> Column:
    return full(x, n, F.avg(x).over(trailing(n, counted(x, nulls))), nulls)


def rolling_sum(x: Column, n: int, nulls: str = "skip") -> Column:
    return full(x, n, F.sum(x).over(trailing(n, counted(x, nulls))), nulls)


def rolling_std(x: Column, n: int, nulls: str = "skip") -> Column:
    """Of the population."""
    return full(x, n, F.stddev_pop(x).over(trailing(n, counted(x, nulls))), nulls)


def rolling_zscore(x: Column, n: int, nulls: str = "skip", sample: bool = False) -> Column:
    """By the deviation of the population, or of a sample."""
    over = trailing(n, counted(x, nulls))
    deviation = (F.stddev_samp(x) if sample else F.stddev_pop(x)).over(over)
    return full(x, n, F.when(deviation > 0, (x - F.avg(x).over(over)) / deviation), nulls)


def rolling_ratio(x: Column, n: int, nulls: str = "skip") -> Column:
    """x over its rolling mean."""
    return full(x, n, F.try_divide(x, F.avg(x).over(trailing(n, counted(x, nulls)))), nulls)


def scaled_volume(volume: Column, transform: str = "none") -> Column:
    return volume if transform == "none" else log(volume, transform)


def vwma(price: Column, volume: Column, n: int, nulls: str = "skip", transform: str = "none") -> Column:
    volume = scaled_volume(volume, transform)
    both = F.when(price.isNotNull() & volume.isNotNull(), F.lit(1))
    over = trailing(n, counted(both, nulls))
    return full(both, n, F.try_divide(F.sum(price * volume).over(over), F.sum(volume).over(over)), nulls)


def vwgm(price: Column, volume: Column, n: int, nulls: str = "skip", transform: str = "none") -> Column:
    """The volume-weighted geometric mean."""
    volume = scaled_volume(volume, transform)
    both = F.when((price > 0) & volume.isNotNull(), F.lit(1))
    over = trailing(n, counted(both, nulls))
    total = F.sum(volume).over(over)
    return full(both, n, F.when(total > 0, F.exp(F.sum(F.ln(price) * volume).over(over) / total)), nulls)


def age(x: Column) -> Column:
    """Bars with a value so far."""
    return F.when(x.isNotNull(), F.count(x).over(along().rowsBetween(Window.unboundedPreceding, 0)))


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = lag(close, 1)
    return F.when(before.isNull(), high - low).otherwise(F.greatest(high - low, F.abs(high - before), F.abs(low - before)))


def compare(left: Column, operator: str, right: Column) -> Column:
    """1.0 or 0.0; null if either side is."""
    result = {"gt": left > right, "ge": left >= right, "lt": left < right, "le": left <= right, "eq": left == right, "ne": left != right}[operator]
    return result.cast("double")


def logical(operator: str, *flags: Column) -> Column:
    """and, or, not over flags; null if any of them is, even where the others would decide."""
    known = flags[0].isNotNull()
    on = flags[0] != 0
    for f in flags[1:]:
        known, on = known & f.isNotNull(), (on & (f != 0) if operator == "and" else on | (f != 0))
    return F.when(known, (~on if operator == "not" else on).cast("double"))


def volatility(x: Column, n: int) -> Column:
    """Population deviation of n one-bar log returns; compute them as a column first (windows do not nest)."""
    return rolling_std(x, n)


def win_rate(x: Column, returns: Column, n: int, threshold: float = 0.0) -> Column:
    """Share of bars with a return above the threshold; a bar without a return counts as one below."""
    won = F.coalesce((returns > threshold).cast("double"), F.lit(0.0))
    return full(x, n, F.avg(won).over(trailing(n)))


def trend_quality(log_price: Column, number: Column, n: int) -> Column:
    """Slope of the log price along bars times R squared; null where the price stands still."""
    over = trailing(n)
    return full(log_price, n, F.when(F.var_pop(log_price).over(over) > 0, F.regr_slope(log_price, number).over(over) * F.regr_r2(log_price, number).over(over)))


def weighted_return(returns: Column, weight: Column, n: int) -> Column:
    both = F.when(returns.isNotNull() & weight.isNotNull(), F.lit(1))
    return full(both, n, F.try_divide(F.sum(returns * weight).over(trailing(n)), F.sum(weight).over(trailing(n))))


def beta(returns: Column, reference: Column, n: int) -> Column:
    both = F.when(returns.isNotNull() & reference.isNotNull(), F.lit(1))
    return full(both, n, F.try_divide(F.covar_samp(returns, reference).over(trailing(n)), F.var_samp(reference).over(trailing(n))))


def persistent(flag: Column, n: int) -> Column:
    """1.0 where the flag was on for n bars running."""
    return full(flag, n, (F.sum(flag).over(trailing(n)) >= n).cast("double"))


def local_time(at: Column, hours: int = 9) -> Column:
    """A time in UTC as the clock of a zone without summer time shows it; by default that of Seoul."""
    return at + F.make_dt_interval(hours=F.lit(hours))


def period_start(unit: str) -> Column:
    """day, week (from Monday) or month of the bar."""
    return F.date_trunc(unit, F.col("date_utc")).cast("timestamp_ntz")


def calendar_reduce(x: Column, unit: str, how: str) -> Column:
    """mean, sum or last of a period, on each of its bars."""
    over = Window.partitionBy("market", period_start(unit))
    return {"mean": F.avg(x), "sum": F.sum(x), "last": F.max_by(x, F.when(x.isNotNull(), F.col("date_utc")))}[how].over(over)
