"""Metrics of many windows of the same curves from mergeable summaries of segments.

The edges of all windows cut time into segments, and every bar lies in one. Each segment of a curve is summarised once: number,
mean and squared deviations of returns and excess returns, and of the log equity its total, highest and lowest point, deepest fall and
the stairs of its running peaks. Summaries of neighbouring segments merge:

* moments combine, and a segment's points lie higher by the totals of the segments before it;
* the deepest fall is the deepest within a segment or from the highest point before to a segment's lowest;
* of a segment's stairs those stay that reach the highest point before, and the first of them ends the wait for a new peak.

So a window costs its segments, not its bars, and bars are never repeated for the windows they lie in.

An account begins in cash at a window's first bar. There its return is 0 and it pays for what it buys; the rest of the
segment is as if it had run before, so the points of a window's first segment only shift. Growth of 0 or less counts
as exp(LOST), which is 0 once it is told.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import backtest

#: The log growth of a lost account.
LOST = -10_000.0
#: Deviations below this are rounding, not risk.
NO_DEVIATION = 1e-9

METRICS = ("bars", "growth", "benchmark_growth", "cagr", "max_drawdown", "sharpe", "sortino", "air", "longest", "second")


def _log(growth: Column) -> Column:
    return F.when(growth > 0, F.ln(growth)).otherwise(LOST)


def _edges(windows: DataFrame) -> list[datetime.datetime]:
    """The edges of the windows in order; windows are a bounded list (see backtest.folds)."""
    return sorted({edge for r in windows.select("begins", "ends").collect() for edge in r})


def with_segment(rows: DataFrame, edges: list[datetime.datetime], name: str = "segment") -> DataFrame:
    """Adds the number of edges up to a row's date_utc; rows before the first edge or from the last one on go. A row looks up its
    month, then compares with the edges of that month only."""
    months: dict[datetime.datetime, list[datetime.datetime]] = {}
    for edge in edges:
        months.setdefault(edge.replace(day=1, hour=0, minute=0, second=0, microsecond=0), []).append(edge)
    table, count = [], 0
    if edges:
        month, last = min(months), max(months)
        while month <= last:
            table.append((month, count, months.get(month, [])))
            count += len(months.get(month, []))
            month = (month + datetime.timedelta(days=32)).replace(day=1)
    lookup = rows.sparkSession.createDataFrame(table, "_month timestamp_ntz, _count int, _edges array<timestamp_ntz>")
    within = rows.where(F.col("date_utc") >= F.lit(edges[0]).cast("timestamp_ntz")).where(F.col("date_utc") < F.lit(edges[-1]).cast("timestamp_ntz")) if edges else rows.where("false")
    joined = within.withColumn("_month", F.date_trunc("month", "date_utc").cast("timestamp_ntz")).join(F.broadcast(lookup), "_month")
    passed = F.size(F.filter("_edges", lambda edge: edge <= F.col("date_utc")))
    return joined.withColumn(name, F.col("_count") + passed).drop("_month", "_count", "_edges")


def summaries(rows: DataFrame, edges: list[datetime.datetime], keys: list[str], price: str, weight: str, fee: float) -> DataFrame:
    """One row per key and segment with bars."""
    over = Window.partitionBy(*keys).orderBy("date_utc")
    rows = backtest.net_growth(rows, price, weight, keys, fee)
    held = F.least(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rows = rows.select(
        *keys,
        "date_utc",
        _log(F.col("growth")).alias("_g"),
        (-F.ln(1 + fee * held)).alias("_o"),
        (F.col("growth") - 1).alias("_r"),
        F.coalesce(F.try_divide(F.col(price), F.lag(price).over(over)) - 1, F.lit(0.0)).alias("_b"),
        F.row_number().over(over).alias("_n"),
    )
    inside = Window.partitionBy(*keys, "segment").orderBy("date_utc").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_segment(rows, edges).withColumn("_at", F.sum("_g").over(inside)).withColumn("_top", F.max("_at").over(inside))
    rows = rows.withColumn("_rest", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)) > 1)
    first = F.min_by(F.struct("_g", "_o", "_r", "_b"), "date_utc")
    r, e = F.col("_r"), F.col("_r") - F.col("_b")
    moments = {"r": r, "e": e, "d": F.when(r < 0, r)}
    benchmark = F.sum(_log(1 + F.col("_b")))
    return rows.groupBy(*keys, "segment").agg(
        F.count("*").alias("bars"), first.alias("first"), F.sum("_g").alias("total"), F.max("_at").alias("peak"), F.min("_at").alias("low"),
        F.min(F.col("_at") - F.col("_top")).alias("fall"), benchmark.alias("benchmark"),
        F.array_sort(F.collect_list(F.when(F.col("_at") == F.col("_top"), F.struct(F.col("_n").alias("n"), F.col("_at").alias("at"))))).alias("stairs"),
        *[_moments(F.when(F.col("_rest"), x)).alias(f"m_{k}") for k, x in moments.items()],
    )


def _moments(x: Column) -> Column:
    """Number, mean and sum of squared deviations of the values that are not null."""
    n = F.count(x)
    return F.struct(n.cast("double").alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("squares"))


def _one(x: Column, counts: Column) -> Column:
    """The moments of one value, or of none."""
    return F.struct(F.when(counts, 1.0).otherwise(0.0).alias("n"), F.when(counts, x).otherwise(0.0).alias("mean"), F.lit(0.0).alias("squares"))


def _merged(parts: str) -> dict[str, Column]:
    """Number, mean and population deviation of all values of a list of moments, without differences of large squares."""
    n = F.aggregate(parts, F.lit(0.0), lambda total, m: total + m["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda total, m: total + m["n"] * m["mean"]) / F.nullif(n, F.lit(0.0))
    return {"n": n, "mean": mean}


def _deviation(parts: str, mean: Column, n: Column) -> Column:
    squares = F.aggregate(parts, F.lit(0.0), lambda total, m: total + m["squares"] + m["n"] * (m["mean"] - mean) * (m["mean"] - mean))
    return F.sqrt(squares / F.nullif(n, F.lit(0.0)))


def window_metrics(found: DataFrame, windows: DataFrame, edges: list[datetime.datetime], keys: list[str], bars_a_year: float) -> DataFrame:
    """keys, the columns of windows that name them, and METRICS for each window of `windows` (begins, ends) with bars.

    growth: factor of the equity from the cash on; cagr: from the first bar's equity on; max_drawdown: positive percent;
    longest and second: bars from a peak to the next, where that is more than one, over recovered falls."""
    names = [c for c in windows.columns if c not in ("begins", "ends")]
    place = {edge: i for i, edge in enumerate(edges, 1)}
    spans = [(*[r[c] for c in names], segment) for r in windows.collect() for segment in range(place[r["begins"]], place[r["ends"]])]
    kinds = dict(windows.dtypes)
    table = windows.sparkSession.createDataFrame(spans, ", ".join(f"{c} {kinds[c]}" for c in names) + ", segment int")
    by = [*keys, *names]
    order = Window.partitionBy(*by).orderBy("segment")
    before, far = order.rowsBetween(Window.unboundedPreceding, -1), F.lit(float("-inf"))
    rows = found.join(F.broadcast(table), "segment").withColumn("_opens", F.row_number().over(order) == 1)
    rows = rows.withColumn("_shift", F.when(F.col("_opens"), F.col("first._o") - F.col("first._g")).otherwise(0.0))
    # Points of a segment lie `base` above where they were counted from.
    rows = rows.withColumn("_total", F.col("total") + F.col("_shift")).withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0.0)) + F.col("_shift"))
    rows = rows.withColumn("_height", F.coalesce(F.max(F.col("_base") + F.col("peak")).over(before), far))
    stays = F.filter("stairs", lambda s: s["at"] + F.col("_base") >= F.col("_height"))
    rows = rows.withColumn("_stays", F.transform(stays, lambda s: s["n"]))
    rows = rows.withColumn("_last", F.max(F.array_max("_stays")).over(before)).withColumn("_all", F.when(F.col("_last").isNotNull() & (F.size("_stays") > 0), F.concat(F.array("_last"), "_stays")).otherwise(F.col("_stays")))
    waits = F.zip_with(F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1))), "_all", lambda after, at: after - at)
    rows = rows.withColumn("_waits", F.slice(F.reverse(F.array_sort(F.filter(waits, lambda n: n > 1))), 1, 2))

    # The first bar of a segment counts for itself; the first of the window has a return of 0.
    opens, r, e = F.col("_opens"), F.col("first._r"), F.col("first._r") - F.col("first._b")
    everywhere = F.lit(True)
    firsts = {"r": _one(F.when(opens, 0.0).otherwise(r), everywhere), "e": _one(F.when(opens, 0.0).otherwise(e), everywhere), "d": _one(r, ~opens & (r < 0))}
    parts = [F.flatten(F.collect_list(F.array(F.col(f"m_{k}"), one))).alias(f"_{k}") for k, one in firsts.items()]
    out = rows.groupBy(*by).agg(
        F.sum("bars").alias("bars"), F.sum("_total").alias("total"), F.sum("_shift").alias("shift"),
        F.sum(F.col("benchmark") - F.when(F.col("_opens"), _log(1 + F.col("first._b"))).otherwise(0.0)).alias("benchmark"),
        F.min(F.least("fall", F.col("_base") + F.col("low") - F.col("_height"))).alias("fall"),
        F.max(F.when(F.col("_opens"), F.col("first._o"))).alias("opening"),
        F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("_waits")))), 1, 2).alias("waits"),
        *parts,
    )
    for k in firsts:
        merged = _merged(f"_{k}")
        out = out.withColumns({f"_{k}_n": merged["n"], f"_{k}_mean": merged["mean"]})
        out = out.withColumn(f"_{k}_deviation", _deviation(f"_{k}", F.col(f"_{k}_mean"), F.col(f"_{k}_n")))
    n = F.col("bars")

    def ratio(mean: str, deviation: str) -> Column:
        return F.when(F.col(deviation) > NO_DEVIATION, F.col(mean) / F.col(deviation) * bars_a_year**0.5)

    return out.select(
        *by,
        "bars",
        F.exp("total").alias("growth"),
        F.exp("benchmark").alias("benchmark_growth"),
        F.when(n > 1, F.exp((F.col("total") - F.col("opening")) * bars_a_year / F.nullif(n - 1, F.lit(0))) - 1).alias("cagr"),
        (100 * (1 - F.exp("fall"))).alias("max_drawdown"),
        ratio("_r_mean", "_r_deviation").alias("sharpe"),
        ratio("_r_mean", "_d_deviation").alias("sortino"),
        ratio("_e_mean", "_e_deviation").alias("air"),
        F.get("waits", F.lit(0)).alias("longest"),
        F.get("waits", F.lit(1)).alias("second"),
    )


def fold_metrics(rows: DataFrame, windows: DataFrame, keys: list[str], price: str, weight: str, fee: float, bars_a_year: float) -> DataFrame:
    """METRICS of every key in every window of folds (see backtest.folds), from one pass over the rows."""
    edges = _edges(windows)
    return window_metrics(summaries(rows, edges, keys, price, weight, fee), windows, edges, keys, bars_a_year)


def both_phases(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fold, is_<metric> and oos_<metric> of METRICS."""
    return results.groupBy(*keys, "fold").agg(*[F.max(F.when(F.col("phase") == phase, F.col(m))).alias(f"{phase}_{m}") for phase in ("is", "oos") for m in METRICS])


def fold_winners(both: DataFrame, asset: list[str], candidate: str, metric: str = "air") -> DataFrame:
    """Of each asset and fold the candidate with the best metric in the window to choose in; of equals the first."""
    order = Window.partitionBy(*asset, "fold").orderBy(F.col(f"is_{metric}").desc_nulls_last(), candidate)
    return both.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def _figures() -> list[Column]:
    """Figures of the windows after those chosen in, over folds."""
    air = F.col("oos_air")
    out = [F.count("*").alias("folds"), F.percentile(air, F.lit(0.5)).alias("median_air"), F.avg(air).alias("mean_air"), F.min(air).alias("worst_air"), F.max(air).alias("best_air")]
    out += [F.avg((F.coalesce(air, F.lit(0.0)) > 0).cast("double")).alias("air_positive"), F.percentile("oos_cagr", F.lit(0.5)).alias("median_cagr"), F.avg("oos_cagr").alias("mean_cagr"), F.max("oos_cagr").alias("best_cagr")]
    return [*out, F.max("oos_max_drawdown").alias("worst_drawdown"), F.percentile("oos_longest", F.lit(0.5)).alias("median_longest"), F.avg("oos_longest").alias("mean_longest")]


def candidate_figures(both: DataFrame, asset: list[str], candidate: str, metric: str = "air") -> DataFrame:
    """Of each candidate the figures out of sample, the chosen metric in sample, and how often and in what share it won."""
    chosen = F.col(f"is_{metric}")
    out = both.groupBy(*asset, candidate).agg(*_figures(), F.percentile(chosen, F.lit(0.5)).alias(f"median_is_{metric}"), F.avg(chosen).alias(f"mean_is_{metric}"))
    wins = fold_winners(both, asset, candidate, metric).groupBy(*asset, candidate).agg(F.count("*").alias("wins"))
    wins = wins.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy(*asset)))
    return out.join(wins, [*asset, candidate], "left").withColumns({"wins": F.coalesce("wins", F.lit(0)), "share": F.coalesce("share", F.lit(0.0))})


def winner_figures(both: DataFrame, asset: list[str], candidate: str, metric: str = "air") -> DataFrame:
    """Of each asset the winners' figures out of sample, and the candidate that won most with its number of wins."""
    won = fold_winners(both, asset, candidate, metric)
    wins = won.groupBy(*asset, candidate).agg(F.count("*").alias("wins"), F.min("fold").alias("_first"))
    most = wins.groupBy(*asset).agg(F.min_by(F.struct(candidate, "wins"), F.struct(-F.col("wins"), "_first")).alias("_most"))
    return won.groupBy(*asset).agg(*_figures()).join(most, asset).withColumns({"most_frequent": F.col(f"_most.{candidate}"), "most_wins": F.col("_most.wins")}).drop("_most")
