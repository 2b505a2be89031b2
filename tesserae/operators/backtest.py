"""Backtests of many runs at once: parameter grids, net growth of target weights, walk-forward folds, winners.

Runs are rows: a run's keys are further partition keys of every window, so a grid is one job however many runs it has.
"""

from __future__ import annotations

import datetime
import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, values: dict[str, list], constraint: str | None = None) -> DataFrame:
    """One row per combination of parameters that meets a SQL condition over them, with run_id in the order of the product."""
    rows = [(n, *combination) for n, combination in enumerate(itertools.product(*values.values()))]
    runs = spark.createDataFrame(rows, ["run_id", *values]).withColumn("run_id", F.col("run_id").cast("int"))
    return runs if constraint is None else runs.where(constraint)


def choose(parameter: str, columns: dict[int, str]) -> Column:
    """The column that a run's parameter names."""
    (first, name), *rest = columns.items()
    out = F.when(F.col(parameter) == first, F.col(name))
    for value, name in rest:
        out = out.when(F.col(parameter) == value, F.col(name))
    return out


def net_growth(rows: DataFrame, price: str, weight: str, keys: list[str], fee: float = 0.0005) -> DataFrame:
    """Adds growth: the factor by which an account of one market grows over the bar up to its close, trades at the close
    included. It goes to its target share at every bar and pays fees on what it trades. Null weights are 0, shares are
    held between 0 and 1.

    With the share s held before trading and the target w after fees, buying costs fee (w - s) / (1 + w fee) of the
    equity and selling fee (s - w) / (1 - w fee), so no recursion is needed.
    """
    over = Window.partitionBy(*keys).orderBy("date_utc")
    rows = rows.withColumn("_w", F.least(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("_r", F.coalesce(F.try_divide(F.col(price), F.lag(price).over(over)) - 1, F.lit(0.0)))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_w").over(over), F.lit(0.0)))
    w, before, r = F.col("_w"), F.col("_before"), F.col("_r")
    gross = 1 + before * r
    share = F.coalesce(F.try_divide(before * (1 + r), gross), F.lit(0.0))
    cost = F.when(w > share, fee * (w - share) / (1 + w * fee)).otherwise(fee * (share - w) / (1 - w * fee))
    return rows.withColumn("growth", gross * (1 - cost)).drop("_w", "_before", "_r")


def compounded(growth: Column) -> Column:
    """The product of positive growth factors, as an aggregate or over a window; 0 or less at any bar makes it 0."""
    return F.exp(F.sum(F.ln(growth)))


def equity(rows: DataFrame, keys: list[str], cash: float = 1000.0) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy("date_utc").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.min("growth").over(over) <= 0
    return rows.withColumn("equity", F.when(lost, 0.0).otherwise(cash * F.exp(F.sum(F.ln("growth")).over(over))))


def _months_later(at: datetime.datetime, months: int) -> datetime.datetime:
    years, month = divmod(at.month - 1 + months, 12)
    first = at.replace(year=at.year + years, month=month + 1, day=1)
    last_day = (first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1) - datetime.timedelta(days=1)).day
    return first.replace(day=min(at.day, last_day))


def folds(bars: DataFrame, fit_months: int, test_months: int, step_months: int, expanding: bool = False) -> DataFrame:
    """fold, phase (is or oos), begins, ends (half open): a window to choose in and the window after it, while the latter
    ends by the last bar. Its size is the number of steps between the first and the last bar."""
    first, last = bars.agg(F.min("date_utc"), F.max("date_utc")).first()
    rows: list[tuple] = []
    for number in itertools.count():
        if first is None:
            break
        # Counted from the first bar, so that month ends do not wear down.
        begins = _months_later(first, number * step_months)
        middle = _months_later(first, number * step_months + fit_months)
        ends = _months_later(first, number * step_months + fit_months + test_months)
        if ends > last:
            break
        rows += [(number, "is", first if expanding else begins, middle), (number, "oos", middle, ends)]
    return bars.sparkSession.createDataFrame(rows, "fold int, phase string, begins timestamp_ntz, ends timestamp_ntz")


def in_folds(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row once per window it lies in. The windows are few (see folds) and go to every task."""
    return rows.join(F.broadcast(windows), (F.col("date_utc") >= F.col("begins")) & (F.col("date_utc") < F.col("ends"))).drop("begins", "ends")


def winners(results: DataFrame, asset: list[str], candidate: str, metric: str) -> DataFrame:
    """Of each fold and asset the candidate with the best metric in the window to choose in, with both windows' metrics."""
    key = [*asset, "fold", candidate]
    both = results.groupBy(*key).agg(F.max(F.when(F.col("phase") == "is", F.col(metric))).alias(f"is_{metric}"), F.max(F.when(F.col("phase") == "oos", F.col(metric))).alias(f"oos_{metric}"))
    order = Window.partitionBy(*asset, "fold").orderBy(F.col(f"is_{metric}").desc_nulls_last(), candidate)
    return both.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def candidate_summary(results: DataFrame, won: DataFrame, asset: list[str], candidate: str, metric: str) -> DataFrame:
    """Each candidate's median, mean, least, largest metric out of sample and share of folds above 0, how often it won and
    its share of the wins."""
    x = F.col("_x")
    out = results.where("phase = 'oos'").withColumn("_x", F.col(metric)).groupBy(*asset, candidate).agg(
        F.count("*").alias("folds"), F.percentile(x, F.lit(0.5)).alias(f"median_oos_{metric}"), F.avg(x).alias(f"mean_oos_{metric}"),
        F.min(x).alias(f"least_oos_{metric}"), F.max(x).alias(f"most_oos_{metric}"), F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("positive"),
    )
    wins = won.groupBy(*asset, candidate).agg(F.count("*").alias("wins")).withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy(*asset)))
    return out.join(wins, [*asset, candidate], "left").withColumn("wins", F.coalesce("wins", F.lit(0))).withColumn("share", F.coalesce("share", F.lit(0.0)))


def winner_summary(won: DataFrame, asset: list[str], candidate: str, metric: str) -> DataFrame:
    """Of each asset: folds, median and mean metric out of sample of the winners, the candidate that won most (of equals the one that
    won first), and how often each won, as JSON."""
    y = F.col(f"oos_{metric}")
    out = won.groupBy(*asset).agg(F.count("*").alias("folds"), F.percentile(y, F.lit(0.5)).alias(f"median_oos_{metric}"), F.avg(y).alias(f"mean_oos_{metric}"), F.avg(F.when(y.isNotNull(), (y > 0).cast("double"))).alias("positive"))
    wins = won.groupBy(*asset, candidate).agg(F.count("*").alias("_wins"), F.min("fold").alias("_first"))
    most = wins.groupBy(*asset).agg(F.min_by(candidate, F.struct(-F.col("_wins"), "_first", candidate)).alias("most_frequent"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(candidate).cast("string"), "_wins"))))).alias("wins"))
    return out.join(most, asset)


def plateau(results: DataFrame, axes: list[str], metric: str, keys: list[str]) -> DataFrame:
    """Adds plateau: the mean metric of a run and of the runs next to it on the list of values of every numeric axis. On
    axes of other types neighbours have the same value. Values of keys tell grids apart."""
    kinds = dict(results.dtypes)
    numeric = [a for a in axes if kinds[a] in ("int", "bigint", "smallint", "tinyint", "float", "double") or kinds[a].startswith("decimal")]
    same = [*keys, *(a for a in axes if a not in numeric)]
    places = [f"_place{k}" for k in range(len(numeric))]
    rows = results
    for a, place in zip(numeric, places, strict=True):
        rows = rows.withColumn(place, F.dense_rank().over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(a)))
    spread = rows.select(*same, *places, F.col(metric).alias("_m"))
    for place in places:
        spread = spread.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(place, F.col(place) + F.col("_d")).drop("_d")
    means = spread.groupBy(*same, *places).agg(F.avg("_m").alias("plateau"))
    return rows.join(means, [*same, *places]).drop(*places)


def run_status(runs: DataFrame, weights: DataFrame, key: str = "run_id") -> DataFrame:
    """Adds status to runs: empty_weights where a run holds nothing at any bar, else ok."""
    held = weights.where(F.abs("target_weight") > 0).select(key).distinct().withColumn("_held", F.lit(True))
    return runs.join(held, key, "left").withColumn("status", F.when(F.col("_held"), "ok").otherwise("empty_weights")).drop("_held")


def best(results: DataFrame, metric: str, n: int, keys: list[str], where: str | None = None) -> DataFrame:
    """The n best rows of each group by a metric, nulls last, among those that meet a SQL condition."""
    rows = results if where is None else results.where(where)
    order = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), "run_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
