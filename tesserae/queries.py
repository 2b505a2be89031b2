"""Registered queries over the panels, with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import cross_section as cs
from tesserae.functions import series as ts
from tesserae.operators import orderstats, portfolio
from tesserae.sources import panels

EVENTS = """panel AS (SELECT event_type AS market, date_trunc('hour', ts)::TIMESTAMP AS date_utc, arg_min(value, ts) AS opening_price, max(value) AS high_price,
 min(value) AS low_price, arg_max(value, ts) AS trade_price, count(*)::DOUBLE AS volume, sum(value) AS turnover FROM events GROUP BY 1, 2)"""
BRANDS = """panel AS (SELECT p_brand AS market, date_trunc('week', l_shipdate)::TIMESTAMP AS date_utc, arg_min(l_extendedprice, l_orderkey * 100 + l_linenumber + l_extendedprice / 1e9) AS opening_price,
 max(l_extendedprice) AS high_price, min(l_extendedprice) AS low_price, arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber + l_extendedprice / 1e9) AS trade_price,
 sum(l_quantity)::DOUBLE AS volume, sum(l_extendedprice) AS turnover FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
M = "(PARTITION BY market ORDER BY date_utc ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _roll(function: str, x: str, n: int, name: str) -> str:
    over = "OVER " + M.format(n - 1)
    return f"round(CASE WHEN count({x}) {over} = {n} THEN {function} {over} END, 6) + 0::DOUBLE AS {name}"


def _out(df: DataFrame, digits: int = 6, **columns) -> DataFrame:
    return df.select("market", "date_utc", *[F.round(c, digits).alias(k) for k, c in columns.items()])


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.event_hours(spark, sf_dir)
    return _out(df, **{c: F.col(c) for c in ("opening_price", "high_price", "low_price", "trade_price", "volume", "turnover")})


def bars_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.brand_weeks(spark, sf_dir)
    return _out(df, **{c: F.col(c) for c in ("opening_price", "high_price", "low_price", "trade_price", "volume", "turnover")})


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    return _out(panels.event_hours(spark, sf_dir), momentum=ts.momentum(x, 5), simple_return=ts.simple_return(x, 3), delta=ts.delta(x), forward=ts.forward_return(x, 2), log_volume=F.log1p("volume"))


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = orderstats.rolled(panels.event_hours(spark, sf_dir), "trade_price", 7, {"median": "median"})
    return _out(df, mean=ts.rolling_mean(x, 12), total=ts.rolling_sum(F.col("turnover"), 24), std=ts.rolling_std(x, 12), zscore=ts.rolling_zscore(x, 12), median=F.col("median"))


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, v = F.col("trade_price"), F.col("volume")
    return _out(panels.event_hours(spark, sf_dir), 9, vwma=ts.vwma(x, v, 10), vwgm=ts.vwgm(x, v, 10), age=ts.age(x), true_range=ts.true_range(F.col("high_price"), F.col("low_price"), x))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.brand_weeks(spark, sf_dir)
    x = F.col("turnover")
    df = df.withColumn("rank", cs.cross_rank(x)).withColumn("n", cs.cross_count(x)).withColumn("share", cs.average_percentile(x))
    return _out(df, rank=F.col("rank"), percentile=cs.cross_percentile(x), bucket=cs.bucket(F.col("rank"), F.col("n"), 4), share=F.col("share"), share_bucket=cs.percentile_bucket(F.col("share"), 5))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.brand_weeks(spark, sf_dir).withColumn("mean", ts.rolling_mean(F.col("turnover"), 4))
    chosen = portfolio.universe(df, "mean", lag=1, quantiles=4, buckets=(1, 2))
    return portfolio.weights(chosen, "rank").select("market", "date_utc", "rank", "selected_rank", "bucket", F.round("target_weight", 6).alias("target_weight"))


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.event_hours(spark, sf_dir).withColumn("short", ts.rolling_mean(x, 3)).withColumn("long", ts.rolling_mean(x, 10))
    df = df.withColumn("entry", ts.compare(F.col("short"), "gt", F.col("long"))).withColumn("exit", ts.compare(x, "lt", F.col("short")))
    df = portfolio.holding_state(df, "entry", "exit").withColumn("both", ts.logical("and", F.col("entry"), F.col("exit")))
    return df.select("market", "date_utc", "entry", "exit", "both", "state")


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.avg("trade_price").over(ts.along().rowsBetween(-(1 << 30), 0))
    df = portfolio.drawdowns(panels.event_hours(spark, sf_dir).withColumn("level", level), "level")
    return df.groupBy("market").agg(F.round(-100 * F.min("drawdown"), 6).alias("max_drawdown_pct"), F.count("*").alias("bars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (bars_events, bars_brands, returns, rolling, weighted_means, ranks, selection, crossing, drawdown)}


_BAR = "market, date_utc, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("opening_price", "high_price", "low_price", "trade_price", "volume", "turnover"))
_LN = "CASE WHEN trade_price > 0 THEN ln(trade_price) END"
_W = "OVER (PARTITION BY market ORDER BY date_utc)"


def oracle_sql() -> dict[str, str]:
    ten, twelve = M.format(9), M.format(11)
    return {
        "bars_events": f"WITH {EVENTS} SELECT {_BAR} FROM panel",
        "bars_brands": f"WITH {BRANDS} SELECT {_BAR} FROM panel",
        "returns": f"""WITH {EVENTS}, l AS (SELECT *, {_LN} AS ln_price FROM panel) SELECT market, date_utc, round(ln_price - lag(ln_price, 5) {_W}, 6) AS momentum,
 round(trade_price / nullif(lag(trade_price, 3) {_W}, 0) - 1, 6) AS simple_return, round(trade_price - lag(trade_price, 1) {_W}, 6) AS delta,
 round(lead(trade_price, 2) {_W} / nullif(trade_price, 0) - 1, 6) AS forward, round(ln(1 + volume), 6) AS log_volume FROM l""",
        "rolling": f"""WITH {EVENTS} SELECT market, date_utc, {_roll('avg(trade_price)', 'trade_price', 12, 'mean')}, {_roll('sum(turnover)', 'turnover', 24, 'total')},
 {_roll('stddev_pop(trade_price)', 'trade_price', 12, 'std')}, {_roll('median(trade_price)', 'trade_price', 7, 'median')},
 round(CASE WHEN count(trade_price) OVER {twelve} = 12 THEN (trade_price - avg(trade_price) OVER {twelve}) / nullif(stddev_pop(trade_price) OVER {twelve}, 0) END, 6) AS zscore FROM panel""",
        "weighted_means": f"""WITH {EVENTS}, f AS (SELECT *, CASE WHEN trade_price > 0 THEN 1 END AS good, {_LN} AS ln_price, lag(trade_price) {_W} AS prev FROM panel)
 SELECT market, date_utc, {'round(CASE WHEN count(*) OVER ' + ten + ' = 10 THEN sum(trade_price * volume) OVER ' + ten + ' / nullif(sum(volume) OVER ' + ten + ', 0) END, 9)'} AS vwma,
 round(CASE WHEN count(good) OVER {ten} = 10 AND sum(volume) OVER {ten} > 0 THEN exp(sum(ln_price * volume) OVER {ten} / sum(volume) OVER {ten}) END, 9) AS vwgm,
 round(row_number() {_W}, 9) AS age, round(CASE WHEN prev IS NULL THEN high_price - low_price ELSE greatest(high_price - low_price, abs(high_price - prev), abs(low_price - prev)) END, 9) AS true_range FROM f""",
        "ranks": f"""WITH {BRANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY turnover DESC, market) AS rn, count(*) OVER (PARTITION BY date_utc) AS n,
 rank() OVER (PARTITION BY date_utc ORDER BY turnover) AS low, count(*) OVER (PARTITION BY date_utc, turnover) AS ties FROM panel)
 SELECT market, date_utc, rn::DOUBLE AS rank, round(CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1)::DOUBLE / (n - 1) END, 6) AS percentile, 1 + (rn - 1) * 4 // n AS bucket,
 round((low + (ties - 1) / 2.0) / n, 6) AS share, least(greatest(ceil((low + (ties - 1) / 2.0) / n * 5), 1), 5)::INT AS share_bucket FROM r""",
        "selection": f"""WITH {BRANDS}, m AS (SELECT *, CASE WHEN count(*) OVER {M.format(3)} = 4 THEN avg(turnover) OVER {M.format(3)} END AS mean FROM panel),
 l AS (SELECT *, lag(mean) {_W} AS feature_value FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY feature_value DESC, market) AS rank, count(*) OVER (PARTITION BY date_utc) AS n FROM l WHERE feature_value IS NOT NULL),
 b AS (SELECT *, 1 + (rank - 1) * 4 // n AS bucket FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY rank) AS selected_rank, count(*) OVER (PARTITION BY date_utc) AS k FROM b WHERE bucket IN (1, 2))
 SELECT market, date_utc, rank, selected_rank, bucket, round((1.0 / selected_rank) / sum(1.0 / selected_rank) OVER (PARTITION BY date_utc), 6) AS target_weight FROM s""",
        "crossing": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT market, date_utc, trade_price, CASE WHEN count(*) OVER {M.format(2)} = 3 THEN avg(trade_price) OVER {M.format(2)} END AS short,
 CASE WHEN count(*) OVER {ten} = 10 THEN avg(trade_price) OVER {ten} END AS long, row_number() {_W} AS rn FROM panel),
 e AS (SELECT *, (short > long)::INT::DOUBLE AS entry, (trade_price < short)::INT::DOUBLE AS exit FROM f),
 s AS (SELECT market, rn, CASE WHEN entry IS NULL OR exit IS NULL THEN 0 WHEN entry = 1 THEN 1 ELSE 0 END AS held FROM e WHERE rn = 1
 UNION ALL SELECT e.market, e.rn, CASE WHEN e.entry IS NULL OR e.exit IS NULL THEN s.held WHEN s.held = 0 AND e.entry = 1 THEN 1 WHEN s.held = 1 AND e.exit = 1 THEN 0 ELSE s.held END FROM s JOIN e ON e.market = s.market AND e.rn = s.rn + 1)
 SELECT e.market, e.date_utc, entry, exit, CASE WHEN entry IS NOT NULL AND exit IS NOT NULL THEN (entry = 1 AND exit = 1)::INT::DOUBLE END AS both,
 CASE WHEN entry IS NOT NULL AND exit IS NOT NULL THEN held::DOUBLE END AS state FROM e JOIN s ON e.market = s.market AND e.rn = s.rn""",
        "drawdown": f"""WITH {EVENTS}, l AS (SELECT *, avg(trade_price) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS level FROM panel),
 p AS (SELECT *, max(level) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS peak FROM l)
 SELECT market, round(-100 * min(level / nullif(peak, 0) - 1), 6) AS max_drawdown_pct, count(*) AS bars FROM p GROUP BY market""",
    }
