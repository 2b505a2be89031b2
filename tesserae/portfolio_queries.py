"""Registered queries of research factors, weights, simulation and metrics, with SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import cross_section as cs
from tesserae.functions import series as ts
from tesserae.operators import metrics, orderstats, portfolio, recursive
from tesserae.queries import BRANDS, EVENTS, M, _out, _roll
from tesserae.sources import panels

REFERENCE = "Brand#1"
YEAR = 24 * 365


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event hours with a smooth price: the mean of all prices so far."""
    level = F.avg("trade_price").over(ts.along().rowsBetween(Window.unboundedPreceding, 0))
    return panels.event_hours(spark, sf_dir).withColumn("level", level)


def research_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.brand_weeks(spark, sf_dir).withColumn("r", ts.simple_return(x, 1)).withColumn("lr", ts.momentum(x, 1)).withColumn("lp", ts.log(x)).withColumn("n", F.row_number().over(ts.along()))
    r = F.col("r")
    df = orderstats.rolled(orderstats.rolled(df, "r", 8, {"median": "median"}), "trade_price", 10, {"share": "percentile"})
    df = orderstats.consistency(df, "r", 7, "consistency")
    return _out(df, volatility=ts.volatility(F.col("lr"), 8), median_momentum=F.col("median"), win_rate=ts.win_rate(x, r, 8), consistency=F.col("consistency"), trend_quality=ts.trend_quality(F.col("lp"), F.col("n"), 12), weighted=ts.weighted_return(r, F.col("turnover"), 6), share=F.col("share"))


def benchmark_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.brand_weeks(spark, sf_dir).withColumn("r", ts.simple_return(x, 1)).withColumn("momentum", ts.simple_return(x, 4))
    reference = df.where(F.col("market") == REFERENCE).select("date_utc", F.col("r").alias("b"), F.col("momentum").alias("bm"))
    df = df.join(reference, "date_utc", "left")
    beta = ts.beta(F.col("r"), F.col("b"), 12)
    return _out(df, beta=beta, residual=F.col("momentum") - beta * F.col("bm"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.event_hours(spark, sf_dir)
    return _out(df, day_mean=ts.calendar_reduce(x, "day", "mean"), week_sum=ts.calendar_reduce(x, "week", "sum"), day_last=ts.calendar_reduce(x, "day", "last"))


def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panels.brand_weeks(spark, sf_dir).withColumn("mean", ts.rolling_mean(F.col("trade_price"), 4)).withColumn("above", ts.compare(F.col("trade_price"), "gt", F.col("mean")))
    df = portfolio.breadth(df.withColumn("steady", ts.persistent(F.col("above"), 2)), "turnover", "above", 10)
    return _out(df, steady=F.col("steady"), breadth=F.col("breadth"))


def scheduled_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.event_hours(spark, sf_dir).withColumn("on", ts.compare(x, "gt", ts.rolling_mean(x, 5)))
    return _out(portfolio.changes_only(portfolio.scheduled(df, "on", "day")), target_weight=F.col("target_weight"))


def capped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover shares with every market held to a twentieth and one of them to a hundredth."""
    df = panels.brand_weeks(spark, sf_dir)
    df = df.withColumn("target_weight", F.col("turnover") / F.sum("turnover").over(cs.across())).withColumn("cap", F.when(F.col("market") == REFERENCE, 0.01).otherwise(0.05))
    return _out(portfolio.capped(df, "cap"), target_weight=F.col("target_weight"))


def smoothings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = recursive.atr(recursive.ewma(panels.event_hours(spark, sf_dir), "trade_price", 6), 5)
    return _out(df, ewma=F.col("ewma"), atr=F.col("atr"))


def directional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(recursive.adx(panels.event_hours(spark, sf_dir), 14), adx=F.col("adx"))


def simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = _levels(spark, sf_dir).withColumn("signal", ts.compare(x, "gt", ts.rolling_mean(x, 3))).withColumn("weight", ts.lag(F.col("signal"), 1))
    return _out(recursive.simulate(df, "level", "weight"), 4, equity=F.col("equity"), cash=F.col("cash"))


def curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(_levels(spark, sf_dir), "level", 365)
    return out.select("market", "bars", *[F.round(c, 5).alias(c) for c in ("total_return", "cagr", "max_drawdown", "sharpe", "sortino")])


def recovery_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recoveries(panels.event_hours(spark, sf_dir), "trade_price")


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _levels(spark, sf_dir)
    reference = df.where("market = 'click'").select("date_utc", "level")
    return metrics.information_ratio(df.where("market <> 'click'"), reference, "level", YEAR).select("market", "bars", F.round("air", 5).alias("air"))


_QUERIES = (research_factors, benchmark_beta, calendar, market_breadth, scheduled_weights, capped_weights, smoothings, directional_index, simulation, curve_metrics, recovery_bars, information)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_W = "OVER (PARTITION BY market ORDER BY date_utc)"
_R = f"trade_price / nullif(lag(trade_price) {_W}, 0) - 1"
_LEVEL = "levels AS (SELECT *, avg(trade_price) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS level FROM panel)"
_RETURNS = f"returns AS (SELECT *, coalesce(level / nullif(lag(level) {_W}, 0) - 1, 0) AS r FROM levels)"


def oracle_sql() -> dict[str, str]:
    seven, eight, twelve = M.format(6), M.format(7), M.format(11)
    return {
        "research_factors": f"""WITH {BRANDS}, l AS (SELECT *, {_R} AS r, ln(trade_price) AS lp, row_number() {_W} AS n FROM panel), f AS (SELECT *, lp - lag(lp) {_W} AS lr, list(trade_price) OVER {M.format(9)} AS held FROM l)
 SELECT market, date_utc, {_roll('stddev_pop(lr)', 'lr', 8, 'volatility')}, {_roll('median(r)', 'r', 8, 'median_momentum')},
 round(CASE WHEN count(*) OVER {eight} = 8 THEN avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) OVER {eight} END, 6) AS win_rate,
 round(CASE WHEN count(r) OVER {seven} = 7 AND abs(avg(r) OVER {seven}) > 1e-12 THEN median(r) OVER {seven} / abs(avg(r) OVER {seven}) END, 6) + 0::DOUBLE AS consistency,
 round(CASE WHEN n >= 12 AND var_pop(lp) OVER {twelve} > 0 THEN regr_slope(lp, n) OVER {twelve} * regr_r2(lp, n) OVER {twelve} END, 6) + 0::DOUBLE AS trend_quality,
 round(CASE WHEN count(r) OVER {M.format(5)} = 6 THEN sum(r * turnover) OVER {M.format(5)} / sum(turnover) OVER {M.format(5)} END, 6) + 0::DOUBLE AS weighted,
 round(CASE WHEN n >= 10 THEN (len(list_filter(held, lambda x: x < trade_price)) + (len(list_filter(held, lambda x: x = trade_price)) + 1) / 2.0) / 10 END, 6) AS share FROM f""",
        "benchmark_beta": f"""WITH {BRANDS}, f AS (SELECT *, {_R} AS r, trade_price / nullif(lag(trade_price, 4) {_W}, 0) - 1 AS momentum FROM panel),
 j AS (SELECT f.*, b.r AS b, b.momentum AS bm FROM f LEFT JOIN f b ON b.market = '{REFERENCE}' AND b.date_utc = f.date_utc),
 k AS (SELECT *, CASE WHEN count(r + b) OVER {twelve} = 12 THEN covar_samp(r, b) OVER {twelve} / nullif(var_samp(b) OVER {twelve}, 0) END AS beta FROM j)
 SELECT market, date_utc, round(beta, 6) AS beta, round(momentum - beta * bm, 6) + 0::DOUBLE AS residual FROM k""",
        "calendar": f"""WITH {EVENTS} SELECT market, date_utc, round(avg(trade_price) OVER (PARTITION BY market, date_trunc('day', date_utc)), 6) AS day_mean, round(sum(trade_price) OVER (PARTITION BY market, date_trunc('week', date_utc)), 6) AS week_sum,
 round(arg_max(trade_price, date_utc) OVER (PARTITION BY market, date_trunc('day', date_utc)), 6) AS day_last FROM panel""",
        "market_breadth": f"""WITH {BRANDS}, f AS (SELECT *, CASE WHEN count(*) OVER {M.format(3)} = 4 THEN (trade_price > avg(trade_price) OVER {M.format(3)})::INT::DOUBLE END AS above FROM panel),
 g AS (SELECT *, CASE WHEN count(above) OVER {M.format(1)} = 2 THEN (sum(above) OVER {M.format(1)} >= 2)::INT::DOUBLE END AS steady,
 row_number() OVER (PARTITION BY date_utc ORDER BY CASE WHEN above IS NOT NULL THEN turnover END DESC NULLS LAST, market) AS place FROM f)
 SELECT market, date_utc, steady, round(avg(CASE WHEN place <= 10 THEN above END) OVER (PARTITION BY date_utc), 6) AS breadth FROM g""",
        "scheduled_weights": f"""WITH {EVENTS}, f AS (SELECT *, coalesce(CASE WHEN count(*) OVER {M.format(4)} = 5 THEN (trade_price > avg(trade_price) OVER {M.format(4)})::INT END, 0) AS sel, min(date_utc) OVER (PARTITION BY date_trunc('day', date_utc)) AS first_bar FROM panel),
 w AS (SELECT *, CASE WHEN date_utc = first_bar THEN CASE WHEN sel = 1 THEN 1.0::DOUBLE / sum(sel) OVER (PARTITION BY date_utc) ELSE 0.0 END END AS w FROM f),
 c AS (SELECT *, (w IS DISTINCT FROM lag(w) {_W})::INT AS changed FROM w), d AS (SELECT *, max(changed) OVER (PARTITION BY date_utc) AS any_changed FROM c)
 SELECT market, date_utc, round(w, 6) AS target_weight FROM d WHERE any_changed = 1""",
        "capped_weights": f"""WITH {BRANDS}, s AS (SELECT * FROM panel) SELECT market, date_utc,
 round(least(turnover / sum(turnover) OVER (PARTITION BY date_utc), CASE WHEN market = '{REFERENCE}' THEN 0.01 ELSE 0.05 END)::DOUBLE, 6) AS target_weight FROM s""",
        "smoothings": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT *, row_number() {_W} AS n, lag(trade_price) {_W} AS prev FROM panel),
 g AS (SELECT *, CASE WHEN prev IS NULL THEN high_price - low_price ELSE greatest(high_price - low_price, abs(high_price - prev), abs(low_price - prev)) END AS tr FROM f),
 h AS (SELECT *, avg(trade_price) OVER {M.format(5)} AS seed, sum(tr) OVER {M.format(4)} AS total FROM g),
 e AS (SELECT market, n, seed AS v FROM h WHERE n = 6 UNION ALL SELECT h.market, h.n, e.v + 2.0::DOUBLE / 7 * (h.trade_price - e.v) FROM e JOIN h ON h.market = e.market AND h.n = e.n + 1),
 a AS (SELECT market, n, total AS v FROM h WHERE n = 5 UNION ALL SELECT h.market, h.n, a.v - a.v / 5 + h.tr FROM a JOIN h ON h.market = a.market AND h.n = a.n + 1)
 SELECT h.market, h.date_utc, round(e.v, 6) AS ewma, round(a.v / 5, 6) AS atr FROM h LEFT JOIN e ON e.market = h.market AND e.n = h.n LEFT JOIN a ON a.market = h.market AND a.n = h.n""",
        "directional_index": f"""WITH RECURSIVE {EVENTS}, f AS (SELECT *, row_number() {_W} AS n, lag(trade_price) {_W} AS prev, coalesce(high_price - lag(high_price) {_W}, 0) AS up, coalesce(lag(low_price) {_W} - low_price, 0) AS down FROM panel),
 g AS (SELECT market, date_utc, n, CASE WHEN prev IS NULL THEN high_price - low_price ELSE greatest(high_price - low_price, abs(high_price - prev), abs(low_price - prev)) END AS tr,
  CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m FROM f),
 s AS (SELECT market, 14::BIGINT AS n, sum(tr)::DOUBLE AS tr, sum(p)::DOUBLE AS p, sum(m)::DOUBLE AS m FROM g WHERE n <= 14 GROUP BY market HAVING count(*) = 14
  UNION ALL SELECT g.market, g.n, s.tr - s.tr / 14 + g.tr, s.p - s.p / 14 + g.p, s.m - s.m / 14 + g.m FROM s JOIN g ON g.market = s.market AND g.n = s.n + 1),
 x AS (SELECT market, n, coalesce(100 * abs(100 * p / nullif(tr, 0) - 100 * m / nullif(tr, 0)) / nullif(100 * p / nullif(tr, 0) + 100 * m / nullif(tr, 0), 0), 0) AS dx FROM s),
 a AS (SELECT market, 27::BIGINT AS n, avg(dx)::DOUBLE AS v FROM x WHERE n BETWEEN 14 AND 27 GROUP BY market HAVING count(*) = 14
  UNION ALL SELECT x.market, x.n, (a.v * 13 + x.dx) / 14 FROM a JOIN x ON x.market = a.market AND x.n = a.n + 1)
 SELECT g.market, g.date_utc, round(a.v, 6) AS adx FROM g LEFT JOIN a ON a.market = g.market AND a.n = g.n""",
        "simulation": f"""WITH RECURSIVE {EVENTS}, {_LEVEL}, m AS (SELECT market, date_utc, level, row_number() {_W} AS n, CASE WHEN count(*) OVER {M.format(2)} = 3 THEN (trade_price > avg(trade_price) OVER {M.format(2)})::INT::DOUBLE END AS signal FROM levels),
 w AS (SELECT *, coalesce(lag(signal) {_W}, 0) AS w FROM m WHERE level > 0),
 s AS (SELECT market, n, 1000.0::DOUBLE AS cash, 0.0::DOUBLE AS units FROM w WHERE n = 1
  UNION ALL SELECT w.market, w.n,
  CASE WHEN w.w * (s.cash + s.units * level) > s.units * level THEN s.cash - (w.w * (s.cash + s.units * level) - s.units * level) / (1 + w.w * 0.0005::DOUBLE) * 1.0005::DOUBLE ELSE s.cash + (s.units * level - w.w * (s.cash + s.units * level)) / (1 - w.w * 0.0005::DOUBLE) * 0.9995::DOUBLE END,
  s.units + CASE WHEN w.w * (s.cash + s.units * level) > s.units * level THEN (w.w * (s.cash + s.units * level) - s.units * level) / (1 + w.w * 0.0005::DOUBLE) / level ELSE -(s.units * level - w.w * (s.cash + s.units * level)) / (1 - w.w * 0.0005::DOUBLE) / level END
  FROM s JOIN w ON w.market = s.market AND w.n = s.n + 1)
 SELECT w.market, w.date_utc, round(cash + units * level, 4) AS equity, round(cash, 4) + 0::DOUBLE AS cash FROM w JOIN s USING (market, n)""",
        "curve_metrics": f"""WITH {EVENTS}, {_LEVEL}, {_RETURNS}, p AS (SELECT *, level / nullif(max(level) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING), 0) - 1 AS down FROM returns)
 SELECT market, count(*) AS bars, round(arg_max(level, date_utc) / arg_min(level, date_utc) - 1, 5) AS total_return, round(pow(arg_max(level, date_utc) / arg_min(level, date_utc), 365.0::DOUBLE / (count(*) - 1)) - 1, 5) AS cagr,
 round(100 * min(down), 5) AS max_drawdown, round(avg(r) / stddev_pop(r) * sqrt(365), 5) AS sharpe, round(avg(r) / stddev_pop(r) FILTER (r < 0) * sqrt(365), 5) AS sortino FROM p GROUP BY market""",
        "recovery_bars": f"""WITH {EVENTS}, p AS (SELECT *, row_number() {_W} AS n, max(trade_price) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS peak FROM panel),
 g AS (SELECT market, date_utc, n - lag(n) {_W} AS gap FROM p WHERE trade_price >= peak), o AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY gap DESC NULLS LAST, date_utc) AS k FROM g)
 SELECT market, max(CASE WHEN k = 1 AND gap > 1 THEN gap END) AS longest, max(CASE WHEN k = 2 AND gap > 1 THEN gap END) AS second FROM o GROUP BY market""",
        "information": f"""WITH {EVENTS}, {_LEVEL}, {_RETURNS} SELECT a.market, count(*) AS bars, round(avg(a.r - b.r) / stddev_pop(a.r - b.r) * sqrt({YEAR}), 5) AS air FROM returns a JOIN returns b ON b.market = 'click' AND a.date_utc = b.date_utc WHERE a.market <> 'click' GROUP BY a.market""",
    }
