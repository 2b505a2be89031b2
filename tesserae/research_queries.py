"""Registered queries of universes in stages, factor studies, grids, walk-forward folds and specs, with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import cross_section as cs
from tesserae.functions import series as ts
from tesserae.operators import backtest, metrics, portfolio, studies
from tesserae.plans import specs
from tesserae.portfolio_queries import _LEVEL, _RETURNS, _W, YEAR, _levels
from tesserae.queries import BRANDS, EVENTS, M, _out
from tesserae.sources import panels

FEE = 0.0005
SHORTS, LONGS = (2, 4, 8), (6, 12)


def gated_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first bar with 20 markets on: high turnover, then of those the upper half by price, in one stage."""
    df = studies.started(panels.brand_weeks(spark, sf_dir), F.col("turnover").isNotNull(), 20).withColumn("in", F.col("volume") > 10)
    df = studies.filter_stage(df, [{"feature": "turnover", "top": 12}, {"feature": "trade_price", "quantiles": 2, "buckets": (1,)}], "in")
    return df.where("in").select("market", "date_utc", F.round("turnover", 6).alias("turnover"))


def calendar_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(studies.calendar_rolling(panels.event_hours(spark, sf_dir), "trade_price", "day", 3, name="mean"), mean=F.col("mean"))


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(studies.rank_change(panels.event_hours(spark, sf_dir), "turnover", 3), rank_change=F.col("rank_change"))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.brand_weeks(spark, sf_dir)
    return df.withColumn("momentum", ts.simple_return(x, 4)).withColumn("forward", ts.forward_return(x, 1))


def bucket_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.bucket_summary(_factors(spark, sf_dir), "momentum", "forward", 5, least=20)
    return out.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "deviation", "positive", "mean_percentile")])


def factor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.factor_cells(_factors(spark, sf_dir), ["momentum", "turnover"], "forward", 3, least=20)
    return out.select("momentum_bucket", "turnover_bucket", "n", F.round("mean", 6).alias("mean"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's bars: a share of 1 after a bar whose short mean was above the long one."""
    df = _levels_of_brands(spark, sf_dir)
    for n in sorted({*SHORTS, *LONGS}):
        df = df.withColumn(f"m{n}", ts.rolling_mean(F.col("trade_price"), n))
    # The grid is a bounded list of parameters; every bar meets every run of it.
    runs = backtest.grid(spark, {"short": list(SHORTS), "long": list(LONGS)}, "short < long")
    rows = df.withColumn("run", F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast("int").alias(c) for c in ("run_id", "short", "long")]) for r in runs.collect()])))
    rows = rows.select("market", "date_utc", "level", *[f"m{n}" for n in sorted({*SHORTS, *LONGS})], "run.*")
    rows = rows.withColumn("signal", ts.compare(backtest.choose("short", {n: f"m{n}" for n in SHORTS}), "gt", backtest.choose("long", {n: f"m{n}" for n in LONGS})))
    return rows.withColumn("weight", F.lag("signal").over(_run_window()))


def _run_window():
    from pyspark.sql import Window

    return Window.partitionBy("run_id", "market").orderBy("date_utc")


def _levels_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.avg("trade_price").over(ts.along().rowsBetween(-(1 << 30), 0))
    return panels.brand_weeks(spark, sf_dir).withColumn("level", level)


def grid_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best runs of each market by growth, with the mean of their neighbours in the grid."""
    rows = backtest.net_growth(_runs(spark, sf_dir), "level", "weight", ["run_id", "market"], FEE)
    results = rows.groupBy("market", "run_id", "short", "long").agg(backtest.compounded(F.col("growth")).alias("growth"))
    results = backtest.plateau(results.withColumn("growth", F.round("growth", 6)), ["short", "long"], "growth", ["market"])
    return backtest.best(results, "growth", 2, ["market"]).select("market", "run_id", "short", "long", "place", "growth", F.round("plateau", 5).alias("plateau"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fold the run with the best growth in 18 months, and its growth in the 6 after."""
    rows = _runs(spark, sf_dir)
    windows = backtest.folds(panels.brand_weeks(spark, sf_dir).select("date_utc"), 18, 6, 3)
    rows = backtest.net_growth(backtest.in_folds(rows, windows), "level", "weight", ["fold", "phase", "run_id", "market"], FEE)
    results = rows.groupBy("market", "fold", "phase", "run_id").agg(F.round(backtest.compounded(F.col("growth")), 6).alias("growth"))
    return backtest.winners(results, ["market"], "run_id", "growth").select("market", "fold", "run_id", "is_growth", "oos_growth")


def rolling_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _levels(spark, sf_dir)
    rows = metrics.excess(df.where("market <> 'click'"), df.where("market = 'click'").select("date_utc", "level"), "level")
    out = metrics.rolling_summary(metrics.rolling_information(rows, 48, YEAR))
    return out.select("market", *[F.round(c, 4).alias(c) for c in ("mean", "deviation", "median", "q25", "positive", "least", "most")])


def latest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(studies.tail(panels.event_hours(spark, sf_dir), 5), trade_price=F.col("trade_price"))


SPECS = [
    {"source": "trade_price", "steps": [{"kind": "rolling_mean", "params": {"window": 3}}], "column_name": "short"},
    {"source": "trade_price", "steps": [{"kind": "rolling_mean", "params": {"window": 10}}], "column_name": "long"},
    {"compare": {"left_feature": "short", "operator": "gt", "right_feature": "long"}, "column_name": "up"},
    {"source": "turnover", "steps": [{"kind": "rolling_sum", "params": {"window": 4}}, {"kind": "cross_percentile"}], "column_name": "share"},
    {"source": "market:click:trade_price", "column_name": "reference"},
    {"components": [{"feature_column": "up", "weight": 0.5}, {"feature_column": "share", "weight": 2.0}], "combine": "weighted_sum", "column_name": "score"},
]


def spec_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = specs.with_features(panels.event_hours(spark, sf_dir), SPECS)
    return _out(df, up=F.col("up"), share=F.col("share"), reference=F.col("reference"), score=F.col("score"))


def spec_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = specs.with_features(panels.event_hours(spark, sf_dir), SPECS)
    chosen = specs.with_universe(df, {"feature_column": "share", "lag": 1, "mode": "top_n", "top_n": 2, "value_filters": [{"feature_column": "up", "operator": "gt", "value": 0.0, "lag": 1}]})
    return _out(specs.with_weights(df, chosen, {"weighting": "equal", "rebalance_frequency": "daily"}), target_weight=F.col("target_weight"))


_QUERIES = (gated_universe, calendar_means, rank_changes, bucket_study, factor_grid, grid_crossings, walk_forward, rolling_ratio, latest_bars, spec_features, spec_weights)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_FACTORS = f"""factors AS (SELECT *, trade_price / nullif(lag(trade_price, 4) {_W}, 0) - 1 AS momentum, lead(trade_price) {_W} / nullif(trade_price, 0) - 1 AS forward FROM panel),
 held AS (SELECT * FROM factors WHERE momentum IS NOT NULL AND forward IS NOT NULL)"""


def _cut(x: str, k: int) -> str:
    return f"1 + (row_number() OVER (PARTITION BY date_utc ORDER BY {x} DESC, market) - 1) * {k} // count(*) OVER (PARTITION BY date_utc)"


def _mean(n: int) -> str:
    return f"CASE WHEN count(*) OVER {M.format(n - 1)} = {n} THEN avg(trade_price) OVER {M.format(n - 1)} END AS m{n}"


_MEANS = ", ".join(_mean(n) for n in sorted({*SHORTS, *LONGS}))
_GRID = " UNION ALL ".join(f"SELECT {i * len(LONGS) + j} AS run_id, {s} AS short, {n} AS long, market, date_utc, level, (m{s} > m{n})::INT AS signal FROM means" for i, s in enumerate(SHORTS) for j, n in enumerate(LONGS) if s < n)
_RUNS = f"""{_LEVEL}, means AS (SELECT *, {_MEANS} FROM levels), signals AS ({_GRID}),
 runs AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY run_id, market ORDER BY date_utc), 0) AS w FROM signals)"""


def _growth(source: str, keys: str) -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY date_utc)"
    return f"""a AS (SELECT *, coalesce(level / nullif(lag(level) {over}, 0) - 1, 0) AS r, coalesce(lag(w) {over}, 0) AS before FROM {source}),
 b AS (SELECT *, 1 + before * r AS gross, coalesce(before * (1 + r) / nullif(1 + before * r, 0), 0) AS s FROM a),
 c AS (SELECT *, gross * (1 - CASE WHEN w > s THEN {FEE}::DOUBLE * (w - s) / (1 + w * {FEE}::DOUBLE) ELSE {FEE}::DOUBLE * (s - w) / (1 - w * {FEE}::DOUBLE) END) AS growth FROM b)"""


_FEATURES = f"""f AS (SELECT *, (CASE WHEN count(*) OVER {M.format(2)} = 3 THEN avg(trade_price) OVER {M.format(2)} END > CASE WHEN count(*) OVER {M.format(9)} = 10 THEN avg(trade_price) OVER {M.format(9)} END)::INT::DOUBLE AS up,
 CASE WHEN count(*) OVER {M.format(3)} = 4 THEN sum(turnover) OVER {M.format(3)} END AS total, max(CASE WHEN market = 'click' THEN trade_price END) OVER (PARTITION BY date_utc) AS reference FROM panel),
 g AS (SELECT *, count(total) OVER (PARTITION BY date_utc) AS n, row_number() OVER (PARTITION BY date_utc ORDER BY total DESC NULLS LAST, market) AS rn FROM f),
 h AS (SELECT *, CASE WHEN total IS NOT NULL THEN CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1)::DOUBLE / (n - 1) END END AS share FROM g)"""


_FACTORS_OF_ALL = "f AS (SELECT *, trade_price / nullif(lag(trade_price, 4) OVER (PARTITION BY market ORDER BY date_utc), 0) - 1 AS momentum, lead(trade_price) OVER (PARTITION BY market ORDER BY date_utc) / nullif(trade_price, 0) - 1 AS forward FROM panel)"


def _average_share(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date_utc ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date_utc, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date_utc) END"


def oracle_sql() -> dict[str, str]:
    return {
        "gated_universe": f"""WITH {BRANDS}, n AS (SELECT date_utc FROM panel GROUP BY 1 HAVING count(turnover) >= 20), b AS (SELECT * FROM panel WHERE date_utc >= (SELECT min(date_utc) FROM n) AND volume > 10),
 t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY date_utc ORDER BY turnover DESC, market) <= 12), u AS (SELECT *, {_cut('trade_price', 2)} AS bucket FROM t)
 SELECT market, date_utc, round(turnover, 6) AS turnover FROM u WHERE bucket = 1""",
        "calendar_means": f"""WITH {EVENTS}, d AS (SELECT market, date_trunc('day', date_utc) AS day, arg_max(trade_price, date_utc) AS v FROM panel GROUP BY 1, 2),
 m AS (SELECT market, day, CASE WHEN count(*) OVER w = 3 THEN avg(v) OVER w END AS mean FROM d WINDOW w AS (PARTITION BY market ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT p.market, p.date_utc, round(mean, 6) AS mean FROM panel p JOIN m ON m.market = p.market AND m.day = date_trunc('day', p.date_utc)""",
        "rank_changes": f"""WITH {EVENTS}, s AS (SELECT market, date_utc, (rank() OVER (PARTITION BY date_utc ORDER BY turnover) + (count(*) OVER (PARTITION BY date_utc, turnover) - 1) / 2.0) / count(*) OVER (PARTITION BY date_utc) AS share FROM panel),
 l AS (SELECT market, min(date_utc) AS first_bar FROM panel GROUP BY 1), d AS (SELECT l.market, t.date_utc FROM l JOIN (SELECT DISTINCT date_utc FROM panel) t ON t.date_utc >= l.first_bar),
 j AS (SELECT d.market, d.date_utc, s.share FROM d LEFT JOIN s ON s.market = d.market AND s.date_utc = d.date_utc)
 SELECT market, date_utc, round(share - lag(share, 3) {_W}, 6) + 0::DOUBLE AS rank_change FROM j""",
        "bucket_study": f"""WITH {BRANDS}, {_FACTORS_OF_ALL}, s AS (SELECT *, {_average_share('momentum')} AS share, count(forward) OVER (PARTITION BY date_utc) AS gate FROM f),
 b AS (SELECT *, least(greatest(ceil(share * 5), 1), 5)::INT AS bucket FROM s WHERE share IS NOT NULL AND forward IS NOT NULL AND gate >= 20)
 SELECT k.bucket::INT AS bucket, count(b.bucket) AS n, round(avg(forward), 6) AS mean, round(median(forward), 6) AS median, round(stddev_pop(forward), 6) AS deviation,
 round(avg((forward > 0)::INT), 6) AS positive, round(avg(share), 6) AS mean_percentile FROM range(1, 6) k(bucket) LEFT JOIN b ON b.bucket = k.bucket GROUP BY 1""",
        "factor_grid": f"""WITH {BRANDS}, {_FACTORS_OF_ALL}, s AS (SELECT *, {_average_share('momentum')} AS a, {_average_share('turnover')} AS t, count(CASE WHEN momentum IS NOT NULL AND turnover IS NOT NULL THEN forward END) OVER (PARTITION BY date_utc) AS gate FROM f),
 b AS (SELECT *, least(greatest(ceil(a * 3), 1), 3)::INT AS x, least(greatest(ceil(t * 3), 1), 3)::INT AS y FROM s WHERE a IS NOT NULL AND t IS NOT NULL AND forward IS NOT NULL AND gate >= 20)
 SELECT i.k::INT AS momentum_bucket, j.k::INT AS turnover_bucket, count(b.x) AS n, round(avg(forward), 6) AS mean FROM range(1, 4) i(k), range(1, 4) j(k) LEFT JOIN b ON b.x = i.k AND b.y = j.k GROUP BY 1, 2""",
        "grid_crossings": f"""WITH {BRANDS}, {_RUNS}, {_growth('runs', 'run_id, market')}, g AS (SELECT market, run_id, short, long, round(exp(sum(ln(growth))), 6) AS growth FROM c GROUP BY 1, 2, 3, 4),
 k AS (SELECT *, dense_rank() OVER (PARTITION BY market ORDER BY short) AS x, dense_rank() OVER (PARTITION BY market ORDER BY long) AS y FROM g),
 p AS (SELECT a.market, a.run_id, avg(b.growth) AS plateau FROM k a JOIN k b ON a.market = b.market AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2),
 o AS (SELECT k.*, row_number() OVER (PARTITION BY market ORDER BY growth DESC, run_id) AS place FROM k)
 SELECT market, run_id, short, long, place, growth, round(plateau, 5) AS plateau FROM o JOIN p USING (market, run_id) WHERE place <= 2""",
        "walk_forward": f"""WITH {BRANDS}, {_RUNS}, e AS (SELECT min(date_utc) AS lo, max(date_utc) AS hi FROM panel),
 n AS (SELECT i::INT AS fold, lo + to_months(3 * i::INT) AS t0, lo + to_months(3 * i::INT + 18) AS t1, lo + to_months(3 * i::INT + 24) AS t2 FROM e, range(400) r(i) WHERE lo + to_months(3 * i::INT + 24) <= hi),
 v AS (SELECT fold, 'is' AS phase, t0 AS begins, t1 AS ends FROM n UNION ALL SELECT fold, 'oos', t1, t2 FROM n), w AS (SELECT * FROM runs JOIN v ON date_utc >= begins AND date_utc < ends),
 {_growth('w', 'fold, phase, run_id, market')}, g AS (SELECT market, fold, phase, run_id, round(exp(sum(ln(growth))), 6) AS growth FROM c GROUP BY 1, 2, 3, 4),
 h AS (SELECT market, fold, run_id, max(growth) FILTER (phase = 'is') AS is_growth, max(growth) FILTER (phase = 'oos') AS oos_growth FROM g GROUP BY 1, 2, 3)
 SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY market, fold ORDER BY is_growth DESC NULLS LAST, run_id) = 1""",
        "rolling_ratio": f"""WITH {EVENTS}, {_LEVEL}, {_RETURNS}, x AS (SELECT a.market, a.date_utc, a.r - b.r AS e FROM returns a JOIN returns b ON b.market = 'click' AND a.date_utc = b.date_utc WHERE a.market <> 'click'),
 y AS (SELECT market, CASE WHEN count(*) OVER {M.format(47)} = 48 THEN avg(e) OVER {M.format(47)} / nullif(stddev_pop(e) OVER {M.format(47)}, 0) * sqrt({YEAR}) END AS v FROM x)
 SELECT market, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation, round(median(v), 4) AS median, round(quantile_cont(v, 0.25), 4) AS q25, round(avg((v > 0)::INT), 4) AS positive, round(min(v), 4) AS least, round(max(v), 4) AS most FROM y GROUP BY market""",
        "latest_bars": f"WITH {EVENTS} SELECT market, date_utc, round(trade_price, 6) AS trade_price FROM panel QUALIFY row_number() OVER (PARTITION BY market ORDER BY date_utc DESC) <= 5",
        "spec_features": f"WITH {EVENTS}, {_FEATURES} SELECT market, date_utc, up, round(share, 6) AS share, round(reference, 6) AS reference, round(0.5 * up + 2.0 * share, 6)::DOUBLE AS score FROM h",
        "spec_weights": f"""WITH {EVENTS}, {_FEATURES}, l AS (SELECT *, CASE WHEN share IS NOT NULL THEN lag(share) OVER (PARTITION BY market, share IS NULL ORDER BY date_utc) END AS v, CASE WHEN up IS NOT NULL THEN lag(up) OVER (PARTITION BY market, up IS NULL ORDER BY date_utc) END AS on_before FROM h),
 c AS (SELECT * FROM l WHERE v IS NOT NULL AND on_before > 0 QUALIFY row_number() OVER (PARTITION BY date_utc ORDER BY v DESC, market) <= 2),
 s AS (SELECT min(date_utc) AS due FROM panel GROUP BY date_trunc('day', panel.date_utc)),
 k AS (SELECT s.due, max(c.date_utc) AS date_utc FROM s JOIN c ON c.date_utc <= s.due GROUP BY 1)
 SELECT market, due AS date_utc, round(1.0::DOUBLE / count(*) OVER (PARTITION BY due), 6) AS target_weight FROM c JOIN k USING (date_utc)""",
    }
