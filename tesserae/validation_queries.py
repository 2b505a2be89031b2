"""Registered queries of walk-forward metrics, whole backtests and grids, with SQL for each."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.engine_queries import _up_universe
from tesserae.engine_sql import SIGNALS, _carried, _chosen
from tesserae.operators import backtest, portfolio, results, segments, shared, signals
from tesserae.plans import payloads, runner, specs
from tesserae.portfolio_queries import _LEVEL, YEAR, _levels
from tesserae.queries import BRANDS, EVENTS, M, _out
from tesserae.research_queries import _RUNS, FEE, _growth, _runs
from tesserae.sinks import runs, tables
from tesserae.sources import intervals, panels, summaries

WEEKS = 52
_DIGITS = {"bars": 0, "longest": 0, "second": 0}


def _both_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = backtest.folds(panels.brand_weeks(spark, sf_dir).select("date_utc"), 18, 6, 3)
    results = segments.fold_metrics(_runs(spark, sf_dir), windows, ["run_id", "market"], "level", "weight", FEE, WEEKS)
    digits = {m: F.round(m, 6) for m in segments.METRICS if m not in _DIGITS}
    return segments.both_phases(results.withColumns(digits), ["market", "run_id"])


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every run in every fold's two windows."""
    return _both_phases(spark, sf_dir)


def fold_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.fold_winners(_both_phases(spark, sf_dir), ["market"], "run_id")
    return out.select("market", "fold", "run_id", "is_air", "oos_air", "oos_cagr", "oos_max_drawdown", "oos_longest")


def candidate_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(segments.candidate_figures(_both_phases(spark, sf_dir), ["market"], "run_id"))


def fold_winner_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(segments.winner_figures(_both_phases(spark, sf_dir), ["market"], "run_id"))


def _rounded(df: DataFrame) -> DataFrame:
    # Means and medians of figures of six digits: no fold count in use leaves a tie at the tenth.
    return df.withColumns({c: F.round(c, 10) for c, kind in df.dtypes if kind == "double"})


TEMPLATES = {
    "features": [
        {"source": "trade_price", "steps": [{"kind": "rolling_mean", "params": {"window": 5}}], "column_name": "mean"},
        {"compare": {"left_feature": "trade_price", "operator": "gt", "right_feature": "mean"}, "column_name": "up"},
        {"source": "turnover", "steps": [{"kind": "cross_percentile"}], "column_name": "share"},
    ],
    "universe": {"feature_column": "{column}", "lag": 0, "top_n": "{top}", "value_filters": [{"feature_column": "up", "operator": "eq", "value": "{value}"}]},
    "weights": {"gross_exposure": 0.9, "rebalance_frequency": "daily"},
}
#: Half of the runs name a column that is not there; a flag is never 2.
PARAMETERS = {"column": ["share", "nowhere"], "top": [1, 3], "value": [1, 2]}


def grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid with runs that fail and runs that hold nothing; how many the first and the second call computed."""
    wanted = payloads.runs(PARAMETERS, TEMPLATES, "{column}_{top}_{value}")
    folder = f"{shared.checkpoint_folder(spark)}/grid-{uuid.uuid4().hex}"
    grid = runner.Grid(_levels(spark, sf_dir), folder, YEAR, price="level", fee=FEE)
    first = grid.run(wanted[:5])
    second, third = grid.run(wanted), grid.run(wanted)
    out = shared.materialised(grid.results(wanted))
    tables.delete(spark, folder)
    figures = [F.round(c, 6).alias(c) for c in ("total_return", "max_drawdown", "sharpe", "mean_selected")]
    return out.select("run_name", "status", F.col("error").isNotNull().cast("int").alias("failed"), "bars", *figures, "rebalances", *[F.lit(n).alias(c) for c, n in (("first", first), ("second", second), ("third", third))])


def spec_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of one spec, from features to equity."""
    run = payloads.runs({"column": ["share"], "top": [3], "value": [1]}, TEMPLATES, "one")[0]
    out = runner.backtest(_levels(spark, sf_dir), run["features"], run["universe"], run["weights"], price="level", fee=FEE)
    return out.select("date_utc", F.round("equity", 4).alias("equity"))


def explicit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly weights that noon hours of some days replace by all of one market, held between."""
    df, chosen = _up_universe(spark, sf_dir)
    weekly = specs.with_weights(df, chosen, {"rebalance_frequency": "weekly"})
    noons = df.where((F.hour("date_utc") == 12) & (F.dayofmonth("date_utc") % 4 == 1)).groupBy("date_utc").agg(F.min("market").alias("market")).withColumn("target_weight", F.lit(0.5))
    rows = portfolio.on_schedule(df, portfolio.by_precedence([noons, weekly]), portfolio.rebalance_bars(df, "week"))
    return _out(rows.where("target_weight IS NOT NULL"), target_weight=F.col("target_weight"))


def sorted_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of markets merged into files in order, and a week of them read back, from less than all files."""
    df = panels.event_hours(spark, sf_dir)
    markets = [df.where(F.col("market") == m) for m in ("click", "purchase")] + [df.where(~F.col("market").isin("click", "purchase"))]
    folder = f"{shared.checkpoint_folder(spark)}/sorted-{uuid.uuid4().hex}"
    runs.merge_sorted(markets, folder, 8)
    begins, ends = datetime.datetime(2024, 1, 8), datetime.datetime(2024, 1, 15)
    read, every = len(runs.files_of(spark, folder, begins, ends)), len(runs.files_of(spark, folder))
    out = shared.materialised(runs.read_slice(spark, folder, begins, ends))
    runs.drop(spark, folder)
    return _out(out, trade_price=F.col("trade_price")).withColumn("pruned", F.lit(int(read < every)))


def feature_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of features in order, and what its manifest tells of them."""
    df = specs.with_features(panels.event_hours(spark, sf_dir), payloads.feature_specs(TEMPLATES["features"]))
    folder = f"{shared.checkpoint_folder(spark)}/features-{uuid.uuid4().hex}"
    out = shared.materialised(runs.write_features(df, folder, ["mean", "up", "share"]))
    runs.drop(spark, folder)
    return out


def warned_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two markets of the highest turnover at each bar that are not warned of: warnings are told by day, of markets with
    few bars the day before."""
    df = shared.materialised(panels.event_hours(spark, sf_dir))
    told = df.groupBy("market", F.date_trunc("day", "date_utc").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    told = told.select("market", (F.col("day") + F.expr("interval 1 day")).alias("date_utc"), F.when(F.col("n") < 23, "CAUTION").otherwise("NONE").alias("market_warning"))
    df = intervals.with_value_at(df, intervals.intervals(told, "market_warning"), "market_warning")
    out = specs.with_universe(df, {"feature_column": "turnover", "lag": 0, "top_n": 2, "exclude_warnings": True})
    return out.select("market", "date_utc", F.round("turnover", 6).alias("turnover"), "selected_rank")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of runs made of parts: every family, some of an unknown one, some malformed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    asset = F.element_at(F.array(*map(F.lit, ("click", "view", "purchase", "nothing"))), (k % 4 + 1).cast("int"))
    short, long = (F.lit(2) + size % 3).cast("string"), (F.lit(6) + size % 4).cast("string")
    family = F.element_at(F.array(*map(F.lit, ("ma_cross", "ma_cross_persist", "ma_cross_exit_persist", "ma_stack", "adx"))), (F.floor(k / 4) % 5 + 1).cast("int"))
    tail = F.when(family == "ma_cross_persist", F.concat(F.lit("_persist"), k % 3 + 1, F.lit("_every_bar"))).when(family == "ma_cross_exit_persist", F.concat(F.lit("_exit_persist"), k % 3 + 1, F.lit("_stateful")))
    tail = tail.when(family == "ma_stack", F.concat(F.lit("_12_every_bar"))).otherwise(F.when(k % 11 == 0, "_each_bar").otherwise("_every_bar"))
    name = F.concat(asset, F.lit("_ma_"), F.when(family == "ma_stack", "stack_").otherwise(""), F.lit("60m_"), short, F.lit("_"), long, tail, F.lit("_fee5bp"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(asset.alias("asset"), family.alias("strategy_family"), name.alias("run_name")).distinct()


def current_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.current(panels.event_hours(spark, sf_dir), shared.materialised(_named(spark, sf_dir)))
    return out.withColumns({"latest_price": F.round("latest_price", 6), "supported": F.col("supported").cast("int"), "signal_on": F.col("signal_on").cast("int")})


def folder_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of results from folders of summaries with unlike columns, of grids and of single runs."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    price, name = F.col("p_retailprice"), F.concat(F.lit("btc_ma_cross_"), "p_partkey").alias("run_name")
    folder = f"{shared.checkpoint_folder(spark)}/summaries-{uuid.uuid4().hex}"
    first = part.where("p_partkey % 4 = 0").select(name, (price / 100).alias("CAGR [%]"), (price / 7).alias("Rolling IR 126d Median"))
    second = part.where("p_partkey % 4 = 1").select(F.concat(F.lit("a, \"b\" "), "p_partkey").alias("run_name"), F.lit("error").alias("status"), (price / 9).alias("Sharpe Ratio"), F.col("p_size").alias("parameter_size"))
    alone = part.where("p_partkey % 4 = 2").groupBy("p_size").agg(F.max("p_retailprice").alias("CAGR [%]"), F.min("p_retailprice").alias("Sharpe Ratio"))
    alone = alone.select(F.concat(F.lit("eth_mom_"), "p_size").alias("run"), F.explode(F.create_map(*[x for c in ("CAGR [%]", "Sharpe Ratio") for x in (F.lit(c), F.col(c))])).alias("index", "value"))
    for rows, at in ((first, "grids/one"), (second, "grids/two"), (alone, "runs")):
        single = "run" in rows.columns  # a run is one file
        writer = (rows.repartition("run") if single else rows).write.option("header", True).option("escape", '"')
        (writer.partitionBy("run") if single else writer).csv(f"{folder}/{at}")
    grids = summaries.widened(shared.materialised(summaries.grid_summaries(spark, f"{folder}/grids", "part-*.csv")))
    runs_ = summaries.widened(shared.materialised(summaries.backtest_summaries(spark, f"{folder}/runs", "part-*.csv")))
    out = shared.materialised(results.results_table(results.normalised(grids, "grid"), results.normalised(runs_, "backtest")))
    tables.delete(spark, folder)
    figures = [F.round(c, 6).alias(c) for c in ("cagr_pct", "sharpe_ratio", "rolling_ir_126d_median")]
    return out.select("record_type", "source_dir", "run_name", "asset_scope", "status", *figures, "parameter_size", F.col("summary_path").endswith(".csv").cast("int").alias("has_path"))


_QUERIES = (fold_metrics, fold_winners, candidate_figures, fold_winner_figures, grid_results, spec_account, explicit_weights, sorted_slice, feature_manifest, warned_universe, current_signals, folder_results)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _sd(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 1e-9 THEN avg({x}) / stddev_pop({x}) * sqrt({WEEKS}) END"


_KEY = "market, run_id, fold, phase"
#: Rows once for each window they lie in, and each window's curve from its own first bar on.
_FOLDED = f"""e AS (SELECT min(date_utc) AS lo, max(date_utc) AS hi FROM panel),
 n AS (SELECT i::INT AS fold, lo + to_months(3 * i::INT) AS t0, lo + to_months(3 * i::INT + 18) AS t1, lo + to_months(3 * i::INT + 24) AS t2 FROM e, range(400) r(i) WHERE lo + to_months(3 * i::INT + 24) <= hi),
 v AS (SELECT fold, 'is' AS phase, t0 AS begins, t1 AS ends FROM n UNION ALL SELECT fold, 'oos', t1, t2 FROM n), w AS (SELECT * FROM runs JOIN v ON date_utc >= begins AND date_utc < ends),
 {_growth('w', _KEY)},
 q AS (SELECT *, exp(sum(ln(growth)) OVER k) AS value, row_number() OVER k AS i, r AS b FROM c WINDOW k AS (PARTITION BY {_KEY} ORDER BY date_utc)),
 x AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE growth - 1 END AS gain, max(value) OVER k AS top FROM q WINDOW k AS (PARTITION BY {_KEY} ORDER BY date_utc)),
 y AS (SELECT {_KEY}, i - lag(i) OVER (PARTITION BY {_KEY} ORDER BY i) AS wait FROM x WHERE value >= top * (1 - 1e-12)),
 z AS (SELECT {_KEY}, max(wait) AS longest, arg_max(wait, (wait, i), 2)[2] AS second FROM (SELECT *, row_number() OVER () AS i FROM y) WHERE wait > 1 GROUP BY ALL),
 m AS (SELECT {_KEY}, count(*) AS bars, round(exp(sum(ln(growth))), 6) AS growth, round(exp(sum(ln(1 + b))), 6) AS benchmark_growth,
  round(CASE WHEN count(*) > 1 THEN (arg_max(value, date_utc) / arg_min(value, date_utc)) ** ({WEEKS}::DOUBLE / (count(*) - 1)) - 1 END, 6) AS cagr, round(100 * max(1 - value / top), 6) AS max_drawdown,
  round({_sd('gain')}, 6) AS sharpe, round(CASE WHEN stddev_pop(gain) FILTER (gain < 0) > 1e-9 THEN avg(gain) / (stddev_pop(gain) FILTER (gain < 0)) * sqrt({WEEKS}) END, 6) AS sortino,
  round({_sd('gain - b')}, 6) AS air FROM x GROUP BY ALL),
 results AS (SELECT m.*, z.longest, z.second FROM m LEFT JOIN z USING ({_KEY})),
 both_ AS (SELECT market, run_id, fold, {', '.join(f"max({k}) FILTER (phase = '{p}') AS {p}_{k}" for p in ('is', 'oos') for k in segments.METRICS)} FROM results GROUP BY ALL),
 won AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY market, fold ORDER BY is_air DESC NULLS LAST, run_id) = 1)"""
_SQL_FIGURES = """count(*) AS folds, round(median(oos_air), 10) AS median_air, round(avg(oos_air), 10) AS mean_air, round(min(oos_air), 10) AS worst_air, round(max(oos_air), 10) AS best_air,
 round(avg((coalesce(oos_air, 0) > 0)::INT), 10) AS air_positive, round(median(oos_cagr), 10) AS median_cagr, round(avg(oos_cagr), 10) AS mean_cagr, round(max(oos_cagr), 10) AS best_cagr,
 round(max(oos_max_drawdown), 10) AS worst_drawdown, round(median(oos_longest), 10) AS median_longest, round(avg(oos_longest), 10) AS mean_longest"""


#: Accounts of the two runs that hold something, bar by bar.
_ACCOUNTS = f"""{EVENTS}, {_LEVEL}, {_chosen(3)}, tops AS (SELECT * FROM (VALUES (1), (3)) t(top)), days AS (SELECT min(date_utc) AS date_utc FROM panel GROUP BY date_trunc('day', panel.date_utc)),
 latest AS (SELECT d.date_utc AS due, max(c.date_utc) AS at_bar FROM days d JOIN chosen c ON c.date_utc <= d.date_utc GROUP BY 1),
 daily AS (SELECT top, due AS date_utc, market, 0.9::DOUBLE / count(*) OVER (PARTITION BY top, due) AS w FROM tops, latest JOIN chosen ON chosen.date_utc = at_bar WHERE place <= top),
 cells AS (SELECT tops.top, m.market, b.date_utc, last_value(level IGNORE NULLS) OVER (PARTITION BY tops.top, m.market ORDER BY b.date_utc ROWS UNBOUNDED PRECEDING) AS p, coalesce(w, 0) AS w, days.date_utc IS NOT NULL AS due
  FROM tops CROSS JOIN (SELECT DISTINCT market FROM panel) m CROSS JOIN (SELECT DISTINCT date_utc FROM panel) b LEFT JOIN levels l ON l.market = m.market AND l.date_utc = b.date_utc
  LEFT JOIN daily ON daily.top = tops.top AND daily.market = m.market AND daily.date_utc = b.date_utc LEFT JOIN days ON days.date_utc = b.date_utc),
 starts AS (SELECT top, min(date_utc) AS begins FROM cells WHERE due AND w > 0 GROUP BY 1),
 bars AS (SELECT top, date_utc, bool_or(due) AS due, list(coalesce(p, 0)::DOUBLE ORDER BY market) AS ps, list(w::DOUBLE ORDER BY market) AS ws, row_number() OVER (PARTITION BY top ORDER BY date_utc) AS n FROM cells JOIN starts USING (top) WHERE date_utc >= begins GROUP BY 1, 2),
 acc AS (SELECT top, 0::BIGINT AS n, 1000.0::DOUBLE AS cash, list_transform(range(5), lambda i: 0.0::DOUBLE) AS us FROM tops
  UNION ALL SELECT top, n, CASE WHEN due THEN total * share * (1 - list_sum(ws)) ELSE cash END, CASE WHEN due THEN list_transform(range(1, 6), lambda j: CASE WHEN ps[j] > 0 THEN ws[j] * total * share / ps[j] ELSE 0.0::DOUBLE END) ELSE us END
  FROM (SELECT *, list_reduce([1.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: 1 - {FEE} * list_sum(list_transform(range(1, 6), lambda j: abs(ws[j] * c - us[j] * ps[j] / total)))) AS share
   FROM (SELECT acc.top, b.n, b.due, b.ps, b.ws, acc.cash, acc.us, acc.cash + list_sum(list_transform(range(1, 6), lambda j: acc.us[j] * b.ps[j])) AS total FROM acc JOIN bars b ON b.top = acc.top AND b.n = acc.n + 1))),
 equity AS (SELECT top, date_utc, cash + list_sum(list_transform(range(1, 6), lambda j: us[j] * ps[j])) AS value FROM acc JOIN bars USING (top, n))"""


def oracle_sql() -> dict[str, str]:
    start = f"WITH {BRANDS}, {_RUNS}, {_FOLDED}"
    return {
        "grid_results": f"""WITH RECURSIVE {_ACCOUNTS}, r AS (SELECT *, coalesce(value / lag(value) OVER k - 1, 0) AS r, value / max(value) OVER k - 1 AS down FROM equity WINDOW k AS (PARTITION BY top ORDER BY date_utc)),
 f AS (SELECT top, count(*) AS bars, arg_max(value, date_utc) / arg_min(value, date_utc) - 1 AS total_return, 100 * min(down) AS max_drawdown, avg(r) / stddev_pop(r) * sqrt({YEAR}) AS sharpe FROM r GROUP BY 1),
 s AS (SELECT top, count(*) AS rebalances, avg(k) AS mean_selected FROM (SELECT top, date_utc, count(CASE WHEN w > 0 THEN 1 END) AS k FROM cells WHERE due GROUP BY 1, 2) GROUP BY 1),
 g AS (SELECT c.name AS name, tops.top, v.value FROM (VALUES ('share'), ('nowhere')) c(name), tops, (VALUES (1), (2)) v(value))
 SELECT name || '_' || g.top || '_' || g.value AS run_name, CASE WHEN name = 'nowhere' THEN 'error' WHEN value = 2 THEN 'empty_weights' ELSE 'ok' END AS status, (name = 'nowhere')::INT AS failed, bars, round(total_return, 6) AS total_return,
 round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, round(mean_selected, 6) AS mean_selected, rebalances, 5 AS first, 3 AS second, 0 AS third
 FROM g LEFT JOIN (f JOIN s USING (top)) ON f.top = g.top AND g.value = 1 AND g.name = 'share'""",
        "spec_account": f"WITH RECURSIVE {_ACCOUNTS} SELECT date_utc, round(value, 4) AS equity FROM equity WHERE top = 3",
        "explicit_weights": f"""WITH {EVENTS}, {_chosen(3)}, {_carried('weekly', 'week', '1.0::DOUBLE / count(*) OVER (PARTITION BY due)')}, noons AS (SELECT date_utc, min(market) AS market, 0.5::DOUBLE AS w FROM panel WHERE hour(date_utc) = 12 AND day(date_utc) % 4 = 1 GROUP BY 1),
 w AS (SELECT date_utc, market, w FROM noons UNION ALL SELECT date_utc, market, w FROM weekly WHERE date_utc NOT IN (SELECT date_utc FROM noons)),
 due AS (SELECT min(date_utc) AS date_utc FROM panel GROUP BY date_trunc('week', panel.date_utc) UNION SELECT date_utc FROM w)
 SELECT market, date_utc, round(coalesce(w, 0), 6)::DOUBLE AS target_weight FROM panel JOIN due USING (date_utc) LEFT JOIN w USING (date_utc, market)""",
        "sorted_slice": f"WITH {EVENTS} SELECT market, date_utc, round(trade_price, 6) AS trade_price, 1 AS pruned FROM panel WHERE date_utc >= '2024-01-08' AND date_utc < '2024-01-15'",
        "feature_manifest": f"""WITH {EVENTS}, {SIGNALS}, f AS (SELECT market, date_utc, CASE WHEN up IS NOT NULL THEN 1 END AS mean, up, turnover AS share FROM sig)
 SELECT 'mean' AS feature, count(mean) AS rows, min(date_utc) FILTER (mean IS NOT NULL) AS first, max(date_utc) FILTER (mean IS NOT NULL) AS last FROM f
 UNION ALL SELECT 'up', count(up), min(date_utc) FILTER (up IS NOT NULL), max(date_utc) FILTER (up IS NOT NULL) FROM f UNION ALL SELECT 'share', count(share), min(date_utc), max(date_utc) FROM f""",
        "warned_universe": f"""WITH {EVENTS}, t AS (SELECT market, date_trunc('day', date_utc) + INTERVAL 1 DAY AS at, count(*) < 23 AS warned FROM panel GROUP BY 1, 2),
 p AS (SELECT panel.*, coalesce(t.warned, false) AS warned FROM panel ASOF LEFT JOIN t ON panel.market = t.market AND panel.date_utc >= t.at),
 k AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY turnover DESC, market) AS selected_rank FROM p WHERE NOT warned)
 SELECT market, date_utc, round(turnover, 6) AS turnover, selected_rank FROM k WHERE selected_rank <= 2""",
        "current_signals": f"""WITH {EVENTS}, a AS (SELECT ['click', 'view', 'purchase', 'nothing'][p_partkey % 4 + 1] AS asset, ['ma_cross', 'ma_cross_persist', 'ma_cross_exit_persist', 'ma_stack', 'adx'][p_partkey // 4 % 5 + 1] AS strategy_family,
  2 + p_size % 3 AS s, 6 + p_size % 4 AS l, p_partkey % 3 + 1 AS k, p_partkey % 11 = 0 AS odd FROM part),
 names AS (SELECT DISTINCT asset, strategy_family, s, l, CASE WHEN strategy_family IN ('ma_cross_persist', 'ma_cross_exit_persist') THEN k END AS k, strategy_family NOT IN ('ma_cross', 'adx') OR NOT odd AS fits,
  asset || '_ma_' || CASE WHEN strategy_family = 'ma_stack' THEN 'stack_' ELSE '' END || '60m_' || s || '_' || l || CASE strategy_family WHEN 'ma_cross_persist' THEN '_persist' || k || '_every_bar' WHEN 'ma_cross_exit_persist' THEN '_exit_persist' || k || '_stateful' WHEN 'ma_stack' THEN '_12_every_bar' ELSE CASE WHEN odd THEN '_each_bar' ELSE '_every_bar' END END || '_fee5bp' AS run_name FROM a),
 p AS (SELECT market, date_utc, trade_price, row_number() OVER (PARTITION BY market ORDER BY date_utc) AS n, count(*) OVER (PARTITION BY market) AS all_, {', '.join(f"CASE WHEN count(*) OVER {M.format(w - 1)} = {w} THEN avg(trade_price) OVER {M.format(w - 1)} END AS m{w}" for w in (2, 3, 4, 6, 7, 8, 9, 12))} FROM panel),
 x AS (SELECT names.*, p.*, CASE s WHEN 2 THEN m2 WHEN 3 THEN m3 ELSE m4 END AS a1, CASE l WHEN 6 THEN m6 WHEN 7 THEN m7 WHEN 8 THEN m8 ELSE m9 END AS a2 FROM names JOIN p ON p.market = asset WHERE fits AND strategy_family <> 'adx'),
 y AS (SELECT *, coalesce(a1 > a2, false) AS up, count(CASE WHEN a1 <= a2 THEN 1 END) OVER (PARTITION BY run_name ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS d3, count(CASE WHEN a1 <= a2 THEN 1 END) OVER (PARTITION BY run_name ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS d2, (a1 <= a2)::INT AS d1 FROM x),
 z AS (SELECT run_name AS name, any_value(strategy_family) AS family, max(date_utc) AS latest_at, arg_max(trade_price, n) AS latest_price,
  CASE any_value(strategy_family) WHEN 'ma_cross' THEN arg_max(up, n) WHEN 'ma_stack' THEN arg_max(up AND coalesce(a2 > m12, false), n) WHEN 'ma_cross_persist' THEN count(CASE WHEN up AND n > all_ - k THEN 1 END) >= any_value(k)
   ELSE coalesce(max(n) FILTER (up), 0) > coalesce(max(n) FILTER (CASE k WHEN 1 THEN d1 = 1 WHEN 2 THEN d2 = 2 ELSE d3 = 3 END), 0) END AS is_on FROM y GROUP BY 1),
 e AS (SELECT names.*, z.*, CASE WHEN strategy_family = 'adx' THEN 'unsupported_strategy_family:adx' WHEN NOT fits THEN 'unsupported_' || strategy_family || '_run_name' WHEN z.latest_at IS NULL THEN 'no_prices' END AS error FROM names LEFT JOIN z ON z.name = names.run_name AND z.family = names.strategy_family)
 SELECT asset, strategy_family, run_name, (error IS NULL)::INT AS supported, error, latest_at, round(latest_price, 6) AS latest_price, is_on::INT AS signal_on, is_on::INT::DOUBLE AS target_weight FROM e""",
        "folder_results": """SELECT 'grid' AS record_type, 'one' AS source_dir, 'btc_ma_cross_' || p_partkey AS run_name, '' AS asset_scope, NULL AS status, round(p_retailprice / 100, 6) AS cagr_pct, NULL::DOUBLE AS sharpe_ratio, round(p_retailprice / 7, 6) AS rolling_ir_126d_median, NULL AS parameter_size, 1 AS has_path FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT 'grid', 'two', 'a, "b" ' || p_partkey, '', 'error', NULL, round(p_retailprice / 9, 6), NULL, p_size::VARCHAR, 1 FROM part WHERE p_partkey % 4 = 1
 UNION ALL SELECT 'backtest', 'run=eth_mom_' || p_size, 'run=eth_mom_' || p_size, '', 'ok', round(max(p_retailprice), 6), round(min(p_retailprice), 6), NULL, NULL, 1 FROM part WHERE p_partkey % 4 = 2 GROUP BY p_size""",
        "fold_metrics": f"{start} SELECT * FROM both_",
        "fold_winners": f"{start} SELECT market, fold, run_id, is_air, oos_air, oos_cagr, oos_max_drawdown, oos_longest FROM won",
        "candidate_figures": f"""{start}, f AS (SELECT market, run_id, {_SQL_FIGURES}, round(median(is_air), 10) AS median_is_air, round(avg(is_air), 10) AS mean_is_air FROM both_ GROUP BY 1, 2),
 s AS (SELECT market, run_id, count(*) AS wins, count(*) / sum(count(*)) OVER (PARTITION BY market) AS share FROM won GROUP BY 1, 2)
 SELECT f.*, coalesce(wins, 0) AS wins, round(coalesce(share, 0), 10)::DOUBLE AS share FROM f LEFT JOIN s USING (market, run_id)""",
        "fold_winner_figures": f"""{start}, s AS (SELECT market, run_id AS most_frequent, count(*) AS most_wins, min(fold) AS first_fold FROM won GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY market ORDER BY count(*) DESC, min(fold)) = 1)
 SELECT f.*, most_frequent, most_wins FROM (SELECT market, {_SQL_FIGURES} FROM won GROUP BY 1) f JOIN s USING (market)""",
    }
