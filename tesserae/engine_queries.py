"""Registered queries of spec steps, universes and weights in full, accounts that share cash, curves, allocation, studies and results, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import cross_section as cs
from tesserae.functions import series as ts
from tesserae.operators import backtest, metrics, portfolio, results, shared, simulation, studies
from tesserae.plans import payloads, specs
from tesserae.portfolio_queries import _levels
from tesserae.queries import _out
from tesserae.research_queries import _factors, _runs
from tesserae.sinks import tables
from tesserae.sources import panels

# --------------------------------------------------------------------------- steps of specs

STEP_SPECS = payloads.feature_specs([
    {"preset": "gaussian_momentum", "params": {"ret_window": 1, "z_window": 6}, "column_name": "gauss"},
    {"preset": "rank_momentum", "params": {"momentum_window": 2, "rank_avg_window": 3}},
    {"preset": "impact_illiquidity", "params": {"avg_window": 4}, "steps": [{"kind": "simple_return", "params": {"window": 1}}, {"kind": "abs"}, {"kind": "ratio_to_reference", "params": {"reference": "turnover"}}, {"kind": "rolling_mean", "params": {"window": 4}}], "column_name": "impact"},
    {"preset": "turnover_rank_persist", "params": {"avg_window": 3}, "source": "turnover"},
    {"source": "trade_price", "steps": [{"kind": "log", "params": {"mode": "log1p"}}], "column_name": "logs"},
    {"source": "trade_price", "steps": [{"kind": "intraday_range_pct"}], "column_name": "range_pct"},
    {"source": "trade_price", "steps": [{"kind": "subtract_reference", "params": {"reference": "market:click:trade_price"}}, {"kind": "abs"}], "column_name": "gap"},
    {"source": "trade_price", "steps": [{"kind": "vwma", "params": {"window": 4, "volume_column": "turnover", "volume_transform": "log1p"}}], "column_name": "weighted"},
    {"source": "trade_price", "steps": [{"kind": "volatility", "params": {"window": 5}}], "column_name": "volatility"},
])


def spec_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = specs.with_features(panels.event_hours(spark, sf_dir), STEP_SPECS)
    return _out(df, **{c: F.col(c) for c in ("gauss", "rank_mom_2_3", "turn_rank_3", "logs", "range_pct", "gap", "weighted", "volatility")}, impact=F.col("impact") * 1e6)


def null_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over prices of which the low ones are missing."""
    df = panels.event_hours(spark, sf_dir).withColumn("x", F.when(F.col("trade_price") > 8, F.col("trade_price")))
    x = F.col("x")
    return _out(df, mean=ts.rolling_mean(x, 3), strict_mean=ts.rolling_mean(x, 3, "strict"), momentum=ts.momentum(x, 2), strict_momentum=ts.momentum(x, 2, "strict"), zscore=ts.rolling_zscore(x, 4), age=ts.age(x).cast("double"), lagged=ts.lag(x, 1, "skip"))


def turnover_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market against its own past in three ways, and whether it has been listed for 200 hours."""
    df = studies.listed_for(panels.event_hours(spark, sf_dir).withColumn("lx", ts.log(F.col("turnover"), "log1p")), "trade_price", 200)
    for column, mode in (("turnover", "percentile"), ("turnover", "ratio"), ("lx", "zscore")):
        df = studies.against_own_past(df, column, 12, mode, mode)
    return _out(df, percentile=F.col("percentile"), ratio=F.col("ratio"), zscore=F.col("zscore"), listed=F.col("listed").cast("double"))


SCORES = {"rules": [
    {"market": "click", "mode": "all_true", "components": [{"feature_column": "up"}, {"feature_column": "rise"}]},
    {"market": "view", "components": [{"feature_column": "up", "weight": 0.25}, {"feature_column": "rise", "weight": 0.5}]},
    {"market": "purchase", "components": [{"feature_column": "rise", "weight": 2.0}]},
]}


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("trade_price")
    df = panels.event_hours(spark, sf_dir).withColumn("mean", ts.rolling_mean(x, 5))
    return df.withColumn("up", ts.compare(x, "gt", F.col("mean"))).withColumn("rise", ts.momentum(x, 1))


def market_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(specs.market_scores(_signals(spark, sf_dir), SCORES), score=F.col("custom_score"))


def bucket_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of markets on among the lowest quarter by price and the second quarter by turnover."""
    df = panels.brand_weeks(spark, sf_dir).withColumn("mean", ts.rolling_mean(F.col("trade_price"), 4)).withColumn("above", ts.compare(F.col("trade_price"), "gt", F.col("mean")))
    for spec in ({"driver_feature": "trade_price", "signal_feature": "above", "mode": "quantile", "quantiles": 4, "bucket_values": [1], "ascending": True}, {"driver_feature": "turnover", "signal_feature": "above", "mode": "quantile", "quantiles": 4, "bucket_values": [2]}):
        df = specs.with_feature(df, {"breadth": spec, "column_name": f"by_{spec['driver_feature']}"})
    return _out(df, by_price=F.col("by_trade_price"), by_turnover=F.col("by_turnover"))


# --------------------------------------------------------------------------- universes and weights

UNIVERSE = {
    "feature_column": "turnover", "lag": 1, "signal_lag": 1, "start_min_cross_section_size": 20, "mode": "quantile", "quantiles": 3, "bucket_values": [1, 2], "scope": "global", "exclude_warnings": True, "min_age_days": 6,
    "excluded_markets": ["Brand#3"], "value_filters": [{"feature_column": "rise", "operator": "gt", "value": -0.5}],
    "filter_stages": [{"mode": "and", "filters": [{"feature_column": "trade_price", "mode": "top_n", "top_n": 15}, {"feature_column": "volume", "mode": "quantile", "quantiles": 2, "bucket_values": [1], "ascending": True, "scope": "base"}]}, {"filters": [{"feature_column": "turnover", "top_n": 8, "lag": 1}]}],
}


def full_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, gate, warnings, age, exclusions, a value filter, a stage that ranks all alike, a stage in turn, then two of three parts by turnover."""
    df = panels.brand_weeks(spark, sf_dir).withColumn("rise", ts.simple_return(F.col("trade_price"), 1)).withColumn("market_warning", F.when(F.col("market") == "Brand#21", "CAUTION").otherwise("NONE"))
    return specs.with_universe(df, UNIVERSE).select("market", "date_utc", F.round("feature_value", 6).alias("feature_value"), F.col("rank").cast("bigint").alias("rank"), F.col("bucket").cast("bigint").alias("bucket"), F.col("cross_section_size").alias("size"), F.col("selected_rank").cast("bigint").alias("selected_rank"))


def _up_universe(spark: SparkSession, sf_dir: str, top: int = 3) -> tuple[DataFrame, DataFrame]:
    df = shared.materialised(_signals(spark, sf_dir).withColumn("share", cs.cross_percentile(F.col("turnover"))))
    return df, specs.with_universe(df, {"feature_column": "share", "lag": 0, "top_n": top, "value_filters": [{"feature_column": "up", "operator": "eq", "value": 1}]})


def weightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, fixed and feature-value weights of one universe, rank weights held to two positions."""
    df, chosen = _up_universe(spark, sf_dir)
    rows = chosen.select("market", "date_utc")
    for name, spec in (("ranked", {"weighting": "rank", "rank_power": 2.0, "max_positions": 2}), ("fixed", {"weighting": "fixed", "fixed_weight": 0.2}), ("valued", {"weighting": "feature_value", "feature_value_scale": 2.0, "feature_value_clip_max": 0.4, "gross_exposure": 0.9})):
        made = specs.with_weights(df, chosen, spec | {"rebalance_frequency": "every_bar"})
        rows = rows.join(made.select("market", "date_utc", F.col("target_weight").alias(name)), ["market", "date_utc"], "left")
    return _out(rows, **{n: F.col(n) for n in ("ranked", "fixed", "valued")})


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, chosen = _up_universe(spark, sf_dir, 2)
    spec = {"weighting": "incremental_signal", "incremental_step_up": 0.5, "incremental_step_down": 0.2, "incremental_max_weight": 0.9, "gross_exposure": 0.8, "rebalance_frequency": "every_bar"}
    return _out(specs.with_weights(df, chosen, spec), score=F.col("score"), target_weight=F.col("target_weight"))


def exposed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly weights scaled by the breadth of the bar before, and by listed markets."""
    df, chosen = _up_universe(spark, sf_dir)
    df = portfolio.breadth(df, "turnover", "up", 3, "heat")
    out = specs.with_weights(df, chosen, {"rebalance_frequency": "weekly", "gross_exposure_feature": "heat", "gross_exposure_lag": 1, "gross_exposure_clip_min": 0.25})
    return _out(studies.listed_rescale(out, df, 4), target_weight=F.col("target_weight"))


def strategy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High turnover against the past and the others, the best two by momentum, every third bar, two bars later."""
    out = studies.turnover_momentum(panels.event_hours(spark, sf_dir), turnover_bars=4, lookback=10, momentum_bars=3, quantiles=3, buckets=(2, 3), every_bars=3, least_age=12, least_markets=3, positive=True, high=0.9, lag=2, most=2)
    return out.select("market", "date_utc", F.round("feature_value", 6).alias("feature_value"), F.col("selected_rank").cast("bigint").alias("selected_rank"), F.round("target_weight", 6).alias("target_weight"))


# --------------------------------------------------------------------------- accounts and curves


def _account_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels at every hour, with equal shares of the markets that are up at the first bar of each day."""
    x = F.col("trade_price")
    df = _levels(spark, sf_dir).withColumn("on", ts.compare(x, "gt", ts.rolling_mean(x, 5)))
    weights = df.where("on = 1").withColumn("target_weight", 0.9 / F.count("*").over(cs.across()))
    rows = studies.dense(df, "level")
    return portfolio.on_schedule(rows, weights, portfolio.rebalance_bars(df, "day"), explicit=False)


def shared_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account of all markets, at two rates of fees."""
    rows = simulation.trimmed(shared.materialised(_account_rows(spark, sf_dir)), [])
    fees = (0.0005, 0.01)
    rows = rows.withColumn("run_id", F.explode(F.array(*map(F.lit, range(len(fees))))))
    out = simulation.shared_cash(rows.withColumn("fee", F.element_at(F.array(*map(F.lit, fees)), F.col("run_id") + 1)), ["run_id"], "level", "target_weight", "fee", 0.0005)
    return out.select("run_id", "date_utc", F.round("equity", 4).alias("equity"))


def drawdown_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.deepest(_levels(spark, sf_dir), "level")
    return out.select("market", "peak_at", "trough_at", "recovered_at", F.round("drawdown", 6).alias("drawdown"))


def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simulation.episodes(panels.event_hours(spark, sf_dir), "trade_price")
    return out.select("market", "peak_at", "trough_at", "recovered_at", F.round("depth", 6).alias("depth"), F.col("bars_down").cast("bigint").alias("bars_down"), "bars")


def recent_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth and deepest drawdown of the last year and the last two, and the return of a window."""
    level = F.avg("trade_price").over(ts.along().rowsBetween(Window.unboundedPreceding, 0))
    df = panels.brand_weeks(spark, sf_dir).withColumn("level", level)
    out = simulation.window_return(df, "level", "1996-01-01", "1997-01-05")
    for years in (1, 2):
        part = metrics.summary(metrics.recent(df, years), "level", 52)
        out = out.join(part.select("market", F.col("bars").alias(f"bars_{years}y"), F.col("total_return").alias(f"return_{years}y"), F.col("calmar").alias(f"calmar_{years}y")), "market")
    return out.select("market", F.round("return_pct", 5).alias("return_pct"), *[c for y in (1, 2) for c in (F.col(f"bars_{y}y"), F.round(f"return_{y}y", 6).alias(f"return_{y}y"), F.round(f"calmar_{y}y", 4).alias(f"calmar_{y}y"))])


def benchmark_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.bought_and_held(_levels(spark, sf_dir), "click", "level").select("date_utc", F.round("value", 5).alias("value"))


# --------------------------------------------------------------------------- allocation


def _sleeves(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, float]]:
    df, chosen = _up_universe(spark, sf_dir)
    daily = specs.with_weights(df, chosen, {"rebalance_frequency": "daily"}).select("date_utc", "market", "target_weight")
    weekly = specs.with_weights(df, chosen, {"rebalance_frequency": "weekly", "weighting": "rank", "gross_exposure": 0.5}).select("date_utc", "market", "target_weight")
    return [(daily, 0.6), (weekly, 0.3)]


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sleeves, one market held to a tenth and what is cut off dealt to the others."""
    out = portfolio.allocated(_sleeves(spark, sf_dir), {"click": 0.1}, redistribute_inactive=True, redistribute_cut=True)
    return _out(out, target_weight=F.col("target_weight"))


def order_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from the last selection, last prices, and balances made of nations."""
    df, chosen = _up_universe(spark, sf_dir)
    weights = portfolio.latest(shared.materialised(specs.with_weights(df, chosen, {"rebalance_frequency": "daily"})))
    prices = studies.snapshot(df, "trade_price", []).select(F.concat(F.lit("KRW-"), F.upper("market")).alias("market"), F.col("trade_price").alias("price"))
    money = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.coalesce(F.get(F.array(*map(F.lit, ("KRW", "click", "view"))), F.col("n_nationkey")), F.col("n_name")).alias("currency"), (F.col("n_nationkey") * 3 + 50).cast("double").alias("balance"), F.lit(0.5).alias("locked"))
    weights = weights.select(F.concat(F.lit("KRW-"), F.upper("market")).alias("market"), "target_weight")
    out = portfolio.order_plan(weights, prices, money, 25.0)
    return out.select("market", *[F.round(c, 6).alias(c) for c in ("price", "quantity", "value", "target_weight", "delta")], "action")


# --------------------------------------------------------------------------- studies


def factor_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of three factors in two parts each."""
    df = _factors(spark, sf_dir).withColumn("rise", F.col("momentum") > -0.2)
    out = studies.factor_cells(df, ["momentum", "turnover", "volume"], "forward", 2, least=15, eligible="rise")
    return out.select("momentum_bucket", "turnover_bucket", "volume_bucket", "n", F.round("median", 6).alias("median"), F.round("positive", 6).alias("positive"))


def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = studies.factor_cells(_factors(spark, sf_dir), ["momentum", "turnover"], "forward", 3)
    out = studies.factor_matrix(cells, "momentum", "turnover", "mean", 3)
    return out.select("momentum_bucket", *[F.round(f"b{k}", 6).alias(f"b{k}") for k in (1, 2, 3)])


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = studies.snapshot(_factors(spark, sf_dir), "forward", ["momentum", "turnover"])
    return out.select("market", "date_utc", *[F.round(c, 6).alias(c) for c in ("forward", "momentum", "turnover")])


def _fold_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    windows = backtest.folds(panels.brand_weeks(spark, sf_dir).select("date_utc"), 18, 6, 3)
    rows = backtest.net_growth(backtest.in_folds(_runs(spark, sf_dir), windows), "level", "weight", ["fold", "phase", "run_id", "market"], 0.0005)
    found = rows.groupBy("market", "fold", "phase", "run_id").agg(F.round(backtest.compounded(F.col("growth")) - 1, 6).alias("gain"))
    return found, backtest.winners(found, ["market"], "run_id", "gain")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, won = _fold_results(spark, sf_dir)
    out = backtest.candidate_summary(found, won, ["market"], "run_id", "gain")
    return out.select("market", "run_id", "folds", "wins", *[F.round(c, 4).alias(c) for c in ("median_oos_gain", "mean_oos_gain", "positive", "share")], "least_oos_gain", "most_oos_gain")


def winner_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backtest.winner_summary(_fold_results(spark, sf_dir)[1], ["market"], "run_id", "gain")
    return out.select("market", "folds", F.round("median_oos_gain", 5).alias("median_oos_gain"), F.round("positive", 5).alias("positive"), "most_frequent", "wins")


def selection_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that differ in how many markets they hold, one of which holds none."""
    df, chosen = _up_universe(spark, sf_dir, 5)
    tops = backtest.grid(spark, {"top": [0, 1, 3]}).withColumnRenamed("top", "top_n")
    rows = portfolio.weights(chosen, "equal").join(F.broadcast(tops), F.col("selected_rank") <= F.col("top_n"))  # three runs
    stats = studies.selection_stats(rows, ["run_id"])
    out = backtest.run_status(tops, rows).join(stats, "run_id", "left")
    return out.select("run_id", "top_n", "status", "rebalances", F.round("mean_selected", 6).alias("mean_selected"), "least_selected", "most_selected")


# --------------------------------------------------------------------------- results and storage


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Summaries made of parts: names from lists of words by the part's key, figures from its price and size."""
    words = F.array(*map(F.lit, ("btc_ma_cross_60m", "ETH_xrp_VWMA_cross", "grid_sol_ma_stack4", "upbit_momentum", "hierarchical_alt_ada", "doge_link_adx", "", "score_exposure_btc_eth_x_sol")))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.element_at(words, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("_"), F.col("p_partkey").cast("string"))
    base = part.withColumn("source_dir", name)
    grid = base.where("p_partkey % 2 = 0").select("source_dir", F.concat(F.lit("run"), F.col("p_size").cast("string")).alias("run_name"), F.when(F.col("p_size") % 7 == 0, "error").otherwise("ok").alias("status"), F.col("p_retailprice").cast("string").alias("CAGR [%]"), F.when(F.col("p_size") % 5 == 0, "").otherwise((F.col("p_size") / 8).cast("string")).alias("Annualized Information Ratio"), F.lit("60m").alias("Timeframe"), F.col("p_size").alias("parameter_size"))
    runs = base.where("p_partkey % 2 = 1").select("source_dir", F.when(F.col("p_size") % 3 == 0, "BTC").otherwise("").alias("Asset Scope"), F.when(F.col("p_size") % 4 == 0, "n/a").otherwise((F.col("p_size") / 16).cast("string")).alias("Annualized Information Ratio"), F.lit("240m").alias("Timeframe"), F.lit("x").alias("parameter_kind"))
    return grid, runs


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, runs = _summaries(spark, sf_dir)
    return results.results_table(results.normalised(grid, "grid"), results.normalised(runs, "backtest"))


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("record_type", "source_dir", "run_name", "asset_scope", "strategy_family", "timeframe", "status", "cagr_pct", "annualized_information_ratio", "parameter_kind", "parameter_size")


def best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.query(_results(spark, sf_dir), equal={"status": "ok"}, contains="_C", least={"annualized_information_ratio": 0.5}, group="asset_scope", top=3)
    return out.select("asset_scope", "source_dir", "run_name", "annualized_information_ratio", F.col("place").cast("bigint").alias("place"))


def merged_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old bars, new ones that replace them, and what is kept when all from the first new bar on is calculated again."""
    df = panels.event_hours(spark, sf_dir).select("market", "date_utc", "trade_price")
    old = df.where("date_utc < timestamp_ntz '2024-01-20'")
    new = df.where("date_utc >= timestamp_ntz '2024-01-18' AND market <> 'view'").withColumn("trade_price", F.col("trade_price") + 1)
    parts = [("upserted", studies.upserted(old, new)), ("recalculated", studies.recalculated(old, new))]
    first = studies.first_seen(df.withColumn("x", F.when(F.col("trade_price") > 50, F.col("trade_price"))), "x")
    out = None
    for name, part in parts:
        figures = part.groupBy("market").agg(F.count("*").alias("n"), F.sum("trade_price").alias("total")).withColumn("kind", F.lit(name))
        out = figures if out is None else out.unionByName(figures)
    return out.join(first, "market").select("kind", "market", "n", F.round("total", 4).alias("total"), F.round("x", 6).alias("first_price"))


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three bars of each market with a price above 40, what lies between them, and its first two bars."""
    df = panels.event_hours(spark, sf_dir).withColumn("x", F.when(F.col("trade_price") > 40, F.col("trade_price")))
    out = studies.tail(df, 3, "x").where("x IS NOT NULL").select("market", "date_utc", F.lit("tail").alias("kind"))
    return out.unionByName(studies.head(df, 2).select("market", "date_utc", F.lit("head").alias("kind")))


def wide_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th bar of a panel made wide and long again."""
    df = panels.event_hours(spark, sf_dir)
    markets = ["click", "error", "purchase", "signup", "view", "search"]  # columns, as a wide table has them
    wide = tables.widened(df.join(portfolio.every(df, 7), "date_utc", "left_semi"), "trade_price", markets)
    return _out(tables.narrowed(wide, "trade_price", [m for m in markets if m != "view"]), trade_price=F.col("trade_price"))


_QUERIES = (spec_steps, null_policies, turnover_scores, market_scores, bucket_breadth, full_universe, weightings, incremental, exposed_weights, strategy_weights, shared_cash, drawdown_anatomy, drawdown_episodes, recent_years, benchmark_curve, allocation, order_plan, factor_cube, factor_table, snapshots, candidates, winner_figures, selection_figures, results_table, best_results, merged_panels, tails, wide_round_trip)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}

