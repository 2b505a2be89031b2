"""Backtests from specs to accounts, and grids of them that outlive runs that fail and sessions that end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import metrics, portfolio, shared, simulation, studies
from tesserae.plans import payloads, specs
from tesserae.sinks import tables

FIGURES = ("bars", "total_return", "cagr", "max_drawdown", "sharpe", "sortino", "calmar", "rebalances", "mean_selected")
RESULTS = "run_key string, run_name string, status string, error string, bars bigint, total_return double, cagr double, max_drawdown double, sharpe double, sortino double, calmar double, rebalances bigint, mean_selected double"


def account_rows(df: DataFrame, universe: dict, weights: dict, price: str) -> DataFrame:
    """market, date_utc, price and target_weight at every bar of a panel with features: what an account trades to at the
    bars of the schedule, nulls (hold) at others."""
    made = specs.with_weights(df, specs.with_universe(df, universe), weights)
    unit = specs.UNITS[payloads.weight_spec(weights)["rebalance_frequency"]]
    schedule = portfolio.rebalance_bars(df, unit) if unit else df.select("date_utc").distinct()
    rows = studies.dense(df, price)
    return portfolio.on_schedule(rows, made.select("date_utc", "market", "target_weight"), schedule).withColumnRenamed(price, "price")


def curves(rows: DataFrame, keys: list[str], fee: float, slippage: float = 0.0, cash: float = 1000.0) -> DataFrame:
    """keys, date_utc, equity from the first bar on at which something is held."""
    return simulation.shared_cash(simulation.trimmed(rows, keys), keys, "price", "target_weight", fee, slippage, cash)


def figures(rows: DataFrame, curve: DataFrame, key: str, bars_a_year: float) -> DataFrame:
    """key and FIGURES of accounts."""
    of_curve = metrics.summary(curve.withColumnRenamed(key, "market"), "equity", bars_a_year).withColumnRenamed("market", key)
    return of_curve.join(studies.selection_stats(rows, [key]), key).select(key, *FIGURES)


def backtest(panel: DataFrame, features: list[dict], universe: dict, weights: dict, *, price: str = "trade_price", fee: float = 0.0005, slippage: float = 0.0, cash: float = 1000.0) -> DataFrame:
    """date_utc, equity of one spec: features, universe, weights, and an account of all its markets."""
    df = shared.materialised(specs.with_features(panel, payloads.feature_specs(features)))
    rows = shared.materialised(account_rows(df, universe, weights, price).withColumn("run_key", F.lit("")))
    return curves(rows, ["run_key"], fee, slippage, cash).drop("run_key")


# --------------------------------------------------------------------------- grids


def run_key(run: dict) -> str:
    """What a run computes, whatever it is called."""
    return payloads.canonical_key({k: run[k] for k in ("features", "universe", "weights")})


def known_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results in a folder; of a key that was run again the last status stays that is no error."""
    if not tables.exists(spark, folder):
        return spark.createDataFrame([], RESULTS)
    rows = spark.read.schema(RESULTS).parquet(folder)
    best = F.max_by(F.struct(*rows.columns), F.when(F.col("status") == "error", 0).otherwise(1)).alias("_best")
    return rows.groupBy("run_key").agg(best).select("_best.*")


class Grid:
    """Runs over one panel: dicts of run_name, features, universe and weights (see payloads.runs).

    Each call computes the runs that have no result in the folder yet, in one job as long as nothing fails. A run that
    fails when it is planned is an error by itself; where a job fails its runs are halved until the one at fault is alone.
    Its message becomes its result; the others' results are the same as without it.
    """

    def __init__(self, panel: DataFrame, folder: str, bars_a_year: float, *, price: str = "trade_price", fee: float = 0.0005, slippage: float = 0.0):
        self.panel, self.folder, self.year, self.price, self.fee, self.slippage = panel, folder, bars_a_year, price, fee, slippage
        self.spark = panel.sparkSession
        self.features: dict[str, DataFrame] = {}

    def missing(self, runs: list[dict], retry: bool = False) -> list[dict]:
        """The runs without a result, or with `retry` also those whose result is an error; one for each key."""
        by_key = {run_key(r): r for r in reversed(runs)}
        known = known_results(self.spark, self.folder)
        done = known.where("status <> 'error'") if retry else known
        asked = self.spark.createDataFrame([(k,) for k in by_key], "run_key string")
        return [by_key[r["run_key"]] for r in asked.join(done, "run_key", "left_anti").orderBy("run_key").collect()]  # a list of runs

    def run(self, runs: list[dict], retry: bool = False) -> int:
        """Adds results of the missing runs to the folder; their number."""
        missing, planned, rows = self.missing(runs, retry), {}, []
        for run in missing:
            key = run_key(run)
            try:
                planned[key] = self._planned(run).withColumn("run_key", F.lit(key))
            except Exception as e:  # whatever is wrong with a run is its result
                rows.append(self._failed(run, e))
        names = {run_key(r): r for r in missing}
        rows += self._computed(planned, names)
        if rows:
            self.spark.createDataFrame(rows, RESULTS).write.mode("append").parquet(self.folder)
        return len(missing)

    def _planned(self, run: dict) -> DataFrame:
        of_features = payloads.canonical_key(run["features"])
        if of_features not in self.features:  # features are computed once for all runs that have them
            self.features[of_features] = shared.materialised(specs.with_features(self.panel, payloads.feature_specs(run["features"])))
        return account_rows(self.features[of_features], run["universe"], run["weights"], self.price)

    def _computed(self, planned: dict[str, DataFrame], runs: dict[str, dict]) -> list[tuple]:
        if not planned:
            return []
        try:
            rows = shared.materialised(reduce(DataFrame.unionByName, planned.values()))
            found = {r["run_key"]: r for r in figures(rows, curves(rows, ["run_key"], self.fee, self.slippage), "run_key", self.year).collect()}  # one row a run
        except Exception as e:
            keys = list(planned)
            if len(keys) == 1:
                return [self._failed(runs[keys[0]], e)]
            half = len(keys) // 2
            return [row for part in (keys[:half], keys[half:]) for row in self._computed({k: planned[k] for k in part}, runs)]
        out = []
        for key in planned:
            name = runs[key]["run_name"]
            out.append((key, name, "ok", None, *(found[key][f] for f in FIGURES)) if key in found else (key, name, "empty_weights", None, *[None] * len(FIGURES)))
        return out

    def _failed(self, run: dict, e: Exception) -> tuple:
        return (run_key(run), run["run_name"], "error", f"{type(e).__name__}: {e}"[:2000], *[None] * len(FIGURES))

    def results(self, runs: list[dict]) -> DataFrame:
        """The results of these runs, under their own names."""
        names = self.spark.createDataFrame([(run_key(r), r["run_name"]) for r in runs], "run_key string, run_name string")
        return names.join(known_results(self.spark, self.folder).drop("run_name"), "run_key", "left")
