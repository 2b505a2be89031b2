"""Walk-forward metrics from segments and what else validates runs, against loops over small curves and SQL on tables."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae import validation_queries
from tesserae.operators import backtest, portfolio, segments
from tesserae.plans import runner

SMALL = "/root/testdata/sf0.001"
START = datetime.datetime(2023, 1, 31)


def loop_metrics(bars, fee, year):
    """METRICS of one window by a loop: bars are (price, weight)."""
    equity, bench, held, values = 1.0, 1.0, 0.0, []
    for i, (price, weight) in enumerate(bars):
        w = min(max(weight or 0.0, 0.0), 1.0)
        r = price / bars[i - 1][0] - 1 if i else 0.0
        gross = 1 + held * r
        share = held * (1 + r) / gross if gross else 0.0
        cost = fee * (w - share) / (1 + w * fee) if w > share else fee * (share - w) / (1 - w * fee)
        equity, bench, held = equity * gross * (1 - cost), bench * (1 + r), w
        values.append((equity, bench))
    gains = [0.0] + [b[0] / a[0] - 1 for a, b in zip(values, values[1:], strict=False)]
    reference = [0.0] + [b[1] / a[1] - 1 for a, b in zip(values, values[1:], strict=False)]
    mean = lambda x: sum(x) / len(x)
    deviation = lambda x: math.sqrt(mean([v * v for v in x]) - mean(x) ** 2) if x and mean([v * v for v in x]) > mean(x) ** 2 else 0.0
    ratio = lambda x: mean(x) / deviation(x) * math.sqrt(year) if deviation(x) > 1e-9 else None
    top, at, waits, fall = values[0][0], 0, [], 0.0
    for i, (value, _) in enumerate(values):
        if value >= top:
            waits.append(i - at)
            top, at = value, i
        fall = max(fall, 1 - value / top)
    waits = sorted([w for w in waits if w > 1], reverse=True) + [None, None]
    losses = [g for g in gains if g < 0]
    cagr = (values[-1][0] / values[0][0]) ** (year / (len(values) - 1)) - 1 if len(values) > 1 else None
    sortino = mean(gains) / deviation(losses) * math.sqrt(year) if deviation(losses) > 1e-9 else None
    return [len(bars), values[-1][0], values[-1][1], cagr, 100 * fall, ratio(gains), sortino, ratio([g - b for g, b in zip(gains, reference, strict=True)]), waits[0], waits[1]]


def test_metrics_of_windows_are_those_of_loops(spark):
    """Curves with gaps, one that begins late, one that never trades, one that always rises."""
    rng, rows = random.Random(4), []
    for market in "ABCD":
        price = 100.0
        for day in range(420):
            price *= 1.002 if market == "D" else math.exp(rng.gauss(0, 0.03))
            if rng.random() < 0.9 and (market != "B" or day > 250):
                rows.append((market, START + datetime.timedelta(days=day), price, None if market == "C" else rng.choice([0.0, 1.0, 0.4, None]) if market != "D" else 1.0))
    df = spark.createDataFrame(rows, "market string, date_utc timestamp_ntz, p double, w double")
    for expanding in (False, True):
        windows = backtest.folds(df, 4, 2, 1, expanding)
        got = {(r["market"], r["fold"], r["phase"]): [r[m] for m in segments.METRICS] for r in segments.fold_metrics(df, windows, ["market"], "p", "w", 0.001, 365).collect()}
        want = {}
        for r in windows.collect():
            for market in "ABCD":
                inside = [(p, w) for m, at, p, w in rows if m == market and r["begins"] <= at < r["ends"]]
                if inside:
                    want[market, r["fold"], r["phase"]] = loop_metrics(inside, 0.001, 365)
        assert got.keys() == want.keys() and len(want) > 20
        for key, values in want.items():
            assert got[key] == [None if v is None else pytest.approx(v, rel=1e-7, abs=1e-9) for v in values], key


def test_a_lost_account_stays_lost(spark):
    rows = [("A", START + datetime.timedelta(days=k), p, 1.0) for k, p in enumerate([100.0, 0.0, 50.0] + [60.0] * 80)]
    df = spark.createDataFrame(rows, "market string, date_utc timestamp_ntz, p double, w double")
    got = segments.fold_metrics(df, backtest.folds(df, 1, 1, 1), ["market"], "p", "w", 0.0, 365).where("phase = 'is' AND fold = 0").first()
    assert got["growth"] == 0.0 and got["max_drawdown"] == 100.0


def test_no_window_no_rows(spark):
    df = spark.createDataFrame([("A", START, 1.0, 1.0)], "market string, date_utc timestamp_ntz, p double, w double")
    assert segments.fold_metrics(df, backtest.folds(df, 1, 1, 1), ["market"], "p", "w", 0.0, 365).collect() == []


def test_bars_are_scanned_once_and_not_repeated(spark):
    """However many folds, bars meet the edges of their month only."""
    df = spark.range(1000).select(F.lit("A").alias("market"), (F.timestamp_seconds(F.col("id") * 86400)).cast("timestamp_ntz").alias("date_utc"), F.lit(1.0).alias("p"), F.lit(1.0).alias("w"))
    edges = sorted({e for r in backtest.folds(df, 6, 3, 1).collect() for e in (r["begins"], r["ends"])})
    held = segments.with_segment(df, edges)
    assert held.count() == df.where((F.col("date_utc") >= edges[0]) & (F.col("date_utc") < edges[-1])).count()
    assert held.groupBy("segment").agg(F.min("date_utc").alias("at")).orderBy("segment").select("at").collect() == [(e,) for e in edges[:-1]]


def bars(spark, n=40):
    rng = random.Random(2)
    rows = [(m, START + datetime.timedelta(days=k), 100 + 10 * rng.random(), float(k % 3 == i)) for k in range(n) for i, m in enumerate("AB")]
    return spark.createDataFrame(rows, "market string, date_utc timestamp_ntz, trade_price double, heat double")


def test_a_run_that_fails_in_its_job_fails_alone(spark, tmp_path):
    """Exposures that differ between markets are found when the job runs; its runs are halved until that one is alone."""
    run = lambda name, **weights: {"run_name": name, "features": [], "universe": {"feature_column": "trade_price", "lag": 0, "top_n": 1}, "weights": {"rebalance_frequency": "weekly"} | weights}
    runs = [run("good"), run("bad", gross_exposure_feature="heat"), run("half", gross_exposure=0.5), run("wrong", weighting="none"), run("same")]
    grid = runner.Grid(bars(spark), f"{tmp_path}/grid", 365)
    assert grid.run(runs[:2]) == 2 and grid.run(runs) == 2 and grid.run(runs) == 0  # "same" computes what "good" does
    found = {r["run_name"]: r for r in grid.results(runs).collect()}
    assert {n: r["status"] for n, r in found.items()} == {"good": "ok", "bad": "error", "half": "ok", "wrong": "error", "same": "ok"}
    assert "differs between the markets" in found["bad"]["error"] and "unknown weighting" in found["wrong"]["error"]
    assert found["same"]["sharpe"] == found["good"]["sharpe"] and found["half"]["max_drawdown"] > found["good"]["max_drawdown"]
    assert grid.run(runs, retry=True) == 2 and known(spark, tmp_path) == 4
    assert runner.known_results(spark, f"{tmp_path}/none").collect() == []


def known(spark, tmp_path):
    return runner.known_results(spark, f"{tmp_path}/grid").count()


def test_calendars_by_precedence(spark):
    df = bars(spark, 16).drop("heat")
    day = lambda k: START + datetime.timedelta(days=k)
    weights = lambda rows: spark.createDataFrame(rows, "date_utc timestamp_ntz, market string, target_weight double")
    explicit, weekly = weights([(day(3), "B", 0.4), (day(6), "A", 1.0)]), weights([(day(6), "A", 0.2), (day(6), "B", 0.2), (day(13), "B", 0.7)])
    rows = portfolio.on_schedule(df, portfolio.by_precedence([explicit, weekly]), portfolio.rebalance_bars(df, "week"))
    got = {(r["date_utc"], r["market"]): r["target_weight"] for r in rows.collect()}
    named = {(day(0), "A"): 0.0, (day(0), "B"): 0.0, (day(3), "A"): 0.0, (day(3), "B"): 0.4, (day(6), "A"): 1.0, (day(6), "B"): 0.0, (day(13), "A"): 0.0, (day(13), "B"): 0.7}
    assert {k: v for k, v in got.items() if v is not None} == named and len(got) == 32
    off = portfolio.on_schedule(df, explicit, portfolio.rebalance_bars(df, "week"), explicit=False)
    assert off.where("target_weight > 0").select("date_utc").collect() == [(day(6),)]


def cells(rows, columns):
    cell = lambda v: str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", list(validation_queries.queries()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "lineitem", "part", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = con.execute(validation_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = validation_queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert cells(df.collect(), names) == cells([dict(zip(names, r, strict=True)) for r in found.fetchall()], names)
