"""Sources and sinks: sorted files, intervals, summaries, candles, wide caches, and what reads run names."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import series
from tesserae.operators import results, signals
from tesserae.plans import specs
from tesserae.sinks import runs, tables
from tesserae.sources import intervals, panels, summaries

DAY = datetime.datetime(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(days=k)


def test_sorted_files_are_one_order(spark, tmp_path):
    rng = random.Random(1)
    cells = [(m, day(k)) for m in "ABC" for k in range(60)]
    rng.shuffle(cells)
    df = spark.createDataFrame([(m, d, rng.random()) for m, d in cells], "market string, date_utc timestamp_ntz, x double").repartition(7)
    folder = f"{tmp_path}/sorted"
    manifest = runs.merge_sorted([df.where(F.col("market") == m) for m in "ABC"], folder, 6).orderBy("first").collect()
    keys = [(r["first"]["date_utc"], r["first"]["market"], r["last"]["date_utc"], r["last"]["market"]) for r in manifest]
    assert len(keys) > 2 and sum(r["rows"] for r in manifest) == 180
    assert all(a[2:] < b[:2] for a, b in zip(keys, keys[1:], strict=False)) and all(k[:2] <= k[2:] for k in keys)
    for r in manifest:  # rows of a file stand in order
        own = [tuple(x) for x in spark.read.parquet(f"{folder}/data/{r['file']}").select("date_utc", "market").coalesce(1).collect()]
        assert own == sorted(own) and own[0] == (r["first"]["date_utc"], r["first"]["market"])
    part = runs.read_slice(spark, folder, day(10), day(13))
    assert {(r["market"], r["date_utc"]) for r in part.collect()} == {c for c in cells if day(10) <= c[1] < day(13)}
    assert 0 < len(runs.files_of(spark, folder, day(10), day(13))) < len(manifest) == len(runs.files_of(spark, folder))
    assert runs.read_slice(spark, folder, day(100)).collect() == [] and runs.read_slice(spark, folder).count() == 180
    told = runs.write_features(df.withColumn("none", F.lit(None).cast("double")), folder, ["x", "none"]).collect()
    assert {r["feature"]: (r["rows"], r["first"], r["last"]) for r in told} == {"x": (180, day(0), day(59)), "none": (0, None, None)}


def test_intervals_meet_bars(spark):
    told = spark.createDataFrame([("A", day(5), "CAUTION"), ("A", day(6), "CAUTION"), ("A", day(70), None), ("A", day(71), "NONE"), ("B", day(0), "NONE")], "market string, date_utc timestamp_ntz, market_warning string")
    held = intervals.intervals(told, "market_warning")
    assert sorted((r["market"], r["begins"], r["ends"]) for r in held.where("market = 'A'").collect()) == [("A", day(5), day(70)), ("A", day(70), day(71)), ("A", day(71), None)]
    bars = spark.createDataFrame([(m, day(k), "old") for m in "ABC" for k in (0, 4, 5, 40, 69, 70, 71, 200)], "market string, date_utc timestamp_ntz, market_warning string")
    got = {(r["market"], (r["date_utc"] - DAY).days): r["market_warning"] for r in intervals.with_value_at(bars, held, "market_warning").collect()}
    assert len(got) == 24 and [got["A", k] for k in (0, 4, 5, 40, 69, 70, 71, 200)] == [None, None, "CAUTION", "CAUTION", "CAUTION", None, "NONE", "NONE"]
    assert {got["B", k] for k in (0, 200)} == {"NONE"} and got["C", 40] is None
    assert intervals.with_value_at(bars.where("false"), held, "market_warning").collect() == []


def test_summaries_of_folders(spark, tmp_path):
    for name, text in (("g/a/summary_results.csv", "﻿run_name,CAGR [%],CAGR [%]\r\nx,1,3\r\ny,2,\r\n"), ("g/b/summary_results.csv", 'run_name,"q ""z""",k\n"a, ""b""",2\n'), ("g/c/summary_results.csv", ""), ("b/one/summary.csv", "index,value\nSharpe Ratio,1.5\nSharpe Ratio,2.5\nStart,\nshort\n")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    grid = summaries.grid_summaries(spark, f"{tmp_path}/g")
    assert sorted((r["source_dir"], sorted((k, v) for k, v in r["figures"].items() if v)) for r in grid.collect()) == [("a", [("CAGR [%]", "3"), ("run_name", "x")]), ("a", [("run_name", "y")]), ("b", [('q "z"', "2"), ("run_name", 'a, "b"')])]
    wide = summaries.widened(grid)
    assert wide.columns == ["summary_path", "source_dir", "CAGR [%]", "k", 'q "z"', "run_name"]
    table = results.results_table(results.normalised(wide.drop('q "z"'), "grid"), results.normalised(summaries.widened(summaries.backtest_summaries(spark, f"{tmp_path}/b")), "backtest"))
    assert sorted((r["record_type"], r["run_name"], r["cagr_pct"], r["sharpe_ratio"]) for r in table.where("cagr_pct IS NOT NULL OR sharpe_ratio IS NOT NULL").collect()) == [("backtest", "one", None, 2.5), ("grid", "x", 3.0, None)]
    assert all(r["summary_path"].endswith(".csv") for r in table.collect()) and "rolling_ir_252d_q25" in table.columns


def test_large_summaries_are_read_in_pieces(spark, tmp_path):
    (tmp_path / "g/a").mkdir(parents=True)
    rows = "".join(f"run-{i},{'x' * 40},{i}\r\n" for i in range(4000))
    (tmp_path / "g/a/summary_results.csv").write_text("\ufeff\r\n \r\nrun_name,k,v\r\n" + rows, encoding="utf-8")
    (tmp_path / "b/one").mkdir(parents=True)
    (tmp_path / "b/one/summary.csv").write_text("index,value\n" + "".join(f"f{i % 500},{i}\n" for i in range(5000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = summaries._lines(spark, f"{tmp_path}/g", "summary_results.csv")[1]
        assert lines.select("place.block").distinct().count() > 10
        grid, alone = summaries.grid_summaries(spark, f"{tmp_path}/g"), summaries.backtest_summaries(spark, f"{tmp_path}/b")
        assert sorted((r["figures"]["run_name"], int(r["figures"]["v"])) for r in grid.collect()) == sorted((f"run-{i}", i) for i in range(4000))
        assert alone.collect()[0]["figures"] == {f"f{i}": str(4500 + i) for i in range(500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def signal_loop(prices, family, numbers):
    mean = lambda i, n: sum(prices[i - n + 1 : i + 1]) / n if i >= n - 1 else None
    above = [mean(i, numbers[0]) is not None and mean(i, numbers[1]) is not None and mean(i, numbers[0]) > mean(i, numbers[1]) for i in range(len(prices))]
    below = [mean(i, numbers[1]) is not None and mean(i, numbers[0]) <= mean(i, numbers[1]) for i in range(len(prices))]
    if family == "ma_cross":
        return above[-1]
    if family == "ma_stack":
        return above[-1] and mean(len(prices) - 1, numbers[2]) is not None and mean(len(prices) - 1, numbers[1]) > mean(len(prices) - 1, numbers[2])
    k = numbers[2]
    if family == "ma_cross_persist":
        return len(prices) >= k and all(above[-k:])
    on = False
    for i in range(len(prices)):
        if on:
            on = not (i >= k - 1 and all(below[i - k + 1 : i + 1]))
        else:
            on = above[i]
    return on


def test_signals_are_loops(spark):
    rng, prices = random.Random(3), {}
    for market in ("btc", "eth", "sol"):
        at = [100.0]
        for _ in range(70):
            at.append(at[-1] * (1 + rng.gauss(0, 0.02)))
        prices[market] = at
    bars = spark.createDataFrame([(m.upper(), day(k), p) for m, at in prices.items() for k, p in enumerate(at)] + [("BTC", day(80), None)], "market string, date_utc timestamp_ntz, trade_price double")
    names, want = [], {}
    for asset in prices:
        for s, n, k in ((2, 5, 1), (3, 9, 2), (5, 20, 3), (2, 90, 2)):
            for family, name, numbers in (("ma_cross", f"ma_60m_{s}_{n}_every_bar", (s, n)), ("ma_stack", f"ma_stack_60m_{s}_{n}_{n + 5}_every_bar", (s, n, n + 5)), ("ma_cross_persist", f"ma_60m_{s}_{n}_persist{k}_every_bar", (s, n, k)), ("ma_cross_exit_persist", f"ma_60m_{s}_{n}_exit_persist{k}_stateful", (s, n, k))):
                names.append((asset.upper(), family, f"{asset}_{name}_fee5bp"))
                want[names[-1]] = signal_loop(prices[asset], family, numbers)
    odd = [("BTC", "ma_cross", "eth_ma_60m_2_5_every_bar_fee5bp"), ("BTC", "adx", "btc_adx"), ("BTC", None, "x"), ("XRP", "ma_cross", "xrp_ma_60m_2_5_every_bar_fee5bp")]
    got = {(r["asset"], r["strategy_family"], r["run_name"]): r for r in signals.current(bars, spark.createDataFrame(names + odd, "asset string, strategy_family string, run_name string")).collect()}
    assert {k: got[k]["signal_on"] for k in want} == want and {0.0, 1.0} == {got[k]["target_weight"] for k in want}
    assert [got[k]["error"] for k in odd] == ["unsupported_ma_cross_run_name", "unsupported_strategy_family:adx", "unsupported_strategy_family:", "no_prices"]
    assert got[names[0]]["latest_at"] == day(70) and got[names[0]]["latest_price"] == prices["btc"][-1]


def test_candles_and_caches(spark, tmp_path):
    folder = tmp_path / "candles"
    folder.mkdir()
    head = "market,korean_name,english_name,market_warning,date_utc,date_kst,opening_price,high_price,low_price,trade_price,candle_acc_trade_volume,candle_acc_trade_price,timestamp"
    for m in ("KRW-A", "KRW-B"):
        lines = [f"{m},k,e,NONE,2024-01-0{k}T00:00:00,2024-01-0{k}T09:00:00,1,3,0.5,{k},10,20," for k in (1, 2)]
        (folder / f"{m}.csv").write_text("﻿" + "\n".join([head, *lines]), encoding="utf-8")
    candles = panels.read_candles(spark, str(folder))
    assert sorted((r["market"], r["date_utc"], r["trade_price"], r["timestamp"]) for r in candles.collect()) == [(m, day(k - 1), float(k), None) for m in ("KRW-A", "KRW-B") for k in (1, 2)]
    assert candles.where(series.local_time(F.col("date_utc")) == F.col("date_kst")).count() == 4
    values = ["trade_price", "high_price"]
    fewer = candles.withColumn("high_price", F.when(F.col("market") == "KRW-A", F.col("high_price")))
    tables.write_wide_cache(fewer, f"{tmp_path}/cache", values, ["KRW-A", "KRW-B"])
    back = {(r["market"], r["date_utc"]): (r["trade_price"], r["high_price"]) for r in tables.read_wide_cache(spark, f"{tmp_path}/cache", values).collect()}
    assert back == {(m, day(k - 1)): (float(k), 3.0 if m == "KRW-A" else None) for m in ("KRW-A", "KRW-B") for k in (1, 2)}
    twice = candles.unionByName(candles)
    assert {r["KRW-A"] for r in tables.widened(twice, "trade_price", ["KRW-A"], "sum").collect()} == {2.0, 4.0}
    chosen = specs.with_universe(candles, {"feature_column": "trade_price", "lag": 0, "top_n": 5, "allowed_markets": ["KRW-B"]})
    assert {r["market"] for r in chosen.collect()} == {"KRW-B"}


def test_keys_and_first_rows(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")], "run string, k string, v string")
    assert {(r["run"], r["x"], r["y"]) for r in results.key_values(df, "k", "v", "run", ["x", "y"]).collect()} == {("a", "1", "2"), ("b", "3", None)}
    assert {r["v"] for r in results.deduplicated(df, ["run"], [F.col("v").desc()]).collect()} == {"2", "3"}
    with pytest.raises(ValueError):
        tables.widened(df, "v", [], "mean")
