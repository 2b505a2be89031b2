"""Payloads, steps on micro-panels with known results, sinks, and the registered queries against their SQL."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae import engine_queries, engine_sql, portfolio_queries
from tesserae.functions import series as ts
from tesserae.operators import backtest, orderstats, portfolio, recursive, shared, simulation, studies, timeline
from tesserae.plans import payloads, specs
from tesserae.sinks import tables

DAY = datetime.datetime(2024, 1, 1)


def panel(spark, values, market="A", name="x"):
    return spark.createDataFrame([(market, DAY + datetime.timedelta(days=k), v) for k, v in enumerate(values)], f"market string, date_utc timestamp_ntz, {name} double")


def column(df, name):
    return [r[0] for r in df.orderBy("date_utc").select(name).collect()]


def test_templates_and_presets():
    assert payloads.rendered({"a": ["{n}", "x_{n}"]}, {"n": 3}) == {"a": [3, "x_3"]}
    spec = payloads.feature_specs([{"preset": "rank_momentum", "params": {"momentum_window": 168, "rank_avg_window": 18}}])[0]
    assert spec["column_name"] == "rank_mom_168_18" and spec["steps"][0]["params"]["window"] == 168
    own = payloads.feature_specs([{"preset": "turnover_rank_persist", "params": {"avg_window": 2}, "column_name": "mine"}])[0]
    assert own["column_name"] == "mine"
    with pytest.raises(ValueError):
        payloads.feature_specs([{"preset": "unknown"}])


def test_universe_payloads():
    spec = payloads.universe_spec({"feature_column": "x", "signal_lag": 2, "value_filters": [{"feature_column": "y", "operator": "gt", "value": 1, "lag": 1}], "rank_filters": [{"feature_column": "z"}]})
    assert spec["lag"] == 3 and spec["value_filters"][0]["lag"] == 3 and spec["filter_stages"][0]["filters"][0]["lag"] == 2
    assert payloads.required_lags({"feature_column": "x", "lag": 0, "rank_filters": [{"feature_column": "z", "lag": 4}]}) == {("x", 0), ("z", 4)}
    for wrong in ({"mode": "some"}, {"lag": -1}, {"value_filters": [{"feature_column": "y", "operator": "like", "value": 1}]}, {"scope": "none"}):
        with pytest.raises(ValueError):
            payloads.universe_spec({"feature_column": "x"} | wrong)
    staged = payloads.universe_spec({"feature_column": "x", "rank_filters": [{"feature_column": "z"}], "filter_stages": [{"mode": "and", "filters": []}]})
    assert [s["mode"] for s in staged["filter_stages"]] == ["and"]  # rank_filters beside stages are left out
    with pytest.raises(ValueError):
        payloads.weight_spec({"weighting": "fixed"})
    with pytest.raises(ValueError):
        payloads.merged_config({"sleeves": [1]}, {})
    assert payloads.merged_config({"a": 1, "b": 2}, {"b": 3, "c": None}) == {"a": 1, "b": 3}


def test_what_payloads_tell(tmp_path):
    features = [{"source": "trade_price", "steps": [{"kind": "rolling_mean", "params": {"window": 100}}], "column_name": "m"}, {"source": "m", "steps": [{"kind": "momentum", "params": {"window": 20}}], "column_name": "mm"}, {"compare": {"left_feature": "m", "operator": "gt", "right_feature": "market:KRW-BTC:trade_price"}, "column_name": "on"}]
    universe = {"feature_column": "mm", "lag": 1, "allowed_markets": ["KRW-ETH"]}
    assert payloads.history_bars(features, universe, {"rebalance_frequency": "every_bar"}) == 100 + 19 + 1 + 1 + 20
    assert payloads.history_bars([*features, {"state": {"entry_feature": "on", "exit_feature": "m"}, "column_name": "s"}], universe, {}) == 119 + 250
    assert payloads.required_markets(features, universe, benchmark="KRW-XRP") == {"KRW-BTC", "KRW-ETH", "KRW-XRP"} and payloads.required_markets(features) is None
    assert payloads.missing_columns(features, ["close"]) == {"trade_price"}
    other = [features[0] | {"source": "opening_price"}, *features[1:]]
    assert payloads.signature("mm", features) != payloads.signature("mm", other) and payloads.signature("mm", features) == payloads.signature("mm", list(reversed(features)))
    assert payloads.canonical_key({"a": 1, "b": 2}) == payloads.canonical_key({"b": 2, "a": 1})
    assert (payloads.bars_a_day("240m"), payloads.bars_a_year("60m"), payloads.bars_a_day("daily")) == (6, 6048, 1)
    with pytest.raises(ValueError):
        payloads.bars_a_day("7m")
    runs = payloads.runs({"n": [2, 4], "k": [1]}, {"feature_specs": [{"window": "{n}"}]}, "run_{n}_{k}")
    assert [(r["run_name"], r["feature_specs"][0]["window"]) for r in runs] == [("run_2_1", 2), ("run_4_1", 4)]
    (tmp_path / "a.json").write_text('﻿{"x": 1}', encoding="utf-8")
    assert payloads.load(str(tmp_path / "a.json")) == {"x": 1}


def test_null_policies(spark):
    df = panel(spark, [1.0, None, 3.0, 5.0])
    assert column(df.withColumn("m", ts.rolling_mean(F.col("x"), 2)), "m") == [None, None, 2.0, 4.0]
    assert column(df.withColumn("m", ts.rolling_mean(F.col("x"), 2, "strict")), "m") == [None, None, None, 4.0]
    assert column(df.withColumn("m", ts.gaussian_signed(F.col("x"))), "m")[0] == pytest.approx(math.exp(-0.5))


def test_recurrences_are_loops(spark):
    values = [math.sin(k) * 10 + 20 for k in range(700)]
    values[5] = None
    for n in (2, 6, 50):
        known, level, expected = [v for v in values if v is not None], None, []
        for k, v in enumerate(known):
            level = sum(known[:n]) / n if k == n - 1 else level + 2 / (n + 1) * (v - level) if k >= n else None
            expected.append(level)
        got = [r[0] for r in recursive.ewma(panel(spark, values), "x", n).where("x IS NOT NULL").orderBy("date_utc").select("ewma").collect()]
        assert got[: n - 1] == expected[: n - 1] and got[n - 1 :] == pytest.approx(expected[n - 1 :], rel=1e-12)
    strict = column(recursive.ewma(panel(spark, values), "x", 6, nulls="strict"), "ewma")
    assert strict == [None] * 700
    wild, total = [], None
    for k in range(700):
        total = sum(range(30)) if k == 29 else total - total / 30 + k if k >= 30 else None
        wild.append(total)
    got = column(recursive.wilder(panel(spark, [float(k) for k in range(700)]), "x", 30, "w"), "w")
    assert got[:29] == wild[:29] and got[29:] == pytest.approx(wild[29:], rel=1e-12)


@pytest.mark.parametrize(("up", "down", "least", "most"), [(0.5, 0.2, 0.0, 0.9), (1.0, 1.0, 0.0, 40.0), (0.25, 0.5, 0.1, 1.0)])
def test_incremental_scores_are_loops(spark, up, down, least, most):
    """Over several blocks; with wide bounds blocks remember what they start from."""
    rng = random.Random(8)
    flags = {m: [rng.choice([1.0, 1.0, 0.0, None, float("nan")] if m == "A" else [1.0, 0.0]) for _ in range(n)] for m, n in (("A", 150), ("B", 64), ("C", 1))}
    df = panel(spark, flags["A"], "A", "on").unionByName(panel(spark, flags["B"], "B", "on")).unionByName(panel(spark, flags["C"], "C", "on"))
    got = recursive.incremental_scores(df, "on", up, down, least, most, block=16)
    assert got.columns == [*df.columns, "score"]
    for market, values in flags.items():
        score, want = 0.0, []
        for on in values:
            score = min(most, max(least, score + (up if on and on == on else -down)))
            want.append(score)
        assert column(got.where(F.col("market") == market), "score") == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("nulls", ["skip", "strict"])
def test_order_statistics_are_those_of_lists(spark, nulls):
    """Over several blocks, with ties, nulls, NaN and a market shorter than the window."""
    rng = random.Random(7)
    values = {"A": [rng.choice([None, float("nan")]) if rng.random() < 0.1 else float(rng.randint(0, 9)) for _ in range(90)], "B": [1.0, 2.0], "C": [None, None]}
    df = panel(spark, values["A"]).unionByName(panel(spark, values["B"], "B")).unionByName(panel(spark, values["C"], "C")).withColumn("other", F.lit("kept"))
    n = 6
    got = orderstats.rolled(df, "x", n, {"p": "percentile", "m": "median"}, nulls, block=8)
    assert got.columns == ["market", "date_utc", "x", "other", "p", "m"] and got.where("other = 'kept'").count() == 94
    for market, xs in values.items():
        held, want = [], []
        for x in xs:
            x = None if x is None or x != x else x
            if x is not None or nulls == "strict":
                held.append(x)
            window = held[-n:]
            if x is None or len(window) < n or None in window:
                want.append((None, None))
            else:
                ordered = sorted(window)
                want.append((pytest.approx((sum(v < x for v in window) + (sum(v == x for v in window) + 1) / 2) / n), (ordered[2] + ordered[3]) / 2))
        assert [(r["p"], r["m"]) for r in got.where(F.col("market") == market).orderBy("date_utc").collect()] == want
    with pytest.raises(ValueError):
        orderstats.rolled(df, "x", n, {"p": "mode"})


def test_scans_in_two_levels_are_windows(spark):
    """Bars over several months, some of them without bars or values."""
    rng = random.Random(6)
    days = sorted(rng.sample(range(400), 90))
    values = [rng.choice([None, float(d)]) for d in days]
    df = spark.createDataFrame([(k, DAY + datetime.timedelta(days=d), v) for k in ("r", None) for d, v in zip(days, values, strict=True)], "k string, date_utc timestamp_ntz, x double")
    bars = df.where("k = 'r'").drop("k")
    assert column(timeline.numbered(bars), "number") == list(range(1, 91))
    last = None
    assert column(timeline.last_known(bars, "x", "y"), "y") == [last := v if v is not None else last for v in values]
    assert column(timeline.lagged(bars, "x", 7, "y"), "y") == [None] * 7 + values[:-7]
    sums = timeline.sum_before(df, ["k"], F.col("x"), "s")
    want = [sum(v or 0.0 for v in values[:i]) for i in range(90)]
    assert column(sums.where("k = 'r'"), "s") == want and column(sums.where("k IS NULL"), "s") == want
    markets = spark.createDataFrame([("A", DAY + datetime.timedelta(days=days[20], hours=1)), ("B", DAY), ("C", DAY + datetime.timedelta(days=500))], "market string, _from timestamp_ntz")
    alive = [(r[0], (r[1] - DAY).days) for r in timeline.alive(markets, df).collect()]
    assert sorted(alive) == sorted([("A", d) for d in days[21:]] + [("B", d) for d in days])
    none = bars.where("false")
    assert timeline.numbered(none).collect() == timeline.alive(markets, none).collect() == timeline.last_known(none, "x").collect() == []


def plans_of(spark, query):
    """The plan of a query and those of what it was made from."""
    made, keep = [], shared.materialised

    def told(df):
        made.append(df)
        return keep(df)

    shared.materialised = told
    try:
        made.append(query(spark, "/root/testdata/sf0.001"))
    finally:
        shared.materialised = keep
    return [df._jdf.queryExecution() for df in made]


@pytest.mark.parametrize("name", ["shared_cash", "strategy_weights", "exposed_weights", "allocation", "incremental"])
def test_no_window_holds_all_bars(spark, name):
    """A window without keys would begin with its order by date_utc; those over one row a range have the range there."""
    plan = "".join(p.optimizedPlan().toString() for p in plans_of(spark, engine_queries.queries()[name]))
    assert "windowspecdefinition(market" in plan and not re.search(r"windowspecdefinition\(date_utc#\d+ (ASC|DESC)", plan)


@pytest.mark.parametrize(("module", "name", "most"), [(engine_queries, "order_plan", 4), (engine_queries, "allocation", 4), (engine_queries, "shared_cash", 4), (portfolio_queries, "directional_index", 1), (portfolio_queries, "smoothings", 1)])
def test_tables_are_scanned_once(spark, module, name, most):
    """What several branches read is computed once: table scans of the plan and of what it was made from."""
    assert sum(p.optimizedPlan().toString().count("Relation [") for p in plans_of(spark, module.queries()[name])) <= most


def test_incremental_weights(spark):
    df = panel(spark, [1.0, 1.0, 0.0, 0.0], "A", "on").unionByName(panel(spark, [1.0, 0.0, 0.0, 0.0], "B", "on"))
    rows = {(r["market"], r["date_utc"].day): (r["score"], r["target_weight"]) for r in recursive.incremental_weights(df, "on", 0.5, 0.5, gross=0.8).collect()}
    assert rows["A", 1] == (0.5, 0.2) and rows["A", 2] == (1.0, 0.8) and rows["B", 2] == (0.0, 0.0)


def test_shared_cash_of_one_market(spark):
    df = panel(spark, [100.0, 110.0], name="p").withColumn("w", F.when(F.col("p") == 100, 1.0).otherwise(0.0)).withColumn("run", F.lit(0))
    assert column(simulation.shared_cash(df, ["run"], "p", "w", 0.001), "equity") == pytest.approx([999.000999, 1097.802198])


def test_schedules(spark):
    df = panel(spark, [float(k) for k in range(20)])
    chosen = df.where("x = 3").select("date_utc", "market", F.lit(1.0).alias("target_weight"))
    weekly = portfolio.rebalance_bars(df, "week")
    assert [r["date_utc"].day for r in portfolio.carried(chosen, weekly).orderBy("date_utc").collect()] == [8, 15]
    rows = portfolio.on_schedule(df, portfolio.carried(chosen, weekly), weekly).orderBy("date_utc").collect()
    assert [r["target_weight"] for r in rows[:9]] == [0.0, None, None, None, None, None, None, 1.0, None]
    assert [r["date_utc"].day for r in portfolio.every(df, 8).orderBy("date_utc").collect()] == [1, 9, 17]


def test_exposure_of_unlike_markets(spark):
    both = panel(spark, [0.5], "A").unionByName(panel(spark, [0.7], "B"))
    with pytest.raises(Exception, match="differs between the markets"):
        studies.market_wide(both, "x").collect()


def test_incremental_step_of_zero(spark):
    df = panel(spark, [1.0, 1.0, 1.0])
    chosen = df.withColumn("selected_rank", F.lit(1))
    out = specs.with_weights(df, chosen, {"weighting": "incremental_signal", "incremental_step_up": 0, "rebalance_frequency": "every_bar"})
    assert column(out, "score") == [0.0, 0.0, 0.0]


def test_plateau_of_mixed_axes(spark):
    runs = backtest.grid(spark, {"n": [1, 2, 4], "kind": ["a", "b"], "k": [0.5, 1.5]}).withColumn("m", F.col("n") * F.when(F.col("kind") == "a", 1.0).otherwise(10.0))
    rows = {(r["n"], r["kind"], r["k"]): r["plateau"] for r in backtest.plateau(runs, ["n", "kind", "k"], "m", []).collect()}
    assert rows[1, "a", 0.5] == 1.5 and rows[2, "b", 1.5] == pytest.approx(70 / 3)


def test_sinks(spark, tmp_path):
    df = panel(spark, [1.0, 2.0, None], "A").unionByName(panel(spark, [5.0], "B")).withColumn("market_warning", F.lit("NONE"))
    tables.write_wide_cache(df, f"{tmp_path}/cache", ["x"], ["A", "B"])
    back = tables.read_wide_cache(spark, f"{tmp_path}/cache", ["x"], last=1)
    assert sorted((r["market"], r["x"], r["market_warning"]) for r in back.collect()) == [("A", 2.0, "NONE"), ("B", 5.0, "NONE")]
    for path in (f"{tmp_path}/t.csv", f"{tmp_path}/t.parquet"):
        tables.write_table(df.select("market", "x"), path)
        assert sorted(map(str, (r["x"] for r in tables.read_table(spark, path).collect()))) == ["1.0", "2.0", "5.0", "None"]
    store = f"{tmp_path}/store"
    tables.merge_into(df.select("market", "date_utc", "x"), store)
    newer = panel(spark, [7.0, 8.0], "A")
    assert sorted((r["market"], r["x"] or 0) for r in tables.merge_into(newer, store).collect()) == [("A", 0), ("A", 7.0), ("A", 8.0), ("B", 5.0)]
    assert sorted(r["x"] for r in tables.merge_into(newer, store, replace_from_first=True).collect()) == [7.0, 8.0]
    late = newer.withColumn("date_utc", F.col("date_utc") + F.expr("interval 3 months"))
    assert tables.merge_into(late, store).count() == 4
    assert tables.merge_into(late.where("false"), store).count() == 4
    assert sorted(r["x"] for r in tables.merge_into(newer.where("x = 8"), store, replace_from_first=True).collect()) == [7.0, 8.0]
    with pytest.raises(ValueError):
        tables.markdown(newer, ["x"], most=1)
    text = tables.markdown(spark.createDataFrame([("g", "a|b"), ("", "c")], "g string, v string"), ["v"], "g")
    assert text == "## g\n\n| v |\n| --- |\n| a\\|b |"


def _cells(rows, columns):
    def cell(v):
        return str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", list(engine_queries.queries()))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "lineitem", "part", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{table}.parquet')")
    found = con.execute(engine_sql.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = engine_queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(names)
    assert _cells(df.collect(), names) == _cells([dict(zip(names, r, strict=True)) for r in found.fetchall()], names)
