import duckdb
import pytest

from tesserae import portfolio_queries, queries, research_queries
from tesserae.functions import series
from tesserae.operators import backtest, metrics, portfolio, recursive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for table in ("events", "lineitem", "part", "orders", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"})
    return sorted(map(tuple, frame.values.tolist()))


QUERIES = queries.queries() | portfolio_queries.queries() | research_queries.queries()
SQL = queries.oracle_sql() | portfolio_queries.oracle_sql() | research_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    for c in got.columns:
        if c not in ("market", "date_utc"):
            got[c], expected[c] = got[c].astype(float), expected[c].astype(float)
        elif c == "date_utc":
            got[c], expected[c] = got[c].astype("datetime64[us]"), expected[c].astype("datetime64[us]")
    assert rows(got) == rows(expected)


def test_holding_state(spark):
    entry, leave = [0, 1, 1, 1, 0, None, 0, 1], [0, 0, 0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([("m", i, e, x) for i, (e, x) in enumerate(zip(entry, leave, strict=True))], "market string, date_utc int, entry double, exit double".replace("double", "int"))
    got = [r["state"] for r in portfolio.holding_state(df, "entry", "exit").orderBy("date_utc").collect()]
    assert got == [0, 1, 1, 0, 0, None, 0, 1]


def test_logical_is_null_strict(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, None), (1, None), (1, 1), (1, 0)], "a int, b int")
    got = df.select(series.logical("and", F.col("a"), F.col("b")).alias("x"), series.logical("or", F.col("a"), F.col("b")).alias("y")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (1.0, 1.0), (0.0, 1.0)]


def bars(spark, values, names):
    return spark.createDataFrame([("m", i, *map(float, v)) for i, v in enumerate(values)], "market string, date_utc int, " + ", ".join(f"{n} double" for n in names))


def test_smoothing_and_simulation(spark):
    got = [r["ewma"] for r in recursive.ewma(bars(spark, [[1], [2], [3], [6]], ["x"]), "x", 3).orderBy("date_utc").collect()]
    assert got == [None, None, 2, 4]
    got = [r["equity"] for r in recursive.simulate(bars(spark, [[100, 1], [110, 0]], ["p", "w"]), "p", "w", fee=0.001).orderBy("date_utc").collect()]
    assert [round(v, 6) for v in got] == [999.000999, 1097.802198]


def test_directional_index_of_a_steady_rise(spark):
    df = bars(spark, [[i + 1, i, i + 0.5] for i in range(12)], ["high_price", "low_price", "trade_price"])
    assert [r["adx"] for r in recursive.adx(df, 3).orderBy("date_utc").collect()][4:] == pytest.approx([100.0] * 8)


def across(spark, weights, caps):
    return spark.createDataFrame([(m, 0, float(w), c) for m, w, c in zip("ABC", weights, caps, strict=True)], "market string, date_utc int, target_weight double, cap double")


def test_caps(spark):
    df = across(spark, (0.5, 0.3, 0.2), (0.3, None, None))
    for redistribute, expected in ((False, [0.3, 0.3, 0.2]), (True, [0.3, 0.42, 0.28])):
        got = portfolio.capped(df, "cap", redistribute=redistribute).orderBy("market").collect()
        assert [round(r["target_weight"], 9) for r in got] == expected
    full = portfolio.capped(across(spark, (0.5, 0.3, 0.2), (0.1, 0.1, 0.1)), "cap", redistribute=True).collect()
    assert [round(r["target_weight"], 9) for r in full] == [0.1, 0.1, 0.1]


def test_feature_value_weights_leave_cash(spark):
    df = spark.createDataFrame([("A", 0, 0.5, 1), ("B", 0, 1.0, 2), ("C", 0, 0.0, 3)], "market string, date_utc int, feature_value double, selected_rank int")
    assert [r["target_weight"] for r in portfolio.weights(df, "feature_value").orderBy("market").collect()] == [0.25, 0.5, 0.0]


def test_allocation_holds_a_sleeve_between_its_bars(spark):
    make = lambda rows: spark.createDataFrame(rows, "date_utc int, market string, target_weight double")
    got = portfolio.allocate([(make([(0, "A", 1.0), (2, "B", 1.0)]), 0.6), (make([(1, "A", 0.5)]), 0.4)]).orderBy("date_utc", "market").collect()
    assert [(r["date_utc"], r["market"], round(r["target_weight"], 9)) for r in got] == [(0, "A", 0.6), (1, "A", 0.8), (2, "A", 0.2), (2, "B", 0.6)]


def test_incremental_score(spark):
    df = bars(spark, [[1], [1], [0], [0]], ["on"])
    assert [r["score"] for r in recursive.incremental_scores(df, "on", 0.5, 0.25).orderBy("date_utc").collect()] == [0.5, 1.0, 0.75, 0.5]


def test_net_growth_is_the_account(spark):
    """Against money and units traded bar by bar."""
    values = [[100, 1], [110, 0], [90, 0.5], [120, 0.25], [80, 1], [85, 1]]
    cash, units, fee, slow = 1000.0, 0.0, 0.001, []
    for p, w in values:
        held = units * p
        gap = w * (cash + held) - held
        if gap > 0:
            spent = gap / (1 + w * fee)
            units, cash = units + spent / p, cash - spent * (1 + fee)
        else:
            sold = -gap / (1 - w * fee)
            units, cash = units - sold / p, cash + sold * (1 - fee)
        slow.append((cash + units * p, cash, units))
    got = recursive.simulate(bars(spark, values, ["p", "w"]), "p", "w", fee=fee).orderBy("date_utc").collect()
    for r, (equity, money, held) in zip(got, slow, strict=True):
        assert (r["equity"], r["cash"], r["units"]) == pytest.approx((equity, money, held), rel=1e-12, abs=1e-9)


def test_folds_hold_month_ends(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2020-01-31', timestamp_ntz'2021-01-31')) AS date_utc")
    got = [(r["fold"], r["phase"], str(r["begins"])[:10], str(r["ends"])[:10]) for r in backtest.folds(df, 6, 3, 1, expanding=True).orderBy("fold", "phase").collect()]
    assert got[:2] == [(0, "is", "2020-01-31", "2020-07-31"), (0, "oos", "2020-07-31", "2020-10-31")]
    assert got[2:4] == [(1, "is", "2020-01-31", "2020-08-31"), (1, "oos", "2020-08-31", "2020-11-30")]
    assert len(got) == 8


def test_deepest_drawdown(spark):
    got = metrics.deepest(bars(spark, [[100], [90], [100], [70], [97], [101], [99]], ["v"]), "v").first()
    assert (got["peak_at"], got["trough_at"], got["recovered_at"]) == (0, 3, 5)
