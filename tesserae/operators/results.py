"""A table of results from runs' summaries, whatever names they use for their figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens of run names that are assets, and families by what a name holds, the first that fits.
ASSETS = ("btc", "eth", "sol", "xrp", "ada", "doge", "avax", "xlm", "link")
FAMILIES = (
    (("score_exposure",), "score_exposure"),
    (("hierarchical_alt",), "hierarchical_alt"),
    (("hierarchical_stack",), "hierarchical_stack"),
    (("hierarchical",), "hierarchical"),
    (("vwma", "cross"), "vwma_cross"),
    (("ma_stack4",), "ma_stack4"),
    (("ma_stack",), "ma_stack"),
    (("ma_cross",), "ma_cross"),
    (("mom",), "momentum"),
    (("adx",), "adx_filter"),
)
# Figures of the table and the names summaries have for them.
FIGURES = {
    "total_return_pct": "Total Return [%]", "cagr_pct": "CAGR [%]", "annualized_information_ratio": "Annualized Information Ratio", "recent_1y_air": "Recent 1Y AIR",
    "benchmark_cagr_pct": "Benchmark CAGR [%]", "max_drawdown_pct": "Max Drawdown [%]", "sharpe_ratio": "Sharpe Ratio", "sortino_ratio": "Sortino Ratio", "calmar_ratio": "Calmar Ratio",
    "win_rate_pct": "Win Rate [%]", "total_trades": "Total Trades",
    "rolling_ir_126d_median": "Rolling IR 126d Median", "rolling_ir_126d_q25": "Rolling IR 126d Q25", "rolling_ir_126d_positive_ratio": "Rolling IR 126d Positive Ratio",
    "rolling_ir_252d_median": "Rolling IR 252d Median", "rolling_ir_252d_q25": "Rolling IR 252d Q25", "rolling_ir_252d_positive_ratio": "Rolling IR 252d Positive Ratio",
    "start_value": "Start Value", "end_value": "End Value",
}
WORDS = {"asset_scope": "Asset Scope", "strategy_family": "Strategy Family", "strategy_label": "Strategy Label", "timeframe": "Timeframe", "benchmark_market": "Benchmark Market", "status": "status", "start": "Start", "end": "End"}


def asset_scope(name: Column, assets: tuple[str, ...] = ASSETS) -> Column:
    """The first run of asset tokens in a name, in capitals and joined by commas."""
    tokens = F.filter(F.split(F.lower(name), "_"), lambda t: t != "")
    state = F.struct(F.array().cast("array<string>").alias("found"), F.lit(False).alias("over"))

    def step(s: Column, t: Column) -> Column:
        known = t.isin(*assets)
        return F.struct(
            F.when(known & ~s["over"], F.array_append(s["found"], F.upper(t))).otherwise(s["found"]).alias("found"),
            (s["over"] | (~known & (F.size(s["found"]) > 0))).alias("over"),
        )

    return F.aggregate(tokens, state, step, lambda s: F.array_join(s["found"], ","))


def strategy_family(name: Column) -> Column:
    lowered, out = F.lower(name), F.lit("other")
    for parts, family in reversed(FAMILIES):
        out = F.when(reduce(lambda a, b: a & b, (lowered.contains(p) for p in parts)), family).otherwise(out)
    return out


def normalised(rows: DataFrame, kind: str, source: str = "source_dir", run_name: str = "run_name") -> DataFrame:
    """Rows of summaries with the table's columns: figures by any of their names, empty ones null; asset and family from
    the name where the summary has none; parameter_* columns as they are."""

    def value(*names: str) -> Column:
        present = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    name = F.coalesce(value(source), value(run_name))
    words = {c: value(c, other) for c, other in WORDS.items()}
    words["asset_scope"] = F.coalesce(words["asset_scope"], asset_scope(name))
    words["strategy_family"] = F.coalesce(words["strategy_family"], strategy_family(name))
    if kind == "backtest":
        words["status"] = F.lit("ok")
    figures = [F.expr(f"try_cast({f'`{c}`' if c in rows.columns else f'`{other}`' if other in rows.columns else 'NULL'} AS DOUBLE)").alias(c) for c, other in FIGURES.items()]
    parameters = [F.col(f"`{c}`").cast("string").alias(c) for c in sorted(rows.columns) if c.startswith("parameter_")]
    return rows.select(F.lit(kind).alias("record_type"), value(source).alias("source_dir"), value("summary_path").alias("summary_path"), F.coalesce(value(run_name), name).alias("run_name"), *[c.alias(n) for n, c in words.items()], *figures, *parameters)


def results_table(*parts: DataFrame) -> DataFrame:
    """All parts, with the parameters that any of them has."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def key_values(rows: DataFrame, key: str, value: str, group: str, keys: list[str]) -> DataFrame:
    """One row a group of rows of names and values."""
    return rows.groupBy(group).pivot(key, keys).agg(F.first(value))


def query(table: DataFrame, *, equal: dict[str, str] | None = None, contains: str | None = None, least: dict[str, float] | None = None, most: dict[str, float] | None = None, sort: str = "annualized_information_ratio", ascending: bool = False, group: str | None = None, top: int = 10) -> DataFrame:
    """The best rows by a figure, nulls last, of all or of each group (a null group is one too), with their place. contains looks for a text in
    run_name and source_dir, whatever its case."""
    for column, word in (equal or {}).items():
        table = table.where(F.col(column) == word)
    if contains:
        table = table.where(F.lower(F.coalesce("run_name", F.lit(""))).contains(contains.lower()) | F.lower(F.coalesce("source_dir", F.lit(""))).contains(contains.lower()))
    for column, bound in (least or {}).items():
        table = table.where(F.col(column) >= bound)
    for column, bound in (most or {}).items():
        table = table.where(F.col(column) <= bound)
    order = [F.col(sort).asc_nulls_last() if ascending else F.col(sort).desc_nulls_last(), F.col("run_name"), F.col("source_dir")]
    if group is None:
        return table.orderBy(*order).limit(top)
    return table.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= top)


def deduplicated(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")
