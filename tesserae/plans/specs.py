"""Feature specs (lists of JSON objects) as DataFrame columns, and market scores.

A spec is one of: a source with steps, a weighted sum of components, a comparison, a logical node, a holding state or a
breadth. Specs are applied in order and may name columns of earlier ones. Every step becomes a column of its own, since
window functions do not nest; Spark then computes steps over the same window in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import cross_section as cs
from tesserae.functions import series as ts
from tesserae.operators import orderstats, portfolio, recursive, studies, timeline
from tesserae.plans import payloads

#: Steps that are one column: kind -> (column, params) -> column. Windows skip nulls unless null_policy is "strict".
STEPS: dict[str, Callable[[Column, dict], Column]] = {
    "momentum": lambda x, p: ts.momentum(x, p["window"], _nulls(p)),
    "simple_return": lambda x, p: ts.simple_return(x, p["window"], _nulls(p)),
    "delta": lambda x, p: ts.delta(x, p.get("periods", 1), _nulls(p)),
    "rolling_mean": lambda x, p: ts.rolling_mean(x, p["window"], _nulls(p)),
    "rolling_sum": lambda x, p: ts.rolling_sum(x, p["window"], _nulls(p)),
    "rolling_std": lambda x, p: ts.rolling_std(x, p["window"], _nulls(p)),
    "rolling_zscore": lambda x, p: ts.rolling_zscore(x, p["window"], _nulls(p), p.get("sample", False)),
    "rolling_ratio": lambda x, p: ts.rolling_ratio(x, p["window"], _nulls(p)),
    "log": lambda x, p: ts.log(x, p.get("mode", "log")),
    "abs": lambda x, p: F.abs(x),
    "gaussian_signed": lambda x, p: ts.gaussian_signed(x),
    "vwma": lambda x, p: ts.vwma(x, F.col(p["volume_column"]), p["window"], _nulls(p), p.get("volume_transform", "none")),
    "vwgm": lambda x, p: ts.vwgm(x, F.col(p["volume_column"]), p["window"], _nulls(p), p.get("volume_transform", "none")),
    "age_days": lambda x, p: ts.age(x).cast("double"),
    "cross_rank": lambda x, p: cs.cross_rank(x, p.get("descending", True)),
    "cross_percentile": lambda x, p: cs.cross_percentile(x, p.get("descending", True)),
    "subtract_reference": lambda x, p: x - F.col(f"`{_reference(p)}`"),
    "ratio_to_reference": lambda x, p: F.try_divide(x, F.col(f"`{_reference(p)}`")),
    "calendar_mean": lambda x, p: ts.calendar_reduce(x, _unit(p), "mean"),
    "calendar_sum": lambda x, p: ts.calendar_reduce(x, _unit(p), "sum"),
    "calendar_last": lambda x, p: ts.calendar_reduce(x, _unit(p), "last"),
}


def _nulls(p: dict) -> str:
    return p.get("null_policy", "skip")


def _reference(p: dict) -> str:
    return p.get("reference") or p["reference_column"]


def _unit(p: dict) -> str:
    """day, week or month; frequencies may be given by their letters."""
    return p["unit"] if "unit" in p else {"D": "day", "W": "week", "M": "month"}[p["freq"].upper()]


def _frame_step(df: DataFrame, kind: str, source: str, p: dict, name: str) -> DataFrame | None:
    """Steps that take more than a column; None for others."""
    if kind == "ewma":
        return recursive.ewma(df, source, p["window"], name, _nulls(p))
    if kind in ("rolling_percentile", "rolling_median"):
        return orderstats.rolled(df, source, p["window"], {name: kind.split("_")[1]}, _nulls(p))
    if kind == "atr":
        return recursive.atr(df, p["window"], name)
    if kind == "adx":
        return recursive.adx(df, p["window"], name)
    if kind == "volatility":
        return df.withColumn("_r", ts.momentum(F.col(f"`{source}`"), 1, _nulls(p))).withColumn(name, ts.rolling_std(F.col("_r"), p["window"], _nulls(p))).drop("_r")
    if kind in ("calendar_rolling_mean", "calendar_rolling_sum"):
        return studies.calendar_rolling(df, source, _unit(p), p["window"], kind.rsplit("_", 1)[1], name)
    if kind == "intraday_range_pct":
        return df.withColumn(name, F.try_divide(F.col("high_price") - F.col("low_price"), F.col("opening_price")))
    return None


def with_market_reference(df: DataFrame, source: str) -> tuple[DataFrame, str]:
    """A source `market:NAME:column` is that market's value at every row of the bar."""
    if not source.startswith("market:"):
        return df, source
    _, market, column = source.split(":")
    value = F.max(F.when(F.col("market") == market, F.col(column))).over(cs.across())
    return df.withColumn(source, value), source


def with_feature(df: DataFrame, spec: dict) -> DataFrame:
    name = payloads.feature_name(spec)
    if spec.get("compare"):
        c = spec["compare"]
        right = F.col(c["right_feature"]) if c.get("right_feature") else F.lit(float(c["right_value"]))
        return df.withColumn(name, ts.compare(F.col(c["left_feature"]), c["operator"], right))
    if spec.get("logical"):
        return df.withColumn(name, ts.logical(spec["logical"]["operator"], *map(F.col, spec["logical"]["features"])))
    if spec.get("state"):
        return portfolio.holding_state(df, spec["state"]["entry_feature"], spec["state"]["exit_feature"], name)
    if spec.get("breadth"):
        b = spec["breadth"]
        chosen = {"top": b.get("top_n", 4)} if b.get("mode", "top_n") == "top_n" else {"quantiles": b.get("quantiles", 4), "buckets": tuple(b.get("bucket_values", (1,)))}
        return portfolio.breadth(df, b["driver_feature"], b["signal_feature"], name=name, descending=not b.get("ascending", False), **chosen)
    if spec.get("components"):
        if spec.get("combine", "weighted_sum") != "weighted_sum":
            raise ValueError(f"unknown combine {spec['combine']}")
        return df.withColumn(name, weighted_sum(spec["components"]))
    df, at = with_market_reference(df, spec["source"])
    made = []
    for number, step in enumerate(spec.get("steps", [])):
        target = f"_{name}_{number}"
        params = dict(step.get("params", {}))
        after = _frame_step(df, step["kind"], at, params, target)
        if after is None:
            if step["kind"] not in STEPS:
                raise ValueError(f"unknown step {step['kind']}")
            if step["kind"] in ("subtract_reference", "ratio_to_reference"):
                df, params["reference"] = with_market_reference(df, _reference(params))
            after = df.withColumn(target, STEPS[step["kind"]](F.col(f"`{at}`"), params))
        df, at = after, target
        made.append(target)
    return df.withColumn(name, F.col(f"`{at}`")).drop(*made)


def with_features(df: DataFrame, specs: list[dict]) -> DataFrame:
    for spec in specs:
        df = with_feature(df, spec)
    return df


def weighted_sum(components: list[dict]) -> Column:
    """Null if any component is."""
    total = F.lit(0.0)
    for c in components:
        total = total + F.col(c["feature_column"]) * float(c.get("weight", 1.0))
    return total


def market_scores(df: DataFrame, spec: dict) -> DataFrame:
    """A score by each market's own rule: the weighted sum of what is above 0, or all_true: 1 where every component is.
    A null is not above 0. Markets without a rule have 0."""
    out = F.lit(0.0)
    for rule in spec["rules"]:
        on = {c["feature_column"]: F.coalesce((F.col(c["feature_column"]) > 0).cast("double"), F.lit(0.0)) for c in rule["components"]}
        if rule.get("mode", "weighted_sum") == "all_true":
            value = F.least(F.lit(1.0), *on.values())
        else:
            value = sum((float(c.get("weight", 1.0)) * on[c["feature_column"]] for c in rule["components"]), F.lit(0.0))
        out = F.when(F.col("market") == rule["market"], value).otherwise(out)
    return df.withColumn(spec.get("output_column", "custom_score"), out)


def with_universe(df: DataFrame, spec: dict, price: str = "trade_price", nulls: str = "skip") -> DataFrame:
    """The rows that a universe spec selects, with feature_value, rank, bucket, cross_section_size and selected_rank.

    Eligible are rows with a lagged sort value, of allowed and not of excluded markets, without a warning and of the age
    asked for; the start gate opens for good at the first bar with enough of them. Value filters, stages of rank filters
    and the final rank narrow them down.
    """
    spec = payloads.universe_spec(spec)
    made = {}

    def lagged(df: DataFrame, column: str, n: int) -> tuple[DataFrame, str]:
        if not n:
            return df, column
        if (column, n) not in made:
            made[column, n] = f"_lag{len(made)}"
            df = df.withColumn(made[column, n], ts.lag(F.col(f"`{column}`"), n, nulls))
        return df, made[column, n]

    # All lags first: they look back over the bars that the start gate leaves out.
    ranked = [f for stage in spec["filter_stages"] for f in stage["filters"]]
    for column, n in [(spec["sort_column"], spec["lag"]), *((f["feature_column"], f["lag"]) for f in [*spec["value_filters"], *ranked])]:
        df, _ = lagged(df, column, n)
    df, sort = lagged(df, spec["sort_column"], spec["lag"])
    base = F.col(sort).isNotNull()
    if spec["allowed_markets"]:
        base = base & F.col("market").isin(*spec["allowed_markets"])
    if spec["excluded_markets"]:
        base = base & ~F.col("market").isin(*spec["excluded_markets"])
    if spec["exclude_warnings"]:
        base = base & (F.upper(F.coalesce(F.col("market_warning"), F.lit("NONE"))) == "NONE")
    if spec["min_age_days"]:
        df = df.withColumn("_age", ts.age(F.col(price)))
        base = base & (F.coalesce("_age", F.lit(0)) >= spec["min_age_days"])
    df = df.withColumn("_base", base)
    if spec["start_min_cross_section_size"] > 0:
        df = studies.started(df, F.col("_base"), spec["start_min_cross_section_size"])
    keep = F.col("_base")
    for f in spec["value_filters"]:
        df, at = lagged(df, f["feature_column"], f["lag"])
        keep = keep & F.coalesce(ts.compare(F.col(f"`{at}`"), f["operator"], F.lit(float(f["value"]))) == 1, F.lit(False))
    df = df.withColumn("_candidate", keep)
    for stage in spec["filter_stages"]:
        filters = []
        for f in stage["filters"]:
            df, at = lagged(df, f["feature_column"], f["lag"])
            filters.append({"feature": at, "descending": not f["ascending"], "scope": "_base" if f["scope"] in ("global", "base") else None} | _chosen(f))
        df = studies.filter_stage(df, filters, "_candidate", stage["mode"])
    scoped = F.when(F.col("_base" if spec["scope"] in ("global", "base") else "_candidate"), F.col(f"`{sort}`"))
    df = df.withColumn("_scoped", scoped)
    x = F.col("_scoped")
    df = df.withColumn("feature_value", F.col(f"`{sort}`")).withColumn("rank", cs.cross_rank(x, not spec["ascending"]).cast("int")).withColumn("cross_section_size", cs.cross_count(x))
    if spec["mode"] == "quantile":
        df = df.withColumn("bucket", cs.bucket(F.col("rank"), F.col("cross_section_size"), spec["quantiles"]))
        chosen = F.col("bucket").isin(*spec["bucket_values"])
    else:
        chosen = F.col("rank") <= spec["top_n"] if spec["mode"] == "top_n" else F.col("rank").isNotNull()
    out = df.where(F.col("_candidate") & chosen).withColumn("selected_rank", F.row_number().over(cs.across().orderBy("rank")))
    return out.drop("_base", "_candidate", "_scoped", "_age", *made.values())


def _chosen(f: dict) -> dict:
    return {"top": f["top_n"]} if f["mode"] == "top_n" else {"quantiles": f["quantiles"], "buckets": tuple(f["bucket_values"])}


UNITS = {"every_bar": None, "daily": "day", "weekly": "week", "monthly": "month"}


def with_weights(panel: DataFrame, selected: DataFrame, spec: dict) -> DataFrame:
    """The target weights of a weight spec: rows of the markets to hold, at the bars of the schedule.

    The schedule is the panel's: the first bar of every period that has bars. At a bar of the schedule the last selection up to it
    holds, so that one made later in a period is not lost. Where nothing is selected there are no rows: the account
    is flat (see schedule).
    """
    spec = payloads.weight_spec(spec)
    if spec["weighting"] == "incremental_signal":
        both = spec["incremental_step_size"]
        up, down = (both if spec[f] is None else spec[f] for f in ("incremental_step_up", "incremental_step_down"))
        tracked = timeline.alive(selected.groupBy("market").agg(F.min("date_utc").alias("_from")), selected)
        tracked = tracked.join(selected.select("market", "date_utc", F.lit(1.0).alias("_on")), ["market", "date_utc"], "left")
        out = recursive.incremental_weights(tracked, "_on", up, down, spec["incremental_min_weight"], spec["incremental_max_weight"], spec["gross_exposure"]).drop("_on")
    else:
        options = {"power": spec["rank_power"], "fixed": spec["fixed_weight"] or 0.0, "scale": spec["feature_value_scale"], "most": spec["max_positions"], "low": spec["feature_value_clip_min"], "high": spec["feature_value_clip_max"]}
        out = portfolio.weights(selected, spec["weighting"], spec["gross_exposure"], **options)
    if spec["rebalance_frequency"] not in UNITS:
        raise ValueError(f"unknown rebalance_frequency {spec['rebalance_frequency']}")
    unit = UNITS[spec["rebalance_frequency"]]
    if unit is not None:
        out = portfolio.carried(out, portfolio.rebalance_bars(panel, unit))
    if spec["gross_exposure_feature"]:
        scale = studies.market_wide(panel, spec["gross_exposure_feature"])
        out = studies.exposure(out, scale, spec["gross_exposure_lag"], spec["gross_exposure_clip_min"], spec["gross_exposure_clip_max"])
    return out
