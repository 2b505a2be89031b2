"""JSON payloads: templates, presets, checks and defaults of specs, and what can be told from them before a run."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable

# Presets that configurations name, with their parameters in braces.
PRESETS: dict[str, dict] = {
    "rank_momentum": {
        "source": "trade_price",
        "steps": [
            {"kind": "momentum", "params": {"window": "{momentum_window}"}},
            {"kind": "cross_percentile", "params": {"descending": False}},
            {"kind": "rolling_mean", "params": {"window": "{rank_avg_window}"}},
        ],
        "column_name": "rank_mom_{momentum_window}_{rank_avg_window}",
    },
    "gaussian_momentum": {
        "source": "trade_price",
        "steps": [{"kind": "simple_return", "params": {"window": "{ret_window}"}}, {"kind": "rolling_zscore", "params": {"window": "{z_window}"}}, {"kind": "gaussian_signed"}],
        "column_name": "gauss_{ret_window}_{z_window}",
    },
    "impact_illiquidity": {
        "source": "trade_price",
        "steps": [
            {"kind": "simple_return", "params": {"window": 1}},
            {"kind": "abs"},
            {"kind": "ratio_to_reference", "params": {"reference": "candle_acc_trade_price"}},
            {"kind": "rolling_mean", "params": {"window": "{avg_window}"}},
        ],
        "column_name": "impact_{avg_window}",
    },
    "turnover_rank_persist": {
        "source": "candle_acc_trade_price",
        "steps": [{"kind": "cross_percentile", "params": {"descending": False}}, {"kind": "rolling_mean", "params": {"window": "{avg_window}"}}],
        "column_name": "turn_rank_{avg_window}",
    },
}
OPERATORS = ("gt", "ge", "lt", "le", "eq", "ne")
# Parameters that count bars of history, as whole names or as endings.
HISTORY_NAMES = ("window", "period", "periods", "lag", "lookback", "lookback_bars", "bars", "span")
HISTORY_ENDINGS = ("_window", "_period", "_periods", "_lag", "_lookback", "_bars", "_span")
_ONE = re.compile(r"\{(\w+)\}")


def feature_name(spec: dict) -> str:
    """column_name, or a name made of the source and its steps."""
    if spec.get("column_name"):
        return spec["column_name"]
    if "source" not in spec:
        raise ValueError(f"a spec without a source needs a column_name: {spec}")
    steps = ["_".join([s["kind"], *[f"{k}{v}" for k, v in sorted(s.get("params", {}).items())]]) for s in spec.get("steps", [])]
    return "__".join([spec["source"], *steps])


def rendered(template, values: dict):
    """The template with names in braces filled in; a string that is one name alone becomes the value as it is."""
    if isinstance(template, dict):
        return {k: rendered(v, values) for k, v in template.items()}
    if isinstance(template, (list, tuple)):
        return [rendered(v, values) for v in template]
    if not isinstance(template, str):
        return template
    whole = _ONE.fullmatch(template)
    return values[whole[1]] if whole and whole[1] in values else template.format(**values)


def feature_specs(payload: list[dict], presets: dict[str, dict] = PRESETS) -> list[dict]:
    """Specs with presets written out; fields beside the preset's own win over it."""
    out = []
    for item in payload:
        if item.get("preset"):
            if item["preset"] not in presets:
                raise ValueError(f"unknown preset {item['preset']}")
            made = rendered(presets[item["preset"]], item.get("params", {}))
            item = made | {k: v for k, v in item.items() if k not in ("preset", "params")}
        out.append(item)
        feature_name(item)
        if "compare" in item and item["compare"]["operator"] not in OPERATORS:
            raise ValueError(f"unknown operator {item['compare']['operator']}")
    return out


def _rank_filter(item: dict) -> dict:
    return {"mode": "top_n", "lag": 0, "top_n": 30, "quantiles": 5, "bucket_values": [1], "ascending": False, "scope": "filtered"} | item


def universe_spec(payload: dict) -> dict:
    """With defaults, lags that include the signal's, and filters in stages. Bare rank_filters are one stage, unless
    filter_stages are given."""
    spec = {"lag": 1, "signal_lag": 0, "start_min_cross_section_size": 0, "mode": "top_n", "top_n": 30, "quantiles": 5, "bucket_values": [1], "ascending": False, "scope": "filtered",
            "exclude_warnings": False, "min_age_days": None, "allowed_markets": [], "excluded_markets": [], "value_filters": [], "rank_filters": [], "filter_stages": []} | payload
    if spec["mode"] not in ("top_n", "quantile", "all"):
        raise ValueError(f"unknown mode {spec['mode']}")
    shift = spec["signal_lag"]
    stages = spec["filter_stages"] or ([{"mode": "sequential", "filters": spec["rank_filters"]}] if spec["rank_filters"] else [])
    filters = [{"lag": 0} | f for f in spec["value_filters"]]
    stages = [{"mode": s.get("mode", "sequential"), "filters": [_rank_filter(f) for f in s.get("filters", [])]} for s in stages]
    for f in filters:
        if f["operator"] not in OPERATORS:
            raise ValueError(f"unknown operator {f['operator']}")
    ranked = [f for s in stages for f in s["filters"]]
    if min([spec["lag"], shift, *(f["lag"] for f in filters + ranked)]) < 0:
        raise ValueError("lags are not negative")
    for s in stages:
        if s["mode"] not in ("sequential", "and"):
            raise ValueError(f"unknown stage mode {s['mode']}")
    for f in [spec, *ranked]:
        if f["scope"] not in ("filtered", "candidates", "global", "base"):
            raise ValueError(f"unknown scope {f['scope']}")
    moved = [s | {"filters": [f | {"lag": f["lag"] + shift} for f in s["filters"]]} for s in stages]
    return spec | {"sort_column": spec.get("sort_column") or spec["feature_column"], "lag": spec["lag"] + shift, "signal_lag": 0, "value_filters": [f | {"lag": f["lag"] + shift} for f in filters], "rank_filters": [], "filter_stages": moved}


def required_lags(spec: dict) -> set[tuple[str, int]]:
    """The (column, lag) pairs that a universe reads."""
    spec = universe_spec(spec)
    return {(spec["sort_column"], spec["lag"]), *((f["feature_column"], f["lag"]) for f in [*spec["value_filters"], *(f for s in spec["filter_stages"] for f in s["filters"])])}


def weight_spec(payload: dict) -> dict:
    spec = {"weighting": "equal", "gross_exposure": 1.0, "gross_exposure_feature": None, "gross_exposure_lag": 0, "gross_exposure_clip_min": 0.0, "gross_exposure_clip_max": 1.0, "fixed_weight": None,
            "rank_power": 1.0, "max_positions": None, "rebalance_frequency": "daily", "feature_value_scale": 1.0, "feature_value_clip_min": 0.0, "feature_value_clip_max": 1.0,
            "incremental_step_size": 0.25, "incremental_step_up": None, "incremental_step_down": None, "incremental_min_weight": 0.0, "incremental_max_weight": 1.0} | payload
    if spec["weighting"] not in ("equal", "fixed", "rank", "feature_value", "incremental_signal"):
        raise ValueError(f"unknown weighting {spec['weighting']}")
    if spec["weighting"] == "fixed" and spec["fixed_weight"] is None:
        raise ValueError("fixed weighting needs fixed_weight")
    return spec


def market_score_spec(payload: dict) -> dict:
    rules = [{"mode": "weighted_sum"} | r | {"market": str(r["market"]).upper()} for r in payload.get("rules", [])]
    return {"output_column": "custom_score"} | payload | {"rules": rules}


def load(path: str):
    """A JSON file's payload, with or without a byte order mark."""
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def merged_config(leaf: dict, overrides: dict) -> dict:
    """An execution configuration: fields of the sleeve that uses a leaf win over the leaf's own; sleeves do not nest."""
    if leaf.get("sleeves"):
        raise ValueError("a sleeve has no sleeves of its own")
    return leaf | {k: v for k, v in overrides.items() if v is not None and k not in ("config", "execution_config_json")}


# --------------------------------------------------------------------------- what a payload tells


def canonical_key(payload) -> str:
    """Equal for equal payloads, whatever the order of their fields."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dependencies(spec: dict) -> set[str]:
    """The columns a feature spec names, features and sources alike."""
    out = {spec["source"]} if spec.get("source") else set()
    out |= {c["feature_column"] for c in spec.get("components", [])}
    out |= set((spec.get("logical") or {}).get("features", []))
    for node, fields in (("compare", ("left_feature", "right_feature")), ("state", ("entry_feature", "exit_feature")), ("breadth", ("driver_feature", "signal_feature"))):
        out |= {(spec.get(node) or {}).get(f) for f in fields}
    for step in spec.get("steps", []):
        out |= {step.get("params", {}).get(p) for p in ("reference", "reference_column", "volume_column")}
    return {name for name in out if name}


def signature(name: str, features: list[dict]) -> str:
    """A key of a feature by its definition and those of all features under it: equal names of other definitions differ."""
    known = {feature_name(f): f for f in features}

    def deep(name: str, above: tuple[str, ...]):
        if name in above:
            raise ValueError(f"features name each other: {' '.join(above)}")
        if name not in known:
            return name
        spec = {k: v for k, v in known[name].items() if k != "column_name"}
        return [spec, {d: deep(d, (*above, name)) for d in sorted(dependencies(spec))}]

    return canonical_key(deep(name, ()))


def missing_columns(features: list[dict], present: Iterable[str]) -> set[str]:
    """Columns that features name and neither the panel nor another feature has."""
    named = {feature_name(f) for f in features}
    wanted = {d.split(":")[-1] for f in features for d in dependencies(f)}
    return wanted - named - set(present)


def required_markets(features: list[dict], universe: dict | None = None, scores: dict | None = None, benchmark: str | None = None) -> set[str] | None:
    """Markets a run reads; None is all of them: only a universe with allowed markets narrows the panel."""
    allowed = (universe or {}).get("allowed_markets")
    if not allowed:
        return None
    named = {d.split(":")[1] for f in features for d in dependencies(f) if d.startswith("market:")}
    return named | set(allowed) | {r["market"] for r in (scores or {}).get("rules", [])} | ({benchmark} if benchmark else set())


def history_bars(features: list[dict], universe: dict, weights: dict) -> int:
    """Bars that the last row needs before it: the longest feature with all it is made of, lags, and room to spare."""
    known = {feature_name(f): f for f in features}

    def param(key: str, value) -> int:
        counts = isinstance(value, (int, float)) and not isinstance(value, bool) and (key in HISTORY_NAMES or key.endswith(HISTORY_ENDINGS))
        return max(0, int(value)) if counts else 0

    def bars(name: str, above: tuple[str, ...] = ()) -> int:
        if name not in known or name in above:
            return 1
        spec = known[name]
        own = sum(max([1, *(param(k.lower(), v) for k, v in s.get("params", {}).items())]) - 1 for s in spec.get("steps", []))
        return own + max([1, *(bars(d, (*above, name)) for d in dependencies(spec))])

    longest = max([1, *map(bars, known)])
    lag = max([n for _, n in required_lags(universe)], default=0)
    needed = longest + lag + (1 if weights.get("rebalance_frequency", "daily") == "every_bar" else 5) + max(20, min(longest // 10, 100))
    return max(needed, longest + 250) if any(f.get("state") for f in features) else needed


def bars_a_day(timeframe: str) -> int:
    """1 for daily, else from minutes that divide the day, as in 60m."""
    if timeframe in ("daily", "1d"):
        return 1
    minutes = re.fullmatch(r"(\d+)m", timeframe)
    if not minutes or not int(minutes[1]) or 1440 % int(minutes[1]):
        raise ValueError(f"unknown timeframe {timeframe}")
    return 1440 // int(minutes[1])


def bars_a_year(timeframe: str) -> int:
    """Of 252 days, as annualised figures count them."""
    return 252 * bars_a_day(timeframe)


def runs(grid: dict[str, list], templates: dict, name: str) -> list[dict]:
    """One entry per combination in the order of the product: its parameters, name, and templates filled in."""
    out = []
    for n, values in enumerate(itertools.product(*grid.values())):
        combination = dict(zip(grid, values, strict=True))
        out.append({"run_id": n, "run_name": rendered(name, combination), "parameters": combination} | {k: rendered(t, combination) for k, t in templates.items()})
    return out
