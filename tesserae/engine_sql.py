"""DuckDB SQL of the queries in engine_queries, written from the definitions and not from the operators."""

from __future__ import annotations

from tesserae.portfolio_queries import _LEVEL, _W
from tesserae.queries import BRANDS, EVENTS, M
from tesserae.research_queries import _FACTORS_OF_ALL, _RUNS, _average_share, _growth


def _skip(x: str, n: int) -> str:
    """A window over the bars that have x."""
    return f"(PARTITION BY market, {x} IS NULL ORDER BY date_utc ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rolled(function: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_skip(x, n)} = {n} THEN {function} OVER {_skip(x, n)} END"


def _ranked(x: str, direction: str) -> str:
    """Percentile by rank, 1 for a market alone."""
    return f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN count({x}) OVER d = 1 THEN 1.0::DOUBLE ELSE (row_number() OVER (PARTITION BY date_utc ORDER BY {x} {direction} NULLS LAST, market) - 1)::DOUBLE / (count({x}) OVER d - 1) END END"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0::DOUBLE AS {name}"


SIGNALS = f"""sig AS (SELECT *, CASE WHEN count(*) OVER {M.format(4)} = 5 THEN (trade_price > avg(trade_price) OVER {M.format(4)})::INT::DOUBLE END AS up,
 ln(nullif(trade_price, 0)) - ln(nullif(lag(trade_price) {_W}, 0)) AS rise FROM panel)"""


def _chosen(top: int) -> str:
    return f"""{SIGNALS}, shares AS (SELECT *, {_ranked('turnover', 'DESC')} AS share FROM sig WINDOW d AS (PARTITION BY date_utc)),
 chosen AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY share DESC, market) AS place FROM shares WHERE up = 1 QUALIFY place <= {top})"""


def _carried(name: str, unit: str, weight: str) -> str:
    """Weights of the last selection at the first bar of each period."""
    return f"""{name} AS (SELECT due AS date_utc, market, {weight} AS w FROM (SELECT * FROM (SELECT s.due, max(c.date_utc) AS at_bar FROM (SELECT min(date_utc) AS due FROM panel GROUP BY date_trunc('{unit}', panel.date_utc)) s
  JOIN chosen c ON c.date_utc <= s.due GROUP BY 1) k JOIN chosen ON chosen.date_utc = at_bar))"""


_NAMES = "['btc_ma_cross_60m', 'ETH_xrp_VWMA_cross', 'grid_sol_ma_stack4', 'upbit_momentum', 'hierarchical_alt_ada', 'doge_link_adx', '', 'score_exposure_btc_eth_x_sol']"
_KNOWN = "['btc', 'eth', 'sol', 'xrp', 'ada', 'doge', 'avax', 'xlm', 'link']"
_RESULTS = f"""names AS (SELECT *, ({_NAMES})[p_partkey % 8 + 1] || '_' || p_partkey AS source_dir FROM part),
 tokens AS (SELECT *, list_filter(string_split(lower(source_dir), '_'), lambda t: t <> '') AS t FROM names),
 found AS (SELECT *, list_position(list_transform(t, lambda x: list_contains({_KNOWN}, x)), true) AS i FROM tokens),
 tail AS (SELECT *, CASE WHEN i > 0 THEN t[i:] ELSE [] END AS rest FROM found),
 cut AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: NOT list_contains({_KNOWN}, x)), true), 0) AS j FROM tail),
 scoped AS (SELECT *, array_to_string(list_transform(CASE WHEN j > 0 THEN rest[1:j - 1] ELSE rest END, lambda x: upper(x)), ',') AS scope, lower(source_dir) AS n FROM cut),
 results AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'grid' ELSE 'backtest' END AS record_type, source_dir, CASE WHEN p_partkey % 2 = 0 THEN 'run' || p_size ELSE source_dir END AS run_name,
 CASE WHEN p_partkey % 2 = 1 AND p_size % 3 = 0 THEN 'BTC' ELSE scope END AS asset_scope,
 CASE WHEN contains(n, 'score_exposure') THEN 'score_exposure' WHEN contains(n, 'hierarchical_alt') THEN 'hierarchical_alt' WHEN contains(n, 'hierarchical_stack') THEN 'hierarchical_stack' WHEN contains(n, 'hierarchical') THEN 'hierarchical'
  WHEN contains(n, 'vwma') AND contains(n, 'cross') THEN 'vwma_cross' WHEN contains(n, 'ma_stack4') THEN 'ma_stack4' WHEN contains(n, 'ma_stack') THEN 'ma_stack' WHEN contains(n, 'ma_cross') THEN 'ma_cross' WHEN contains(n, 'mom') THEN 'momentum' WHEN contains(n, 'adx') THEN 'adx_filter' ELSE 'other' END AS strategy_family,
 CASE WHEN p_partkey % 2 = 0 THEN '60m' ELSE '240m' END AS timeframe, CASE WHEN p_partkey % 2 = 0 AND p_size % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS cagr_pct,
 CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 5 <> 0 THEN p_size / 8.0::DOUBLE END ELSE CASE WHEN p_size % 4 <> 0 THEN p_size / 16.0::DOUBLE END END AS annualized_information_ratio,
 CASE WHEN p_partkey % 2 = 1 THEN 'x' END AS parameter_kind, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS parameter_size FROM scoped)"""

_FOLDS = f"""{_RUNS}, span AS (SELECT min(date_utc) AS b, max(date_utc) AS e FROM panel),
 windows AS (SELECT k::INT AS fold, phase, CASE WHEN phase = 'is' THEN b + to_months((3 * k)::INT) ELSE b + to_months((3 * k + 18)::INT) END AS begins, CASE WHEN phase = 'is' THEN b + to_months((3 * k + 18)::INT) ELSE b + to_months((3 * k + 24)::INT) END AS ends
  FROM span, range(0, 200) r(k), (VALUES ('is'), ('oos')) p(phase) WHERE b + to_months((3 * k + 24)::INT) <= e),
 inside AS (SELECT runs.*, fold, phase FROM runs JOIN windows ON date_utc >= begins AND date_utc < ends), {_growth('inside', 'fold, phase, run_id, market')},
 gains AS (SELECT market, fold, phase, run_id, round(exp(sum(ln(growth))) - 1, 6) AS gain FROM c GROUP BY 1, 2, 3, 4),
 both_of AS (SELECT market, fold, run_id, max(gain) FILTER (phase = 'is') AS is_gain, max(gain) FILTER (phase = 'oos') AS oos_gain FROM gains GROUP BY 1, 2, 3),
 won AS (SELECT * FROM both_of QUALIFY row_number() OVER (PARTITION BY market, fold ORDER BY is_gain DESC NULLS LAST, run_id) = 1)"""


def oracle_sql() -> dict[str, str]:
    twelve = M.format(11)
    return {
        "spec_steps": f"""WITH {EVENTS}, a AS (SELECT *, trade_price / nullif(lag(trade_price) {_W}, 0) - 1 AS r, ln(nullif(trade_price, 0)) - ln(nullif(lag(trade_price) {_W}, 0)) AS lr, ln(nullif(trade_price, 0)) - ln(nullif(lag(trade_price, 2) {_W}, 0)) AS m2,
 max(CASE WHEN market = 'click' THEN trade_price END) OVER (PARTITION BY date_utc) AS reference FROM panel),
 b AS (SELECT *, abs(r) / nullif(turnover, 0) AS illiquid, {_ranked('m2', 'ASC')} AS pm, {_ranked('turnover', 'ASC')} AS pt, CASE WHEN count(r) OVER {_skip('r', 6)} = 6 AND stddev_pop(r) OVER {_skip('r', 6)} > 0 THEN (r - avg(r) OVER {_skip('r', 6)}) / stddev_pop(r) OVER {_skip('r', 6)} END AS z FROM a WINDOW d AS (PARTITION BY date_utc))
 SELECT market, date_utc, {_r('z * exp(-0.5 * z * z)', 'gauss')}, {_r(_rolled('avg(pm)', 'pm', 3), 'rank_mom_2_3')}, {_r(f"1e6 * ({_rolled('avg(illiquid)', 'illiquid', 4)})", 'impact')}, {_r(_rolled('avg(pt)', 'pt', 3), 'turn_rank_3')},
 {_r('ln(1 + trade_price)', 'logs')}, {_r('(high_price - low_price) / nullif(opening_price, 0)', 'range_pct')}, {_r('abs(trade_price - reference)', 'gap')},
 {_r(f"CASE WHEN count(*) OVER {M.format(3)} = 4 THEN sum(trade_price * ln(1 + turnover)) OVER {M.format(3)} / nullif(sum(ln(1 + turnover)) OVER {M.format(3)}, 0) END", 'weighted')}, {_r(_rolled('stddev_pop(lr)', 'lr', 5), 'volatility')} FROM b""",
        "null_policies": f"""WITH {EVENTS}, a AS (SELECT *, CASE WHEN trade_price > 8 THEN trade_price END AS x FROM panel)
 SELECT market, date_utc, {_r(_rolled('avg(x)', 'x', 3), 'mean')}, {_r(f"CASE WHEN count(x) OVER {M.format(2)} = 3 THEN avg(x) OVER {M.format(2)} END", 'strict_mean')},
 {_r("ln(x) - ln(lag(x, 2) OVER (PARTITION BY market, x IS NULL ORDER BY date_utc))", 'momentum')}, {_r(f"ln(x) - ln(lag(x, 2) {_W})", 'strict_momentum')},
 {_r(f"CASE WHEN count(x) OVER {_skip('x', 4)} = 4 AND stddev_pop(x) OVER {_skip('x', 4)} > 0 THEN (x - avg(x) OVER {_skip('x', 4)}) / stddev_pop(x) OVER {_skip('x', 4)} END", 'zscore')},
 CASE WHEN x IS NOT NULL THEN (count(x) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING))::DOUBLE END AS age, {_r("CASE WHEN x IS NOT NULL THEN lag(x) OVER (PARTITION BY market, x IS NULL ORDER BY date_utc) END", 'lagged')} FROM a""",
        "turnover_scores": f"""WITH {EVENTS}, a AS (SELECT *, ln(1 + turnover) AS lx, list(turnover) OVER {twelve} AS held, row_number() {_W} AS n FROM panel)
 SELECT market, date_utc, {_r("CASE WHEN n >= 12 THEN (len(list_filter(held, lambda z: z < turnover)) + (len(list_filter(held, lambda z: z = turnover)) + 1) / 2.0) / 12 END", 'percentile')},
 {_r(f"CASE WHEN n >= 12 THEN turnover / nullif(avg(turnover) OVER {twelve}, 0) END", 'ratio')}, {_r(f"CASE WHEN n >= 12 AND stddev_samp(lx) OVER {twelve} > 0 THEN (lx - avg(lx) OVER {twelve}) / stddev_samp(lx) OVER {twelve} END", 'zscore')},
 (date_utc >= min(date_utc) OVER (PARTITION BY market) + INTERVAL 200 HOUR)::INT::DOUBLE AS listed FROM a""",
        "market_scores": f"""WITH {EVENTS}, {SIGNALS}, b AS (SELECT *, coalesce((up > 0)::INT, 0) AS u, coalesce((rise > 0)::INT, 0) AS r FROM sig)
 SELECT market, date_utc, CASE market WHEN 'click' THEN least(u, r)::DOUBLE WHEN 'view' THEN 0.25::DOUBLE * u + 0.5::DOUBLE * r WHEN 'purchase' THEN 2.0::DOUBLE * r ELSE 0.0::DOUBLE END AS score FROM b""",
        "bucket_breadth": f"""WITH {BRANDS}, a AS (SELECT *, CASE WHEN count(*) OVER {M.format(3)} = 4 THEN (trade_price > avg(trade_price) OVER {M.format(3)})::INT::DOUBLE END AS above FROM panel),
 v AS (SELECT market, date_utc, above, 1 + (row_number() OVER (PARTITION BY date_utc ORDER BY trade_price, market) - 1) * 4 // count(*) OVER (PARTITION BY date_utc) AS bp, 1 + (row_number() OVER (PARTITION BY date_utc ORDER BY turnover DESC, market) - 1) * 4 // count(*) OVER (PARTITION BY date_utc) AS bt FROM a WHERE above IS NOT NULL),
 s AS (SELECT date_utc, coalesce(avg(above) FILTER (bp = 1), 0) AS by_price, coalesce(avg(above) FILTER (bt = 2), 0) AS by_turnover FROM v GROUP BY 1)
 SELECT market, date_utc, round(by_price, 6) AS by_price, round(by_turnover, 6) AS by_turnover FROM panel LEFT JOIN s USING (date_utc)""",
        "full_universe": f"""WITH {BRANDS}, a AS (SELECT *, trade_price / nullif(lag(trade_price) {_W}, 0) - 1 AS rise, lag(turnover, 2) {_W} AS t2, lag(trade_price) {_W} AS p1, lag(volume) {_W} AS v1, row_number() {_W} AS age FROM panel),
 b AS (SELECT *, CASE WHEN rise IS NOT NULL THEN lag(rise) OVER (PARTITION BY market, rise IS NULL ORDER BY date_utc) END AS rise1, t2 IS NOT NULL AND market NOT IN ('Brand#3', 'Brand#21') AND age >= 6 AS base FROM a),
 g AS (SELECT min(date_utc) AS opens FROM (SELECT date_utc FROM b WHERE base GROUP BY 1 HAVING count(*) >= 20)),
 c AS (SELECT *, coalesce(rise1 > -0.5, false) AND base AS c0 FROM b WHERE date_utc >= (SELECT opens FROM g)),
 e AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY CASE WHEN c0 THEN p1 END DESC NULLS LAST, market) AS rp, row_number() OVER (PARTITION BY date_utc ORDER BY CASE WHEN base THEN v1 END ASC NULLS LAST, market) AS rv, count(CASE WHEN base THEN v1 END) OVER (PARTITION BY date_utc) AS nv,
  row_number() OVER (PARTITION BY date_utc ORDER BY CASE WHEN base THEN t2 END DESC NULLS LAST, market) AS place, count(CASE WHEN base THEN t2 END) OVER (PARTITION BY date_utc) AS n FROM c),
 f AS (SELECT *, c0 AND p1 IS NOT NULL AND rp <= 15 AND v1 IS NOT NULL AND (rv - 1) * 2 // nullif(nv, 0) = 0 AS c1 FROM e),
 h AS (SELECT *, c1 AND row_number() OVER (PARTITION BY date_utc ORDER BY CASE WHEN c1 THEN t2 END DESC NULLS LAST, market) <= 8 AS c2, 1 + (place - 1) * 3 // nullif(n, 0) AS part FROM f)
 SELECT market, date_utc, round(t2, 6) AS feature_value, place AS rank, part AS bucket, n AS size, row_number() OVER (PARTITION BY date_utc ORDER BY place) AS selected_rank FROM h WHERE c2 AND part IN (1, 2)""",
        "weightings": f"""WITH {EVENTS}, {_chosen(3)}, s AS (SELECT *, least(greatest(share / 2, 0), 0.4)::DOUBLE AS score FROM chosen)
 SELECT market, date_utc, round(CASE WHEN place <= 2 THEN (1.0::DOUBLE / (place * place)) / sum(CASE WHEN place <= 2 THEN 1.0::DOUBLE / (place * place) END) OVER d END, 6) AS ranked, 0.2::DOUBLE AS fixed,
 round(CASE WHEN count(CASE WHEN score > 0 THEN 1 END) OVER d > 0 THEN 0.9::DOUBLE * score / count(CASE WHEN score > 0 THEN 1 END) OVER d ELSE 0.0 END, 6) AS valued FROM s WINDOW d AS (PARTITION BY date_utc)""",
        "incremental": f"""WITH RECURSIVE {EVENTS}, {_chosen(2)}, bars AS (SELECT DISTINCT date_utc FROM chosen), firsts AS (SELECT market, min(date_utc) AS b FROM chosen GROUP BY 1),
 tracked AS (SELECT f.market, bars.date_utc, (c.market IS NOT NULL) AS is_on, row_number() OVER (PARTITION BY f.market ORDER BY bars.date_utc) AS n FROM firsts f JOIN bars ON bars.date_utc >= f.b LEFT JOIN chosen c ON c.market = f.market AND c.date_utc = bars.date_utc),
 s AS (SELECT market, n, 0.5::DOUBLE AS score FROM tracked WHERE n = 1
  UNION ALL SELECT t.market, t.n, least(0.9::DOUBLE, greatest(0.0::DOUBLE, s.score + CASE WHEN is_on THEN 0.5::DOUBLE ELSE -0.2::DOUBLE END)) FROM s JOIN tracked t ON t.market = s.market AND t.n = s.n + 1),
 j AS (SELECT t.market, t.date_utc, score FROM tracked t JOIN s USING (market, n))
 SELECT market, date_utc, round(score, 6) AS score, round(CASE WHEN count(CASE WHEN score > 0 THEN 1 END) OVER d > 0 THEN 0.8::DOUBLE * score / count(CASE WHEN score > 0 THEN 1 END) OVER d ELSE 0.0 END, 6) AS target_weight FROM j WINDOW d AS (PARTITION BY date_utc)""",
        "exposed_weights": f"""WITH {EVENTS}, {_chosen(3)}, {_carried('weekly', 'week', '1.0::DOUBLE / count(*) OVER (PARTITION BY due)')},
 v AS (SELECT date_utc, up, row_number() OVER (PARTITION BY date_utc ORDER BY turnover DESC, market) AS k FROM sig WHERE up IS NOT NULL), h AS (SELECT date_utc, coalesce(avg(up) FILTER (k <= 3), 0) AS heat FROM v GROUP BY 1),
 bars AS (SELECT b.date_utc, lag(heat) OVER (ORDER BY b.date_utc) AS heat, n FROM (SELECT date_utc, count(DISTINCT market) AS n FROM panel GROUP BY 1) b LEFT JOIN h USING (date_utc))
 SELECT market, date_utc, round(w * CASE WHEN heat IS NULL THEN 0 ELSE least(greatest(heat, 0.25), 1) END * 4 / n, 6)::DOUBLE AS target_weight FROM weekly JOIN bars USING (date_utc)""",
        "strategy_weights": f"""WITH {EVENTS}, a AS (SELECT *, CASE WHEN count(*) OVER {M.format(3)} = 4 THEN sum(turnover) OVER {M.format(3)} END AS total, trade_price / nullif(lag(trade_price, 3) {_W}, 0) - 1 AS momentum, row_number() {_W} AS age FROM panel),
 b AS (SELECT *, list(total) OVER {_skip('total', 10)} AS held FROM a), c AS (SELECT *, CASE WHEN total IS NOT NULL AND len(held) = 10 THEN (len(list_filter(held, lambda z: z < total)) + (len(list_filter(held, lambda z: z = total)) + 1) / 2.0) / 10 END AS score FROM b),
 e AS (SELECT *, {_average_share('score')} AS share, {_average_share('momentum')} AS pm, count(CASE WHEN score IS NOT NULL AND momentum IS NOT NULL AND age >= 12 THEN 1 END) OVER (PARTITION BY date_utc) AS ready FROM c),
 f AS (SELECT market, date_utc, momentum, coalesce(least(greatest(ceil(share * 3), 1), 3) IN (2, 3) AND age >= 12 AND momentum > 0 AND pm <= 0.9, false) AND ready >= 3 AS ok FROM e),
 bars AS (SELECT date_utc, row_number() OVER (ORDER BY date_utc) AS n FROM (SELECT DISTINCT date_utc FROM panel)), firsts AS (SELECT market, min(date_utc) AS b FROM panel GROUP BY 1),
 grid AS (SELECT firsts.market, bars.date_utc, n, momentum, ok FROM firsts JOIN bars ON date_utc >= b LEFT JOIN f ON f.market = firsts.market AND f.date_utc = bars.date_utc),
 l AS (SELECT market, date_utc, n, lag(momentum, 2) {_W} AS m, lag(ok, 2) {_W} AS ok FROM grid),
 k AS (SELECT *, row_number() OVER (PARTITION BY date_utc ORDER BY m DESC NULLS LAST, market) AS place FROM l WHERE ok AND (n - 1) % 3 = 0 QUALIFY place <= 2)
 SELECT market, date_utc, round(m, 6) AS feature_value, place AS selected_rank, round(1.0::DOUBLE / count(*) OVER (PARTITION BY date_utc), 6) AS target_weight FROM k""",
        "shared_cash": f"""WITH RECURSIVE {EVENTS}, {_LEVEL}, s AS (SELECT *, CASE WHEN count(*) OVER {M.format(4)} = 5 THEN trade_price > avg(trade_price) OVER {M.format(4)} END AS up FROM levels),
 w AS (SELECT market, date_utc, 0.9::DOUBLE / count(*) OVER (PARTITION BY date_utc) AS w FROM s WHERE up), days AS (SELECT min(date_utc) AS date_utc FROM panel GROUP BY date_trunc('day', panel.date_utc)),
 grid AS (SELECT m.market, b.date_utc, last_value(level IGNORE NULLS) OVER (PARTITION BY m.market ORDER BY b.date_utc ROWS UNBOUNDED PRECEDING) AS p, coalesce(w.w, 0) AS w, days.date_utc IS NOT NULL AS due
  FROM (SELECT DISTINCT market FROM panel) m CROSS JOIN (SELECT DISTINCT date_utc FROM panel) b LEFT JOIN levels l ON l.market = m.market AND l.date_utc = b.date_utc LEFT JOIN w ON w.market = m.market AND w.date_utc = b.date_utc LEFT JOIN days ON days.date_utc = b.date_utc),
 bars AS (SELECT date_utc, bool_or(due) AS due, list(coalesce(p, 0)::DOUBLE ORDER BY market) AS ps, list(w::DOUBLE ORDER BY market) AS ws, row_number() OVER (ORDER BY date_utc) AS n FROM grid WHERE date_utc >= (SELECT min(date_utc) FROM grid WHERE due AND w > 0) GROUP BY 1),
 acc AS (SELECT run_id, fee, 0::BIGINT AS n, 1000.0::DOUBLE AS cash, list_transform(range(5), lambda i: 0.0::DOUBLE) AS us FROM (VALUES (0, 0.001::DOUBLE), (1, 0.0105::DOUBLE)) f(run_id, fee)
  UNION ALL SELECT run_id, fee, n, CASE WHEN due THEN total * share * (1 - list_sum(ws)) ELSE cash END, CASE WHEN due THEN list_transform(range(1, 6), lambda j: CASE WHEN ps[j] > 0 THEN ws[j] * total * share / ps[j] ELSE 0.0::DOUBLE END) ELSE us END
  FROM (SELECT *, list_reduce([1.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: 1 - fee * list_sum(list_transform(range(1, 6), lambda j: abs(ws[j] * c - us[j] * ps[j] / total)))) AS share
   FROM (SELECT acc.run_id, acc.fee, b.n, b.due, b.ps, b.ws, acc.cash, acc.us, acc.cash + list_sum(list_transform(range(1, 6), lambda j: acc.us[j] * b.ps[j])) AS total FROM acc JOIN bars b ON b.n = acc.n + 1)))
 SELECT run_id, date_utc, round(cash + list_sum(list_transform(range(1, 6), lambda j: us[j] * ps[j])), 4) AS equity FROM acc JOIN bars USING (n)""",
        "drawdown_anatomy": f"""WITH {EVENTS}, {_LEVEL}, p AS (SELECT *, max(level) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS peak FROM levels), d AS (SELECT *, level / nullif(peak, 0) - 1 AS down FROM p),
 t AS (SELECT market, date_utc AS trough_at, peak AS top, down FROM d QUALIFY row_number() OVER (PARTITION BY market ORDER BY down NULLS FIRST, date_utc) = 1)
 SELECT t.market, min(d.date_utc) FILTER (level = top AND d.date_utc <= trough_at) AS peak_at, trough_at, min(d.date_utc) FILTER (level >= top AND d.date_utc > trough_at) AS recovered_at, round(t.down, 6) + 0::DOUBLE AS drawdown FROM t JOIN d USING (market) GROUP BY t.market, trough_at, t.down""",
        "drawdown_episodes": f"""WITH {EVENTS}, p AS (SELECT *, row_number() {_W} AS n, max(trade_price) OVER (PARTITION BY market ORDER BY date_utc ROWS UNBOUNDED PRECEDING) AS peak FROM panel),
 tops AS (SELECT market, date_utc AS peak_at, n AS first_n, trade_price AS height, lead(date_utc) {_W} AS recovered_at, lead(n) {_W} AS next_n FROM p WHERE trade_price >= peak),
 e AS (SELECT * FROM tops WHERE next_n > first_n + 1), l AS (SELECT e.*, p.date_utc AS trough_at, p.n AS low_n, p.trade_price AS low FROM e JOIN p ON p.market = e.market AND p.n > e.first_n AND p.n < e.next_n QUALIFY row_number() OVER (PARTITION BY e.market, first_n ORDER BY p.trade_price, p.date_utc) = 1)
 SELECT market, peak_at, trough_at, recovered_at, round(1 - low / height, 6) AS depth, low_n - first_n AS bars_down, next_n - first_n AS bars FROM l""",
        "recent_years": f"""WITH {BRANDS}, {_LEVEL}, ends AS (SELECT market, max(date_utc) AS last FROM panel GROUP BY 1), cut AS (SELECT l.*, y FROM levels l JOIN ends USING (market), (VALUES (1), (2)) v(y) WHERE date_utc >= last - to_years(y)),
 d AS (SELECT *, level / nullif(max(level) OVER (PARTITION BY market, y ORDER BY date_utc ROWS UNBOUNDED PRECEDING), 0) - 1 AS down FROM cut),
 s AS (SELECT market, y, count(*) AS bars, arg_max(level, date_utc) / nullif(arg_min(level, date_utc), 0) - 1 AS ret, (pow(arg_max(level, date_utc) / arg_min(level, date_utc), 52.0::DOUBLE / nullif(count(*) - 1, 0)) - 1) / nullif(abs(min(down)), 0) AS calmar FROM d GROUP BY 1, 2),
 w AS (SELECT market, 100 * (arg_max(level, date_utc) / nullif(arg_min(level, date_utc), 0) - 1) AS pct FROM levels WHERE date_utc BETWEEN '1996-01-01' AND '1997-01-05' GROUP BY 1)
 SELECT w.market, {_r('pct', 'return_pct', 5)}, a.bars AS bars_1y, {_r('a.ret', 'return_1y')}, {_r('a.calmar', 'calmar_1y', 4)}, b.bars AS bars_2y, {_r('b.ret', 'return_2y')}, {_r('b.calmar', 'calmar_2y', 4)} FROM w JOIN s a ON a.market = w.market AND a.y = 1 JOIN s b ON b.market = w.market AND b.y = 2""",
        "benchmark_curve": f"WITH {EVENTS}, {_LEVEL} SELECT date_utc, round(1000 * level / first_value(level) OVER (ORDER BY date_utc), 5) AS value FROM levels WHERE market = 'click'",
        "allocation": f"""WITH {EVENTS}, {_chosen(3)}, {_carried('daily', 'day', '1.0::DOUBLE / count(*) OVER (PARTITION BY due)')}, {_carried('weekly', 'week', '0.5::DOUBLE / place / sum(1.0::DOUBLE / place) OVER (PARTITION BY due)')},
 days AS (SELECT date_utc FROM daily UNION SELECT date_utc FROM weekly), parts AS (SELECT d.date_utc, market, 0.6::DOUBLE * w AS w FROM (SELECT days.date_utc, max(x.date_utc) AS b FROM days JOIN daily x ON x.date_utc <= days.date_utc GROUP BY 1) d JOIN daily ON daily.date_utc = b
  UNION ALL SELECT d.date_utc, market, 0.3::DOUBLE * w FROM (SELECT days.date_utc, max(x.date_utc) AS b FROM days JOIN weekly x ON x.date_utc <= days.date_utc GROUP BY 1) d JOIN weekly ON weekly.date_utc = b),
 sums AS (SELECT date_utc, market, sum(w) AS w FROM parts GROUP BY 1, 2), scaled AS (SELECT date_utc, market, 0.9::DOUBLE * w / sum(w) OVER (PARTITION BY date_utc) AS w FROM sums),
 c AS (SELECT *, coalesce(max(CASE WHEN market = 'click' THEN w END) OVER (PARTITION BY date_utc), 0) AS k FROM scaled)
 SELECT market, date_utc, round(CASE WHEN k <= 0.1 THEN w WHEN market = 'click' THEN 0.1 ELSE w * (0.9 - 0.1) / (0.9 - k) END, 6)::DOUBLE AS target_weight FROM c""",
        "order_plan": f"""WITH {EVENTS}, {_chosen(3)}, {_carried('daily', 'day', '1.0::DOUBLE / count(*) OVER (PARTITION BY due)')}, t AS (SELECT 'KRW-' || upper(market) AS market, w FROM daily WHERE date_utc = (SELECT max(date_utc) FROM daily)),
 p AS (SELECT 'KRW-' || upper(market) AS market, arg_max(trade_price, date_utc) AS price FROM panel GROUP BY 1), own AS (SELECT upper(CASE n_nationkey WHEN 0 THEN 'KRW' WHEN 1 THEN 'click' WHEN 2 THEN 'view' ELSE n_name END) AS currency, n_nationkey * 3 + 50 + 0.5::DOUBLE AS q FROM nation),
 m AS (SELECT market, price, coalesce(w, 0) AS w, coalesce(q, 0) AS q, coalesce(q, 0) * price AS value FROM p LEFT JOIN t USING (market) LEFT JOIN own ON market = 'KRW-' || currency), e AS (SELECT (SELECT q FROM own WHERE currency = 'KRW') + sum(value) AS equity FROM m)
 SELECT market, round(price, 6) AS price, round(q, 6)::DOUBLE AS quantity, round(value, 6) AS value, round(w, 6)::DOUBLE AS target_weight, round(equity * w - value, 6) + 0::DOUBLE AS delta, CASE WHEN abs(equity * w - value) < 25 THEN 'hold' WHEN equity * w > value THEN 'buy' ELSE 'sell' END AS action FROM m, e
 UNION ALL SELECT 'KRW-' || currency, NULL, q, NULL, 0, NULL, 'unmanaged' FROM own WHERE currency NOT IN ('KRW', 'CLICK', 'VIEW')""",
        "factor_cube": f"""WITH {BRANDS}, {_FACTORS_OF_ALL}, s AS (SELECT *, {_average_share('momentum')} AS a, {_average_share('turnover')} AS b, {_average_share('volume')} AS c FROM f),
 k AS (SELECT *, forward IS NOT NULL AND momentum > -0.2 AS ok FROM s), g AS (SELECT *, count(CASE WHEN ok THEN 1 END) OVER (PARTITION BY date_utc) AS n FROM k),
 v AS (SELECT *, least(greatest(ceil(a * 2), 1), 2)::INT AS x, least(greatest(ceil(b * 2), 1), 2)::INT AS y, least(greatest(ceil(c * 2), 1), 2)::INT AS z FROM g WHERE ok AND n >= 15)
 SELECT i.k::INT AS momentum_bucket, j.k::INT AS turnover_bucket, l.k::INT AS volume_bucket, count(x) AS n, round(median(forward), 6) AS median, round(avg((forward > 0)::INT), 6) AS positive FROM range(1, 3) i(k), range(1, 3) j(k), range(1, 3) l(k) LEFT JOIN v ON x = i.k AND y = j.k AND z = l.k GROUP BY 1, 2, 3""",
        "factor_table": f"""WITH {BRANDS}, {_FACTORS_OF_ALL}, s AS (SELECT *, {_average_share('momentum')} AS a, {_average_share('turnover')} AS t FROM f),
 v AS (SELECT *, least(greatest(ceil(a * 3), 1), 3)::INT AS x, least(greatest(ceil(t * 3), 1), 3)::INT AS y FROM s WHERE a IS NOT NULL AND t IS NOT NULL AND forward IS NOT NULL)
 SELECT k::INT AS momentum_bucket, round(avg(forward) FILTER (y = 1), 6) AS b1, round(avg(forward) FILTER (y = 2), 6) AS b2, round(avg(forward) FILTER (y = 3), 6) AS b3 FROM range(1, 4) r(k) LEFT JOIN v ON x = k GROUP BY 1""",
        "snapshots": f"""WITH {BRANDS}, {_FACTORS_OF_ALL} SELECT market, date_utc, round(forward, 6) AS forward, round(momentum, 6) AS momentum, round(turnover, 6) AS turnover FROM f WHERE forward IS NOT NULL QUALIFY row_number() OVER (PARTITION BY market ORDER BY date_utc DESC) = 1""",
        "candidates": f"""WITH {BRANDS}, {_FOLDS}, n AS (SELECT market, run_id, count(*) AS wins FROM won GROUP BY 1, 2), t AS (SELECT market, count(*) AS total FROM won GROUP BY 1)
 SELECT g.market, g.run_id, count(*) AS folds, coalesce(max(wins), 0) AS wins, {_r('median(gain)', 'median_oos_gain', 4)}, {_r('avg(gain)', 'mean_oos_gain', 4)}, min(gain) AS least_oos_gain, max(gain) AS most_oos_gain,
 round(avg((gain > 0)::INT), 4) AS positive, round(coalesce(max(wins), 0) / max(total), 4)::DOUBLE AS share FROM gains g LEFT JOIN n ON n.market = g.market AND n.run_id = g.run_id JOIN t ON t.market = g.market WHERE phase = 'oos' GROUP BY 1, 2""",
        "winner_figures": f"""WITH {BRANDS}, {_FOLDS}, n AS (SELECT market, run_id, count(*) AS wins, min(fold) AS first FROM won GROUP BY 1, 2), m AS (SELECT market, run_id AS most_frequent FROM n QUALIFY row_number() OVER (PARTITION BY market ORDER BY wins DESC, first, run_id) = 1),
 j AS (SELECT market, '{{' || string_agg('"' || run_id || '":' || wins, ',' ORDER BY run_id::VARCHAR) || '}}' AS wins FROM n GROUP BY 1)
 SELECT w.market, count(*) AS folds, {_r('median(oos_gain)', 'median_oos_gain', 5)}, round(avg((oos_gain > 0)::INT), 5) AS positive, any_value(most_frequent) AS most_frequent, any_value(j.wins) AS wins FROM won w JOIN m USING (market) JOIN j USING (market) GROUP BY 1""",
        "selection_figures": f"""WITH {EVENTS}, {_chosen(5)}, r AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 3)) r(run_id, top_n)), b AS (SELECT run_id, date_utc, count(*) AS n FROM r JOIN chosen ON place <= top_n GROUP BY 1, 2)
 SELECT r.run_id, top_n, CASE WHEN count(n) > 0 THEN 'ok' ELSE 'empty_weights' END AS status, nullif(count(n), 0) AS rebalances, round(avg(n), 6) AS mean_selected, min(n) AS least_selected, max(n) AS most_selected FROM r LEFT JOIN b USING (run_id) GROUP BY 1, 2""",
        "results_table": f"WITH {_RESULTS} SELECT record_type, source_dir, run_name, asset_scope, strategy_family, timeframe, status, cagr_pct, annualized_information_ratio, parameter_kind, parameter_size FROM results",
        "best_results": f"""WITH {_RESULTS} SELECT asset_scope, source_dir, run_name, annualized_information_ratio, row_number() OVER (PARTITION BY asset_scope ORDER BY annualized_information_ratio DESC, run_name, source_dir) AS place FROM results
 WHERE status = 'ok' AND (contains(lower(run_name), '_c') OR contains(lower(source_dir), '_c')) AND annualized_information_ratio >= 0.5 QUALIFY place <= 3""",
        "merged_panels": f"""WITH {EVENTS}, o AS (SELECT * FROM panel WHERE date_utc < '2024-01-20'), n AS (SELECT * REPLACE (trade_price + 1 AS trade_price) FROM panel WHERE date_utc >= '2024-01-18' AND market <> 'view'),
 u AS (SELECT 'upserted' AS kind, * FROM (SELECT o.market, o.date_utc, o.trade_price FROM o ANTI JOIN n USING (market, date_utc) UNION ALL SELECT market, date_utc, trade_price FROM n)),
 r AS (SELECT 'recalculated' AS kind, * FROM (SELECT market, date_utc, trade_price FROM o WHERE date_utc < (SELECT min(date_utc) FROM n) UNION ALL SELECT market, date_utc, trade_price FROM n)),
 f AS (SELECT market, arg_min(trade_price, date_utc) FILTER (trade_price > 50) AS x FROM panel GROUP BY 1)
 SELECT kind, market, count(*) AS n, round(sum(trade_price), 4) AS total, round(any_value(x), 6) AS first_price FROM (SELECT * FROM u UNION ALL SELECT * FROM r) JOIN f USING (market) GROUP BY 1, 2""",
        "tails": f"""WITH {EVENTS}, t AS (SELECT market, date_utc FROM panel WHERE trade_price > 40 QUALIFY row_number() OVER (PARTITION BY market ORDER BY date_utc DESC) <= 3), h AS (SELECT market, date_utc FROM panel QUALIFY row_number() {_W} <= 2)
 SELECT *, 'tail' AS kind FROM t UNION ALL SELECT *, 'head' AS kind FROM h""",
        "wide_round_trip": f"""WITH {EVENTS}, b AS (SELECT date_utc, row_number() OVER (ORDER BY date_utc) AS n FROM (SELECT DISTINCT date_utc FROM panel)) SELECT market, date_utc, round(trade_price, 6) AS trade_price FROM panel JOIN b USING (date_utc) WHERE (n - 1) % 7 = 0 AND market IN ('click', 'error', 'purchase', 'signup')""",
    }
