"""Tick tape to minute operators: signs, runs, gaps, sizes, entropy, quotes, spreads."""

from __future__ import annotations

from ..plans.dialect import either
from ..sources.frames import BARS, QUOTE_BARS, QUOTES, SIGNED, TAPE_QUOTES, TRADES

#: Prints of this size and above are large; odd lots are smaller than ROUND.
LARGE, ROUND, TIMES = 80, 10, 4.0
W = "PARTITION BY symbol, t ORDER BY us, event_id"
GAPS = f"SELECT *, us - lag(us) OVER ({W}) AS gap, min(price) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low_so_far, CAST(floor(us / 60000000) AS bigint) AS slot, avg(size) OVER (PARTITION BY symbol, t) AS mean_size FROM ({SIGNED}) g0"
BIN = "least(5, coalesce(CAST(floor(CASE WHEN size > 0 THEN log10(size) * 2 END) AS int), 0))"
N = 1.7e-10
r = lambda e, d=6: f"round(CAST({e} AS double) + {N}, {d})"
PCT = lambda p, x: f"[[percentile({x}, {p})::quantile_cont({x}, {p})]]"

QUERIES: dict[str, str] = {}
QUERIES["tick_sign"] = f"SELECT symbol, event_id, CAST(side AS int) AS side FROM ({SIGNED}) q"
QUERIES["trade_agg_minute"] = f"""
SELECT symbol, t, sum(CASE WHEN side > 0 THEN size ELSE 0 END) AS buy_volume, sum(CASE WHEN side < 0 THEN size ELSE 0 END) AS sell_volume, sum(side * size) AS signed_volume,
  CAST(sum(CASE WHEN size >= {LARGE} THEN 1 ELSE 0 END) AS bigint) AS large_prints, {r("count(*) / 60.0")} AS intensity, {r(PCT(0.5, "size"))} AS median_size, {r(PCT(0.95, "size"))} AS p95_size, count(*) AS n
FROM ({SIGNED}) q GROUP BY symbol, t"""
QUERIES["quote_agg_minute"] = f"SELECT symbol, t, {', '.join(r(c) + f' AS {c}' for c in ('mean_spread_bps', 'quote_imbalance', 'mean_bid_size', 'mean_ask_size', 'n_quotes'))} FROM ({QUOTE_BARS}) q"
QUERIES["bucket_minute"] = f"SELECT symbol, event_id, CAST(floor(us / 60000000) AS bigint) AS minute FROM ({TRADES}) q"
QUERIES["tick_run_features"] = f"""
WITH s AS (SELECT *, coalesce(sign(price - lag(price) OVER ({W})), 0) AS sg FROM ({SIGNED}) a),
m AS (SELECT *, CASE WHEN sg <> 0 AND (lag(sg) OVER ({W}) IS NULL OR lag(sg) OVER ({W}) <> sg) THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT *, sum(new) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m),
c AS (SELECT symbol, t, run, sum(CASE WHEN sg <> 0 THEN 1 ELSE 0 END) AS n, sum(sg * size) AS v, max(new) AS starts FROM i GROUP BY symbol, t, run)
SELECT symbol, t, CAST(max(n) AS bigint) AS max_signed_run_1m, CAST(sum(starts) AS bigint) AS signed_run_count_1m, sum(v) AS tick_signed_volume_1m FROM c GROUP BY symbol, t"""
FANO = "CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN var_samp(gap / 1e6) / avg(gap / 1e6) END"
HHI = "sum(price * size * price * size) / nullif(sum(price * size) * sum(price * size), 0)"
QUERIES["tick_minute_primitives"] = f"SELECT symbol, t, {r(FANO, 4)} AS gap_fano, {r(HHI)} AS notional_hhi, {', '.join(f'CAST(sum(CASE WHEN {BIN} = {k} THEN 1 ELSE 0 END) AS bigint) AS size_bin_{k}' for k in range(6))} FROM ({GAPS}) q GROUP BY symbol, t"
QUERIES["microstructure_burst"] = f"""
WITH g AS ({GAPS}), s AS (SELECT symbol, t, slot, count(*) AS n FROM g GROUP BY symbol, t, slot), p AS (SELECT symbol, t, max(n) AS peak, count(*) AS active FROM s GROUP BY symbol, t)
SELECT g.symbol, g.t, max(peak) AS peak_trades_per_second_1m, max(active) AS active_seconds_1m, {r("CASE WHEN count(gap) >= 2 THEN stddev_samp(gap / 1e6) / nullif(avg(gap / 1e6), 0) END")} AS inter_arrival_cv_1m, {r("max(price - low_so_far)")} AS max_runup_1m
FROM g JOIN p ON g.symbol = p.symbol AND g.t = p.t GROUP BY g.symbol, g.t"""
QUERIES["inter_arrival"] = f"""
WITH g AS ({GAPS}), s AS (SELECT symbol, t, slot, count(*) AS n FROM g GROUP BY symbol, t, slot),
e AS (SELECT symbol, t, CASE WHEN count(*) <= 1 THEN 0 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(CASE WHEN count(*) > 1 THEN count(*) ELSE 2 END) END AS h FROM s GROUP BY symbol, t)
SELECT g.symbol, g.t, {r("avg(CASE WHEN gap IS NULL THEN NULL WHEN gap < 600000000 THEN 1.0 ELSE 0.0 END)")} AS rapid_fire_ratio_1m, {r(PCT(0.1, "gap / 1000.0"), 3)} AS p10_inter_arrival_ms_1m, {r("max(h)")} AS trade_timing_entropy_1m
FROM g JOIN e ON g.symbol = e.symbol AND g.t = e.t GROUP BY g.symbol, g.t"""
big = f"size >= {TIMES} * mean_size"
QUERIES["large_print_burst"] = f"SELECT symbol, t, {r(f'avg(CASE WHEN {big} THEN 1.0 ELSE 0.0 END)')} AS large_print_ratio_1m, {r(f'sum(CASE WHEN {big} THEN size ELSE 0.0 END) / nullif(sum(size), 0)')} AS large_print_volume_share_1m, {r('max(size) / nullif(avg(size), 0)')} AS max_print_size_ratio_1m FROM ({GAPS}) q GROUP BY symbol, t"
QUERIES["trade_size_dist"] = f"SELECT symbol, t, {r(f'avg(CASE WHEN size < {ROUND} THEN 1.0 ELSE 0.0 END)')} AS odd_lot_ratio_1m, {r(f'avg(CASE WHEN size > 0 AND size % {ROUND} = 0 THEN 1.0 ELSE 0.0 END)')} AS round_lot_ratio_1m, {r(f'avg(CASE WHEN size >= {LARGE} THEN 1.0 ELSE 0.0 END)')} AS institutional_trade_ratio_1m FROM ({TRADES}) q0 JOIN (SELECT event_id AS e, t FROM ({SIGNED}) q1) q2 ON event_id = e GROUP BY symbol, t"
over = lambda f, x, w: f"{f}({x}) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
MINUTE = f"SELECT symbol, t, {FANO} AS fano, {HHI} AS hhi, {', '.join(f'CAST(sum(CASE WHEN {BIN} = {k} THEN 1 ELSE 0 END) AS double) AS b{k}' for k in range(6))} FROM ({GAPS}) q GROUP BY symbol, t"
QUERIES["print_hhi"] = f"SELECT symbol, t, {r(over('avg', 'hhi', 30))} AS print_hhi_30m, {r(over('avg', 'hhi', 60))} AS print_hhi_60m FROM ({MINUTE}) m"
QUERIES["subminute_gap_fano"] = f"SELECT symbol, t, {r(over('avg', 'fano', 60), 3)} AS subminute_gap_fano_60m FROM ({MINUTE}) m"
ent = lambda w: f"CASE WHEN n{w} > 0 THEN ln(n{w}) - ({' + '.join(f'CASE WHEN s{k}_{w} > 0 THEN s{k}_{w} * ln(s{k}_{w}) ELSE 0 END' for k in range(6))}) / n{w} END"
QUERIES["size_entropy"] = f"""
WITH m AS ({MINUTE}), s AS (SELECT symbol, t, {', '.join(over('sum', f'b{k}', w) + f' AS s{k}_{w}' for w in (30, 60) for k in range(6))} FROM m),
n AS (SELECT *, {', '.join('(' + ' + '.join(f's{k}_{w}' for k in range(6)) + f') AS n{w}' for w in (30, 60))} FROM s)
SELECT symbol, t, {r(ent(30))} AS size_entropy_30m, {r(ent(60))} AS size_entropy_60m FROM n"""
#: As of the last quote at or before each trade: one sort of the union instead of a range join.
ASOF = """
WITH u AS (SELECT symbol, t, 0 AS kind, quote_id AS id, (bid + ask) / 2 AS mid, CAST(NULL AS double) AS price FROM ({q}) a
  UNION ALL SELECT symbol, t, 1 AS kind, quote_id AS id, CAST(NULL AS double) AS mid, ask AS price FROM ({q}) b WHERE quote_id % 3 = 0)
SELECT *, [[last(mid, true)::last_value(mid IGNORE NULLS)]] OVER (PARTITION BY symbol ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM u
""".format(q=QUOTES)
QUERIES["asof_backward"] = f"SELECT symbol, t, id, {r('held', 4)} AS mid FROM ({ASOF}) q WHERE kind = 1"
QUERIES["lee_ready_sign"] = f"SELECT symbol, t, id, CAST(sign(price - held) AS int) AS side FROM ({ASOF}) q WHERE kind = 1"


def half_spread_at(entries: str, quotes: str, window_us: int = 300_000_000, least: int = 5) -> str:
    """Dwell-weighted relative half spread (bps) of the valid quotes in [entry - window, entry); the last one stands until the entry.

    entries: symbol, us. Null with fewer than `least` valid quotes. Spark cuts time into blocks as long as the window: what a
    window holds is the end of one block and the beginning of the next, both running sums. No range join, no sliding frame.
    """
    over = f"OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {window_us} PRECEDING AND 1 PRECEDING)"
    last = lambda x: f"[[max_by({x}, CASE WHEN kind = 0 THEN struct(us, id) END)::arg_max({x}, CASE WHEN kind = 0 THEN (us, id) END)]] {over}"
    valid = f"WITH v AS (SELECT symbol, us, quote_id AS id, (ask - bid) / ((ask + bid) / 2) * 5000 AS half, coalesce(lead(us) OVER (PARTITION BY symbol ORDER BY us, quote_id) - us, 0) / 1e6 AS dwell FROM ({quotes}) q WHERE bid > 0 AND ask > bid AND bid_size > 0 AND ask_size > 0),"
    out = f"SELECT symbol, us, {r('CASE WHEN n >= ' + str(least) + ' THEN CASE WHEN sw <= 1e-9 THEN plain ELSE hw / sw END END', 4)} AS half_spread_bps FROM z"
    sliding = f"""
{valid}
u AS (SELECT symbol, us, 0 AS kind, id, half, dwell, us / 1e6 AS sec FROM v UNION ALL SELECT symbol, us, 1 AS kind, CAST(0 AS bigint) AS id, CAST(NULL AS double) AS half, CAST(NULL AS double) AS dwell, CAST(NULL AS double) AS sec FROM ({entries}) e),
w AS (SELECT symbol, us, kind, sum(half * dwell) {over} AS hw, sum(dwell) {over} AS sw, avg(half) {over} AS plain, count(half) {over} AS n, {last('half')} AS last_half, {last('dwell')} AS last_dwell, us / 1e6 - {last('sec')} AS stood FROM u),
z AS (SELECT symbol, us, n, plain, hw - last_half * last_dwell + last_half * stood AS hw, sw - last_dwell + stood AS sw FROM w WHERE kind = 1)
{out}"""
    head, tail = (f"OVER (PARTITION BY symbol, block ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for order in ("us, kind, id", "us DESC, kind, id DESC"))
    # entries ask twice: at the entry for the block's quotes before it (-1), a window earlier for the quotes from there on (1)
    part = lambda x: f"CASE WHEN kind < 0 THEN {x} {head} ELSE {x} {tail} END"
    newest = lambda x: f"CASE WHEN kind < 0 THEN last({x}, true) {head} ELSE first({x}, true) {tail} END"
    later = lambda x: f"coalesce(max(CASE WHEN kind < 0 THEN {x} END), max(CASE WHEN kind > 0 THEN {x} END))"
    blocks = f"""
{valid}
e AS (SELECT symbol, us AS entry, count(*) AS copies FROM ({entries}) e0 GROUP BY symbol, us),
a AS (SELECT symbol, CASE WHEN kind < 0 THEN entry ELSE entry - {window_us} END AS us, kind, entry, copies FROM e LATERAL VIEW explode(array(-1, 1)) x AS kind),
u AS (SELECT *, us - pmod(us, {window_us}) AS block FROM (SELECT symbol, us, 0 AS kind, id, half, dwell, us / 1e6 AS sec, CAST(NULL AS bigint) AS entry, CAST(NULL AS bigint) AS copies FROM v UNION ALL SELECT symbol, us, kind, CAST(NULL AS bigint), CAST(NULL AS double), CAST(NULL AS double), CAST(NULL AS double), entry, copies FROM a) u0),
p AS (SELECT symbol, entry, copies, kind, {part('sum(half * dwell)')} AS hw, {part('sum(dwell)')} AS sw, {part('sum(half)')} AS halves, {part('count(half)')} AS n, {newest('half')} AS last_half, {newest('dwell')} AS last_dwell, {newest('sec')} AS last_sec FROM u),
w AS (SELECT symbol, entry AS us, copies, sum(hw) AS hw, sum(sw) AS sw, sum(halves) / nullif(sum(n), 0) AS plain, sum(n) AS n, {later('last_half')} AS last_half, {later('last_dwell')} AS last_dwell, entry / 1e6 - {later('last_sec')} AS stood FROM p WHERE kind <> 0 GROUP BY symbol, entry, copies),
z AS (SELECT symbol, us, n, plain, hw - last_half * last_dwell + last_half * stood AS hw, sw - last_dwell + stood AS sw FROM w LATERAL VIEW explode(array_repeat(0, CAST(copies AS int))) x AS one)
{out}"""
    return either(blocks, sliding)


#: The tape here has some prints an hour and symbol, so a day stands for the minutes of the default.
QUERIES["realized_half_spread"] = half_spread_at(f"SELECT symbol, t * 3600000000 AS us FROM ({BARS}) b", TAPE_QUOTES, window_us=86_400_000_000)
QUERIES["spread_headroom"] = f"SELECT symbol, {r(PCT(0.5, 'spread'), 4)} AS median_spread_bps, {r(PCT(0.5, 'bid_size + ask_size'), 4)} AS median_size FROM (SELECT symbol, bid_size, ask_size, (ask - bid) / ((ask + bid) / 2) * 10000 AS spread FROM ({QUOTES}) q0) q WHERE spread <= 1500 GROUP BY symbol"
QUERIES["minute_agg_enrich"] = f"""
SELECT b.symbol, b.t, b.n_trades, q.spread IS NOT NULL AS has_quotes, {r("coalesce(q.spread, 0)")} AS mean_spread_bps, {r("coalesce(q.imbalance, 0)")} AS quote_imbalance
FROM ({BARS}) b LEFT JOIN (SELECT symbol, t, avg(CASE WHEN bid + ask > 0 AND ask >= bid THEN (ask - bid) / ((ask + bid) / 2) * 10000 END) AS spread, avg(CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END) AS imbalance
  FROM ({TAPE_QUOTES}) z GROUP BY symbol, t) q ON b.symbol = q.symbol AND b.t = q.t"""
