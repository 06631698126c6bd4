"""Coverage reports: depth and breadth of raw tiers, one cell's symbols, the grid with trust, timelines, daily slippage.

Each report reduces its rows to cells of symbol and day first; all that is joined later has a row a day, source or group.
"""

from __future__ import annotations

from ..sources.frames import BARS, DAILY, TAPE_QUOTES, TRADES
from .quality import BACK, DAYS, FILLS, PCT, STREAM, cnt, r

HOURS, MICROS = "CAST(floor(t / 24) AS bigint)", "CAST(floor(us / 86400000000) AS bigint)"


def raw_coverage(tiers: dict[str, str], window: int) -> str:
    """Symbols and rows of each tier and day in the window, beside the depth and breadth of the tier's whole tape.

    `tiers` gives each tier's manifest: symbol, day, n. A cell counts with the most rows recorded for it, if any.
    """
    manifest = " UNION ALL ".join(f"SELECT '{tier}' AS tier, symbol, day, n FROM ({sql}) m_{tier}" for tier, sql in tiers.items())
    return f"""
WITH c AS (SELECT tier, symbol, day, max(n) AS n FROM ({manifest}) m GROUP BY tier, symbol, day HAVING max(n) > 0),
d AS (SELECT tier, day, count(*) AS n_symbols, CAST(sum(n) AS bigint) AS n_rows FROM c GROUP BY tier, day),
k AS (SELECT tier, count(DISTINCT symbol) AS tier_symbols, count(*) AS n_cells FROM c GROUP BY tier),
s AS (SELECT tier, min(day) AS earliest, max(day) AS latest, count(*) AS n_dates, avg(n_symbols) AS mean_symbols, {PCT(0.5, 'n_symbols')} AS median_symbols,
  [[max_by(n_symbols, day)::arg_max(n_symbols, day)]] AS newest_symbols FROM d GROUP BY tier)
SELECT d.tier, d.day, d.n_symbols, d.n_rows, earliest, latest, latest - earliest + 1 AS span_days, n_dates, tier_symbols, n_cells,
  {r('mean_symbols', 1)} AS mean_symbols, {r('median_symbols', 1)} AS median_symbols, newest_symbols
FROM d JOIN s ON d.tier = s.tier JOIN k ON d.tier = k.tier WHERE d.day > latest - {window}"""


def cell_drill(stream: str, backfill: str, day: int, universe: int) -> str:
    """The symbols present in one group's day, each with the source that has it, and the cell's counts by source."""
    one = lambda source, sql: f"SELECT DISTINCT symbol, '{source}' AS source FROM ({sql}) x_{source} WHERE t >= {day * 24} AND t < {day * 24 + 24}"
    return f"""
WITH p AS (SELECT symbol, count(CASE WHEN source = 'stream' THEN 1 END) AS s, count(CASE WHEN source = 'backfill' THEN 1 END) AS b FROM ({one('stream', stream)} UNION ALL {one('backfill', backfill)}) u GROUP BY symbol),
n AS (SELECT count(*) AS n_symbols, {cnt('s = 1 AND b = 1', 'n_both')}, {cnt('b = 0', 'n_stream_only')}, {cnt('s = 0', 'n_backfill_only')} FROM p)
SELECT symbol, CASE WHEN s = 1 THEN 'stream' ELSE 'backfill' END AS source, n_symbols, {r(f'100.0 * n_symbols / {universe}', 1)} AS coverage_pct, n_both, n_stream_only, n_backfill_only FROM p CROSS JOIN n"""


def feature_grid(stream: str, backfill: str, groups: dict[str, list[str]], periods: tuple[int, ...]) -> str:
    """Coverage of each source over each period that ends at the newest day, beside the trust of each group's features.

    Expected are the busiest day's symbols on every day of the period. A group shows its worst state first: divergent, then
    validated where any feature is, pending, ungraded.
    """
    members = " UNION ALL ".join(f"SELECT '{g}' AS grp, '{f}' AS feature" for g, fs in groups.items() for f in fs)
    per_day = " UNION ALL ".join(f"SELECT '{source}' AS source, {HOURS} AS day, count(DISTINCT symbol) AS n FROM ({sql}) y_{source} GROUP BY {HOURS}" for source, sql in (("stream", stream), ("backfill", backfill)))
    return f"""
{DAYS}, a AS (SELECT feature, sum(matched) * 1.0 / sum(compared) AS rate, count(*) AS days FROM d WHERE compared > 0 GROUP BY feature),
l AS (SELECT feature, CASE WHEN days < 5 THEN 'PENDING' WHEN rate >= 0.99 THEN 'VALIDATED' WHEN rate >= 0.5 THEN 'DIVERGENT' ELSE 'RETIRED' END AS state FROM a),
u AS (SELECT grp, count(*) AS n_features, {cnt("state = 'VALIDATED'", 'n_trusted')}, {cnt("state = 'PENDING'", 'n_validating')}, {cnt("state = 'DIVERGENT'", 'n_divergent')} FROM ({members}) g LEFT JOIN l ON g.feature = l.feature GROUP BY grp),
p AS ({per_day}), z AS (SELECT max(day) AS anchor FROM p),
w AS (SELECT source, period, count(*) AS n_dates, CAST(sum(n) AS bigint) AS symbol_days, max(n) * greatest(period, count(*)) AS expected
  FROM p CROSS JOIN z CROSS JOIN ({' UNION ALL '.join(f'SELECT CAST({k} AS bigint) AS period' for k in periods)}) q WHERE day > anchor - period GROUP BY source, period)
SELECT grp, source, period, n_dates, symbol_days, CAST(expected AS bigint) AS expected, {r('100.0 * symbol_days / expected', 1)} AS coverage_pct,
  CASE WHEN n_divergent > 0 THEN 'DIVERGENT' WHEN n_trusted > 0 THEN 'VALIDATED' WHEN n_validating > 0 THEN 'PENDING' ELSE 'UNGRADED' END AS state, {r('100.0 * n_trusted / n_features', 1)} AS trusted_pct
FROM w CROSS JOIN u"""


#: Share of its own busiest day at which a stream counts as dropped or thinning; fixed values.
SEVERE, THINNING = 0.4, 0.6


def coverage_timeline(stream: str, backfill: str, span: int, least: int = 100) -> str:
    """Each of the last `span` days with its symbols by source and provenance, and whether the stream's newest day fell off.

    The newest day with stream symbols is held against the span's busiest; spans whose busiest day has fewer than `least` pass.
    """
    per_day = lambda sql, n: f"SELECT {HOURS} AS day, count(DISTINCT symbol) AS {n} FROM ({sql}) x_{n} GROUP BY {HOURS}"
    return f"""
WITH s AS ({per_day(stream, 'ns')}), b AS ({per_day(backfill, 'nb')}),
m AS (SELECT coalesce(s.day, b.day) AS day, coalesce(ns, 0) AS ns, coalesce(nb, 0) AS nb FROM s FULL OUTER JOIN b ON s.day = b.day),
a AS (SELECT max(day) AS anchor FROM m), g AS (SELECT anchor - i AS day FROM (SELECT anchor, [[explode(sequence(0, {span - 1}))::unnest(range(0, {span}))]] AS i FROM a) x),
j AS (SELECT g.day, coalesce(ns, 0) AS n_stream, coalesce(nb, 0) AS n_backfill FROM g LEFT JOIN m ON g.day = m.day),
v AS (SELECT max(n_stream) AS baseline, [[max_by(n_stream, day) FILTER (WHERE n_stream > 0)::arg_max(n_stream, day) FILTER (WHERE n_stream > 0)]] AS recent FROM j)
SELECT CAST(day AS bigint) AS day, n_stream, n_backfill, CASE WHEN n_stream > 0 AND n_backfill > 0 THEN 'both' WHEN n_stream > 0 THEN 'stream_only' WHEN n_backfill > 0 THEN 'backfill_only' ELSE 'absent' END AS provenance,
  baseline, coalesce(recent, 0) AS recent, {r('recent * 1.0 / nullif(baseline, 0)', 3)} AS ratio,
  CASE WHEN recent IS NULL THEN 'no_stream' WHEN baseline < {least} THEN 'ok' WHEN recent <= {SEVERE} * baseline THEN 'drop' WHEN recent <= {THINNING} * baseline THEN 'thinning' ELSE 'ok' END AS status
FROM j CROSS JOIN v"""


def orderflow_trend(groups: dict[str, str], span: int) -> str:
    """Symbols a day in any and in all of the groups that have some that day, and how the union changed over the span.

    `groups` gives each group's rows: symbol, day.
    """
    rows = " UNION ALL ".join(f"SELECT DISTINCT day, symbol, '{g}' AS grp FROM ({sql}) g_{g}" for g, sql in groups.items())
    return f"""
WITH m AS ({rows}), k AS (SELECT day, symbol, count(*) AS n FROM m GROUP BY day, symbol), l AS (SELECT day, count(DISTINCT grp) AS live FROM m GROUP BY day),
t AS (SELECT k.day, count(*) AS n_union, {cnt('n = live', 'n_intersection')}, max(live) AS n_live_groups FROM k JOIN l ON k.day = l.day GROUP BY k.day),
a AS (SELECT max(day) AS anchor FROM t), w AS (SELECT t.* FROM t CROSS JOIN a WHERE day > anchor - {span}),
e AS (SELECT [[max_by(n_union, day)::arg_max(n_union, day)]] - [[min_by(n_union, day)::arg_min(n_union, day)]] AS union_delta FROM w)
SELECT day, n_union, n_intersection, n_live_groups, union_delta FROM w CROSS JOIN e"""


QUERIES: dict[str, str] = {}
_tape = lambda sql: f"SELECT symbol, {MICROS} AS day, count(*) AS n FROM ({sql}) x GROUP BY symbol, {MICROS}"
#: Some fetches came back empty, on days with and without a tape.
_EMPTY = f"SELECT DISTINCT symbol, {MICROS} + CASE WHEN symbol LIKE 'view%' THEN 40 ELSE 0 END AS day, CAST(0 AS bigint) AS n FROM ({TAPE_QUOTES}) e"
QUERIES["raw_coverage"] = raw_coverage({"bars": f"SELECT symbol, {HOURS} AS day, count(*) AS n FROM ({BARS}) x GROUP BY symbol, {HOURS}", "trades": _tape(TRADES), "quotes": f"{_tape(TAPE_QUOTES)} UNION ALL {_EMPTY}"}, window=14)
#: Days on which a source is missing as a whole.
_S, _B = f"SELECT * FROM ({STREAM}) s0 WHERE {HOURS} % 6 <> 0", f"SELECT * FROM ({BACK}) b0 WHERE {HOURS} % 4 <> 0"
QUERIES["cell_drill"] = cell_drill(f"SELECT * FROM ({STREAM}) s0 WHERE symbol NOT LIKE 'view%'", f"SELECT * FROM ({BACK}) b0 WHERE symbol NOT LIKE 'click%'", day=19730, universe=20)
QUERIES["feature_grid"] = feature_grid(_S, _B, {"price": ["close"], "flow": ["volume"], "bars": ["close", "volume", "vwap"]}, (7, 30))
QUERIES["coverage_timeline"] = coverage_timeline(_S, _B, span=14, least=5)
QUERIES["orderflow_trend"] = orderflow_trend({"tape": f"SELECT symbol, {MICROS} AS day FROM ({TRADES}) x WHERE size > 20", "prints": f"SELECT symbol, {MICROS} AS day FROM ({TRADES}) x WHERE size > 95", "quotes": f"SELECT symbol, {MICROS} AS day FROM ({TAPE_QUOTES}) x WHERE ask > bid AND {MICROS} % 5 <> 0"}, span=20)
#: A third of the orders carry a mid of their own; the others are held against the last close before their day.
_MID = "CASE WHEN id % 3 = 0 THEN price * (1 + 0.0001 * (id % 7 - 3)) ELSE held END"
QUERIES["execution_slippage_daily"] = f"""
WITH u AS (SELECT symbol, t, 1 AS kind, o_orderkey AS id, side, price, CAST(NULL AS double) AS ref FROM ({FILLS}) f UNION ALL SELECT symbol, t + 1, 0, 0, 0, CAST(NULL AS double), close FROM ({DAILY}) d),
a AS (SELECT *, [[last(ref, true)::last_value(ref IGNORE NULLS)]] OVER (PARTITION BY symbol ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM u),
m AS (SELECT t AS day, side, price, 1 + id % 5 AS qty, {_MID} AS mid FROM a WHERE kind = 1),
x AS (SELECT day, qty * price AS gross, {r('side * (price - mid) / nullif(mid, 0) * 10000', 2)} AS bps, {r('side * (price - mid) * qty', 2)} AS usd FROM m)
SELECT day, count(*) AS n_legs, {r('avg(bps)', 2)} AS oneway_cost_bps_mean, {r(PCT(0.5, 'bps'), 2)} AS oneway_cost_bps_median, {r('sum(usd)', 2)} AS slippage_usd_total, {r('sum(gross)', 2)} AS gross_traded_usd FROM x GROUP BY day"""
