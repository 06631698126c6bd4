"""Parity, trust and data-quality analytics, ledgers and coverage reports."""

from __future__ import annotations

from ..plans.dialect import either
from ..sources.frames import BARS, DAILY, FILINGS, NEWS, SIGNED, TRADES

N = 1.7e-10
r = lambda e, d=6: f"round(CAST({e} AS double) + {N}, {d})"
PCT = lambda p, x: f"[[percentile({x}, {p})::quantile_cont({x}, {p})]]"
#: A live copy of the bars with planted differences: rows missing, rows only live, values off.
TOLERANCE = 1e-6
BACK = f"SELECT symbol, t, close, volume FROM ({BARS}) b WHERE (t * 7 + cluster_id) % 29 <> 0"
STREAM = f"SELECT symbol, t, CASE WHEN (t + cluster_id) % 17 = 0 THEN close * 1.01 ELSE close END AS close, volume FROM ({BARS}) b WHERE (t * 5 + cluster_id) % 23 <> 0"
CELLS = "".join(["SELECT symbol, t, 'close' AS feature, live, back FROM j UNION ALL SELECT symbol, t, 'volume' AS feature, live_v AS live, back_v AS back FROM j"])
VERDICT = f"CASE WHEN live IS NULL AND back IS NULL THEN 'uncompared' WHEN back IS NULL THEN 'extra_live' WHEN live IS NULL THEN 'missing_live' WHEN abs(live - back) <= 1e-12 + {TOLERANCE} * abs(back) THEN 'match' ELSE 'mismatch' END"
JOINED = f"WITH s AS ({STREAM}), k AS ({BACK}), j AS (SELECT coalesce(s.symbol, k.symbol) AS symbol, coalesce(s.t, k.t) AS t, s.close AS live, k.close AS back, s.volume AS live_v, k.volume AS back_v FROM s FULL OUTER JOIN k ON s.symbol = k.symbol AND s.t = k.t), c AS ({CELLS}), v AS (SELECT *, {VERDICT} AS verdict FROM c)"
cnt = lambda c, n: f"count(CASE WHEN {c} THEN 1 END) AS {n}"

QUERIES: dict[str, str] = {}
QUERIES["cell_verdict"] = f"{JOINED} SELECT symbol, t, feature, verdict FROM v"
QUERIES["parity_diff"] = f"{JOINED}, a AS (SELECT feature, CAST(ascii(substr(symbol, 1, 1)) % 3 AS int) AS tier, {cnt('''verdict IN ('match', 'mismatch')''', 'compared')}, {cnt('''verdict = 'match' ''', 'matched')}, count(*) AS n FROM v GROUP BY feature, CAST(ascii(substr(symbol, 1, 1)) % 3 AS int)) SELECT feature, tier, compared, {r('compared * 1.0 / n')} AS coverage, {r('CASE WHEN compared >= 1000 THEN matched * 1.0 / compared END')} AS score, compared * 1.0 / n >= 0.95 AND matched * 1.0 / nullif(compared, 0) >= 0.95 AS passed FROM a"
QS = (0.05, 0.25, 0.5, 0.75, 0.95)
QUERIES["dist_score"] = f"{JOINED}, q AS (SELECT feature, {', '.join(f'{PCT(p, x)} AS {x}{k}' for k, p in enumerate(QS) for x in ('live', 'back'))}, avg(CASE WHEN live IS NULL OR back IS NULL THEN NULL WHEN abs(live - back) <= 0.03 * abs(back) THEN 1.0 ELSE 0.0 END) AS paired FROM v GROUP BY feature) SELECT feature, {r('greatest(' + ', '.join(f'abs(live{k} - back{k}) / nullif(abs(back{k}), 0)' for k in range(5)) + ')')} AS worst, {r('paired')} AS paired FROM q"
QUERIES["coverage_by_hour"] = f"WITH s AS ({STREAM}), k AS ({BACK}) SELECT CAST(k.t % 24 AS int) AS hour, count(*) AS missing_live FROM k LEFT JOIN s ON s.symbol = k.symbol AND s.t = k.t WHERE s.t IS NULL GROUP BY CAST(k.t % 24 AS int)"
QUERIES["cell_rollup"] = f"{JOINED} SELECT feature, symbol, {', '.join(cnt(f'verdict = {x!r}', f'n_{x}') for x in ('match', 'mismatch', 'extra_live', 'missing_live'))} FROM v GROUP BY feature, symbol"
DAYS = f"{JOINED}, d AS (SELECT feature, CAST(floor(t / 24) AS bigint) AS day, {cnt('''verdict IN ('match', 'mismatch')''', 'compared')}, {cnt('''verdict = 'match' ''', 'matched')} FROM v GROUP BY feature, CAST(floor(t / 24) AS bigint))"
QUERIES["feature_day"] = f"{DAYS} SELECT feature, day, compared, matched, {r('matched * 1.0 / nullif(compared, 0)')} AS rate FROM d"
QUERIES["recompute_trust"] = f"{DAYS}, a AS (SELECT feature, sum(compared) AS compared, sum(matched) AS matched, count(*) AS days, [[max_by(matched * 1.0 / compared, day)::arg_max(matched * 1.0 / compared, day)]] AS last_rate FROM d WHERE compared > 0 GROUP BY feature) SELECT feature, CAST(compared AS bigint) AS compared, days, {r('matched * 1.0 / compared')} AS rate, {r('last_rate')} AS last_rate, CASE WHEN days < 5 THEN 'new' WHEN matched * 1.0 / compared >= 0.9999 THEN 'A' WHEN matched * 1.0 / compared >= 0.999 THEN 'B' WHEN matched * 1.0 / compared >= 0.99 THEN 'C' WHEN matched * 1.0 / compared >= 0.95 THEN 'D' ELSE 'F' END AS grade FROM a"
QUERIES["symbol_day_clean"] = f"""
WITH g AS (SELECT DISTINCT symbol, CAST(floor(t / 24) AS bigint) AS day FROM ({BARS}) b), h AS (SELECT symbol, day, day * 24 + x.i AS t FROM g CROSS JOIN (SELECT DISTINCT t % 24 AS i FROM ({BARS}) c) x),
m AS (SELECT h.symbol, h.day, h.t, CASE WHEN s.t IS NULL THEN 1 ELSE 0 END AS miss FROM h LEFT JOIN ({STREAM}) s ON s.symbol = h.symbol AND s.t = h.t),
i AS (SELECT *, sum(1 - miss) OVER (PARTITION BY symbol, day ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m),
q AS (SELECT symbol, day, island, sum(miss) AS run, count(*) AS n FROM i GROUP BY symbol, day, island)
SELECT symbol, day, {r('1 - sum(run) * 1.0 / sum(n)')} AS coverage, CAST(max(run) AS bigint) AS longest_miss, max(run) <= 5 AND 1 - sum(run) * 1.0 / sum(n) >= 0.9 AS clean FROM q GROUP BY symbol, day"""
QUERIES["gather_coherence"] = f"SELECT {r('avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END)')} AS incoherent_share, count(*) AS hours FROM (SELECT t, count(DISTINCT round(mkt, 6)) AS n FROM (SELECT t, max(close) OVER (PARTITION BY t) + CASE WHEN t % 37 = 0 AND symbol LIKE '%-1' THEN 1 ELSE 0 END AS mkt FROM ({BARS}) b) z GROUP BY t) y"
QUERIES["lifecycle_state"] = f"{DAYS}, a AS (SELECT feature, sum(matched) * 1.0 / sum(compared) AS rate, count(*) AS days FROM d WHERE compared > 0 GROUP BY feature) SELECT feature, CASE WHEN days < 5 THEN 'PENDING' WHEN rate >= 0.99 THEN 'VALIDATED' WHEN rate >= 0.5 THEN 'DIVERGENT' ELSE 'RETIRED' END AS state FROM a"
QUERIES["earned_features"] = f"{DAYS}, a AS (SELECT feature, sum(matched) * 1.0 / sum(compared) AS rate FROM d WHERE compared > 0 GROUP BY feature), p AS (SELECT 'close' AS feature, 0.9 AS pass_rate UNION ALL SELECT 'volume', 0.99) SELECT a.feature, {r('rate')} AS rate FROM a JOIN p ON a.feature = p.feature AND rate >= pass_rate"
QUERIES["introspect"] = f"SELECT count(*) AS n, {r('avg(CASE WHEN vwap IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_share, {r('min(close)')} AS lo, {r(PCT(0.5, 'close'))} AS p50, {r('max(close)')} AS hi, count(DISTINCT close) AS n_distinct, max(close) = min(close) AS degenerate FROM ({BARS}) b"
QUERIES["contract_range_check"] = f"SELECT {cnt('close < low OR close > high', 'close_out')}, {cnt('volume < 0', 'volume_out')}, {cnt('abs(signed_volume) > volume', 'signed_out')} FROM ({BARS}) b"
QUERIES["feature_scan"] = f"SELECT feature, n, {r('missing * 1.0 / n')} AS nan_share, n_distinct <= 1 AS constant FROM (SELECT 'vwap' AS feature, count(*) AS n, {cnt('vwap IS NULL', 'missing')}, count(DISTINCT vwap) AS n_distinct FROM ({BARS}) a UNION ALL SELECT 'flag' AS feature, count(*) AS n, {cnt('high < low', 'missing')}, count(DISTINCT high < low) AS n_distinct FROM ({BARS}) b) z"
QUERIES["healthcheck"] = f"SELECT symbol, max(t) AS newest, count(DISTINCT CAST(floor(t / 24) AS bigint)) AS days, {r('avg(CASE WHEN signed_volume = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_rate FROM ({BARS}) b GROUP BY symbol"
rank_q = lambda q: f"max(CASE WHEN i = floor({q} * (n - 1) + 0.5) + 1 THEN lag_us END)"
QUERIES["news_lag"] = f"SELECT symbol, {rank_q(0.5)} AS p50, {rank_q(0.9)} AS p90, {rank_q(0.99)} AS p99 FROM (SELECT symbol, lag_us, row_number() OVER (PARTITION BY symbol ORDER BY lag_us) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, available_us - published_us AS lag_us FROM ({NEWS}) n0) n1) z GROUP BY symbol"
QUERIES["qa_extreme_jump"] = f"SELECT symbol, t, {r('ratio')} AS ratio FROM (SELECT symbol, t, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) AS ratio FROM ({DAILY}) d) z WHERE ratio > 3 OR ratio < 1 / 3.0"
QUERIES["qa_bars_integrity"] = f"SELECT {cnt('high < low', 'high_low')}, {cnt('open > high OR open < low', 'open_range')}, {cnt('close > high OR close < low', 'close_range')}, {cnt('volume < 0', 'negative_volume')}, {cnt('n_trades < 1', 'empty')}, {r('avg(CASE WHEN t % 24 BETWEEN 9 AND 15 THEN 0.0 ELSE 1.0 END)')} AS ext_share FROM ({BARS}) b"
QUERIES["qa_stream_backfill"] = f"{JOINED}, s2 AS (SELECT DISTINCT symbol FROM j WHERE symbol LIKE 'error%') SELECT {r('avg(CASE WHEN abs(live - back) > 1e-9 THEN 1.0 ELSE 0.0 END)')} AS mismatch_share, count(*) AS overlap FROM j WHERE live IS NOT NULL AND back IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.symbol = j.symbol)"
QUERIES["qa_nan_report"] = "SELECT pos, count(*) AS n, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS below FROM [[(SELECT posexplode(embedding) AS (pos, v) FROM embeddings)::(SELECT unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)]] z GROUP BY pos"
QUERIES["qa_label_median"] = f"SELECT {r('avg(m)')} AS avg_median, {r('max(m)')} AS max_median FROM (SELECT t, {PCT(0.5, 'close')} AS m FROM ({DAILY}) d GROUP BY t) z"
QUERIES["qa_pit_membership"] = f"SELECT b.symbol, count(*) AS orphans FROM ({BARS}) b LEFT JOIN (SELECT DISTINCT symbol, CAST(floor(t / 24) AS bigint) AS day FROM ({STREAM}) s WHERE t % 24 BETWEEN 3 AND 4) m ON m.symbol = b.symbol AND m.day = CAST(floor(b.t / 24) AS bigint) WHERE m.day IS NULL GROUP BY b.symbol"
FILLS = "SELECT o_orderkey, concat(c_mktsegment, '-', CAST(c_nationkey % 4 AS [[STRING::VARCHAR]])) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, o_totalprice AS price, [[unix_date(to_date(o_orderdate))::date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))]] AS t, o_orderstatus AS auction FROM orders JOIN customer ON o_custkey = c_custkey"
QUERIES["realized_pnl_by_name"] = f"SELECT t, symbol, {r('sum(-side * price)', 4)} AS cash_flow FROM ({FILLS}) f GROUP BY t, symbol"
QUERIES["execution_slippage"] = f"""
WITH u AS (SELECT symbol, t, 1 AS kind, o_orderkey AS id, side, price, CAST(NULL AS double) AS ref FROM ({FILLS}) f UNION ALL SELECT symbol, t + 1, 0, 0, 0, CAST(NULL AS double), close FROM ({DAILY}) d),
a AS (SELECT *, [[last(ref, true)::last_value(ref IGNORE NULLS)]] OVER (PARTITION BY symbol ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM u)
SELECT id, {r('side * (price - held) / nullif(held, 0) * 10000', 4)} AS bps FROM a WHERE kind = 1"""
QUERIES["slippage_by_auction"] = f"SELECT auction, count(*) AS n, {r('avg(side * price)', 4)} AS avg_usd FROM ({FILLS}) f GROUP BY auction"
QUERIES["open_exposure"] = f"SELECT symbol, {r('coalesce(sum(CASE WHEN auction = ' + chr(39) + 'O' + chr(39) + ' THEN side * price END), 0)', 3)} AS exposure FROM ({FILLS}) f GROUP BY symbol"
QUERIES["positions_from_ledger"] = f"SELECT symbol, sum(side) AS net, count(*) AS fills FROM ({FILLS}) f GROUP BY symbol HAVING sum(side) <> 0"
QUERIES["reconcile"] = f"WITH p AS (SELECT symbol, sum(side) AS net FROM ({FILLS}) f GROUP BY symbol), k AS (SELECT symbol, sum(side) + CASE WHEN symbol LIKE '%-2' THEN 1 ELSE 0 END AS broker FROM ({FILLS}) g WHERE symbol NOT LIKE 'MACH%' GROUP BY symbol) SELECT coalesce(p.symbol, k.symbol) AS symbol, coalesce(net, 0) - coalesce(broker, 0) AS drift FROM p FULL OUTER JOIN k ON p.symbol = k.symbol WHERE coalesce(net, 0) <> coalesce(broker, 0)"
QUERIES["pre_trade_check"] = f"SELECT o_orderkey, sum(price) OVER (PARTITION BY symbol ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 5000000 AS admitted FROM ({FILLS}) f"
QUERIES["corporate_actions_pit"] = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'forward_split' WHEN 'O' THEN 'reverse_split' ELSE 'cash_dividend' END AS action, " + r("(1 + o_custkey % 4) / (1.0 + o_orderkey % 3)") + " AS ratio, [[CAST(o_orderdate AS date)::CAST(o_orderdate AS DATE)]] < DATE '1998-01-01' AS known FROM orders"
QUERIES["recent_ex_date"] = "SELECT DISTINCT o_custkey AS symbol FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-02-01 00:00:00'"
QUERIES["seam_dedup"] = f"WITH f AS (SELECT symbol, form_type, CAST(floor(available_us / 86400000000) AS bigint) AS day, CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'backfill' END AS source, event_id FROM ({FILINGS}) z), b AS (SELECT symbol, form_type, day FROM f GROUP BY symbol, form_type, day HAVING count(DISTINCT source) = 2) SELECT f.event_id FROM f LEFT JOIN b ON f.symbol = b.symbol AND f.form_type = b.form_type AND f.day = b.day WHERE NOT (b.day IS NOT NULL AND f.source = 'backfill')"
QUERIES["coverage_minutes"] = f"SELECT symbol, CAST(floor(t / 24) AS bigint) AS day, count(DISTINCT t) AS have, {r('count(DISTINCT t) / 24.0')} AS share FROM ({BARS}) b GROUP BY symbol, CAST(floor(t / 24) AS bigint)"
QUERIES["cert_by_day"] = f"{DAYS} SELECT day, feature, matched, CAST(sum(matched) OVER (PARTITION BY feature ORDER BY day) AS bigint) AS running FROM d"
QUERIES["filing_rate"] = f"SELECT form_type, CAST(floor(available_us / 3600000000) AS bigint) AS hour, count(*) AS n FROM ({FILINGS}) f GROUP BY form_type, CAST(floor(available_us / 3600000000) AS bigint)"
QUERIES["under_represented"] = f"WITH b AS (SELECT symbol, count(*) AS n FROM ({BACK}) k GROUP BY symbol), s AS (SELECT symbol, count(*) AS m FROM ({STREAM}) x GROUP BY symbol) SELECT b.symbol, n - coalesce(m, 0) AS gap, row_number() OVER (ORDER BY n - coalesce(m, 0) DESC, b.symbol) AS pos FROM b LEFT JOIN s ON b.symbol = s.symbol"
QUERIES["source_holes"] = f"SELECT s.symbol, d.day FROM (SELECT DISTINCT symbol FROM ({BARS}) a) s CROSS JOIN (SELECT DISTINCT CAST(floor(t / 24) AS bigint) AS day FROM ({BARS}) b) d LEFT JOIN (SELECT DISTINCT symbol, CAST(floor(t / 24) AS bigint) AS day FROM ({BACK}) c WHERE t % 3 = 0) m ON m.symbol = s.symbol AND m.day = d.day WHERE m.day IS NULL"
QUERIES["store_grid"] = f"SELECT CAST(floor(t / 24) AS bigint) AS day, CAST(floor(255.0 * count(DISTINCT symbol) / 20) AS int) AS coverage, {r('count(DISTINCT CASE WHEN symbol LIKE ' + chr(39) + 'click%' + chr(39) + ' THEN symbol END) / 4.0')} AS click_share FROM ({STREAM}) s GROUP BY CAST(floor(t / 24) AS bigint)"
QUERIES["symbol_depth"] = f"SELECT symbol, count(DISTINCT CAST(floor(t / 24) AS bigint)) AS n_dates, min(t) AS earliest, max(t) AS latest, max(t) - min(t) AS span FROM ({BARS}) b GROUP BY symbol"
QUERIES["thin_live_symbols"] = f"SELECT symbol, {r('n / 720.0')} AS coverage FROM (SELECT symbol, count(*) AS n FROM ({STREAM}) s GROUP BY symbol) z ORDER BY n, symbol LIMIT 10"
QUERIES["stream_drop"] = f"SELECT day, n, {r('base')} AS base, n < 0.9 * base AS dropped FROM (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base FROM (SELECT CAST(floor(t / 24) AS bigint) AS day, count(*) AS n FROM ({STREAM}) s GROUP BY CAST(floor(t / 24) AS bigint)) a) z"
QUERIES["trust_frontier"] = f"{DAYS}, a AS (SELECT feature, sum(matched) * 1.0 / sum(compared) AS rate FROM d WHERE compared > 0 GROUP BY feature), o AS (SELECT feature, count(*) AS defects FROM v WHERE verdict = 'mismatch' GROUP BY feature) SELECT a.feature, coalesce(defects, 0) AS defects, CASE WHEN coalesce(defects, 0) = 0 THEN 'trusted' WHEN rate >= 0.9 THEN 'frontier' ELSE 'blocked' END AS state FROM a LEFT JOIN o ON a.feature = o.feature"
QUERIES["worker_queue_order"] = f"{DAYS}, a AS (SELECT feature, day, matched * 1.0 / nullif(compared, 0) AS rate FROM d) SELECT feature, day, row_number() OVER (ORDER BY CASE WHEN rate < 0.9 THEN 0 WHEN rate IS NULL THEN 3 WHEN rate < 0.99 THEN 1 ELSE 2 END, feature, day) AS pos FROM a"
QUERIES["supersede_candidates"] = "SELECT p_partkey AS id, p_size AS version FROM (SELECT *, max(CASE WHEN p_partkey % 3 = 0 THEN p_size END) OVER (PARTITION BY p_brand) AS trusted, max(p_size) OVER (PARTITION BY p_brand) AS newest FROM part) z WHERE p_size < trusted AND p_size < newest AND p_partkey % 3 <> 0"
QUERIES["random_recheck"] = f"{DAYS} SELECT feature, day, matched * 1.0 / compared < 0.95 AS failed FROM d WHERE compared > 0 AND (day * 31 + ascii(feature)) % 4 = 0"
QUERIES["settled_window_compare"] = f"{JOINED}, m AS (SELECT max(t) - 2 AS stop FROM j) SELECT feature, {cnt('''verdict = 'match' ''', 'matched')}, {cnt('''verdict = 'mismatch' ''', 'mismatched')} FROM v CROSS JOIN m WHERE t <= stop AND t > stop - 48 GROUP BY feature"
QUERIES["settle_lag"] = f"SELECT layer, top - last AS lag FROM (SELECT layer, last, max(last) OVER () AS top FROM (SELECT 'bars' AS layer, max(t) AS last FROM ({BACK}) b UNION ALL SELECT 'trades', max(t) FROM ({SIGNED}) s WHERE side > 0) a) z"
QUERIES["news_sentiment"] = f"""
WITH k AS (SELECT symbol, (t + 1) * 3600000000 AS us FROM ({BARS}) b), u AS (SELECT symbol, us, 1 AS kind, CAST(NULL AS double) AS s FROM k UNION ALL SELECT symbol, available_us, 0, CAST(sentiment AS double) FROM ({NEWS}) n),
w AS (SELECT *, {', '.join(f"{f}(s) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {h * 3600000000 - 1} PRECEDING AND CURRENT ROW) AS {f}{h}" for h in (1, 24, 168) for f in ('avg', 'sum', 'count'))}, [[last(s, true)::last_value(s IGNORE NULLS)]] OVER (PARTITION BY symbol ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, max(CASE WHEN kind = 0 THEN us END) OVER (PARTITION BY symbol ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_us FROM u)
SELECT symbol, us, {', '.join(f"{r(f'avg{h}')} AS news_sentiment_mean_{n}, {r(f'coalesce(sum{h}, 0)')} AS news_sentiment_sum_{n}, count{h} AS news_count_{n}" for h, n in ((1, '60m'), (24, '1d'), (168, '7d')))}, {r('held')} AS news_sentiment_last, {r('(us - seen_us) / 60000000.0', 4)} AS news_minutes_since_last FROM w WHERE kind = 1"""
day_us = 86400000000
FORMS = ("8-K", "10-Q", "10-K", "4")
EDGAR_SQL = f"""
WITH k AS (SELECT DISTINCT symbol, (CAST(floor(available_us / {day_us}) AS bigint) + 1) * {day_us} AS us FROM ({FILINGS}) f), u AS (SELECT symbol, us, 1 AS kind, CAST(NULL AS [[string::varchar]]) AS form FROM k UNION ALL SELECT symbol, available_us, 0, form_type FROM ({FILINGS}) g),
w AS (SELECT *, {', '.join(f"count(form) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {d * day_us - 1} PRECEDING AND CURRENT ROW) AS n{d}" for d in (7, 30, 90, 365))}, {', '.join(f"count(CASE WHEN form = '{f}' THEN 1 END) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {90 * day_us - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k, f in enumerate(FORMS))}, max(CASE WHEN kind = 0 THEN us END) OVER (PARTITION BY symbol ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_us, max(CASE WHEN form = '8-K' THEN us END) OVER (PARTITION BY symbol ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at8 FROM u)
"""
#: Rows are asked at whole days over windows of whole days, so filings are counted by symbol and day first; windows run over the days.
EDGAR_DAYS = f"""
WITH k AS (SELECT DISTINCT symbol, (CAST(floor(available_us / {day_us}) AS bigint) + 1) * {day_us} AS us FROM ({FILINGS}) f), f AS (SELECT *, available_us + pmod(-available_us, {day_us}) AS us FROM ({FILINGS}) f0),
u AS (SELECT symbol, us, 1 AS kind, {', '.join(f'CAST(NULL AS bigint) AS {x}' for x in ('m', 'm0', 'm1', 'm2', 'm3', 'newest', 'newest8'))} FROM k
  UNION ALL SELECT symbol, us, 0, count(form_type), {', '.join(f"count(CASE WHEN form_type = '{f}' THEN 1 END)" for f in FORMS)}, max(available_us), max(CASE WHEN form_type = '8-K' THEN available_us END) FROM f GROUP BY symbol, us),
w AS (SELECT *, {', '.join(f"coalesce(sum({m}) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {d * day_us - 1} PRECEDING AND CURRENT ROW), 0) AS {n}" for m, d, n in (*(('m', d, f'n{d}') for d in (7, 30, 90, 365)), *((f'm{k}', 90, f'c{k}') for k in range(4))))}, {', '.join(f"max({x}) OVER (PARTITION BY symbol ORDER BY us, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for x, n in (('newest', 'seen_us'), ('newest8', 'at8')))} FROM u)
"""
EDGAR = f"""SELECT symbol, us, n7 AS edgar_filing_count_7d, n30 AS edgar_filing_count_30d, n90 AS edgar_filing_count_90d, {', '.join(f'c{k} AS edgar_count_{n}_90d' for k, n in enumerate(('8k', '10q', '10k', '4')))}, {r('(us - seen_us) / 60000000.0', 4)} AS edgar_minutes_since_last_filing, {r('(us - at8) / 60000000.0', 4)} AS edgar_minutes_since_last_8k, {r('n7 / nullif(n365 * 7 / 365.0, 0)')} AS edgar_filing_burst FROM w WHERE kind = 1"""
QUERIES["edgar_filing_frequency"] = either(EDGAR_DAYS + EDGAR, EDGAR_SQL + EDGAR)
