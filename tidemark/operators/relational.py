"""Scans, projections, joins, aggregations, windows, top-k and set operations over the given tables."""

from __future__ import annotations

from ..sources.frames import BARS, DAILY, NEWS, QUOTES, TRADES

N = 1.7e-10
r = lambda e, d=6: f"round(CAST({e} AS double) + {N}, {d})"
PCT = lambda p, x: f"[[percentile({x}, {p})::quantile_cont({x}, {p})]]"
QUERIES: dict[str, str] = {}
# scans
QUERIES["scan_raw_bars"] = f"SELECT symbol, t, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume, n_trades FROM ({BARS}) b WHERE CAST(floor(t / 24) AS bigint) = 19730"
QUERIES["scan_raw_partition"] = f"SELECT event_id, us, {r('price')} AS price, size FROM ({TRADES}) q WHERE symbol = 'click-1' AND us >= 1704412800000000 AND us < 1704499200000000"
QUERIES["scan_news_range"] = f"SELECT symbol, event_id, available_us, {r('sentiment')} AS sentiment FROM ({NEWS}) n WHERE available_us BETWEEN 1704412800000000 AND 1705017600000000"
QUERIES["scan_sql_loaders"] = "SELECT n_name, r_name, count(c_custkey) AS customers, " + r("avg(c_acctbal)", 3) + " AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name"
QUERIES["distinct_stream_symbols"] = f"SELECT DISTINCT symbol FROM (SELECT symbol FROM ({BARS}) b WHERE t % 24 = 9 UNION SELECT symbol FROM ({TRADES}) q WHERE size > 50) z"
QUERIES["manifest_resume"] = "SELECT o_custkey AS symbol, CAST(floor(o_orderkey / 1000) AS bigint) AS day, max(o_orderkey % 7) AS row_count, CASE WHEN CAST(floor(o_orderkey / 1000) AS bigint) < 5 THEN TRUE ELSE max(o_orderkey % 7) > 0 END AS done FROM orders GROUP BY o_custkey, CAST(floor(o_orderkey / 1000) AS bigint)"
QUERIES["manifest_reconcile"] = "SELECT DISTINCT l_suppkey AS symbol FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000) m ON l_suppkey = s_suppkey WHERE s_suppkey IS NULL"
QUERIES["news_upsert_first_sight"] = "SELECT user_id AS id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) z WHERE k = 1"
QUERIES["compact_keep_last"] = "SELECT o_custkey, o_orderkey, " + r("o_totalprice", 2) + " AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) z WHERE k = 1"
QUERIES["retention_drop_before"] = "SELECT count(*) AS kept, min(o_orderkey) AS first_key FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'"
# projections and filters
QUERIES["scalar_functions"] = "SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in {"lg": "ln(1 + abs(value))", "l10": "CASE WHEN value > 0 THEN log10(value) END", "rt": "sqrt(abs(value))", "fl": "floor(value)", "sg": "sign(value - 50)", "ex": "exp(-abs(value) / 100)", "pw": "power(abs(value), 1.5)", "clipped": "greatest(10, least(90, value))"}.items()) + ", CASE WHEN value IS NOT NULL AND abs(value) < 1e300 THEN TRUE ELSE FALSE END AS finite FROM events"
QUERIES["forward_fill"] = f"SELECT symbol, event_id, {r('[[last(x, true)::last_value(x IGNORE NULLS)]] OVER (PARTITION BY symbol ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS filled FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN price END AS x FROM ({TRADES}) q) z"
QUERIES["significant_round"] = "SELECT o_orderkey, " + r("round(o_totalprice / power(10, floor(log10(o_totalprice)) - 1)) * power(10, floor(log10(o_totalprice)) - 1)", 3) + " AS two_figures FROM orders WHERE o_totalprice > 0"
QUERIES["etf_screen"] = "SELECT p_partkey, [[p_name RLIKE '(?i)green|blue|red'::regexp_matches(p_name, '(?i)green|blue|red')]] AS is_like, replace(lower(trim(p_type)), ' ', '_') AS normal FROM part"
QUERIES["row_index"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders"
# joins
QUERIES["join_inner"] = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"
QUERIES["join_left_broadcast"] = "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
QUERIES["join_full_coalesce"] = f"SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.t, b.t) AS t, {r('a.close')} AS live, {r('b.close')} AS back FROM (SELECT * FROM ({BARS}) x WHERE t % 5 <> 0) a FULL OUTER JOIN (SELECT * FROM ({BARS}) y WHERE t % 7 <> 0) b ON a.symbol = b.symbol AND a.t = b.t"
QUERIES["join_left_anti"] = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"
QUERIES["join_left_semi"] = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"
QUERIES["join_right"] = f"SELECT g.symbol, g.t, {r('b.close')} AS close FROM (SELECT symbol, t, close FROM ({BARS}) x WHERE t % 2 = 0) b RIGHT JOIN (SELECT DISTINCT symbol, t FROM ({BARS}) y) g ON b.symbol = g.symbol AND b.t = g.t"
QUERIES["minute_grid"] = f"SELECT symbol, day * 24 + h AS t FROM (SELECT DISTINCT symbol FROM ({TRADES}) q) s CROSS JOIN (SELECT DISTINCT CAST(floor(us / 86400000000) AS bigint) AS day FROM ({TRADES}) p) d CROSS JOIN (SELECT [[explode(sequence(9, 15))::unnest(range(9, 16))]] AS h) x"
QUERIES["join_exact_time_lag"] = f"SELECT a.symbol, a.t, {r('b.close')} AS lagged FROM ({BARS}) a LEFT JOIN ({BARS}) b ON a.symbol = b.symbol AND b.t = a.t - 3"
QUERIES["join_not_exists_range"] = "SELECT count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey AS k, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey) l WHERE l.k = o.o_orderkey AND l.last > o.o_orderdate + INTERVAL 60 DAYS)"
QUERIES["join_point_in_time"] = f"""
WITH u AS (SELECT symbol, t * 3600000000 AS us, 1 AS kind, t AS id FROM ({BARS}) b UNION ALL SELECT symbol, available_us, 0, event_id FROM ({NEWS}) n)
SELECT symbol, id AS t, n FROM (SELECT *, sum(1 - kind) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {86400000000 - 1} PRECEDING AND CURRENT ROW) AS n FROM u) z WHERE kind = 1"""
QUERIES["training_data"] = "SELECT d.doc_id, source, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
# aggregations
QUERIES["agg_grouped"] = f"SELECT symbol, count(*) AS n, {r('sum(price)', 3)} AS total, {r('avg(price)')} AS mean, min(event_id) AS lo, max(event_id) AS hi, [[min_by(event_id, struct(us, event_id))::arg_min(event_id, (us, event_id))]] AS first_id, [[max_by(event_id, struct(us, event_id))::arg_max(event_id, (us, event_id))]] AS last_id FROM ({TRADES}) q GROUP BY symbol"
QUERIES["agg_filtered"] = f"SELECT symbol, count(*) FILTER (WHERE size > 50) AS large, {r('sum(price) FILTER (WHERE size > 50)', 3)} AS large_value FROM ({TRADES}) q GROUP BY symbol"
QUERIES["agg_dispersion"] = f"SELECT symbol, {r('stddev_samp(price)')} AS sd1, {r('stddev_pop(price)')} AS sd0, {r('var_samp(price)', 4)} AS var1, {r(PCT(0.5, 'price'))} AS median, {r(PCT(0.95, 'price'))} AS p95 FROM ({TRADES}) q GROUP BY symbol"
QUERIES["agg_nearest_quantile"] = f"SELECT symbol, {r('max(CASE WHEN i = CAST(floor(0.25 * (n - 1) + 0.5) AS int) + 1 THEN price END)')} AS q25, {r('max(CASE WHEN i = CAST(floor(0.75 * (n - 1) + 0.5) AS int) + 1 THEN price END)')} AS q75 FROM (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY price) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({TRADES}) q) z GROUP BY symbol"
QUERIES["agg_count_distinct"] = "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag"
QUERIES["agg_hhi_entropy"] = f"SELECT symbol, {r('sum(n * n) / (sum(n) * sum(n))')} AS hhi, {r('ln(sum(n)) - sum(n * ln(n)) / sum(n)')} AS entropy FROM (SELECT symbol, size, CAST(count(*) AS double) AS n FROM ({TRADES}) q GROUP BY symbol, size) z GROUP BY symbol"
QUERIES["pivot_long_wide"] = "SELECT o_custkey, " + ", ".join(f"{r(f'''coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 0)''', 2)} AS total_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY o_custkey"
QUERIES["unpivot_wide_long"] = f"SELECT symbol, t, name, {r('value')} AS value FROM (SELECT symbol, t, 'open' AS name, open AS value FROM ({BARS}) a UNION ALL SELECT symbol, t, 'close', close FROM ({BARS}) b) z"
QUERIES["having_ntile"] = "WITH t AS (SELECT l_partkey, " + r("sum(l_extendedprice)", 2) + " AS v FROM lineitem GROUP BY l_partkey HAVING count(*) >= 10) SELECT l_partkey, v, ntile(4) OVER (ORDER BY v, l_partkey) AS quartile FROM t"
QUERIES["unnest_ordinality"] = "SELECT vec_id, pos, " + r("v") + " AS v FROM [[(SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings)::(SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)]] z"
# windows
O = "PARTITION BY symbol ORDER BY t"
QUERIES["window_row_frames"] = f"SELECT symbol, t, {', '.join(r(f'{f}(close) OVER ({O} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)') + f' AS {f}_10' for f in ('avg', 'sum', 'max', 'min', 'stddev_samp'))} FROM ({DAILY}) d"
QUERIES["window_left_closed"] = f"SELECT symbol, t, {r(f'avg(close) OVER ({O} RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)')} AS before FROM ({BARS}) b"
QUERIES["window_shift_diff"] = f"SELECT symbol, t, {r(f'lag(close, 2) OVER ({O})')} AS lag2, {r(f'lead(close, 2) OVER ({O})')} AS lead2, {r(f'close - lag(close) OVER ({O})')} AS diff FROM ({BARS}) b"
QUERIES["window_cumulative"] = f"SELECT symbol, t, {r(f'sum(volume) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cum_volume, {r(f'max(high) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS run_high FROM ({BARS}) b"
QUERIES["window_rank_average"] = f"SELECT symbol, t, {r('rank() OVER (PARTITION BY t ORDER BY volume) + (count(*) OVER (PARTITION BY t, volume) - 1) / 2.0')} AS avg_rank FROM ({BARS}) b"
QUERIES["gaps_and_islands"] = f"SELECT symbol, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM (SELECT symbol, t, t - row_number() OVER ({O}) AS island FROM ({BARS}) b) z GROUP BY symbol, island"
QUERIES["reverse_running_min"] = f"SELECT symbol, t, {r(f'min(low) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS floor_ahead FROM ({BARS}) b"
# top-k and sampling
QUERIES["topk_adv"] = f"SELECT symbol, {r('adv', 3)} AS adv FROM (SELECT symbol, avg(close * volume) AS adv FROM ({DAILY}) d GROUP BY symbol HAVING avg(close) >= 1) z ORDER BY adv DESC, symbol LIMIT 10"
QUERIES["topk_universe_mean"] = f"WITH u AS (SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY avg(close * volume) DESC, symbol) AS k FROM ({DAILY}) d GROUP BY symbol) z WHERE k <= 5) SELECT d.symbol, d.t FROM ({DAILY}) d WHERE EXISTS (SELECT 1 FROM u WHERE u.symbol = d.symbol)"
QUERIES["tiers_by_rank"] = "SELECT c_custkey, CASE WHEN k < 500 THEN 1 WHEN k < 2000 THEN 2 ELSE 3 END AS tier FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS k FROM customer) z"
QUERIES["topk_slow_symbols"] = f"SELECT symbol, max(gap) AS worst FROM (SELECT symbol, t - lag(t) OVER ({O}) AS gap FROM ({BARS}) b) z GROUP BY symbol ORDER BY worst DESC, symbol LIMIT 5"
QUERIES["top_bottom_k"] = f"SELECT symbol, t, CASE WHEN hi <= k THEN 1 WHEN lo <= k THEN -1 ELSE 0 END AS leg FROM (SELECT symbol, t, count(*) OVER (PARTITION BY t) AS n, greatest(1, CAST(floor(0.2 * count(*) OVER (PARTITION BY t)) AS int)) AS k, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS hi, row_number() OVER (PARTITION BY t ORDER BY close, symbol DESC) AS lo FROM ({BARS}) b) z WHERE n >= 2 * k"
QUERIES["basket_select"] = f"WITH s AS (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS hi, row_number() OVER (PARTITION BY t ORDER BY close, symbol) AS lo, cluster_id FROM ({BARS}) b) SELECT symbol, t, 'long' AS side FROM s WHERE hi <= 2 UNION ALL SELECT symbol, t, 'short' FROM s WHERE lo <= 2 AND cluster_id <> 3 AND hi > 2"
QUERIES["rank_by_dollar_volume"] = f"SELECT symbol, row_number() OVER (ORDER BY sum(close * volume) DESC, symbol) AS pos FROM ({BARS}) b WHERE t >= 474000 GROUP BY symbol"
QUERIES["most_common"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3"
QUERIES["seeded_sample"] = "SELECT c_custkey FROM customer ORDER BY (c_custkey * 7919 + 20240101) % 10007, c_custkey LIMIT 50"
QUERIES["quote_tranche"] = f"SELECT symbol FROM (SELECT symbol, row_number() OVER (ORDER BY count(*) DESC, symbol) AS k FROM ({TRADES}) q GROUP BY symbol) z WHERE k BETWEEN 3 AND 12 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT symbol AS s FROM ({TRADES}) w WHERE price > 330) g WHERE g.s = z.symbol)"
# sets
QUERIES["union_missing_columns"] = "SELECT s_suppkey AS id, s_name AS name, " + r("s_acctbal", 2) + " AS balance, CAST(NULL AS [[string::varchar]]) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, " + r("c_acctbal", 2) + ", c_mktsegment FROM customer"
QUERIES["set_difference"] = "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT p_partkey FROM part WHERE p_size > 25"
QUERIES["set_intersect"] = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"
# research queries
SESS = f"SELECT t, row_number() OVER (ORDER BY t) AS rn, stddev_samp(close) AS disp FROM ({DAILY}) d GROUP BY t HAVING count(*) >= 3"
#: Each session against the 120 before it: a bounded list a session instead of a range join.
BEFORE = "OVER (ORDER BY t ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"
QUERIES["range_self_join_pctile"] = f"WITH s AS ({SESS}), l AS (SELECT t, disp, count(disp) {BEFORE} AS n, [[collect_list(disp)::list(disp)]] {BEFORE} AS seen FROM s), j AS (SELECT t, n, coalesce([[size(filter(seen, x -> x < disp))::len(list_filter(seen, lambda x: x < disp))]], 0) AS below FROM l) SELECT t, {r('CASE WHEN n >= 20 THEN below * 1.0 / n END')} AS pctile, CASE WHEN n >= 20 THEN greatest(1, least(5, CAST(ceil(5.0 * below / n) AS int))) END AS tier FROM j"
QUERIES["session_anchor_prices"] = f"SELECT symbol, CAST(floor(t / 24) AS bigint) AS day, max(CASE WHEN t % 24 = 9 THEN open END) AS p0930, max(CASE WHEN t % 24 = 10 THEN open END) AS p1000, max(CASE WHEN t % 24 = 15 THEN close END) AS p1559, sum(CASE WHEN t % 24 BETWEEN 9 AND 10 THEN volume END) AS early_volume FROM ({BARS}) b GROUP BY symbol, CAST(floor(t / 24) AS bigint)"
QUERIES["liquidity_quartile"] = f"SELECT symbol, ntile(4) OVER (ORDER BY v, symbol) AS quartile FROM (SELECT symbol, {PCT(0.5, 'close * volume')} AS v FROM ({DAILY}) d GROUP BY symbol) z"
QUERIES["spread_cadence"] = f"SELECT symbol, t, quote_id, {r('(ask - bid) / 2', 4)} AS half FROM ({QUOTES}) q WHERE t % 30 = 0 OR quote_id % 30 = 1"
QUERIES["flagship_pricing"] = "SELECT l_returnflag, l_linestatus, " + r("sum(l_quantity)", 2) + " AS sum_qty, " + r("sum(l_extendedprice * (1 - l_discount))", 2) + " AS revenue, " + r("avg(l_discount)") + " AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
