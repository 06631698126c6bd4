"""Canonical frames over the given tables: trades, bars, sessions, daily bars, quotes, filings, news.

Each is one SQL text for both engines. A symbol is an event type with a customer bucket; time is an integer count of
buckets (hours for bars, days for daily frames), so windows are exact range frames on it. `frame()` gives the DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.dialect import run_sql

#: The symbols that stand for the market.
INDEX, INDEX2 = "click-0", "view-0"

TRADES = """
SELECT concat(event_type, '-', CAST(user_id % 4 AS [[STRING::VARCHAR]])) AS symbol, event_type AS sector, user_id % 4 AS cluster_id, event_id,
  [[unix_micros(CAST(ts AS timestamp))::epoch_us(ts)]] AS us, value AS price, CAST(regexp_extract(props, '([0-9]+)', 1) AS double) AS size
FROM events WHERE value IS NOT NULL
"""
SIGNED = f"""
SELECT *, coalesce([[last(step, true)::last_value(step IGNORE NULLS)]] OVER (PARTITION BY symbol ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS side
FROM (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY us, event_id)), 0) AS step, CAST(floor(us / 3600000000) AS bigint) AS t FROM ({TRADES}) q0) q1
"""
BARS = f"""
SELECT symbol, min(sector) AS sector, min(cluster_id) AS cluster_id, t,
  [[min_by(price, struct(us, event_id))::arg_min(price, (us, event_id))]] AS open, max(price) AS high, min(price) AS low,
  [[max_by(price, struct(us, event_id))::arg_max(price, (us, event_id))]] AS close, sum(size) AS volume, CAST(count(*) AS double) AS n_trades,
  sum(side * size) AS signed_volume, sum(price * size) / nullif(sum(size), 0) AS vwap
FROM ({SIGNED}) q2 GROUP BY symbol, t
"""
#: Eastern time (daylight saving as the zone has it; the oracle's range lies in winter).
ET = f"""
SELECT *, [[unix_date(to_date(et))::date_diff('day', DATE '1970-01-01', CAST(et AS DATE))]] AS session, hour(et) * 60 AS minute_et,
  [[weekday(et) + 1::isodow(et)]] AS dow, day(et) AS dom, month(et) AS mon, day(last_day(et)) AS dim
FROM (SELECT *, [[from_utc_timestamp(timestamp_seconds(t * 3600), 'America/New_York')::CAST(make_timestamp(t * 3600000000) AS TIMESTAMP) - INTERVAL 5 HOUR]] AS et FROM ({BARS}) q3) q4
"""
SESSIONS = f"""
SELECT b.*, p.prev_close FROM ({ET}) b LEFT JOIN (
  SELECT symbol, session, lag(last_close) OVER (PARTITION BY symbol ORDER BY session) AS prev_close
  FROM (SELECT symbol, session, [[max_by(close, t)::arg_max(close, t)]] AS last_close FROM ({ET}) q5 GROUP BY symbol, session) q6
) p ON b.symbol = p.symbol AND b.session = p.session
"""
DAILY = """
SELECT symbol, min(sector) AS sector, t, [[min_by(price, key)::arg_min(price, key)]] AS open, max(price) AS high, min(price) AS low, [[max_by(price, key)::arg_max(price, key)]] AS close,
  CAST(count(*) AS double) AS volume, avg(price) AS vwap
FROM (SELECT concat(c_mktsegment, '-', CAST(c_nationkey % 4 AS [[STRING::VARCHAR]])) AS symbol, c_mktsegment AS sector, [[unix_date(to_date(o_orderdate))::date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))]] AS t,
  o_totalprice AS price, o_orderkey AS key FROM orders JOIN customer ON o_custkey = c_custkey) q0
GROUP BY symbol, t
"""
QUOTES = """
SELECT concat(l_returnflag, l_linestatus, '-', CAST(l_suppkey % 4 AS [[STRING::VARCHAR]])) AS symbol, [[unix_date(to_date(l_shipdate))::date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))]] AS t,
  l_extendedprice * (1 - l_discount) AS bid, l_extendedprice * (1 + l_tax) AS ask, l_quantity AS bid_size, CAST(l_linenumber AS double) AS ask_size, l_orderkey * 10 + l_linenumber AS quote_id FROM lineitem
"""
QUOTE_BARS = f"""
SELECT symbol, t, coalesce(avg(CASE WHEN bid + ask > 0 AND ask >= bid THEN (ask - bid) / ((ask + bid) / 2) * 10000 END), 0) AS mean_spread_bps,
  coalesce(avg(CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END), 0) AS quote_imbalance,
  avg(bid_size) AS mean_bid_size, avg(ask_size) AS mean_ask_size, CAST(count(*) AS double) AS n_quotes
FROM ({QUOTES}) q1 GROUP BY symbol, t
"""
FILINGS = "SELECT concat('u', CAST(user_id % 50 AS [[STRING::VARCHAR]])) AS symbol, [[element_at(array('8-K', '10-Q', '10-K', '4', 'S-1'), CAST(event_id % 5 + 1 AS int))::list_extract(['8-K', '10-Q', '10-K', '4', 'S-1'], event_id % 5 + 1)]] AS form_type, [[unix_micros(CAST(ts AS timestamp))::epoch_us(ts)]] AS available_us, event_id FROM events"
#: Words that tell good news from bad; fixed values.
POSITIVE = """approval approved awarded beat beats best breakthrough bullish clears exceeds expands expansion gain gains growing growth highest innovative jump jumps
optimistic outperform raised raises rallies rally record robust soar soars solid spike spikes strong successful surge surges surpasses tops upbeat upgrade upgraded wins""".split()
NEGATIVE = """bearish concern concerns contraction contracts crash crashes cuts decline declining disappointing disappoints downgrade downgraded drop drops fail failed fails fall falls
fraud investigation lawsuit lowered lowers lowest miss misses pessimistic plunge plunges rejected rejection scandal sink sinks sluggish sued tumble tumbles underperform warning
warns weak worst""".split()
_APART = r"[\s\x22\x27\x60!?.,;:()\[\]{}<>/\\|@#$%^&*+=~_-]+"


def lexicon_score(text: str, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> str:
    """(p - n) / (p + n) of the different good and bad words that a text has, whole words only; 0 without any."""
    words = f"[[split(regexp_replace(lower(coalesce({text}, '')), r'{_APART}', ' '), ' ')::string_split(regexp_replace(lower(coalesce({text}, '')), '{_APART}', ' ', 'g'), ' ')]]"
    hits = lambda lexicon: f"[[size(array_intersect(w, array({', '.join(map(repr, lexicon))})))::len(list_intersect(w, [{', '.join(map(repr, lexicon))}]))]]"
    return f"(SELECT *, coalesce((p - n) / nullif(p + n, 0.0), 0.0) AS sentiment FROM (SELECT *, {hits(positive)} AS p, {hits(negative)} AS n FROM (SELECT *, {words} AS w FROM documents) x0) x1)"


#: News are all documents: each belongs to a symbol and comes some time after it was published, later the longer it is.
NEWS = f"""
SELECT concat([[element_at(array('click', 'error', 'purchase', 'signup', 'view'), CAST(doc_id % 5 + 1 AS int))::list_extract(['click', 'error', 'purchase', 'signup', 'view'], doc_id % 5 + 1)]], '-', CAST(CAST(floor(doc_id / 5) AS bigint) % 4 AS [[STRING::VARCHAR]])) AS symbol,
  published_us + n_chars * 1000 AS available_us, published_us, doc_id AS event_id, sentiment
FROM (SELECT *, 1704067200000000 + (doc_id * 7919 % 43200) * 60000000 AS published_us FROM {lexicon_score('text')} x2) x3
"""
#: Sessions with what is typical of their clock bucket (an hour) in earlier sessions: mean |return|, and volume against the mean of all buckets.
CLOCK = f"""
WITH s AS ({SESSIONS}), d AS (SELECT session, minute_et, sum(abs(close / nullif(open, 0) - 1)) AS a, sum(volume) AS v, count(*) AS n FROM s WHERE minute_et >= 570 AND minute_et < 960 GROUP BY session, minute_et),
b AS (SELECT session, minute_et, sum(a) OVER w / sum(n) OVER w AS baseline_absret, sum(v) OVER w / sum(n) OVER w AS mean_v FROM d WINDOW w AS (PARTITION BY minute_et ORDER BY session RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT session, avg(mean_v) AS all_v FROM b GROUP BY session)
SELECT s.*, b.baseline_absret, b.mean_v / nullif(m.all_v, 0) AS vol_shape FROM s LEFT JOIN b ON s.session = b.session AND s.minute_et = b.minute_et LEFT JOIN m ON s.session = m.session
"""
#: Quotes around each print of the tape, an hour later; some are crossed.
BID, ASK, ASK_SIZE = "price * (1 - 0.0002 * (event_id % 6))", "price * (1 + 0.0001 * (event_id % 7))", "size + event_id % 3"
TAPE_QUOTES = f"""
SELECT symbol, us + 3600000000 AS us, CAST(floor(us / 3600000000) AS bigint) + 1 AS t, event_id AS quote_id, {BID} AS bid, {ASK} AS ask, size AS bid_size, {ASK_SIZE} AS ask_size FROM ({TRADES}) q8
"""

FRAMES = {"trades": TRADES, "signed": SIGNED, "bars": BARS, "et": ET, "sessions": SESSIONS, "daily": DAILY, "quotes": QUOTES, "quote_bars": QUOTE_BARS, "filings": FILINGS, "news": NEWS, "clock": CLOCK, "tape_quotes": TAPE_QUOTES}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, FRAMES[name])
