"""Queries whose Spark form isn't their SQL's text, against that SQL in DuckDB on small odd tables."""

from __future__ import annotations

import time

import duckdb
import pandas as pd
import pytest

from tests.conftest import canonical
from tidemark import registry
from tidemark.functions.groups import GROUPS
from tidemark.operators import ticks
from tidemark.plans.dialect import duckdb_text, spark_text


def agree(got: pd.DataFrame, want: pd.DataFrame) -> None:
    got, want = canonical(got), canonical(want)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert not (got != want).any(axis=None), f"\n{got[(got != want).any(axis=1)].head()}\n{want[(got != want).any(axis=1)].head()}"


#: Events of one symbol, 30 seconds apart over three weeks: what every row looks back on grows with the table.
CROWDED = "SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:07' + INTERVAL (i * 30) SECOND AS ts, 5 AS user_id, 'view' AS event_type, 1.0 + i * 7919 % 1000 AS value, '{{\"k\": ' || i * 31 % 97 || '}}' AS props FROM range({n}) r(i)"
#: Ends of days and hours, gaps, many at once, missing times, values and sizes, prices of zero and below.
ODD = """
SELECT i AS event_id, CASE WHEN i % 41 = 0 THEN NULL WHEN i % 5 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (i % 7) DAY WHEN i % 5 = 1 THEN TIMESTAMP '2023-12-30' + INTERVAL (i % 60) HOUR
  WHEN i % 5 = 2 THEN TIMESTAMP '2024-01-02' - INTERVAL 1 MICROSECOND + INTERVAL (i % 3) MICROSECOND WHEN i % 5 = 3 THEN TIMESTAMP '2024-02-01' + INTERVAL (i * i % 500) DAY ELSE TIMESTAMP '1969-12-20' + INTERVAL (i * 577) MINUTE END AS ts,
  i * 13 % 6 AS user_id, 'view' AS event_type, CASE WHEN i % 29 = 0 THEN NULL ELSE i * 7919 % 500 - 2.0 END AS value, CASE WHEN i % 31 <> 0 THEN '{"k": ' || i * 31 % 97 || '}' END AS props FROM range(1200) r(i)
"""


@pytest.fixture
def events(spark, tmp_path):
    """Writes a table of events; gives a query's rows over it in Spark, the time this took, and its SQL's rows."""

    def run(name: str, made: str) -> tuple[pd.DataFrame, float, pd.DataFrame]:
        con = duckdb.connect()
        con.execute(f"COPY ({made}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
        began = time.monotonic()
        got = registry.queries()[name](spark, str(tmp_path)).toPandas()
        return got, time.monotonic() - began, con.execute(registry.oracle_sql()[name]).fetchdf()

    return run


@pytest.mark.parametrize("name", ["edgar_filing_frequency", "realized_half_spread", "intraday_panel"])
def test_odd_events(events, name):
    got, _, want = events(name, ODD)
    agree(got, want)
    assert len(got) > 100


@pytest.mark.parametrize(("name", "rows"), [("edgar_filing_frequency", 60_000), ("realized_half_spread", 60_000), ("intraday_panel", 60_000)])
def test_time_grows_with_the_table_not_its_square(events, name, rows):
    got, took, want = events(name, CROWDED.format(n=rows))
    agree(got, want)
    assert took < 25


#: Hours of one or several trades and gaps up to three days, full hours to the microsecond, hours without any valid quote.
SPARSE = """
SELECT CASE WHEN i % 6 = 5 THEN i * 42 ELSE i * 7 + 1 END AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 9 * 5 + i * i % 71) HOUR + INTERVAL (CASE WHEN i % 4 = 0 THEN 0 WHEN i % 4 = 1 THEN 3599999999 ELSE i * 104729 % 3600000 * 1000 END) MICROSECOND AS ts,
  i % 2 + i // 7 % 3 * 4 AS user_id, CASE WHEN i % 3 = 0 THEN 'view' ELSE 'click' END AS event_type, 50.0 + i * 7919 % 100 AS value, '{"k": ' || CASE WHEN i // 40 % 4 = 3 THEN 0 ELSE i % 9 END || '}' AS props FROM range(2000) r(i)
"""


def test_panel_reads_the_tape_once(spark, events, tmp_path):
    got, _, want = events("intraday_panel", SPARSE)
    agree(got, want)
    assert got.cost_bps.nunique() > 100 and (got.cost_bps == 3.0).any()
    plan = registry.queries()["intraday_panel"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_entries_between_blocks(spark):
    """Entries at any time, some of them twice, over quotes at equal times and ends of windows."""
    quotes = [(s, (k * k * 37 + 11 * s) % 3000 - 900, k, 9.0 + k % 3, 9.0 + k % 3 + k % 7 * 0.25, float(k % 5), 1.0) for s in range(3) for k in range(700)]
    entries = [(s, us) for s in range(4) for us in (*range(-1000, 2400, 50), *range(-960, 2400, 240), 17, 17, 17)]
    con = duckdb.connect()
    for name, rows, columns in (("quotes_q", quotes, "symbol bigint, us bigint, quote_id bigint, bid double, ask double, bid_size double, ask_size double"), ("entries_q", entries, "symbol bigint, us bigint")):
        spark.createDataFrame(rows, columns).createOrReplaceTempView(name)
        con.register(name, pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")]))
    text = ticks.half_spread_at("SELECT * FROM entries_q", "SELECT * FROM quotes_q", window_us=240)
    got, want = spark.sql(spark_text(text)).toPandas(), con.execute(duckdb_text(text)).fetchdf()
    assert len(got) == len(entries) and got.half_spread_bps.notna().sum() > 100
    # the last place may fall on either side of a rounding boundary
    keys = ["symbol", "us", "half_spread_bps"]
    got, want = got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[keys], want[keys], check_dtype=False, atol=2e-4)


def test_draw_range_from_an_extreme_of_zero(spark):
    paths = {"rises": [0, 5, 3], "falls": [0, -3, -5], "zeros": [0, 0, 4, 0, 2], "later": [3, 0, 5, 0, 7], "missing": [None, 0, None, 5], "none": [None, None], "usual": [4, 6, 3, 9], "below": [-2, -4, -1, 0]}
    closes = [(s, 10 + t, None if c is None else float(c)) for s, path in paths.items() for t, c in enumerate(path)]
    frame = spark.createDataFrame(closes, "symbol string, t long, close double")
    con = duckdb.connect()
    con.execute("CREATE TABLE closes (symbol VARCHAR, t BIGINT, close DOUBLE)")
    con.executemany("INSERT INTO closes VALUES (?, ?, ?)", closes)
    got = GROUPS["draw_range"].rounded(frame).toPandas()
    assert got[got.symbol == "rises"].max_drawup_60m.isna().all()
    agree(got, con.execute(GROUPS["draw_range"].sql({"bars": "SELECT * FROM closes"})).fetchdf())
