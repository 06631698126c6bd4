"""Coverage reports and the store's reads over several groups, against plain Python."""

from __future__ import annotations

import pandas as pd
import pytest

from tidemark.operators import coverage
from tidemark.operators.store import FeatureStore
from tidemark.plans.dialect import spark_text


def cells(table: dict[int, int]) -> str:
    """SQL for `n` symbols on each day."""
    rows = ", ".join(f"('s{i}', {day * 24 + 3})" for day, n in table.items() for i in range(n))
    return f"SELECT * FROM (VALUES {rows}) AS v(symbol, t)"


def timeline(spark, stream, backfill, span, least):
    return spark.sql(spark_text(coverage.coverage_timeline(cells(stream), cells(backfill), span, least))).toPandas().set_index("day").sort_index()


@pytest.mark.parametrize(("newest", "least", "status"), [(10, 5, "ok"), (6, 5, "ok"), (5, 5, "thinning"), (3, 5, "drop"), (3, 100, "ok")])
def test_newest_day_against_the_busiest(spark, newest, least, status):
    got = timeline(spark, {1: 10, 2: 9, 4: newest}, {2: 3, 5: 2}, 4, least)
    assert got.index.tolist() == [2, 3, 4, 5]
    assert got["provenance"].tolist() == ["both", "absent", "stream_only", "backfill_only"]
    # day 1 lies before the span, so day 2 or the newest is the busiest
    busiest = max(9, newest)
    assert set(got["baseline"]) == {busiest} and set(got["recent"]) == {newest}
    assert set(got["status"]) == {status}


def test_span_without_a_stream(spark):
    got = timeline(spark, {1: 3}, {9: 2}, 3, 1)
    assert set(got["status"]) == {"no_stream"} and got["ratio"].isna().all()


def test_trend_counts_live_groups_only(spark):
    rows = lambda pairs: "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {d})" for s, d in pairs) + ") AS v(symbol, day)"
    groups = {"x": rows([("a", 1), ("b", 1), ("b", 1), ("a", 2)]), "y": rows([("b", 1), ("c", 1)])}
    got = spark.sql(spark_text(coverage.orderflow_trend(groups, 5))).toPandas().set_index("day").sort_index()
    assert got["n_union"].tolist() == [3, 1] and got["n_intersection"].tolist() == [1, 1]
    assert got["n_live_groups"].tolist() == [2, 1] and set(got["union_delta"]) == {-2}


def test_empty_fetches_are_no_coverage(spark):
    manifest = "SELECT * FROM (VALUES ('a', 1, 0), ('a', 1, 7), ('b', 1, 0), ('a', 4, 2), ('b', 9, 0)) AS v(symbol, day, n)"
    (got,) = spark.sql(spark_text(coverage.raw_coverage({"bars": manifest}, 3))).collect()
    assert (got.day, got.n_symbols, got.n_rows) == (4, 1, 2)
    assert (got.earliest, got.latest, got.span_days, got.n_dates, got.n_cells) == (1, 4, 4, 2, 2)


@pytest.fixture
def store(spark, tmp_path):
    out = FeatureStore(spark, str(tmp_path))
    frame = lambda name, rows: spark.createDataFrame(pd.DataFrame([(s, t, float(v)) for s, t, v in rows], columns=["symbol", "t", name]))
    out.write(frame("p", [("a", 1, 1), ("a", 25, 2)]), "price", "backfill")
    out.write(frame("p", [("a", 1, 9), ("b", 2, 3), ("a", 50, 4)]), "price", "stream")
    out.write(frame("q", [("b", 2, 5), ("c", 30, 6)]), "size", "backfill")
    out.write(frame("q", [("c", 30, 8)]), "size", "stream")
    return out


def test_groups_meet_on_keys(store):
    got = store.features(["q", "p"], {"p": "price", "q": "size"}, (0, 2))
    assert sorted((r.symbol, r.t, r.p, r.q) for r in got.fillna(-1.0).collect()) == [("a", 1, 1, -1), ("a", 25, 2, -1), ("a", 50, 4, -1), ("b", 2, 3, 5), ("c", 30, -1, 6)]
    with pytest.raises(KeyError):
        store.features(["r"], {"p": "price"}, (0, 2))


def test_unsettled_days_are_refused(store):
    catalog = {"p": "price", "q": "size"}
    assert store.unsettled("price", (0, 9)) == [2] and store.unsettled("size", (0, 9)) == []
    assert store.features(["p", "q"], catalog, (0, 1), require_settled=True).count() == 4
    with pytest.raises(ValueError, match=r"\[2\]"):
        store.features(["p", "q"], catalog, (0, 2), require_settled=True)


def test_simulated_rows_stay_apart(spark, store, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0)], "symbol string, t long, p double")
    with pytest.raises(ValueError):
        store.write(rows, "price", "sim")
    mock = FeatureStore(spark, str(tmp_path / "mock"), mock=True)
    with pytest.raises(ValueError):
        mock.write(rows, "price", "stream")
    mock.write(rows, "price", "sim")
    mock.write(rows.withColumn("t", rows.t + 1), "price", "backfill")
    assert mock.read("price").count() == 2
