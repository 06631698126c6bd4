"""Properties of the feature groups and folds that don't depend on an engine."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.groups import GROUPS
from tidemark.operators import folds
from tidemark.operators.store import FeatureStore
from tidemark.sources.frames import frame
from tidemark.streaming import live


def bars(rows: int = 80, symbols: int = 3, seed: int = 1) -> pd.DataFrame:
    rnd = random.Random(seed)
    out = []
    for s in range(symbols):
        price, t = 100.0, 0
        for _ in range(rows):
            t += rnd.choice([1, 1, 1, 2, 5])
            o, price = price, price * (1 + rnd.uniform(-0.02, 0.02))
            out.append((f"s{s}", f"sec{s % 2}", s, t, o, max(o, price) * 1.001, min(o, price) * 0.999, price, float(rnd.randint(0, 90)), float(rnd.randint(1, 9)), float(rnd.randint(-40, 40)), price))
    return pd.DataFrame(out, columns=["symbol", "sector", "cluster_id", "t", "open", "high", "low", "close", "volume", "n_trades", "signed_volume", "vwap"])


@pytest.mark.parametrize("name", sorted(n for n, g in GROUPS.items() if g.frame == "bars"))
def test_no_look_ahead(spark, name):
    group, full = GROUPS[name], bars()
    cut = int(full["t"].median())
    keys = ["symbol", "t"]
    whole = group.compute(spark.createDataFrame(full)).where(f"t <= {cut}").toPandas().sort_values(keys).reset_index(drop=True)
    early = group.compute(spark.createDataFrame(full[full.t <= cut])).toPandas().sort_values(keys).reset_index(drop=True)
    for c in group.features:
        np.testing.assert_allclose(whole[c].astype(float), early[c].astype(float), rtol=1e-7, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("name", ["trend_quality", "market_beta", "return_dynamics", "clean_momentum", "distribution", "technical"])
def test_flat_series_is_degenerate_not_wrong(spark, name):
    flat = bars(40).assign(open=5.0, high=5.0, low=5.0, close=5.0)
    out = GROUPS[name].compute(spark.createDataFrame(flat)).toPandas()
    values = out[GROUPS[name].features].astype(float).to_numpy()
    assert not np.isinf(values).any()


def test_ols_slope_is_polyfit(spark):
    data = bars()
    out = GROUPS["trend_quality"].compute(spark.createDataFrame(data)).toPandas()
    one = data[data.symbol == "s1"]
    last = int(one.t.max())
    window = one[one.t > last - 30]
    want = np.polyfit(window.t, window.close, 1)[0] / window.close.mean()
    got = out[(out.symbol == "s1") & (out.t == last)]["price_slope_30m"].iloc[0]
    assert got == pytest.approx(want, rel=1e-8)


def test_ewm_is_pandas():
    x = np.random.default_rng(1).normal(100, 5, 300)
    np.testing.assert_allclose(folds.ewm(x, 12), pd.Series(x).ewm(span=12).mean(), rtol=1e-12)


def test_swing_turns_at_theta_and_ignores_redelivery():
    fold = folds.Swing(theta=0.05)
    path = [100, 101, 103, 102, 97, 96, 99, 102]
    out = [fold.step(t, float(c)) for t, c in enumerate(path)]
    assert [o[2] for o in out] == [0, 0, 0, 0, -1, -1, -1, 1]
    assert out[4][0] == 2  # the pivot was at 103, two steps before
    again = fold.step(5, 50.0)
    assert again[2] == 1 and fold.pivots == 2


def test_directional_change_counts_pivots_on_every_scale():
    fold = folds.DirectionalChange()
    rows = [fold.step(t % 24 + 24 * (t // 24), 100 * (1 + 0.04 * math.sin(t)), 5.0, 1.0) for t in range(24)]
    names = dict(zip(folds.DC, rows[-1], strict=True))
    assert len(folds.DC) == 74 and names["dc_cur_dir_s05"] in (-1, 1)
    assert all(len(r) == 74 for r in rows)
    assert names["dc_last_leg_ntrades_s05"] > 0


def test_positions_realize_average_cost():
    out = folds.positions(pd.DataFrame({"symbol": ["a"] * 3, "t": [0, 2, 3], "close": [10.0, 20.0, 30.0], "volume": [1.0, 1.0, 1.0]}))
    assert out["realized"].tolist() == [0, 0, 15] and out["net"].tolist() == [1, 2, 1]


def test_implied_vol_inverts_the_price():
    out = folds.implied_vol(pd.DataFrame({"symbol": ["a"], "t": [0], "close": [100.0], "high": [110.0], "low": [100.0]}))
    assert out["status"].iloc[0] == "ok" and 0.05 < out["implied_vol"].iloc[0] < 2


def test_store_last_write_wins_and_sources_merge(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    df = lambda rows: spark.createDataFrame(rows, "symbol string, t long, close double")
    store.write(df([("a", 1, 1.0), ("a", 2, 2.0)]), "g", "backfill")
    store.write(df([("a", 2, 9.0)]), "g", "backfill", 1)
    store.write(df([("a", 2, 5.0), ("a", 30, 3.0)]), "g", "stream")
    assert sorted((r.t, r.close) for r in store.read("g").collect()) == [(1, 1.0), (2, 9.0), (30, 3.0)]
    assert [r.t for r in store.read("g", days=(1, 1)).collect()] == [30]
    store.compact("g", str(tmp_path / "c"))
    assert FeatureStore(spark, str(tmp_path / "c")).scan("g").count() == 4
    assert store.retain("g", 1).count() == 1


def test_streaming_swing_is_the_batch_fold(spark, sf):
    batch = folds.QUERIES["swing"](spark, sf).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    stream = live.swing_leg_state(spark, sf).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(batch, stream[batch.columns], check_dtype=False)


def test_scans_are_pruned(spark, sf):
    plan = frame(spark, sf, "bars")._jdf.queryExecution().executedPlan().toString()
    assert "props" in plan and "ReadSchema" in plan and "user_id" in plan
