"""Feature groups and statistics against plain Python written from their definitions, on random frames; no shared text."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.test_features import bars
from tidemark.functions.groups import GROUPS
from tidemark.operators import evaluation, ticks
from tidemark.operators.folds import Swing
from tidemark.plans.dialect import duckdb_text, spark_text


def by_row(spark, name: str, data: pd.DataFrame) -> dict[tuple, dict]:
    frame = spark.createDataFrame(data)
    frame = frame.selectExpr(*(f"nullif({c}, double('nan')) AS {c}" if kind == "double" else c for c, kind in frame.dtypes))
    out = GROUPS[name].compute(frame).toPandas()
    return {(r["symbol"], r["t"]): r for r in out.to_dict("records")}


def same(got, want) -> bool:
    missing = lambda v: v is None or (isinstance(v, float) and math.isnan(v))
    return missing(got) if missing(want) else not missing(got) and float(got) == pytest.approx(float(want), rel=1e-6, abs=1e-9)


def check(spark, name: str, data: pd.DataFrame, want) -> None:
    got, hits = by_row(spark, name, data), 0
    for symbol, one in data.groupby("symbol"):
        one = one.sort_values("t").reset_index(drop=True)
        for i in range(len(one)):
            for feature, value in want(one, i).items():
                row = got[symbol, one["t"][i]]
                assert same(row[feature], value), (feature, symbol, i, row[feature], value)
                hits += value is not None
    assert hits > 50


def window(one: pd.DataFrame, i: int, w: int) -> pd.DataFrame:
    return one[(one.t > one.t[i] - w) & (one.t <= one.t[i])]


def test_momentum_consistency(spark):
    def want(one, i):
        one = one.assign(ret=one.close / one.close.shift(1) - 1)
        out = {}
        for w in (5, 20):
            part = window(one, i, w).ret.dropna()
            net = one.close[i] - one.close[i - w] if i >= w else None
            good = None if net is None or not len(part) else (part > 0).mean() if net > 0 else (part < 0).mean() if net < 0 else 0.5
            signs = np.sign(one.ret)
            flips = [(signs[k] * signs[k - 1] < 0) for k in window(one, i, w).index if k > 0]
            out |= {f"consistent_direction_{w}m": good, f"reversal_count_{w}m": sum(flips) / w if len(part) else None}
        return out

    check(spark, "momentum_consistency", bars(60), want)


def test_clean_momentum(spark):
    data = bars(60)
    data["close"] = np.where(data.symbol == "s0", 100 - 0.2 * data.t, data.close)  # a clean fall counts as well as a rise

    def want(one, i):
        out = {}
        for w in (10, 30):
            part = window(one, i, w)
            flag = score = None
            if len(part) >= 4:
                slope, cut = np.polyfit(part.t - part.t.mean(), part.close, 1)
                left = part.close - cut - slope * (part.t - part.t.mean())
                var = (left**2).mean()
                if var > (part.close.mean() * 1e-6) ** 2:
                    rel, spread = abs(slope / part.close.mean()), math.sqrt(var) / part.close.mean() * 100
                    r2 = np.corrcoef(part.t, part.close)[0, 1] ** 2
                    flag = float(rel > 0.0002 and r2 > 0.7 and spread < 0.3)
                    score = 0.4 * min(rel / 0.001, 1) + 0.3 * r2 + 0.3 * max(0, 1 - spread / 0.5)
            out |= {f"momentum_quality_flag_{w}m": flag, f"clean_momentum_score_{w}m": score}
        return out

    check(spark, "clean_momentum", data, want)


def test_volume_exhaustion_and_streaks(spark):
    def want(one, i):
        part = window(one, i, 15)
        up, down = part.volume[part.close > part.open].sum(), part.volume[part.close < part.open].sum()
        return {"vol_down_up_ratio_15m": down / up if up > 1e-9 * (up + down) else None, "vol_dryup_15m": one.volume[i] / part.volume.mean() if part.volume.mean() > 0 else None}

    check(spark, "volume_exhaustion", bars(60), want)

    def streak(one, i):
        sign = np.sign(one.close / one.close.shift(1) - 1)
        part = sign[window(one, i, 20).index].dropna().tolist()
        best = run = 0
        for k, s in enumerate(part):
            run = run + 1 if k and s == part[k - 1] else 1
            best = max(best, run)
        return {"longest_streak_20m": best / 20 if len(part) >= 2 else None}

    check(spark, "longest_streak", bars(60), streak)


def test_daily_breadth_and_dispersion_know_yesterday_only(spark):
    data = bars(40, symbols=6).assign(t=lambda d: d.groupby("symbol").cumcount())
    for c in ("breadth_daily", "return_dispersion_daily"):
        late = data.copy()
        last = late.t == late.t.max()
        late.loc[last, "close"] *= 3
        a, b = by_row(spark, c, data), by_row(spark, c, late)
        assert all(same(b[k][f], a[k][f]) for k in a for f in GROUPS[c].features)
    close = data.pivot(index="t", columns="symbol", values="close")
    known = close.shift(1)
    for w in (1, 5):
        ret = known / known.shift(w) - 1
        got = by_row(spark, "breadth_daily", data)
        spread = by_row(spark, "return_dispersion_daily", data)
        for t in range(w + 1, 40):
            row = ret.loc[t].sort_values().to_list()
            assert same(got["s0", t][f"breadth_up_{w}d"], np.mean([x > 0.0001 for x in row]))
            at = lambda q, row=row: row[math.floor(q * (len(row) - 1) + 0.5)]
            assert same(spread["s0", t][f"return_dispersion_iqr_{w}d"], at(0.75) - at(0.25))
            assert same(spread["s0", t][f"return_dispersion_std_{w}d"], np.std(row, ddof=1))


@pytest.mark.parametrize(("name", "prefix", "move"), [("runner_state", "runner", "early_move"), ("dumper_state", "dumper", "early_drop")])
def test_movers_use_the_prior_close(spark, name, prefix, move):
    rnd = random.Random(4)
    rows = []
    for s, prev in (("a", 5.0), ("b", 50.0), ("c", None), ("d", 2.0)):
        price = 8.0
        for k in range(30):
            price *= 1 + rnd.uniform(-0.2, 0.2)
            rows.append((s, k, 0, 540 + 30 * k, price * 0.99, price * 1.02, price * 0.97, price, 10.0, prev))
    data = pd.DataFrame(rows, columns=["symbol", "t", "session", "minute_et", "open", "high", "low", "close", "volume", "prev_close"])

    def want(one, i):
        if one.minute_et[i] < 570:
            return {f"{prefix}_in_band": None, f"{prefix}_is_active": None}
        prev = one.prev_close[i]
        own = one[(one.minute_et >= 570) & (one.t <= one.t[i])]
        ext = own.high.max() if prefix == "runner" else own.low.min()
        if prev is None or math.isnan(prev):
            return {f"{prefix}_in_band": None, f"{prefix}_{move}": None}
        early = (ext / prev - 1) * (1 if prefix == "runner" else -1)
        band = 2 <= prev <= 20
        return {f"{prefix}_in_band": float(band), f"{prefix}_is_active": float(band and early >= 0.3), f"{prefix}_{move}": ext / prev - 1}

    check(spark, name, data, want)


def test_large_prints_are_four_times_the_mean(oracle):
    tape = oracle(duckdb_text(ticks.SIGNED))
    got = {(r["symbol"], r["t"]): r for r in oracle(duckdb_text(ticks.QUERIES["large_print_burst"])).to_dict("records")}
    for key, part in tape.groupby(["symbol", "t"]):
        big = part["size"] >= 4 * part["size"].mean()
        assert abs(got[key]["large_print_ratio_1m"] - big.mean()) < 2e-6


def test_half_spread_is_weighted_by_dwell(spark):
    rnd = random.Random(9)
    quotes = [("s", rnd.randrange(0, 1000), k, 100 - rnd.choice([0.1, 0.2, -1.0, 200.0]), 100 + rnd.choice([0.1, 0.3]), 1.0, float(rnd.choice([0, 1, 2]))) for k in range(300)]
    entries = [("s", e) for e in range(0, 1100, 37)] + [("none", 5)]
    spark.createDataFrame(quotes, "symbol string, us long, quote_id long, bid double, ask double, bid_size double, ask_size double").createOrReplaceTempView("some_quotes")
    spark.createDataFrame(entries, "symbol string, us long").createOrReplaceTempView("some_entries")
    out = {(r.symbol, r.us): r.half_spread_bps for r in spark.sql(spark_text(ticks.half_spread_at("SELECT * FROM some_entries", "SELECT * FROM some_quotes", window_us=120))).collect()}
    measured = 0
    for s, e in entries:
        valid = sorted((us, k, (a - b) / ((a + b) / 2) * 1e4) for x, us, k, b, a, bs, as_ in quotes if x == s and b > 0 and a > b and bs > 0 and as_ > 0 and e - 120 <= us < e)
        if len(valid) < 5:
            assert out[s, e] is None
            continue
        dwell = [(valid[k + 1][0] if k + 1 < len(valid) else e) - v[0] for k, v in enumerate(valid)]
        assert out[s, e] == pytest.approx(sum(d * v[2] for d, v in zip(dwell, valid, strict=True)) / sum(dwell) / 2, abs=2e-4)
        measured += 1
    assert measured > 10


def test_p_values_and_folds():
    z = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 6.0]
    got = duckdb.sql("SELECT z, " + duckdb_text(evaluation.upper_tail("z")) + " AS p FROM (SELECT unnest([" + ", ".join(map(str, z)) + "]) AS z) x").fetchall()
    assert all(p == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), abs=2e-7) for x, p in zip(z, (r[1] for r in got), strict=True))
    for n in range(6, 60):
        size = n / 6
        want = [sum(i >= round(k * size) for k in range(1, 6)) for i in range(n)]
        fold = " + ".join(f"CASE WHEN i >= {evaluation.start(k)} THEN 1 ELSE 0 END" for k in range(1, 6))
        assert [r[0] for r in duckdb.sql(f"SELECT {fold} FROM (SELECT unnest(range(0, {n})) AS i, {n} AS n) x ORDER BY i").fetchall()] == want


def test_a_leg_starts_with_the_day():
    """The first turn of a day closes a leg from its first bar; lengths are fractions; a new day starts anew."""
    fold, closes = Swing(theta=0.05), [100, 104, 98, 97, 103]
    rows = [fold.step(k, float(c)) for k, c in enumerate(closes)]
    assert rows[1][4] == pytest.approx(0.04) and rows[1][2] == 0 and math.isnan(rows[1][0])
    # at 98 price is 5.8 % below the high: the leg 100 -> 104 ends there
    assert rows[2][2] == -1 and rows[2][5:7] == (1.0, 1.0) and rows[2][4] == pytest.approx(98 / 104 - 1)
    assert rows[2][7] == pytest.approx(0.04 + 98 / 104 - 1) and rows[2][1] == pytest.approx((98 - 104) / (100 - 104))
    assert rows[4][2] == 1 and rows[4][5:7] == (2.0, 2.0) and rows[4][7] == pytest.approx(0.04 + (97 / 104 - 1) + (103 / 97 - 1))
    new = fold.step(24, 50.0)
    assert new[2] == 0 and new[4] == 0 and new[5] == 0
