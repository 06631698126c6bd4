"""Sequential folds that windows can't express: averages over all history, ZigZag swings, directional change, positions.

Each is a grouped map over one symbol's rows in time order. The streaming twins reuse the same fold objects as state.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import duckdb_text
from ..sources.frames import BARS, DAILY, frame

N = 1.7e-10
DAY = 24  # time units of a day
RING = 8  # completed legs that are remembered
THETA = 0.005
FIB_MOST = 10.0
LEVELS = (0.382, 0.5, 0.618, 0.786)


def _by_symbol(df: DataFrame, f, schema: str, daily: bool = False) -> DataFrame:
    """f over each symbol's rows in order, or over those of one day where the fold starts anew each day."""
    by = ["symbol", F.floor(F.col("t") / DAY)] if daily else ["symbol"]
    return df.groupBy(*by).applyInPandas(lambda pdf: f(pdf.sort_values("t", kind="stable")), schema)


def nullable(x: np.ndarray) -> np.ndarray:
    return np.round(x + N, 6)


# --- exponentially weighted means --------------------------------------------------------------------------------
def ewm(x: np.ndarray, span: int) -> np.ndarray:
    """The adjusted exponentially weighted mean: weights (1 - alpha)^age, normalised by their sum."""
    keep, top, bottom, out = 1 - 2 / (span + 1), 0.0, 0.0, np.empty(len(x))
    for i, v in enumerate(x):
        top, bottom = top * keep + v, bottom * keep + 1
        out[i] = top / bottom
    return out


def macd(pdf: pd.DataFrame) -> pd.DataFrame:
    close = pdf["close"].to_numpy(float)
    line = ewm(close, 12) - ewm(close, 26)
    signal = ewm(line, 9)
    return pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"], "macd_line": nullable(line), "macd_signal": nullable(signal), "macd_hist": nullable(line - signal)})


# --- swings ------------------------------------------------------------------------------------------------------
class Swing:
    """A causal ZigZag of one day: a leg turns once price retraces theta from its extreme."""

    def __init__(self, theta: float = THETA, ring: int = RING):
        self.theta, self.ring = theta, ring
        self.dir, self.day, self.last = 0, None, None
        self.reset()

    def reset(self) -> None:
        self.dir, self.high, self.low, self.start, self.end = 0, None, None, None, None
        self.legs: list[tuple[float, float]] = []
        self.pivots = self.turns = 0
        self.before: tuple[float, float] | None = None

    def turn(self, t: int, close: float, pivot: tuple[float, int], to: int) -> None:
        if self.start is not None and self.start[0] > 0:
            gain, span = pivot[0] / self.start[0] - 1, pivot[1] - self.start[1]
            self.legs = [*self.legs, (gain, gain / span if span > 0 else 0.0)][-self.ring :]
            self.before = (self.start[0], pivot[0])
            self.turns += 1
        self.pivots += 1
        self.dir, self.start, self.end = to, pivot, (close, t)

    def step(self, t: int, close: float) -> tuple:
        if self.last is not None and t <= self.last:
            return self.emit(t, close)
        if t // DAY != self.day:
            self.reset()
            self.day = t // DAY
        self.last = t
        if self.high is None:
            self.high = self.low = self.start = self.end = (close, t)
        elif self.dir == 0:
            self.high, self.low = max(self.high, (close, t), key=lambda p: p[0]), min(self.low, (close, t), key=lambda p: p[0])
            down = (self.high[0] - close) / self.high[0] if self.high[0] > 0 else 0.0
            up = (close - self.low[0]) / self.low[0] if self.low[0] > 0 else 0.0
            if down >= self.theta and down >= up:
                self.turn(t, close, self.high, -1)
            elif up >= self.theta:
                self.turn(t, close, self.low, 1)
        elif (close - self.end[0]) * self.dir >= 0:
            self.end = (close, t)
        elif self.end[0] > 0 and (self.end[0] - close) * self.dir / self.end[0] >= self.theta:
            self.turn(t, close, self.end, -self.dir)
        return self.emit(t, close)

    def emit(self, t: int, close: float) -> tuple:
        """since pivot, retracement, direction, steepness, length, pivots, alternations, persistence, resolved."""
        length = close / self.start[0] - 1 if self.start[0] > 0 else 0.0
        span = t - self.start[1]
        steep = length / span if span > 0 else 0.0
        since = float(span) if self.dir else math.nan
        fib = math.nan
        if self.before and abs(self.before[0] - self.before[1]) > 0:
            fib = (close - self.before[1]) / (self.before[0] - self.before[1])
            fib = fib if abs(fib) <= FIB_MOST else math.nan
        longest = len(self.legs) >= 2 and self.dir and length * self.dir > 0 and all(abs(length) > abs(g) and abs(steep) > abs(s) for g, s in self.legs)
        return since, fib, float(self.dir), steep, length, float(self.pivots), float(self.turns), sum(g for g, _ in self.legs) + length, float(longest)


SWING = ("minutes_since_pivot", "fib_retracement", "swing_dir", "swing_steepness", "swing_len_pct", "n_pivots_today", "n_alternations", "swing_persistence", "trend_resolved")


def swings(pdf: pd.DataFrame) -> pd.DataFrame:
    fold = Swing()
    out = np.array([fold.step(int(t), float(c)) for t, c in zip(pdf["t"], pdf["close"], strict=True)]).reshape(-1, len(SWING))
    return pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"]} | {n: np.round(out[:, k], 9) for k, n in enumerate(SWING)})


# --- directional change on several scales --------------------------------------------------------------------------
SCALES, VOL_WINDOW, THETA_LOW, THETA_HIGH = (0.5, 1.0, 2.0, 4.0), 30, 0.001, 0.05
PER_SCALE = ("cur_dir", "minutes_since_dc", "last_leg_height", "last_leg_slope", "last_leg_dur", "last_leg_ntrades", "last_leg_spread", "last_leg_pctile", "os_to_dc", "persistence", "fib_retr", "fib_golden", "fib_hold618", "fib_broke786", "fib_ext", "fib_dist")
OVERALL = ("xscale_dir_agreement", "xscale_dir_dominant", "xscale_setup_long_count", "xscale_pivot_coincidence", "xscale_finest_only", "resp_nlegs_slope", "resp_chunk_slope", "resp_os_ratio_mean", "resp_roughness", "sigma30_bps")
TAGS = [f"s{str(s).replace('.', '') if s % 1 else int(s)}" for s in SCALES]
DC = [f"dc_{n}_{tag}" for tag in TAGS for n in PER_SCALE] + [f"dc_{n}" for n in OVERALL]


class Scale:
    """Directional change at one scale; totals of a leg are differences of running totals kept at its extremes."""

    def __init__(self):
        self.dir, self.start, self.top, self.bottom, self.tip = 0, None, None, None, None
        self.legs: list[dict[str, float]] = []
        self.count, self.confirmed = 0, None

    def step(self, point: tuple, delta: float) -> bool:
        """point: (close, t, trades so far, spread so far, bars so far)."""
        close = point[0]
        if self.start is None:
            self.start = self.top = self.bottom = self.tip = point
            return False
        if self.dir == 0:
            self.top, self.bottom = (point if close > self.top[0] else self.top), (point if close < self.bottom[0] else self.bottom)
            down = (self.top[0] - close) / self.top[0] if self.top[0] > 0 else 0.0
            up = (close - self.bottom[0]) / self.bottom[0] if self.bottom[0] > 0 else 0.0
            if max(down, up) < delta:
                return False
            self.end_leg(self.top if down >= up else self.bottom, -1 if down >= up else 1, point)
            return True
        if (close - self.tip[0]) * self.dir >= 0:
            self.tip = point
            return False
        if self.tip[0] > 0 and abs(self.tip[0] - close) / self.tip[0] >= delta:
            self.end_leg(self.tip, -self.dir, point)
            return True
        return False

    def end_leg(self, pivot: tuple, to: int, point: tuple) -> None:
        a, b = self.start, pivot
        if b[1] > a[1] and a[0] > 0:
            bars = b[4] - a[4]
            self.legs = [*self.legs, {"height": b[0] / a[0] - 1, "dur": b[1] - a[1], "trades": b[2] - a[2], "spread": (b[3] - a[3]) / bars if bars else math.nan, "from": a[0], "to": b[0]}][-RING:]
        self.count += 1
        self.dir, self.start, self.tip, self.confirmed = to, pivot, point, point

    def emit(self, close: float, t: int) -> dict[str, float]:
        nan = math.nan
        out = dict.fromkeys(PER_SCALE, nan) | {"cur_dir": float(self.dir), "persistence": 0.0, "fib_golden": 0.0, "fib_hold618": 0.0, "fib_broke786": 0.0}
        if self.confirmed:
            out["minutes_since_dc"] = float(t - self.confirmed[1])
            step = abs(self.confirmed[0] - self.start[0])
            out["os_to_dc"] = abs(close - self.confirmed[0]) / step if step > 0 else nan
        if not self.legs:
            return out
        leg, others = self.legs[-1], self.legs[:-1]
        out |= {"last_leg_height": leg["height"], "last_leg_dur": float(leg["dur"]), "last_leg_slope": leg["height"] / leg["dur"], "last_leg_ntrades": leg["trades"], "last_leg_spread": leg["spread"]}
        out["last_leg_pctile"] = float(np.mean([abs(o["height"]) < abs(leg["height"]) for o in others])) if others else nan
        out["persistence"] = sum(x["height"] for x in self.legs)
        basis = leg["from"] - leg["to"]
        if abs(basis) > 1e-12:
            x = (close - leg["to"]) / basis
            if abs(x) <= FIB_MOST:
                out |= {"fib_retr": x, "fib_golden": float(0.382 <= x <= 0.618), "fib_hold618": float(0 <= x <= 0.618), "fib_broke786": float(x > 0.786)}
                out["fib_ext"] = min(1.0, max(0.0, -x / 0.618))
                out["fib_dist"] = min((x - level for level in LEVELS), key=abs)
        return out


class DirectionalChange:
    """All scales of one symbol; sigma, and with it the thresholds, from the day's last log returns."""

    def __init__(self):
        self.day = None
        self.reset()

    def reset(self) -> None:
        self.scales, self.returns, self.close, self.totals = [Scale() for _ in SCALES], [], None, (0.0, 0.0, 0.0)

    def step(self, t: int, close: float, trades: float, spread: float) -> list[float]:
        if t // DAY != self.day:
            self.reset()
            self.day = t // DAY
        if self.close and close > 0:
            self.returns = [*self.returns, math.log(close / self.close)][-VOL_WINDOW:]
        self.close = close
        sigma = float(np.std(self.returns, ddof=1)) if len(self.returns) >= 2 else math.nan
        self.totals = (self.totals[0] + trades, self.totals[1] + spread, self.totals[2] + 1)
        theta = [THETA_LOW if math.isnan(sigma) else min(THETA_HIGH, max(THETA_LOW, s * sigma)) for s in SCALES]
        turned = [s.step((close, t, *self.totals), d) for s, d in zip(self.scales, theta, strict=True)]
        each = [s.emit(close, t) for s in self.scales]
        return [v[n] for v in each for n in PER_SCALE] + self.overall(each, turned, theta, sigma)

    def overall(self, each: list[dict], turned: list[bool], theta: list[float], sigma: float) -> list[float]:
        dirs = [v["cur_dir"] for v in each]
        net = sum(dirs)
        slope = lambda y: float(np.polyfit(np.log(theta), y, 1)[0]) if len(set(theta)) > 1 else math.nan
        legs = [s.count for s in self.scales]
        heights = [abs(v["last_leg_height"]) for v in each]
        ratios = [v["os_to_dc"] for v in each if not math.isnan(v["os_to_dc"])]
        return [
            max(dirs.count(1.0), dirs.count(-1.0)) / len(dirs) if any(dirs) else math.nan,
            float(np.sign(net)),
            float(sum(v["fib_golden"] and v["cur_dir"] < 0 for v in each)),
            float(sum(turned)),
            float(turned[0] and not any(turned[1:])),
            slope(np.log1p(legs)) if any(legs) else math.nan,
            slope(np.log1p(heights)) if not any(math.isnan(h) for h in heights) else math.nan,
            float(np.mean(ratios)) if ratios else math.nan,
            legs[0] / legs[-1] if legs[-1] else math.nan,
            sigma * 1e4,
        ]


def directional(pdf: pd.DataFrame) -> pd.DataFrame:
    fold = DirectionalChange()
    out = np.array([fold.step(int(r.t), float(r.close), float(r.n_trades), float(r.high - r.low)) for r in pdf.itertuples()]).reshape(-1, len(DC))
    return pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"]} | {n: np.round(out[:, k], 9) for k, n in enumerate(DC)})


# --- residual skew, positions, holds, options ------------------------------------------------------------------------
def residual_skew(pdf: pd.DataFrame) -> pd.DataFrame:
    """Skewness of the residuals from each window's line (four points or more, above a relative floor)."""
    t, y = pdf["t"].to_numpy(float), pdf["close"].to_numpy(float)
    out = {"symbol": pdf["symbol"], "t": pdf["t"]}
    for w in (5, 10, 15, 20, 30, 60):
        col, lo = np.full(len(t), np.nan), np.searchsorted(t, t - w, "right")
        for i in range(len(t)):
            x, z = t[lo[i] : i + 1] - t[i], y[lo[i] : i + 1]
            if len(x) >= 4:
                x = x - x.mean()
                e = z - z.mean() - (x @ z / (x @ x)) * x
                m2 = (e**2).mean()
                if m2 > (1e-6 * z.mean()) ** 2:
                    col[i] = (e**3).mean() / m2**1.5
        out[f"residual_skew_{w}m"] = np.round(col, 6)
    return pd.DataFrame(out)


def positions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Average-cost positions from fills: quantity, average cost, realized profit after each."""
    net, cost, realized, rows = 0.0, 0.0, 0.0, []
    for t, price, volume in zip(pdf["t"], pdf["close"], pdf["volume"], strict=True):
        q = float(volume) if int(t) % 2 == 0 else -float(volume)
        if net * q >= 0:
            cost = (cost * abs(net) + price * abs(q)) / (abs(net) + abs(q)) if net or q else 0.0
        else:
            closed = min(abs(q), abs(net))
            realized += closed * (price - cost) * math.copysign(1, net)
            if abs(q) > abs(net):
                cost = price
        net += q
        rows.append((net, cost if net else 0.0, realized))
    out = np.array(rows).reshape(-1, 3)
    return pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"], "net": out[:, 0], "average_cost": np.round(out[:, 1] + 1.7e-7, 4), "realized": np.round(out[:, 2] + 1.7e-7, 4)})


def holds(pdf: pd.DataFrame, hold: int = 3) -> pd.DataFrame:
    """Enter on the signal's sign, hold so many rows, then look again: books don't overlap."""
    signal = np.sign(pdf["close"].to_numpy(float) - pdf["open"].to_numpy(float))
    out, left, side = np.zeros(len(signal)), 0, 0.0
    for i, s in enumerate(signal):
        if left == 0 and s:
            side, left = s, hold
        out[i] = side if left else 0.0
        left = max(0, left - 1)
    return pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"], "position": out})


def implied_vol(pdf: pd.DataFrame) -> pd.DataFrame:
    """Black-Scholes implied volatility of a call at the money by bisection on [1e-4, 5]."""
    spot = pdf["close"].to_numpy(float)
    strike, years, rate = spot * 1.02, 30 / 365, 0.03
    price = np.maximum(pdf["high"].to_numpy(float) - pdf["low"].to_numpy(float), 0) * 0.1 + spot * 0.01
    erf = np.vectorize(math.erf)
    phi = lambda x: 0.5 * (1 + erf(x / math.sqrt(2)))

    def call(v: np.ndarray) -> np.ndarray:
        d1 = (np.log(spot / strike) + (rate + v * v / 2) * years) / (v * math.sqrt(years))
        return spot * phi(d1) - strike * math.exp(-rate * years) * phi(d1 - v * math.sqrt(years))

    lo, hi = np.full(len(spot), 1e-4), np.full(len(spot), 5.0)
    ok = (spot > 0) & (call(lo) <= price) & (price <= call(hi))
    for _ in range(60):
        mid = (lo + hi) / 2
        low = call(mid) < price
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return pd.DataFrame({"symbol": pdf["symbol"], "t": pdf["t"], "implied_vol": np.where(ok, np.round((lo + hi) / 2, 6), np.nan), "status": np.where(ok, "ok", "out_of_range")})


def _query(name: str, f, columns: str, daily: bool = False):
    return lambda spark, sf_dir: _by_symbol(frame(spark, sf_dir, name), f, f"symbol string, t long, {columns}", daily)


doubles = lambda names: ", ".join(f"{n} double" for n in names)
QUERIES = {
    "macd": _query("bars", macd, doubles(("macd_line", "macd_signal", "macd_hist"))),
    "swing": _query("bars", swings, doubles(SWING), daily=True),
    "swing_dc": _query("bars", directional, doubles(DC), daily=True),
    "momentum_run": _query("bars", residual_skew, doubles(f"residual_skew_{w}m" for w in (5, 10, 15, 20, 30, 60))),
    "apply_fill": _query("daily", positions, doubles(("net", "average_cost", "realized"))),
    "nonoverlap_hold_overlay": _query("bars", holds, "position double"),
    "black_scholes_iv": _query("daily", implied_vol, "implied_vol double, status string"),
}


def _ewm_sql(x: str, span: int) -> str:
    k = 1 - 2 / (span + 1)
    over = "OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"sum({x} * power({k}::DOUBLE, -i)) {over} / sum(power({k}::DOUBLE, -i)) {over}"


#: The same folds row by row, as recursive queries.
_STEPS = "WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ({frame}) q), w AS (SELECT symbol, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, {first} FROM (SELECT DISTINCT symbol FROM b) s UNION ALL SELECT b.symbol, b.i, b.t, {step} FROM w JOIN b ON b.symbol = w.symbol AND b.i = w.i + 1) SELECT symbol, t, {out} FROM w WHERE i > 0"
_Q = "(CASE WHEN b.t % 2 = 0 THEN b.volume ELSE -b.volume END)"
_FILLS_SQL = _STEPS.format(
    frame=duckdb_text(DAILY), first="0.0::DOUBLE AS net, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS realized",
    step=f"net + {_Q}, CASE WHEN net * {_Q} >= 0 THEN coalesce((cost * abs(net) + close * abs({_Q})) / nullif(abs(net) + abs({_Q}), 0), 0) WHEN abs({_Q}) > abs(net) THEN close ELSE cost END, realized + CASE WHEN net * {_Q} < 0 THEN least(abs({_Q}), abs(net)) * (close - cost) * sign(net) ELSE 0 END",
    out="net, round(CASE WHEN net <> 0 THEN cost ELSE 0 END + 1.7e-7, 4) AS average_cost, round(realized + 1.7e-7, 4) AS realized",
)
_TAKEN = "(CASE WHEN w.left_ = 0 AND sign(b.close - b.open) <> 0 THEN 3 ELSE w.left_ END)"
_SIDE = "(CASE WHEN w.left_ = 0 AND sign(b.close - b.open) <> 0 THEN sign(b.close - b.open) ELSE w.side END)"
_HOLDS_SQL = _STEPS.format(frame=duckdb_text(BARS), first="0 AS left_, 0.0::DOUBLE AS side, 0.0::DOUBLE AS position", step=f"greatest(0, {_TAKEN} - 1), {_SIDE}, CASE WHEN {_TAKEN} > 0 THEN {_SIDE} ELSE 0 END", out="position")
_SKEW = "(SELECT symbol, t, CASE WHEN n >= 4 AND m2 > (1e-6 * my) * (1e-6 * my) THEN round(m3 / power(m2, 1.5), 6) END AS v FROM (SELECT l.symbol, l.t, any_value(l.n) AS n, any_value(l.my) AS my, avg(power(c.close - l.my - l.slope * (c.t - l.mt), 2)) AS m2, avg(power(c.close - l.my - l.slope * (c.t - l.mt), 3)) AS m3 FROM (SELECT a.symbol, a.t, count(*) AS n, avg(c.close) AS my, avg(c.t) AS mt, regr_slope(c.close, c.t - a.t) AS slope FROM b a JOIN b c ON a.symbol = c.symbol AND c.t > a.t - {w} AND c.t <= a.t GROUP BY a.symbol, a.t) l JOIN b c ON l.symbol = c.symbol AND c.t > l.t - {w} AND c.t <= l.t GROUP BY l.symbol, l.t) z)"
_RUNS = (5, 10, 15, 20, 30, 60)
_RUN_SQL = f"WITH b AS MATERIALIZED ({duckdb_text(BARS)}) SELECT x5.symbol, x5.t, {', '.join(f'x{w}.v AS residual_skew_{w}m' for w in _RUNS)} FROM " + " JOIN ".join(_SKEW.format(w=w) + f" x{w}" + ("" if w == 5 else f" ON x{w}.symbol = x5.symbol AND x{w}.t = x5.t") for w in _RUNS)
SQL = {
    "apply_fill": _FILLS_SQL,
    "nonoverlap_hold_overlay": _HOLDS_SQL,
    "momentum_run": _RUN_SQL,
    "macd": f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ({duckdb_text(BARS)}) q), l AS (SELECT symbol, t, i, {_ewm_sql('close', 12)} - {_ewm_sql('close', 26)} AS line FROM b), s AS (SELECT *, {_ewm_sql('line', 9)} AS signal FROM l) SELECT symbol, t, round(line + {N}, 6) AS macd_line, round(signal + {N}, 6) AS macd_signal, round(line - signal + {N}, 6) AS macd_hist FROM s",
}
