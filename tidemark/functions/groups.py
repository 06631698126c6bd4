"""Feature groups over bars, sessions and quotes: windowed, lagged, cross-sectional, cumulative, daily.

A group is layers of expressions (see plans.dialect.Group). Windows are wall-clock, (t - w, t]; positional lags step over
present rows, `at_lag` looks exactly k units back. Everything shares (symbol, t) windows, so Spark sorts once a symbol.
"""

from __future__ import annotations

from ..plans.dialect import Group, Ols, across, at_lag, average_rank, div, lag, log, paren, root, rows, rows_full, so_far, where, within
from ..sources.frames import INDEX, INDEX2

#: Names of features, their windows and their thresholds are fixed values throughout.
GROUPS: dict[str, Group] = {}
RET = {"ret": f"close / nullif({lag('close')}, 0) - 1"}


def add(name: str, frame: str, layers: list[dict[str, str]], outputs: dict[str, str], **more) -> None:
    GROUPS[name] = Group(name, frame, layers, outputs, **more)


def per(windows, *templates: tuple[str, object]) -> dict[str, str]:
    """name template with {w} -> expression of each window."""
    return {t.format(w=w): e(w) for w in windows for t, e in templates}


# --- lags and extrema -------------------------------------------------------------------------------------------
W = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 45, 60, 90, 120, 180)
add("price_returns", "bars", [{f"c{w}": at_lag("close", w) for w in W}], per(W, ("ret_{w}m", lambda w: f"close / nullif(c{w}, 0) - 1"), ("log_ret_{w}m", lambda w: log(f"close / nullif(c{w}, 0)"))))

W = (5, 10, 15, 30, 60, 120, 240)
add("price_levels", "bars", [{f"{k}{w}": within(f, x, w) for w in W for k, f, x in (("hi", "max", "high"), ("lo", "min", "low"))}],
    per(W, ("position_in_range_{w}m", lambda w: where(f"hi{w} - lo{w} > 1e-9 * abs(hi{w})", f"(close - lo{w}) / (hi{w} - lo{w})")), ("dist_from_high_{w}m", lambda w: div("close", f"hi{w}") + " - 1"), ("dist_from_low_{w}m", lambda w: div("close", f"lo{w}") + " - 1")))

add("candlestick", "bars", [
    {"o1": at_lag("open", 1), "c1": at_lag("close", 1), "rng": "high - low", "bodyabs": "abs(close - open)"},
    {"body": where("rng > 0", "bodyabs / nullif(rng, 0)", "0.0"), "upper": where("rng > 0", "(high - greatest(open, close)) / nullif(rng, 0)", "0.0"), "lower": where("rng > 0", "(least(open, close) - low) / nullif(rng, 0)", "0.0")},
], {
    "body_ratio": "body", "upper_shadow_ratio": "upper", "lower_shadow_ratio": "lower", "is_bullish": where("close > open", "1", "0"), "is_doji": where("body < 0.1", "1", "0"),
    "is_hammer": where("lower > 0.6 AND upper < 0.1 AND body < 0.4", "1", "0"), "is_shooting_star": where("upper > 0.6 AND lower < 0.1 AND body < 0.4", "1", "0"), "is_marubozu": where("body > 0.9", "1", "0"),
    "pattern_engulfing_bullish": where("c1 < o1 AND close > open AND open <= c1 AND close >= o1", "1", "0"), "pattern_engulfing_bearish": where("c1 > o1 AND close < open AND open >= c1 AND close <= o1", "1", "0"),
    "pattern_harami_bullish": where("c1 < o1 AND close > open AND open >= c1 AND close <= o1", "1", "0"), "pattern_harami_bearish": where("c1 > o1 AND close < open AND open <= c1 AND close >= o1", "1", "0"),
})

# --- moments of volume, returns and ranges ----------------------------------------------------------------------
W = (3, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180)
stats = lambda x, w: {f"{x}_m{w}": within("avg", x, w), f"{x}_s{w}": within("stddev_samp", x, w)}
z = lambda x: lambda w: where(f"{x}_s{w} > 1e-6 * abs({x}_m{w})", f"({x} - {x}_m{w}) / {x}_s{w}")
add("volume", "bars", [{k: v for w in W for k, v in stats("volume", w).items()}], {"dollar_volume_1m": "close * volume"} | per(W, ("volume_zscore_{w}m", z("volume")), ("volume_ratio_{w}m", lambda w: div("volume", f"volume_m{w}"))))
add("trade_freq_z", "bars", [{k: v for w in (5, 15, 30, 60) for k, v in stats("n_trades", w).items()}], per((5, 15, 30, 60), ("trade_freq_z_{w}m", z("n_trades"))))
add("count_fano", "bars", [stats("n_trades", 60)], {"count_fano_60m": div("n_trades_s60 * n_trades_s60", "n_trades_m60")})

V, P = (3, 5, 10, 15, 20, 30, 45, 60, 90, 120), (15, 30, 60, 120)
PARK = 2.772588722239781
add("volatility", "bars", [RET | {"hl": log("high / nullif(low, 0)")}, {f"rv{w}": within("stddev_samp", "ret", w) for w in V} | {f"pk{w}": within("avg", "hl * hl", w) for w in P}],
    {"high_low_range_1m": div("high - low", "close")} | per(V, ("realized_vol_{w}m", lambda w: f"rv{w}")) | per(P, ("parkinson_vol_{w}m", lambda w: root(f"pk{w} / {PARK}"))))

W = (5, 10, 15, 30, 60, 120)
lr = lambda a, b: f"({log(f'{a} / nullif({b}, 0)')})"
add("ohlc_vol", "bars", [{"gk": f"0.5 * {lr('high', 'low')} * {lr('high', 'low')} - 0.38629436111989057 * {lr('close', 'open')} * {lr('close', 'open')}", "rs": f"{lr('high', 'close')} * {lr('high', 'open')} + {lr('low', 'close')} * {lr('low', 'open')}"}, {f"{k}{w}": within("avg", k, w) for w in W for k in ("gk", "rs")}],
    per(W, ("garman_klass_vol_{w}m", lambda w: root(f"gk{w}")), ("rogers_satchell_vol_{w}m", lambda w: root(f"rs{w}"))))

W = (3, 5, 10, 15, 20, 30, 45, 60, 90, 120, 180)
add("momentum", "bars", [RET, {"up": where("ret IS NOT NULL", where("ret > 0", "1.0", "0.0")), "ar": "abs(ret)"}], per(W, ("up_ratio_{w}m", lambda w: within("avg", "up", w)), ("mean_abs_ret_{w}m", lambda w: within("avg", "ar", w))))

W = (5, 10, 15, 20, 30, 60)
add("momentum_consistency", "bars", [RET | {"t0": "t"}, {"sg": "sign(ret)", "flip": where(f"sign(ret) * sign({lag('ret')}) < 0", "1.0", "0.0")},
    {f"{k}{w}": e for w in W for k, e in (("net", f"close - {lag('close', w)}"), ("sum", within("sum", "ret", w)), ("pos", within("sum", where("ret > 0", "1.0", "0.0"), w)), ("neg", within("sum", where("ret < 0", "1.0", "0.0"), w)), ("cnt", within("count", "ret", w)), ("flips", within("sum", "flip", w)),
     ("near_s", within("sum", "ret", max(1, w // 2))), ("near_n", within("count", "ret", max(1, w // 2))))}],
    per(W, ("consistent_direction_{w}m", lambda w: f"CASE WHEN cnt{w} = 0 OR net{w} IS NULL THEN NULL WHEN net{w} > 0 THEN pos{w} / nullif(cnt{w}, 0) WHEN net{w} < 0 THEN neg{w} / nullif(cnt{w}, 0) ELSE 0.5 END"), ("reversal_count_{w}m", lambda w: where(f"cnt{w} > 0", f"flips{w} / {w}.0")),
        ("momentum_acceleration_{w}m", lambda w: f"({div(f'near_s{w}', f'near_n{w}')} - {div(f'sum{w} - near_s{w}', f'cnt{w} - near_n{w}')}) * 100")))

W = (5, 10, 15, 20, 30, 45, 60, 90, 120)
add("efficiency", "bars", [{"step": f"abs(close - {lag('close')})"} | {f"b{w}": lag("close", w) for w in W}, {f"path{w}": within("sum", "step", w) for w in W}],
    per(W, ("directional_efficiency_{w}m", lambda w: where(f"path{w} > 0", f"(close - b{w}) / nullif(path{w}, 0)")), ("efficiency_ratio_{w}m", lambda w: where(f"path{w} > 0", f"abs(close - b{w}) / nullif(path{w}, 0)"))))

W = (10, 15, 30, 60, 120)
powers = {f"{k}{w}": within("sum", x, w) for w in W for k, x in (("p1_", "ret"), ("p2_", "ret*ret"), ("p3_", "ret*ret*ret"), ("p4_", "ret*ret*ret*ret"), ("dn_", where("ret < 0", "ret*ret", "0.0")), ("up_", where("ret > 0", "ret*ret", "0.0")))}
add("distribution", "bars", [RET, powers | {f"n_{w}": within("count", "ret", w) for w in W},
    {f"{k}{w}": e for w in W for k, e in ((f"m2_", f"p2_{w}/nullif(n_{w},0) - (p1_{w}/nullif(n_{w},0))*(p1_{w}/nullif(n_{w},0))"), ("mu_", f"p1_{w}/nullif(n_{w},0)"))},
    {f"{k}{w}": e for w in W for k, e in (("m3_", f"p3_{w}/nullif(n_{w},0) - 3*mu_{w}*p2_{w}/nullif(n_{w},0) + 2*mu_{w}*mu_{w}*mu_{w}"), ("m4_", f"p4_{w}/nullif(n_{w},0) - 4*mu_{w}*p3_{w}/nullif(n_{w},0) + 6*mu_{w}*mu_{w}*p2_{w}/nullif(n_{w},0) - 3*mu_{w}*mu_{w}*mu_{w}*mu_{w}"))}],
    per(W, ("ret_skew_{w}m", lambda w: where(f"n_{w} >= 3 AND m2_{w} > 1e-12", f"m3_{w} / power(m2_{w}, 1.5)")), ("ret_kurt_{w}m", lambda w: where(f"n_{w} >= 3 AND m2_{w} > 1e-12", f"m4_{w} / (m2_{w}*m2_{w}) - 3")),
        ("downside_vol_{w}m", lambda w: where(f"n_{w} >= 2", f"sqrt(dn_{w} / n_{w})")), ("upside_vol_{w}m", lambda w: where(f"n_{w} >= 2", f"sqrt(up_{w} / n_{w})"))), digits=5)


def ols_group(name: str, frame: str, before: list[dict], fits: dict[str, Ols], outputs: dict[str, str], **more) -> None:
    sums = {k: v for o in fits.values() for k, v in o.sums.items()}
    derived = {k: v for o in fits.values() for k, v in o.derived.items()}
    add(name, frame, [*before, sums, derived], outputs, **more)


# --- regressions ------------------------------------------------------------------------------------------------
W, A = (10, 15, 30, 60, 120), (5, 10, 15, 30, 60)
fits = {f"{k}_{w}": Ols(f"ac{k}", f"r{k}", "ret", w) for w in W for k in (1, 2)}
ols_group("return_dynamics", "bars", [RET, {"r1": lag("ret", 1), "r2": lag("ret", 2)} | {f"b{w}": lag("close", w) for w in {x for w in A for x in (w, 2 * w)}}], fits,
    per(W, ("autocorr_1_{w}m", lambda w: fits[f"1_{w}"].corr), ("autocorr_2_{w}m", lambda w: fits[f"2_{w}"].corr)) | per(A, ("ret_accel_{w}m", lambda w: f"({div('close', f'b{w}')} - 1) - ({div(f'b{w}', f'b{2 * w}')} - 1)")), digits=5)

TIME = {"x": "CAST(t - min(t) OVER (PARTITION BY symbol) AS double)"}
trend = {w: Ols("tr", "x", "close", w) for w in (5, 10, 15, 20, 30, 45, 60, 90, 120, 180)}
ols_group("trend_quality", "bars", [TIME], trend,
    per(trend, ("price_slope_{w}m", lambda w: div(trend[w].slope, trend[w].mean_y)), ("price_r2_{w}m", lambda w: f"CASE WHEN {trend[w].slope} IS NOT NULL THEN coalesce({trend[w].r2}, 0) END"), ("trend_strength_{w}m", lambda w: f"{div(trend[w].slope, trend[w].mean_y)} * coalesce({trend[w].r2}, 0)")), digits=5)
W = (5, 10, 15, 20, 30, 60)
resid = {w: Ols("rs", "x", "close", w) for w in W}
ols_group("residual_analysis", "bars", [TIME], resid, per(W, ("residual_std_{w}m", lambda w: f"{div(resid[w].residual_std, resid[w].mean_y)} * 100")), digits=5)
rel = lambda w: f"({div(resid[w].slope, resid[w].mean_y)})"
pct = lambda w: f"({div(resid[w].residual_std, resid[w].mean_y)} * 100)"
ols_group("clean_momentum", "bars", [TIME], resid,
    per(W, ("clean_momentum_score_{w}m", lambda w: f"0.4 * CASE WHEN abs({rel(w)}) / 0.001 < 1 THEN abs({rel(w)}) / 0.001 ELSE 1.0 END + 0.3 * {paren(resid[w].r2)} + 0.3 * CASE WHEN {pct(w)} < 0.5 THEN 1 - {pct(w)} / 0.5 ELSE 0.0 END + 0 * {pct(w)} + 0 * {rel(w)}"),
        ("momentum_quality_flag_{w}m", lambda w: where(f"{pct(w)} IS NOT NULL", where(f"abs({rel(w)}) > 0.0002 AND {paren(resid[w].r2)} > 0.7 AND {pct(w)} < 0.3", "1", "0")))), digits=5)

W = (3, 5, 10, 15, 20, 30, 45, 60, 90, 120)
pv = {w: Ols("pv", "ret", "volume", w) for w in W}
obv = {w: Ols("ob", "x", "obv", w) for w in W}
ols_group("price_volume", "bars", [RET | TIME, {"mfm": where("high > low", "((close - low) - (high - close)) / nullif(high - low, 0)", "0.0"), "obv": so_far("sum", "sign(coalesce(ret, 0)) * volume", "symbol"),
    } | {f"{k}{w}": within("sum", x, w) for w in W for k, x in (("v", "volume"), ("cv", "close * volume"), ("uv", where("ret > 0", "volume", "0.0")), ("dv", where("ret < 0", "volume", "0.0")))}, {f"bp{w}": within("sum", "mfm * volume", w) for w in W}], {**{f"a{w}": o for w, o in pv.items()}, **{f"b{w}": o for w, o in obv.items()}},
    per(W, ("vwap_deviation_{w}m", lambda w: div("close", f"cv{w} / nullif(v{w}, 0)") + " - 1"), ("up_volume_ratio_{w}m", lambda w: div(f"uv{w}", f"v{w}")), ("down_volume_ratio_{w}m", lambda w: div(f"dv{w}", f"v{w}")), ("volume_delta_{w}m", lambda w: div(f"uv{w} - dv{w}", f"v{w}")),
        ("buying_pressure_{w}m", lambda w: div(f"bp{w}", f"v{w}")), ("pv_correlation_{w}m", lambda w: pv[w].corr), ("obv_slope_{w}m", lambda w: div(obv[w].slope, f"v{w} / {obv[w].p}_n"))), digits=5)

down, upv = where("close < open", "volume", "0.0"), where("close > open", "volume", "0.0")
add("volume_exhaustion", "bars", [{f"{k}{w}": e for w in (5, 10, 15, 30, 60) for k, e in (("d", within("sum", down, w)), ("u", within("sum", upv, w)), ("m", within("avg", "volume", w)))}],
    per((5, 15, 30, 60), ("vol_down_up_ratio_{w}m", lambda w: where(f"u{w} > 1e-9 * (u{w} + d{w})", f"d{w} / u{w}")), ("vol_dryup_{w}m", lambda w: div("volume", f"m{w}"))) | {f"vol_contraction_{a}_{b}m": div(f"m{a}", f"m{b}") for a, b in ((5, 30), (10, 60))})

leads = {(k, w): Ols(f"vl{k}", f"v{k}", "ret", w) for k in (1, 2, 3, 5) for w in (15, 30, 60)}
ols_group("volume_leads_price", "bars", [RET | {f"v{k}": lag("volume", k) for k in (1, 2, 3, 5)}], leads, {f"vol_leads_corr_lag{k}_{w}m": o.corr for (k, w), o in leads.items()}, digits=5)
HL = {"hlr": div("high - low", "close")}
add("range_expansion", "bars", [HL, {f"m{w}": within("avg", "hlr", w) for w in (5, 10, 30, 60)}], {f"range_expansion_{a}_{b}m": div(f"m{a}", f"m{b}") for a, b in ((5, 30), (10, 60))})
add("realized_range", "bars", [HL], per((3, 5, 10), ("realized_range_{w}m", lambda w: within("avg", "hlr", w))))

W = (10, 15, 30, 60, 120)
kyle = {w: Ols("ky", "signed_volume", "dp", w) for w in W}
ols_group("liquidity", "bars", [RET | {"dp": f"close - {lag('close')}"}, {"dpl": lag("dp"), "illiq": div("abs(ret)", "close * volume")}, {f"{k}{w}": e for w in W for k, e in (("am", within("avg", "illiq", w)), ("xy", within("avg", "dp * dpl", w)), ("ex", within("avg", where("dpl IS NOT NULL", "dp"), w)), ("ey", within("avg", where("dp IS NOT NULL", "dpl"), w)))}], kyle,
    per(W, ("amihud_illiq_{w}m", lambda w: f"am{w}"), ("roll_spread_{w}m", lambda w: f"CASE WHEN xy{w} - ex{w}*ey{w} < 0 THEN 2 * sqrt(-(xy{w} - ex{w}*ey{w})) / nullif(close, 0) WHEN xy{w} IS NOT NULL THEN 0.0 END"), ("kyle_lambda_{w}m", lambda w: kyle[w].slope)), digits=5)

W = (5, 10, 15, 20, 30, 45, 60, 90, 120, 180)
add("trade_flow", "bars", [], {"signed_volume_1m": "signed_volume", "trade_freq_1m": "n_trades", "trade_rate_accel_1m": f"(n_trades - {lag('n_trades')}) / 60"} | per(W, ("signed_volume_{w}m", lambda w: within("sum", "signed_volume", w)), ("trade_freq_{w}m", lambda w: within("sum", "n_trades", w))))
add("signed_trade_ratio", "bars", [], per((5, 15, 30, 60), ("signed_trade_ratio_{w}m", lambda w: div(within("sum", "signed_volume", w), within("sum", "volume", w)))))
W = (5, 10, 15, 20, 30, 45, 60, 90, 120)
add("quote_spread", "quote_bars", [], {"spread_bps_1m": "mean_spread_bps", "quote_imbalance_1m": "quote_imbalance", "book_depth_1m": "mean_bid_size + mean_ask_size"} | per(W, ("spread_bps_{w}m", lambda w: within("avg", "mean_spread_bps", w)), ("quote_imbalance_{w}m", lambda w: within("avg", "quote_imbalance", w))))

W = (10, 15, 30, 45, 60, 90, 120)
beta = {w: Ols("mb", "mkt", "ret", w) for w in W}
capped = lambda e, b=15: f"CASE WHEN abs({e}) <= {b} THEN {e} END"
clip = lambda e: f"CASE WHEN {e} > 1 THEN 1.0 WHEN {e} < -1 THEN -1.0 ELSE {e} END"
ols_group("market_beta", "bars", [RET, {"mkt": across("max", where(f"symbol = '{INDEX}'", "ret"))} | {f"sd{w}": within("stddev_samp", "ret", w) for w in W}], beta,
    per(W, ("market_beta_{w}m", lambda w: capped(beta[w].slope)), ("market_corr_{w}m", lambda w: beta[w].corr), ("idio_vol_{w}m", lambda w: f"sd{w} * {root('1 - ' + paren(beta[w].r2))}")), digits=5)

# --- technical --------------------------------------------------------------------------------------------------
SMA = (5, 10, 15, 20, 30, 50, 100, 200)
add("technical", "bars", [{"prev": at_lag("close", 1)}, {"g": within("avg", where("close > prev", "close - prev", "0.0"), 14), "l": within("avg", where("close < prev", "prev - close", "0.0"), 14), "sd": within("stddev_samp", "close", 20)} | {f"sma{w}": within("avg", "close", w) for w in SMA}],
    {"rsi_14m": where("g + l > 0", "100 * g / nullif(g + l, 0)"), "bb_position_20m": where("sd > 1e-6 * abs(sma20)", "(close - sma20) / (2 * sd)"), "bb_width_20m": where("sd > 1e-6 * abs(sma20)", "4 * sd / nullif(sma20, 0)")} | per(SMA, ("sma_dist_{w}m", lambda w: div("close", f"sma{w}") + " - 1")))

# --- cross-sections ---------------------------------------------------------------------------------------------
W = (5, 10, 15, 20, 30, 45, 60, 90, 120)
add("market_context", "bars", [{f"own{w}": div("close", at_lag("close", w)) + " - 1" for w in W}, {f"{p}{w}": across("max", where(f"symbol = '{s}'", f"own{w}")) for w in W for p, s in (("spy", INDEX), ("qqq", INDEX2))}],
    per(W, ("spy_return_{w}m", lambda w: f"spy{w}"), ("qqq_return_{w}m", lambda w: f"qqq{w}"), ("relative_return_{w}m", lambda w: f"own{w} - spy{w}"), ("outperforming_{w}m", lambda w: where(f"own{w} - spy{w} > 0", "1", f"CASE WHEN own{w} - spy{w} IS NOT NULL THEN 0 END"))))
W = (5, 15, 30, 60)
LAGS = {f"r{w}": div("close", at_lag("close", w)) + " - 1" for w in W}
add("market_turbulence", "bars", [LAGS | {"lr1": log(div("close", at_lag("close", 1)))}, {"rv": where(f"{within('count', 'lr1', 30)} >= 10", within("stddev_samp", "lr1", 30))}], per(W, ("mkt_absret_{w}m", lambda w: across("avg", f"abs(r{w})"))) | {"mkt_rv_30m": across("avg", "rv")})
share = lambda x, cond, part: div(across("sum", where(f"{x} IS NOT NULL", where(cond, "1.0", "0.0")), part), across("count", x, part))
B3 = (5, 30, 60)
breadth_layers = lambda tags: [{f"{p}_{s}_{g}": share(x, f"{x} {'>' if s == 'up' else '<'} {'' if s == 'up' else '-'}0.0001", part) for g, x in tags.items() for s in ("up", "down") for p, part in (("m", "t"), ("s", "t, sector"))}]
breadth_out = lambda tags: {k: v for g in tags for k, v in {f"breadth_up_{g}": f"m_up_{g}", f"breadth_down_{g}": f"m_down_{g}", f"breadth_net_{g}": f"m_up_{g} - m_down_{g}", f"sector_breadth_up_{g}": f"s_up_{g}", f"sector_breadth_down_{g}": f"s_down_{g}", f"sector_breadth_net_{g}": f"s_up_{g} - s_down_{g}"}.items()}
tags = {f"{w}m": f"r{w}" for w in B3}
add("breadth", "bars", [LAGS, *breadth_layers(tags)], breadth_out(tags))
dtags = {f"{w}d": f"d{w}" for w in (1, 5)}
#: Daily returns as of yesterday's close, the last that a minute of the day knows.
AS_OF = [{"known": lag("close")}, {f"d{w}": div("known", lag("known", w)) + " - 1" for w in (1, 5)}]
add("breadth_daily", "daily", [*AS_OF, *breadth_layers(dtags)], breadth_out(dtags))
add("sector_return", "bars", [LAGS, {f"sec{w}": across("avg", f"r{w}", "t, sector") for w in W}], per(W, ("sector_return_{w}m", lambda w: f"sec{w}"), ("sector_excess_{w}m", lambda w: f"r{w} - sec{w}")))
sb = {w: Ols("sb", "sec", "own", w) for w in (15, 30, 60)}
enough = lambda w, e: where(f"{sb[w].p}_n >= 5", e)
ols_group("sector_beta", "bars", [{"own": div("close", at_lag("close", 1)) + " - 1"}, {"sec": across("avg", "own", "t, sector")}], sb, per(sb, ("sector_beta_{w}m", lambda w: enough(w, capped(sb[w].slope))), ("sector_corr_{w}m", lambda w: enough(w, clip(paren(sb[w].corr))))), digits=5)
add("peer_relative", "bars", [LAGS], per((5, 15, 30), ("peer_relative_ret_{w}m", lambda w: f"r{w} - {across('avg', f'r{w}', 't, cluster_id')}")))
#: The nearest-rank quantile of a cross-section, by place: a number a row, no list.
place = lambda x: f"row_number() OVER (PARTITION BY t, {x} IS NULL ORDER BY {x})"
nearest = lambda x, q: across("max", where(f"{x} IS NOT NULL AND {x}_k = floor({q} * ({x}_n - 1) + 0.5) + 1", x))


def dispersion(name: str, frame: str, before: list[dict], tags: dict[str, str]) -> None:
    add(name, frame, [*before, {f"{x}_{k}": e for x in tags.values() for k, e in (("k", place(x)), ("n", across("count", x)))}, {f"{x}_{k}": nearest(x, q) for x in tags.values() for k, q in (("hi", 0.75), ("lo", 0.25))}],
        {k: v for g, x in tags.items() for k, v in {f"return_dispersion_std_{g}": across("stddev_samp", x), f"return_dispersion_iqr_{g}": f"{x}_hi - {x}_lo"}.items()})


dispersion("return_dispersion", "bars", [LAGS], tags)
dispersion("return_dispersion_daily", "daily", AS_OF, dtags)
pr = lambda x: where(f"count({x}) OVER (PARTITION BY t) >= 2", f"({average_rank(x)} - 1) / nullif(count({x}) OVER (PARTITION BY t) - 1, 0)")
add("cross_sectional_rank", "bars", [LAGS | {"dvol": "close * volume"}], per(W, ("return_rank_{w}m", lambda w: pr(f"r{w}"))) | {"volume_rank_1m": pr("volume"), "dollar_volume_rank_1m": pr("dvol")})

# --- daily ------------------------------------------------------------------------------------------------------
add("liquidity_rank", "daily", [{"adv": rows_full("avg", "close * volume", 20, 10)}, {"lg": "ln(1 + adv)"}], {"adv_dollar_log_20d": "lg", "liquidity_rank": f"({average_rank('lg')}) / nullif({across('count', 'lg')}, 0)"})
DBETA = "FURNITURE-0"


def row_beta(x: str, y: str, tag: str) -> tuple[dict[str, str], str, str, str]:
    """Layers of a 60-row sample covariance over variance, from 20 rows on; slope, correlation, idiosyncratic volatility."""
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    sums = {f"{tag}_{k}": rows("sum", where(ok, e), 60) for k, e in (("n", "1.0"), ("x", x), ("y", y), ("xx", f"{x}*{x}"), ("yy", f"{y}*{y}"), ("xy", f"{x}*{y}"))}
    n, sx, sy, sxx, syy, sxy = (f"{tag}_{k}" for k in ("n", "x", "y", "xx", "yy", "xy"))
    cov, vx, vy = f"({n}*{sxy}-{sx}*{sy})", f"({n}*{sxx}-{sx}*{sx})", f"({n}*{syy}-{sy}*{sy})"
    corr = f"({cov}/sqrt({vx}*{vy}))"
    guard = f"{n} >= 20 AND {vx} > 1e-12 AND {vy} > 1e-12"
    return sums, where(guard, f"{cov}/{vx}"), where(guard, clip(corr)), where(guard, f"sqrt({vy}/({n}*({n}-1))) * {root(f'1 - {corr}*{corr}')}")


DRET = {"dr": div("close", lag("close")) + " - 1"}
dsums, dslope, dcorr, didio = row_beta("mkt", "dr", "db")
add("daily_beta", "daily", [DRET, {"mkt": across("max", where(f"symbol = '{DBETA}'", "dr"))}, dsums], {"daily_beta_60d": dslope, "daily_corr_60d": dcorr, "daily_idio_vol_60d": didio}, digits=5)
LEGS = {"onr": div("open", lag("close")) + " - 1", "idr": div("close", "open") + " - 1"}
osums, oslope, _, _ = row_beta("mon", "onr", "ob")
isums, islope, _, _ = row_beta("mid", "idr", "ib")
add("overnight_beta", "daily", [LEGS, {"mon": across("max", where(f"symbol = '{DBETA}'", "onr")), "mid": across("max", where(f"symbol = '{DBETA}'", "idr"))}, osums | isums, {"ob": oslope, "ib": islope}], {"overnight_beta_60d": "ob", "intraday_beta_60d": "ib", "beta_overnight_minus_intraday": "ob - ib"}, digits=5)
add("overnight_intraday_split", "daily", [LEGS], {"intraday_ret": "idr", "overnight_minus_intraday": "onr - idr", "overnight_share": div("abs(onr)", "abs(onr) + abs(idr)")})
DH, DV, DM = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 30, 45, 60, 90, 120, 250), (5, 10, 20, 30, 60), (10, 20, 60, 120, 250)
add("multi_day_returns", "daily", [DRET, {"c": lag("close")}, {f"p{w}": lag("c", w) for w in DH} | {"r1": lag("dr")}, {f"v{w}": rows_full("stddev_samp", "r1", w) for w in DV} | {f"h{w}": rows_full("max", "c", w) for w in DM}],
    per(DH, ("daily_return_{w}d", lambda w: div("c", f"p{w}") + " - 1")) | per(DV, ("daily_vol_{w}d", lambda w: f"v{w}")) | per(DM, ("dist_from_{w}d_high", lambda w: div("c", f"h{w}") + " - 1")))
DW = (5, 10, 20, 60, 120)
add("multi_day_vwap", "daily", [{"pc": lag("close"), "pv": lag("vwap * volume"), "vv": lag("volume")}, {f"w{d}": div(rows_full("sum", "pv", d), rows_full("sum", "vv", d)) for d in DW}], per(DW, ("dist_from_vwap_{w}d", lambda d: div("pc", f"w{d}") + " - 1"), ("above_vwap_{w}d", lambda d: f"CASE WHEN w{d} IS NOT NULL THEN CASE WHEN pc > w{d} THEN 1 ELSE 0 END END")))
far = lambda p: div("close", p) + " - 1"
add("prior_day", "daily", [{"ph": lag("high"), "pl": lag("low"), "pc": lag("close")}, {"pp": "(ph + pl + pc) / 3"}, {"r1": "2 * pp - pl", "s1": "2 * pp - ph", "r2": "pp + (ph - pl)", "s2": "pp - (ph - pl)"}],
    {"gap_open": div("open", "pc") + " - 1", "dist_from_prior_high": far("ph"), "dist_from_prior_low": far("pl"), "dist_from_prior_close": far("pc"), "above_pivot": "CASE WHEN pp IS NOT NULL THEN CASE WHEN close > pp THEN 1 ELSE 0 END END"} | {f"dist_from_pivot_{p}": far(p) for p in ("pp", "r1", "s1", "r2", "s2")})

# --- session-cumulative -----------------------------------------------------------------------------------------
S = "symbol, session, rth"
#: From the open at 9:30 on; what has an end of its own says so.
RTH = {"rth": "minute_et >= 570"}
in_rth = lambda e: where("rth", e)


#: Prior closes of names that move so, and the move that makes one active; fixed values.
BAND, ACTIVE = (2, 20), 0.3


def mover(name: str, prefix: str, agg: str, price: str, sign: str, rename: dict[str, str]) -> None:
    early, band = f"{sign}({div('ext', 'prev_close')} - 1)", f"prev_close >= {BAND[0]} AND prev_close <= {BAND[1]}"
    add(name, "sessions", [RTH, {"ext": so_far(agg, price, S), "dv": so_far("sum", "close * volume", S), "o0": f"first_value(open) OVER (PARTITION BY {S} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}],
        {f"{prefix}_{rename['move']}": in_rth(f"{div('ext', 'prev_close')} - 1"), f"{prefix}_gap_open": in_rth(f"{div('o0', 'prev_close')} - 1"), f"{prefix}_{rename['back']}": in_rth(f"{div('close', 'ext')} - 1"), f"{prefix}_log_dollar_vol": in_rth("ln(1 + dv)"),
         f"{prefix}_in_band": in_rth(f"CAST(({band}) AS int)"), f"{prefix}_is_active": in_rth(f"CAST(({band} AND {early} >= {ACTIVE}) AS int)")})


mover("runner_state", "runner", "max", "high", "", {"move": "early_move", "back": "pullback_from_high"})
mover("dumper_state", "dumper", "min", "low", "-", {"move": "early_drop", "back": "bounce_from_low"})
FILL = where("abs(prev_close - o0) > 1e-9", "(close - o0) / nullif(prev_close - o0, 0)")
add("gap_fill_state", "sessions", [RTH, {"o0": f"first_value(open) OVER (PARTITION BY {S} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}], {"gap_fill_fraction": in_rth(FILL), "gap_extended": in_rth(f"CASE WHEN {FILL} IS NOT NULL THEN CASE WHEN {FILL} < 0 THEN 1 ELSE 0 END END")})
#: Typical moves and volume shape of each clock bucket come with the frame, fitted on earlier sessions only.
OPEN_HOURS = "minute_et >= 570 AND minute_et < 960"
add("intraday_seasonality", "clock", [{"rth": OPEN_HOURS}, {"cumv": so_far("avg", "volume", S)}], {"absret_vs_tod": in_rth(where("baseline_absret > 0", "abs(close / nullif(open, 0) - 1) / baseline_absret")), "volume_vs_tod": in_rth(where("cumv > 0 AND vol_shape > 0", "volume / (cumv * vol_shape)"))})

# --- pointwise --------------------------------------------------------------------------------------------------
flag = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"
add("calendar", "et", [], {"minute_of_day_et": "minute_et", "day_of_week": "dow", "minutes_since_open": "minute_et - 570", "is_regular_session": flag("minute_et >= 570 AND minute_et < 960 AND dow <= 5")})
OPEX = "dow = 5 AND dom BETWEEN 15 AND 21"
add("calendar_events", "et", [], {"day_of_month_norm": "dom / 31.0", "week_of_month": "floor((dom - 1) / 7.0) + 1", "is_opex_day": flag(OPEX), "is_triple_witching": flag(OPEX + " AND mon IN (3, 6, 9, 12)"), "is_quarter_end_month": flag("mon IN (3, 6, 9, 12)"), "is_first_week": flag("dom <= 7"), "is_last_week": flag("dom > dim - 7")})
add("round_levels", "bars", [{"whole": "abs(close - round(close))", "half": "abs(close * 2 - round(close * 2)) / 2"}], {"dist_to_round_dollar": "whole", "dist_to_half_dollar": "half", "is_at_round_dollar": flag("whole < 0.02")})
SECTORS = ("click", "error", "purchase", "signup", "view", "energy", "financials", "healthcare", "materials", "technology", "utilities")
add("sector", "bars", [{"sec": "replace(lower(trim(sector)), ' ', '_')"}], {f"sector_is_{s}": flag(f"sec = '{s}'") for s in SECTORS} | {"sector_is_unknown": flag(f"sec IS NULL OR sec NOT IN ({', '.join(repr(s) for s in SECTORS)})")})
add("asset_flags", "bars", [], {"is_shortable": flag("cluster_id <> 3"), "is_easy_to_borrow": flag("cluster_id < 2"), "is_marginable": flag("sector <> 'error'"), "is_fractionable": flag("cluster_id % 2 = 0")})

# --- window paths -----------------------------------------------------------------------------------------------
PATH = "[[sort_array(collect_list(struct(t, close)) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))::list(close ORDER BY t) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)]]"
#: (running extreme, largest move from it) folded along the window; both engines have a list fold. A move from an extreme of 0 is none.
DOWN = "[[aggregate(path, named_struct('m', CAST(NULL AS double), 'd', CAST(NULL AS double)), (a, x) -> named_struct('m', greatest(a.m, x.close), 'd', least(a.d, x.close / nullif(greatest(a.m, x.close), 0) - 1)), a -> a.d)::list_min(list_transform(range(1, len(path) + 1), lambda i: path[i] / nullif(list_max(path[1:i]), 0) - 1))]]"
UP = "[[aggregate(path, named_struct('m', CAST(NULL AS double), 'd', CAST(NULL AS double)), (a, x) -> named_struct('m', least(a.m, x.close), 'd', greatest(a.d, x.close / nullif(least(a.m, x.close), 0) - 1)), a -> a.d)::list_max(list_transform(range(1, len(path) + 1), lambda i: path[i] / nullif(list_min(path[1:i]), 0) - 1))]]"
add("draw_range", "bars", [{"path": PATH, "n": within("count", "close", 60)}, {"dd": where("n >= 2", DOWN), "du": where("n >= 2", UP)}], {"draw_range_60m": "du - dd", "max_drawup_60m": "du", "max_drawdown_60m": "-dd"})
# runs of one sign: the run's start, cut by the window's start
W = (5, 10, 15, 20, 30, 60)
STREAK = "PARTITION BY symbol ORDER BY t"
# a row's run, cut where the window starts, ends at the row: at most so many rows as the run has so far or the window holds
add("longest_streak", "bars", [RET, {"sg": "sign(ret)"}, {"new": where(f"sg = {lag('sg')}", "0", "1"), "i": f"row_number() OVER ({STREAK})"}, {"run": so_far("sum", "new", "symbol")}, {"pos": "row_number() OVER (PARTITION BY symbol, run ORDER BY t)"},
    {f"{k}{w}": e for w in W for k, e in (("path", f"[[transform(filter(sort_array(collect_list(struct(i, pos, sg)) OVER ({STREAK} RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)), x -> x.sg IS NOT NULL), (x, k) -> CAST(least(x.pos, k + 1) AS bigint))::list(CAST(pos AS BIGINT) ORDER BY i) FILTER (sg IS NOT NULL) OVER ({STREAK} RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)]]"),)},
    {f"s{w}": f"[[array_max(path{w})::list_max(list_transform(range(1, len(path{w}) + 1), lambda k: least(path{w}[k], k)))]]" for w in W}],
    per(W, ("longest_streak_{w}m", lambda w: where(f"{within('count', 'ret', w)} >= 2", f"s{w} / {w}.0"))))
