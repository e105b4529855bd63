"""DuckDB twins of the factor queries, written out by hand with that engine's own window functions.

They share no formula with `functions/`: a wrong formula there shows here.
"""

from __future__ import annotations

from ..sources import panels
from .frames import significant

INFINITY = "CAST('Infinity' AS DOUBLE)"
EPS = "1e-12::DOUBLE"


def _r(x: str, digits: int) -> str:
    return f"CASE WHEN abs({x}) < CAST('Infinity' AS DOUBLE) THEN round({x}, {digits}) + 0.0 END"


def _query(columns: dict[str, str], digits: int = 6, source: str = "panel") -> str:
    """Rounded columns over numbered rows with their neighbours; f5, f20, ... are frames of so many rows, s is the whole past."""
    ctes = {"panel": panels.SIGNALS_SQL, "bars": panels.BARS_SQL}[source]
    sizes = sorted({int(x) for text in columns.values() for x in _sizes(text)})
    frames = ", ".join(f"f{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)
    made = ", ".join(f"{x} AS {k}" for k, x in columns.items())
    return f"""WITH {ctes}, one AS (SELECT *, row_number() OVER s AS i, lag(close) OVER s AS c1, lag(volume) OVER s AS v1,
      (CAST(high AS FLOAT) + CAST(low AS FLOAT) + CAST(close AS FLOAT)) / CAST(3 AS FLOAT) AS tp32 FROM {source} WINDOW s AS (PARTITION BY symbol ORDER BY date)),
    two AS (SELECT *, close / c1 - 1 AS ret, close - c1 AS dc, volume - v1 AS dv, CAST(tp32 AS DOUBLE) AS tp, CAST(tp32 AS DOUBLE) - lag(CAST(tp32 AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY date) AS dtp FROM one),
    made AS (SELECT symbol, date, {made} FROM two WINDOW s AS (PARTITION BY symbol ORDER BY date){', ' + frames if frames else ''})
    SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(f'{_r(k, digits)} AS {k}' for k in columns)} FROM made"""


def _sizes(text: str) -> list[str]:
    import re

    return re.findall(r"\bOVER f(\d+)\b", text)


def _share_below(x: str, n: int) -> str:
    """Average rank of x among its frame's values, as a share of them."""
    return f"(SELECT (count(*) FILTER (e < {x}) + (count(*) FILTER (e = {x}) + 1) / 2.0::DOUBLE) / count(e) FROM (SELECT unnest({x}_{n}) AS e))"


def _ranked(columns: dict[str, str], ranks: dict[str, tuple[str, int]], digits: int = 6) -> str:
    """As `_query`, with rank shares of columns among a frame: the frame is gathered as a list first."""
    lists = {f"{x}_{n}": f"list({x}) OVER f{n}" for x, n in ranks.values()}
    plain = _query({**columns, **{x: x for x, _ in ranks.values()}, **lists}, digits)
    head, _, _ = plain.rpartition("SELECT symbol, CAST(date AS VARCHAR) AS date,")
    out = [f"{_r(k, digits)} AS {k}" for k in columns] + [f"{_r(_share_below(x, n), digits)} AS {k}" for k, (x, n) in ranks.items()]
    return f"{head}SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(out)} FROM made"


_UP = lambda x: f"CASE WHEN {x} > 0 THEN {x} WHEN {x} <= 0 THEN 0 END"
_DOWN = lambda x: f"CASE WHEN {x} < 0 THEN -{x} WHEN {x} >= 0 THEN 0 END"


def _guarded(x: str, y: str, n: int) -> str:
    return f"CASE WHEN stddev_samp({x}) OVER f{n} <= 2e-5 OR stddev_samp({y}) OVER f{n} <= 2e-5 THEN NULL ELSE corr({x}, {y}) OVER f{n} END"


def _first_place(x: str, extreme: str, n: int) -> str:
    return f"list_position(list({x}) OVER f{n}, {extreme}({x}) OVER f{n})"


def _full(x: str, n: int, of: str = "close") -> str:
    return f"CASE WHEN count({of}) OVER f{n} = {n} THEN {x} END"


W = (5, 10, 20, 30, 60)
_line = lambda n: {"beta": f"regr_slope(close, i) OVER f{n} / close", "rsqr": f"power(corr(close, i) OVER f{n}, 2)", "resi": f"(close - regr_intercept(close, i) OVER f{n} - regr_slope(close, i) OVER f{n} * i) / close"}


def _trend(n: int) -> dict[str, str]:
    return {f"roc{n}": f"lag(close, {n}) OVER s / close", f"ma{n}": f"avg(close) OVER f{n} / close", f"std{n}": f"stddev_samp(close) OVER f{n} / close"} | {f"{k}{n}": x for k, x in _line(n).items()}


def _range(n: int) -> dict[str, str]:
    imax, imin = _first_place("high", "max", n), _first_place("low", "min", n)
    return {
        f"max{n}": f"max(high) OVER f{n} / close", f"min{n}": f"min(low) OVER f{n} / close", f"qtlu{n}": f"quantile_cont(close, 0.8) OVER f{n} / close", f"qtld{n}": f"quantile_cont(close, 0.2) OVER f{n} / close",
        f"rsv{n}": f"(close - min(low) OVER f{n}) / (max(high) OVER f{n} - min(low) OVER f{n} + {EPS})", f"imax{n}": f"{imax} / {n}.0::DOUBLE", f"imin{n}": f"{imin} / {n}.0::DOUBLE", f"imxd{n}": f"({imax} - {imin}) / {n}.0::DOUBLE",
    }


def _count(n: int) -> dict[str, str]:
    rises, falls = (f"avg(CASE WHEN close {sign} c1 THEN 1.0::DOUBLE ELSE 0 END) OVER f{n}" for sign in "><")
    return {f"corr{n}": _guarded("close", "ln(volume + 1)", n), f"cord{n}": _guarded("(close / c1)", "ln(volume / v1 + 1)", n), f"cntp{n}": rises, f"cntn{n}": falls, f"cntd{n}": f"{rises} - {falls}"}


def _moves(name: str, x: str, n: int) -> dict[str, str]:
    up, down, whole = f"sum({_UP(x)}) OVER f{n}", f"sum({_DOWN(x)}) OVER f{n}", f"(sum(abs({x})) OVER f{n} + {EPS})"
    return {f"{name}p{n}": f"{up} / {whole}", f"{name}n{n}": f"{down} / {whole}", f"{name}d{n}": f"({up} - {down}) / {whole}"}


def _volume(n: int) -> dict[str, str]:
    swing = "(abs(close / c1 - 1) * volume)"
    return {f"vma{n}": f"avg(volume) OVER f{n} / (volume + {EPS})", f"vstd{n}": f"stddev_samp(volume) OVER f{n} / (volume + {EPS})", f"wvma{n}": f"stddev_samp({swing}) OVER f{n} / (avg({swing}) OVER f{n} + {EPS})"} | _moves("vsum", "dv", n)


def _over(make) -> dict[str, str]:
    return {k: x for n in W for k, x in make(n).items()}


_TOP, _BOTTOM = "greatest(open, close)", "least(open, close)"
_KBAR = {"kmid": "(close - open)", "klen": "(high - low)", "kup": f"(high - {_TOP})", "klow": f"({_BOTTOM} - low)", "ksft": "(2 * close - high - low)"}
_C = "nullif(close, 0)"
_IMPACT = f"(abs(ret) / (abs(amount) + {EPS}))"


def _gap(x: str, by: str) -> str:
    return f"{x} / nullif({by}, 0) - 1"


_PURIFIED = {
    **{f"lgbm_ret_{n}": f"close / lag({_C}, {n}) OVER s - 1" for n in (20, 60)}, **{f"lgbm_dist_ma{n}": _gap("close", f"avg({_C}) OVER f{n}") for n in (20, 60, 120)}, "lgbm_std_60": "stddev_samp(ret) OVER f60",
    "lgbm_atr_14": "avg(greatest(high - low, abs(high - c1), abs(low - c1))) OVER f14 / close", "lgbm_amihud_20": f"avg({_IMPACT}) OVER f20", "lgbm_vol_ratio_20": "volume / nullif(avg(nullif(volume, 0)) OVER f20, 0)",
    "lgbm_corr_cv_20": "corr(close, volume) OVER f20", "lgbm_vwap_ratio": _gap("close", "vwap"), "lgbm_log_mcap": "ln(1 + CASE WHEN circ_mv > 0 THEN circ_mv WHEN circ_mv <= 0 THEN 0 END)",
    "lgbm_ep_ttm": "CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm ELSE -1 END", "lgbm_is_loss": "CASE WHEN pe_ttm <= 0 THEN 1.0::DOUBLE ELSE 0 END", "lgbm_ep_ttm_clean": "CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END", "lgbm_ep_ttm_invalid": "CASE WHEN pe_ttm <= 0 THEN 1.0::DOUBLE WHEN pe_ttm > 0 THEN 0 END",
    "lgbm_bp": "CASE WHEN pb > 0 THEN 1 / pb ELSE -1 END", "lgbm_bp_clean": "CASE WHEN pb > 0 THEN 1 / pb END", "lgbm_bp_invalid": "CASE WHEN pb <= 0 THEN 1.0::DOUBLE WHEN pb > 0 THEN 0 END",
    "lgbm_turnover_20": "avg(turnover) OVER f20", "lgbm_dist_high_20": _gap("close", "max(high) OVER f20"), "lgbm_dist_low_20": _gap("close", "min(low) OVER f20"),
}


def _temporal(n: int) -> dict[str, str]:
    one = {
        "ret": f"close / lag(close, {n}) OVER s - 1", "ma_gap": _gap("close", f"avg(close) OVER f{n}"), "std": f"stddev_samp(ret) OVER f{n}", "rsv": f"(close - min(low) OVER f{n}) / (max(high) OVER f{n} - min(low) OVER f{n} + {EPS})",
        "volume_ratio": _gap("volume", f"avg(volume) OVER f{n}"), "turnover_mean": f"avg(turnover) OVER f{n}", "amihud": f"avg({_IMPACT}) OVER f{n}", "high_gap": _gap("close", f"max(high) OVER f{n}"),
        "low_gap": _gap("close", f"min(low) OVER f{n}"), "corr_cv": f"corr(close, ln(volume + 1)) OVER f{n}",
    }
    return {f"temp_{k}_{n}": x for k, x in one.items()}


def _bollinger(n: int) -> dict[str, str]:
    m, s = f"avg(close) OVER f{n}", f"stddev_samp(close) OVER f{n}"
    one = {"pos": f"(close - {m}) / (2 * {s} + {EPS})", "width": f"4 * {s} / (abs({m}) + {EPS})", "zscore": f"(close - {m}) / ({s} + {EPS})"}
    return {f"boll_{k}_{n}_2": _full(x, n) for k, x in one.items()}


_FLOW = "(tp * coalesce(volume, 0))"
_MFI = f"100 - 100 / (1 + sum(CASE WHEN dtp > 0 THEN {_FLOW} ELSE 0 END) OVER f14 / (sum(CASE WHEN dtp < 0 THEN abs({_FLOW}) ELSE 0 END) OVER f14 + {EPS}))"
_SINCE = lambda x, extreme, n: f"({n} - {_first_place(x, extreme, n)})"
_AROON = {k: f"100 * (25 - {_SINCE(x, e, 25)}) / 25.0::DOUBLE" for k, x, e in (("up", "high", "max"), ("down", "low", "min"))}
_SIGNED = "(CASE WHEN dc > 0 THEN 1 WHEN dc < 0 THEN -1 ELSE 0 END * coalesce(volume, 0))"
_LOG = lambda x: f"CASE WHEN {x} IS NOT NULL THEN ln(1 + greatest({x}, -0.999999::DOUBLE)) END"
_LAST = lambda event: f"max(CASE WHEN {event} THEN i END) OVER s"
_CCI = _query({"tp": "tp", "m": _full("avg(tp) OVER f20", 20, "tp"), "l": "list(tp) OVER f20"}).rpartition("SELECT symbol, CAST(date AS VARCHAR) AS date,")[0]

TWINS = {
    "flagship_factors": _ranked({"ret_5": "close / lag(close, 5) OVER s - 1", "ma_gap_20": "close / avg(close) OVER f20 - 1", "std_20": "stddev_samp(ret) OVER f20", "corr_cv_10": "corr(close, ln(volume + 1)) OVER f10", "slope_10": "regr_slope(close, i) OVER f10 / close"}, {"rank_20": ("close", 20)}),
    "lag_delta": _query({"lag_2": "lag(close, 2) OVER s", "diff_3": "close - lag(close, 3) OVER s", "change_4": "close / lag(close, 4) OVER s - 1", "shifted_ratio_2": "lag(volume, 2) OVER s / close"}, 9),
    "roll_mean_std": _query({k: x for n in (3, 10, 30) for k, x in ((f"mean_{n}", f"avg(close) OVER f{n} / close"), (f"std_{n}", f"stddev_samp(close) OVER f{n} / close"), (f"gated_sum_{n}", _full(f"sum(close) OVER f{n} / close", n)))}),
    "roll_extreme": _query({k: x for n in (3, 10, 30) for k, x in ((f"max_{n}", f"max(high) OVER f{n}"), (f"min_{n}", f"min(low) OVER f{n}"), (f"full_max_{n}", _full(f"max(high) OVER f{n}", n, "high")))}, 9),
    "roll_quantile": _query({f"q{q}_{n}": f"quantile_cont(close, {q / 100}) OVER f{n}" for n in (5, 20) for q in (20, 50, 80)}, 9),
    "roll_rank_pct": _ranked({}, {f"rank_{n}": ("close", n) for n in (4, 12, 60)}),
    "roll_regression": _query({k: x for n in (5, 20) for k, x in ((f"slope_{n}", _line(n)["beta"]), (f"r2_{n}", _line(n)["rsqr"]), (f"resid_{n}", _line(n)["resi"]))}),
    "roll_corr_guard": _query({"corr_10": "corr(close, volume) OVER f10", "guarded_10": _guarded("close", "ln(volume + 1)", 10)}),
    "arg_extreme": _query({"imax_5": _first_place("high", "max", 5), "imin_5": _first_place("low", "min", 5), "gap_imax_4": f"CASE WHEN count(ret) OVER f4 = count(*) OVER f4 THEN {_first_place('ret', 'max', 4)} WHEN count(ret) OVER f4 > 0 THEN 1 END"}),
    "event_age_streak": _query({"age": f"i - {_LAST('ret > 0.5')}", "streak": f"i - coalesce({_LAST('NOT coalesce(dc > 0, false)')}, 0)", "down_streak": f"i - coalesce({_LAST('NOT coalesce(dc < 0, false)')}, 0)"}),
    "dsl_profile": _ranked({
        "reversal": "1 - close / lag(close, 2) OVER s", "calm": "avg(dc) OVER f5 / (stddev_samp(dc) OVER f10 + 1e-6::DOUBLE)", "swing": "sqrt(abs(max(high) OVER f6 - min(low) OVER f6)) - sum(close) OVER f3 / 3", "lv": "ln(volume)",
    }, {"place": ("volume", 8)}).replace(f"{_r('lv', 6)} AS lv, ", "").replace(_r(_share_below("volume", 8), 6), _r(f"{_share_below('volume', 8)} * lv", 6)),
    "periods_since_extreme": _query({"since_max_6": _full(_SINCE("high", "max", 6), 6, "high"), "since_min_6": _full(_SINCE("low", "min", 6), 6, "low")}),
    "compound_return": _query({f"comp_{n}": f"exp(sum({_LOG('ret')}) OVER f{n}) - 1" for n in (3, 12)}),
    "indicator_rates": _query({"up_rate_6": "avg(CASE WHEN close > c1 THEN 1.0::DOUBLE ELSE 0 END) OVER f6", "loss_rate_6": "avg(CASE WHEN ret < 0 THEN 1.0::DOUBLE WHEN ret >= 0 THEN 0 ELSE 0 END) OVER f6"}),
    "kbar": _query({k: f"{x} / open" for k, x in _KBAR.items()} | {f"{k}2": f"{x} / (high - low + {EPS})" for k, x in _KBAR.items() if k != "klen"}),
    "alpha_price": _query({f"{x}{n}": (f"lag({x}, {n}) OVER s / close" if n else f"{x} / close") for x in ("open", "high", "low", "vwap") for n in (0, 1)} | {f"volume{n}": f"lag(volume, {n}) OVER s / (volume + {EPS})" for n in (1, 2)}),
    "alpha_trend": _query(_over(_trend)), "alpha_range": _ranked(_over(_range), {f"rank{n}": ("close", n) for n in W}), "alpha_count": _query(_over(_count)), "alpha_sum": _query(_over(lambda n: _moves("sum", "dc", n))), "alpha_volume": _query(_over(_volume)),
    "purified": _query(_PURIFIED), "temporal": _ranked({k: x for n in (1, *W, 120) for k, x in _temporal(n).items()}, {f"temp_price_rank_{n}": ("close", n) for n in (1, *W, 120)}),
    "bollinger": _query({k: x for n in (20, 60) for k, x in _bollinger(n).items()}), "mfi": _query({"mfi_14": _full(_MFI, 14, "tp")}),
    "cci": f"{_CCI}SELECT symbol, CAST(date AS VARCHAR) AS date, {_r(f'(tp - m) / (0.015 * (SELECT avg(abs(e - m)) FROM (SELECT unnest(l) AS e)) + {EPS})', 6)} AS cci_20 FROM made",
    "willr": _query({"willr_14": _full(f"-100 * (max(high) OVER f14 - close) / (max(high) OVER f14 - min(low) OVER f14 + {EPS})", 14)}),
    "aroon": _query({f"aroon_{k}_25": _full(x, 25) for k, x in _AROON.items()} | {"aroon_osc_25": _full(f"{_AROON['up']} - {_AROON['down']}", 25)}),
    "obv_flow": _query({f"obv_flow_{n}": _full(f"sum({_SIGNED}) OVER f{n} / (sum(coalesce(volume, 0)) OVER f{n} + {EPS})", n, "1") for n in (20, 60)}),
    "mean_abs_dev": _query({"m": _full("avg(close) OVER f8", 8), "l": "list(close) OVER f8"}).rpartition("SELECT symbol, CAST(date AS VARCHAR) AS date,")[0] + f"SELECT symbol, CAST(date AS VARCHAR) AS date, {_r('CASE WHEN m IS NOT NULL THEN (SELECT avg(abs(e - m)) FROM (SELECT unnest(l) AS e)) END', 6)} AS mad_8 FROM made",
}


# ---- the provider family, over a wide panel


def bounded(x: str, scale: float = 1.0) -> str:
    return f"tanh(({x}) / {scale}::DOUBLE)"


def blend(parts: list[tuple[float, str]], least: float = 0.5) -> str:
    """Weighted sum of what is known, if it has at least a share of the weight."""
    total = sum(abs(w) for w, _ in parts)
    seen = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN {abs(w)}::DOUBLE ELSE 0 END" for w, x in parts)
    return f"CASE WHEN {seen} >= {total * least}::DOUBLE - 1e-12::DOUBLE THEN {' + '.join(f'coalesce({w}::DOUBLE * ({x}), 0)' for w, x in parts)} END"


_inv = lambda x: f"CASE WHEN {x} > 0 THEN 1 / {x} END"
_bad = lambda x: f"CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 0 THEN 0 END"
_yes = lambda x: f"CASE WHEN {x} THEN 1.0::DOUBLE WHEN NOT ({x}) THEN 0 END"
_z = lambda x: f"({x} - avg({x}) OVER f20) / (stddev_samp({x}) OVER f20 + {EPS})"
_pos = lambda x, y: f"CASE WHEN {y} > {EPS} THEN {x} / {y} END"

#: What single rows say, in steps: each may read the ones before.
_STEPS = [
    {"c": "nullif(close, 0)", "nth": "row_number() OVER s"},
    {"ret": "c / lag(c) OVER s - 1", "up": "up_limit", "dn": "down_limit", "yield_proxy": f"div_cash_div / CASE WHEN c > {EPS} THEN c END", "fresh_fc": "exp(-greatest(fc_days_since_ann, 0) / 20) * CASE WHEN fc_days_since_ann IS NOT NULL THEN 1 END", "fresh_exp": "exp(-greatest(exp_days_since_ann, 0) / 20) * CASE WHEN exp_days_since_ann IS NOT NULL THEN 1 END",
     "ep_": _inv("pe"), "sp_": _inv("ps"), "spt_": _inv("ps_ttm"), "ept_": _inv("pe_ttm"), "bp_": _inv("pb"), "mid": "(fc_p_change_min + fc_p_change_max) / 2", "width": "fc_p_change_max - fc_p_change_min", "np_mid": "(fc_net_profit_min + fc_net_profit_max) / 2", "exp_all": "exp_yoy_sales + exp_yoy_op + exp_yoy_dedu_np + exp_yoy_eps"},
    {"place": f"(c - dn) / (up - dn + {EPS})", "hit_up": _yes("c >= up * (1 - 1e-6)"), "hit_dn": _yes("c <= dn * (1 + 1e-6)"), "gap_up": "up / c - 1", "gap_dn": "c / dn - 1", "band": f"(up - dn) / (nullif(limit_pre_close, 0) + {EPS})", "ff": "free_share / nullif(total_share, 0)", "fc_ratio": "free_share / nullif(circ_share, 0)", "mv": "circ_mv / nullif(total_mv, 0)",
     "ft": "turnover_free / nullif(turnover, 0)", "fs": "turnover_free - turnover", "illiquid": f"abs(ret) / (abs(amount) + {EPS})", "illiquid_dn": f"CASE WHEN ret < 0 THEN abs(ret) END / (abs(amount) + {EPS})", "div_eps": _pos("div_cash_div", "fi_eps"), "div_ocf": _pos("div_cash_div", "fi_ocfps"),
     "sure_of": f"CASE WHEN mid IS NULL THEN NULL WHEN fc_p_change_min > 0 THEN mid / (abs(width) + {EPS}) WHEN fc_p_change_max < 0 THEN -abs(mid) / (abs(width) + {EPS}) ELSE 0 END",
     **{f"rel{n}": f"c / lag(c, {n}) OVER s - 1 - ind_ret_{n}" for n in (5, 20, 60)}, **{f"own{n}": f"c / lag(c, {n}) OVER s - 1" for n in (5,)}, "vol20": f"stddev_samp(ret) OVER f20 / (ind_std_20 + {EPS})", "vol60": f"stddev_samp(ret) OVER f60 / (ind_std_60 + {EPS})", "vol5": f"stddev_samp(ret) OVER f5 / (ind_std_5 + {EPS})",
     "ocf_rel": f"fi_ocfps / (abs(fi_eps) + {EPS}) - ind_fi_ocf_to_eps_mean", "margin_rel": "fi_grossprofit_margin - fi_netprofit_margin - ind_fi_margin_quality_mean", "yield_rel": "dv_ttm - ind_dividend_yield_ttm_mean", "cash_rel": "yield_proxy - ind_dividend_cash_yield_proxy_mean"},
    {"near_up": "CASE WHEN place >= 0.9 AND hit_up <= 0 THEN 1.0::DOUBLE ELSE 0 END", "near_dn": "CASE WHEN place <= 0.1 AND hit_dn <= 0 THEN 1.0::DOUBLE ELSE 0 END", "pressure": f"sum(CASE WHEN ret < 0 THEN turnover END) OVER f20 / (sum(turnover) OVER f20 + {EPS})",
     "ud": f"sum(CASE WHEN ret > 0 THEN turnover END) OVER f20 / (sum(CASE WHEN ret < 0 THEN turnover END) OVER f20 + {EPS})", "rt": "corr(ret, turnover) OVER f20", **{f"dr{n}": f"avg(illiquid_dn) OVER f{n} / (ind_downside_amihud_mean_{n} + {EPS})" for n in (20, 60)},
     "quality": blend([(0.35, bounded("fi_roe_dt", 20)), (0.25, bounded("ocf_rel", 2)), (0.2, bounded("fi_ocf_yoy - fi_netprofit_yoy", 50)), (0.1, bounded("margin_rel", 20)), (-0.2, bounded("fi_debt_to_assets", 60))]),
     "value": blend([(1.0, "bp_ - ind_bp_clean_mean"), (1.0, "spt_ - ind_sp_ttm_clean_mean"), (0.25, bounded("yield_rel", 5))]),
     "growth": blend([(0.3, bounded("fi_or_yoy", 50)), (0.25, bounded("fi_op_yoy", 50)), (0.3, bounded("fi_ocf_yoy", 50)), (0.15, bounded("fi_netprofit_yoy", 50)), (-0.25, bounded("abs(fi_netprofit_yoy - fi_ocf_yoy)", 50))]),
     "express": blend([(0.35, bounded("exp_yoy_sales", 50)), (0.35, bounded("exp_yoy_dedu_np", 50)), (0.2, bounded("exp_yoy_eps", 50)), (0.1, bounded("exp_yoy_dedu_np - exp_yoy_tp", 30)), (-0.15, bounded("exp_growth_assets", 50))]),
     **{f"trend{n}": blend([(0.35, bounded(f"ind_ret_{n}", a)), (0.25, bounded(f"ind_excess_ret_{n}", b)), (0.25, bounded(f"ind_pos_rate_{n} - 0.5", 0.2)), (-0.15, bounded(f"ind_std_{n}", d))]) for n, a, b, d in ((20, 0.2, 0.1, 0.05), (60, 0.3, 0.15, 0.08))}},
    {"near_dn20": "sum(near_dn) OVER f20", "up20": "sum(hit_up) OVER f20", "dn20": "sum(hit_dn) OVER f20", "payout": "CASE WHEN x_payout IS NOT NULL THEN greatest(x_payout, 0) END"},
]
_STEPS[3]["x_payout"] = blend([(0.5, bounded("div_eps - 0.8", 0.5)), (0.5, bounded("div_ocf - 0.6", 0.5))], 0.25)


def _provider(columns: dict[str, str], ctes: str) -> str:
    """Rounded columns of the wide panel after all steps, each a select over the one before."""
    out, before = [ctes], "wide"
    for k, step in enumerate([*_STEPS, columns]):
        sizes = sorted({int(n) for x in step.values() for n in _sizes(x)})
        frames = "".join(f", f{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)
        made = ", ".join(f"{x} AS {name}" for name, x in step.items())
        keep = "*" if k < len(_STEPS) else "symbol, date"
        out.append(f"step{k} AS (SELECT {keep}, {made} FROM {before} WINDOW s AS (PARTITION BY symbol ORDER BY date){frames})")
        before = f"step{k}"
    return f"WITH {', '.join(out)} SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(f"{significant(n, INFINITY)} AS {n}" for n in columns)} FROM {before}"


# Columns of the announced tables.
_FI = "eps dt_eps bps ocfps roe roe_dt roa grossprofit_margin netprofit_margin debt_to_assets q_eps q_dtprofit q_roe q_dt_roe tr_yoy or_yoy op_yoy netprofit_yoy ocf_yoy".split()
_EXP = "revenue operate_profit total_profit n_income total_assets diluted_eps diluted_roe yoy_sales yoy_op yoy_tp yoy_dedu_np yoy_eps yoy_roe growth_assets yoy_assets".split()
_calm = lambda n: bounded(f"vol{n} - 1", 0.5)


def _relative(n: int) -> dict[str, str]:
    ratio = lambda x, k: f"avg({x}) OVER f{n} / (ind_{k}_{n} + {EPS})"
    r = {"turnover_ratio": ratio("turnover", "turnover_mean"), "free_turnover_ratio": ratio("turnover_free", "free_turnover_mean"), "volume_ratio_gap": f"avg(volume_ratio) OVER f{n} - ind_volume_ratio_mean_{n}", "amihud_ratio": ratio("illiquid", "amihud_mean"), "downside_amihud_ratio": f"dr{n}", "amplitude_ratio": ratio("amplitude", "amplitude_mean"), "hit_up_limit_gap": f"avg(hit_up) OVER f{n} - ind_hit_up_limit_rate_{n}", "hit_down_limit_gap": f"avg(hit_dn) OVER f{n} - ind_hit_down_limit_rate_{n}"}
    over = lambda k: bounded(f"{r[k]} - 1")
    r["crowding"] = blend([(0.25, over("turnover_ratio")), (0.25, over("free_turnover_ratio")), (0.2, bounded(r["volume_ratio_gap"], 2)), (0.2, over("amplitude_ratio")), (0.1, bounded(f"({r['hit_up_limit_gap']}) - ({r['hit_down_limit_gap']})", 0.5))])
    r["liquidity_stress"] = blend([(0.45, over("downside_amihud_ratio")), (0.25, over("amihud_ratio")), (0.2, over("amplitude_ratio")), (0.1, bounded(r["hit_down_limit_gap"], 0.5))])
    r["low_vol_liquidity"] = blend([(-0.45, _calm(n)), (-0.25, over("amihud_ratio")), (-0.15, over("downside_amihud_ratio")), (0.15, over("free_turnover_ratio"))])
    return {f"stock_vs_industry_{k}_{n}": x for k, x in r.items()}


PROVIDER = {
    "base": {
        "gap_up_limit": "gap_up", "gap_down_limit": "gap_dn", "limit_band_pct": "band", "limit_band_pos": "place", "hit_up_limit": "hit_up", "hit_down_limit": "hit_dn", "free_float_ratio": "ff", "circ_float_ratio": "circ_share / nullif(total_share, 0)", "free_to_circ_ratio": "fc_ratio", "free_turnover_ratio": "ft", "free_turnover_spread": "fs",
        **{f"free_turnover_mean_{n}": f"avg(turnover_free) OVER f{n}" for n in (5, 20)}, **{f"{k}_accel_5_20": f"avg({x}) OVER f5 / (avg({x}) OVER f20 + {EPS}) - 1" for k, x in (("turnover", "turnover"), ("free_turnover", "turnover_free"))}, "volume_ratio_raw": "volume_ratio", "float_mv_ratio": "mv",
        "ep": "coalesce(ep_, -1)", "sp": "coalesce(sp_, -1)", "sp_ttm": "coalesce(spt_, -1)", "ep_ttm_gap": "coalesce(ep_, -1) - coalesce(ept_, -1)", "ep_clean": "ep_", "ep_invalid": _bad("pe"), "sp_clean": "sp_", "sp_invalid": _bad("ps"), "sp_ttm_clean": "spt_", "sp_ttm_invalid": _bad("ps_ttm"), "ep_ttm_clean": "ept_", "ep_ttm_invalid": _bad("pe_ttm"),
        "ep_ttm_gap_clean": "ep_ - ept_", "bp_clean": "bp_", "bp_invalid": _bad("pb"), "dividend_yield": "dv_ratio", "dividend_yield_ttm": "dv_ttm", "has_dividend": _yes("dv_ttm > 0"), "dividend_cash_to_eps": "div_eps", "dividend_cash_to_ocfps": "div_ocf", "dividend_cash_yield_proxy": "yield_proxy",
        "industry_member_count": "ind_member_count", "industry_daily_ret": "ind_daily_ret", "industry_excess_daily_ret": "ind_excess_daily_ret",
    },
    "flows": {
        **{f"{k}_mean_{n}": f"avg({x}) OVER f{n}" for n in (5, 20) for k, x in (("limit_band_pct", "band"), ("limit_band_pos", "place"), ("gap_up_limit", "gap_up"), ("gap_down_limit", "gap_dn"), ("amplitude", "amplitude"), ("pct_chg", "pct_chg"))}, **{f"hit_{k}_limit_count_{n}": f"sum(hit_{x}) OVER f{n}" for n in (5, 20) for k, x in (("up", "up"), ("down", "dn"))},
        **{f"{k}_change_{n}": f"{x} / lag({x}, {n}) OVER s - 1" for n in (20, 60) for k, x in (("free_float_ratio", "ff"), ("free_to_circ_ratio", "fc_ratio"), ("float_mv_ratio", "mv"), ("sp_ttm", "coalesce(spt_, -1)"), ("sp_ttm_clean", "spt_"), ("dividend_yield_ttm", "dv_ttm"))},
        **{f"{k}_change_{n}": f"{x} - lag({x}, {n}) OVER s" for n in (20, 60) for k, x in (("ep_ttm", "coalesce(ept_, -1)"), ("ep_ttm_clean", "ept_"), ("bp", "coalesce(bp_, -1)"), ("bp_clean", "bp_"))},
        **{f"industry_{k}_{n}": f"ind_{k}_{n}" for n in (5, 20, 60) for k in ("ret", "std", "excess_ret", "pos_rate", "dispersion")}, **{f"industry_rel_ret_{n}": f"rel{n}" for n in (5, 20, 60)}, **{f"stock_vs_industry_std_ratio_{n}": f"vol{n}" for n in (5, 20, 60)},
        **{f"{k}_zscore_20": _z(x) for k, x in (("amplitude", "amplitude"), ("pct_chg", "pct_chg"), ("free_turnover_ratio", "ft"), ("free_turnover_spread", "fs"), ("volume_ratio_raw", "volume_ratio"))}, "amihud_term_5_20": f"avg(illiquid) OVER f5 / (avg(illiquid) OVER f20 + {EPS}) - 1", "downside_amihud_20": "avg(illiquid_dn) OVER f20",
        **{f"{k}_surprise_20": f"{x} - avg({x}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)" for k, x in (("dividend_yield_ttm", "dv_ttm"), ("dividend_cash_yield_proxy", "yield_proxy"))},
    },
    "announced": {
        "fi_ocf_to_eps": f"fi_ocfps / (abs(fi_eps) + {EPS})", "fi_ocfps_minus_eps": "fi_ocfps - fi_eps", "fi_ocf_yoy_minus_np_yoy": "fi_ocf_yoy - fi_netprofit_yoy", "fi_roe_quality_gap": "fi_roe_dt - fi_roe", "fi_q_roe_quality_gap": "fi_q_dt_roe - fi_q_roe", "fi_margin_quality": "fi_grossprofit_margin - fi_netprofit_margin",
        "fi_profitability_combo": "fi_roe_dt + fi_roa + fi_netprofit_margin", "fi_growth_quality_combo": "fi_or_yoy + fi_op_yoy + fi_netprofit_yoy + fi_ocf_yoy", "fc_p_change_mid": "mid", "fc_p_change_width": "width", "fc_net_profit_mid": "np_mid", "fc_net_profit_width": "fc_net_profit_max - fc_net_profit_min", "fc_net_profit_mid_ratio": f"np_mid / (abs(fc_last_parent_net) + {EPS})",
        "fc_positive_confidence": "sure_of", "fc_days_since_ann": "fc_days_since_ann", "fc_freshness_weight": "fresh_fc", "fc_surprise_fresh": "mid * fresh_fc", "exp_growth_combo": "exp_all", "exp_profit_quality_gap": "exp_yoy_dedu_np - exp_yoy_tp", "exp_asset_efficiency": "exp_yoy_sales - exp_growth_assets", "exp_profit_margin_proxy": f"exp_n_income / (abs(exp_revenue) + {EPS})",
        "exp_op_margin_proxy": f"exp_operate_profit / (abs(exp_revenue) + {EPS})", "exp_days_since_ann": "exp_days_since_ann", "exp_freshness_weight": "fresh_exp", "exp_growth_fresh": "exp_all * fresh_exp",
    },
    "events": {
        "up_down_turnover_ratio_20": "ud", "return_turnover_corr_20": "rt", "downside_turnover_pressure_20": "pressure", **{f"days_since_last_{k}_limit": f"row_number() OVER s - max(CASE WHEN {x} > 0 THEN nth END) OVER s" for k, x in (("up", "hit_up"), ("down", "hit_dn"))},
        **{f"{k}_limit_streak": f"row_number() OVER s - coalesce(max(CASE WHEN NOT coalesce({x} > 0, false) THEN nth END) OVER s, 0)" for k, x in (("up", "hit_up"), ("down", "hit_dn"))}, "near_up_limit_count_20": "sum(near_up) OVER f20", "near_down_limit_count_20": "near_dn20",
    },
    "industry": {
        "industry_breadth_accel_20_60": "ind_pos_rate_20 - ind_pos_rate_60", "industry_momentum_accel_20_60": "ind_ret_20 - ind_ret_60", "stock_industry_ret_gap_5_20": "rel5 - rel20", "stock_industry_ret_gap_20_60": "rel20 - rel60", **{f"stock_relative_strength_quality_{n}": f"rel{n} / (ind_std_{n} + {EPS})" for n in (20, 60)}, **_relative(20), **_relative(60),
        **{f"{k}_minus_industry_{k}": f"coalesce({x}, -1) - ind_{k}_mean" for k, x in (("ep", "ep_"), ("sp", "sp_"), ("sp_ttm", "spt_"), ("bp", "bp_"))}, **{f"{k}_clean_minus_industry_{k}_clean": f"{x} - ind_{k}_clean_mean" for k, x in (("ep", "ep_"), ("sp", "sp_"), ("sp_ttm", "spt_"), ("bp", "bp_"))},
        "dividend_yield_minus_industry": "dv_ratio - ind_dividend_yield_mean", "dividend_yield_ttm_minus_industry": "yield_rel", "dividend_cash_to_eps_minus_industry": "div_eps - ind_dividend_cash_to_eps_mean", "dividend_cash_to_ocfps_minus_industry": "div_ocf - ind_dividend_cash_to_ocfps_mean", "dividend_cash_yield_proxy_minus_industry": "cash_rel",
        "dividend_yield_ttm_industry_spread_zscore_20": _z("yield_rel"), "dividend_cash_yield_industry_spread_zscore_20": _z("cash_rel"), "fi_ocf_to_eps_minus_industry": "ocf_rel", "fi_ocfps_minus_eps_minus_industry": "fi_ocfps - fi_eps - ind_fi_ocfps_minus_eps_mean", "fi_roe_quality_gap_minus_industry": "fi_roe_dt - fi_roe - ind_fi_roe_quality_gap_mean", "fi_margin_quality_minus_industry": "margin_rel",
    },
    "semantic": {
        "sem_value_quality": "value + quality", "sem_value_quality_low_vol": f"value + quality - {_calm(20)}", "sem_dividend_quality": "yield_rel * (1 + CASE WHEN quality IS NOT NULL THEN least(greatest(quality, -0.5::DOUBLE), 0.75::DOUBLE) END)", "sem_profitability_resilience": f"quality - {_calm(20)}", "sem_growth_cash_quality": "growth",
        "sem_growth_cash_quality_accel_20": "growth - avg(growth) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "sem_forecast_confidence_fresh": f"{bounded('mid', 50)} * {bounded('sure_of')} * fresh_fc", "sem_forecast_unpriced_5": f"{bounded('mid', 50)} * {bounded('sure_of')} * fresh_fc - {bounded('own5', 0.1)}",
        "sem_express_growth_quality_fresh": "express * fresh_exp", **{f"sem_industry_strength_low_vol_{n}": f"trend{n} - {_calm(n)}" for n in (20, 60)}, "sem_industry_relative_winner_20": f"trend20 + {bounded('rel20', 0.2)} - {_calm(20)}", "sem_industry_pullback_recovery_5_20": f"trend20 + {bounded('rel20', 0.2)} - {bounded('rel5', 0.1)}",
        "sem_liquidity_absorption_20": blend([(1.0, bounded("ud - 1", 2)), (1.0, bounded("rt")), (-1.0, bounded("pressure - 0.5", 0.3))]), "sem_downside_liquidity_relief_20": blend([(-1.0, bounded("dr20 - 1")), (-1.0, bounded("pressure - 0.5", 0.3)), (-1.0, bounded("near_dn20", 3))]),
        "sem_limit_breakout_quality_20": blend([(1.0, bounded("up20", 3)), (-1.0, bounded("dn20", 3)), (1.0, "trend20"), (-1.0, bounded("near_dn20", 3))]), "sem_low_vol_value_reversal_5": f"value + quality - {_calm(20)} - {bounded('own5', 0.1)}",
        "sem_dividend_cash_quality": blend([(0.35, bounded("yield_rel", 5)), (0.3, bounded("cash_rel", 0.05)), (0.25, "quality"), (-0.1, "payout")]),
    },
    "snapshots": {
        **{f"latest_{x}": f"fi_{x}" for x in _FI}, "latest_div_cash": "div_cash_div", "latest_div_cash_tax": "div_cash_div_tax", "latest_div_stock": "div_stk_div", "latest_div_bo_rate": "div_stk_bo_rate", "latest_div_co_rate": "div_stk_co_rate", "latest_div_base_share": "div_base_share", "latest_div_cash_yield_proxy": f"div_cash_div / (c + {EPS})",
        "latest_div_stock_ratio": "div_stk_div + div_stk_bo_rate + div_stk_co_rate", "has_stock_dividend": _yes("div_stk_div + div_stk_bo_rate + div_stk_co_rate > 0"), **{f"latest_fc_{x}": f"fc_{x}" for x in ("p_change_min", "p_change_max", "net_profit_min", "net_profit_max", "last_parent_net")}, **{f"latest_exp_{x}": f"exp_{x}" for x in _EXP},
    },
}


def provider_twin(group: str, ctes: str) -> str:
    return _provider(PROVIDER[group], ctes)
