"""Queries over rolling primitives and factor families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions.expr import call, col, corr, rounded, sure, when
from ..functions.factors import alpha158, provider, purified, technical, temporal
from ..functions.factors.registry import generate, sources
from ..functions.kernel import with_kernels
from ..operators.industry import compound
from ..sources import panels
from . import twins
from .frames import formulas_query, significant, text_date

C, V, H, L = (col(x) for x in ("close", "volume", "high", "low"))
_rolling = {w: alpha158.rolling(w) for w in alpha158.WINDOWS}


def _group(name: str) -> dict:
    return {f"{k}{w}": _rolling[w][f"{k}{w}"] for w in alpha158.WINDOWS for k in alpha158.GROUPS[name]}


_tech = technical.windowed()
_pick = lambda *starts: {k: x for k, x in _tech.items() if k.startswith(starts)}
PROFILE = {"name": "example", "factors": [
    {"name": "reversal", "expr": "-(close / delay(close, 2) - 1)"}, {"name": "calm", "expr": "ts_mean(delta(close, 1), 5) / (ts_std(delta(close, 1), 10) + 1e-6)"}, {"name": "place", "expr": "ts_rank(volume, 8) * log(volume)"},
    {"name": "swing", "expr": "sqrt(abs(ts_max(high, 6) - ts_min(low, 6))) - ts_sum(close, 3) / 3"},
]}

_FORMULAS = {
    "flagship_factors": {"ret_5": C.change(5), "ma_gap_20": C / C.mean(20) - 1.0, "std_20": C.change(1).std(20), "corr_cv_10": corr(C, call("ln", V + 1.0), 10), "rank_20": C.rank(20), "slope_10": C.slope(10) / C},
    "lag_delta": {"lag_2": C.lag(2), "diff_3": C.diff(3), "change_4": C.change(4), "shifted_ratio_2": V.lag(2) / C},
    "roll_mean_std": {f"{k}_{w}": x for w in (3, 10, 30) for k, x in (("mean", C.mean(w) / C), ("std", C.std(w) / C), ("gated_sum", C.sum(w, w) / C))},
    "roll_extreme": {f"{k}_{w}": x for w in (3, 10, 30) for k, x in (("max", H.max(w)), ("min", L.min(w)), ("full_max", H.max(w, w)))},
    "roll_quantile": {f"q{q}_{w}": C.quantile(w, q / 100) for w in (5, 20) for q in (20, 50, 80)},
    "roll_rank_pct": {f"rank_{w}": C.rank(w) for w in (4, 12, 60)},
    "roll_regression": {f"{k}_{w}": x for w in (5, 20) for k, x in (("slope", C.slope(w) / C), ("r2", C.fit(w)), ("resid", C.residual(w) / C))},
    "roll_corr_guard": {"corr_10": corr(C, V, 10), "guarded_10": alpha158.guarded(C, call("ln", V + 1.0), 10)},
    "arg_extreme": {"imax_5": H.place_of(5, True), "imin_5": L.place_of(5, False), "gap_imax_4": C.change(1).place_of(4, True)},
    "periods_since_extreme": {"since_max_6": H.since(6, True), "since_min_6": L.since(6, False)},
    "mean_abs_dev": {"mad_8": C.deviation(8)},
    "event_age_streak": {"age": (C.change(1) - 0.5).age(), "streak": C.diff().streak(), "down_streak": (-C.diff()).streak()},
    "compound_return": {"comp_3": compound(C.change(1), 3), "comp_12": compound(C.change(1), 12)},
    "kbar": alpha158.bars(), "alpha_price": alpha158.prices((0, 1)) | alpha158.volumes((1, 2)), "alpha_trend": _group("trend"), "alpha_range": _group("range"), "alpha_count": _group("relation"), "alpha_sum": _group("sums"), "alpha_volume": _group("volume"),
    "purified": purified.factors(), "temporal": temporal.factors(), "bollinger": _pick("boll"), "mfi": _pick("mfi"), "cci": _pick("cci"), "willr": _pick("willr"), "aroon": _pick("aroon"), "obv_flow": _pick("obv"),
    "dsl_profile": {k: dsl.formula(t) for k, t in dsl.profile(PROFILE).items()},
    "indicator_rates": {"up_rate_6": sure(C > C.lag(1)).mean(6), "loss_rate_6": when(C.change(1) < 0.0, 1.0, 0.0).mean(6)},
}
#: Prices are short decimals, whose means end in fives; nine digits leave no ties to rounding.
_DIGITS = dict.fromkeys(("lag_delta", "roll_quantile", "roll_extreme"), 9)
_made = {k: formulas_query(f, digits=_DIGITS.get(k, 6)) for k, f in _FORMULAS.items()}
QUERIES = {k: q for k, (q, _) in _made.items()}
#: Where there is a twin written by hand, it stands for the one that is compiled from the same formula.
ORACLES = {k: s for k, (_, s) in _made.items()} | twins.TWINS

# ---- the provider family over the signals, industry context and announced side table

_SIDE = [f"fi_{c}" for c in provider.FI] + [f"div_{c}" for c in provider.DIV] + [f"fc_{c}" for c in provider.FC] + [f"exp_{c}" for c in provider.EXP]
_have = {"symbol", "date", "open", "high", "low", "close", "volume", "amount", "vwap", "turnover", "turnover_free", "pe_ttm", "pb", "pe", "ps", "ps_ttm", "dv_ratio", "dv_ttm", "circ_mv", "total_mv", "total_share", "circ_share", "free_share", "volume_ratio", "amplitude", "pct_chg", "pre_close", "up_limit", "down_limit"}


def _synthetic(dialect_double: str) -> dict[str, str]:
    """Stand-ins for announced and industry columns: smooth functions of the bars, missing on some months."""
    out = {}
    for k, c in enumerate(provider.columns()):
        if c in _have:
            continue
        m = k % 7 + 1
        base = f"((close / open - 1) * {m} + ({k % 5} - 2) * (volume / 1000) + discount * {k % 11} + 0.37)"
        out[c] = f"CASE WHEN month(date) <> {k % 12 + 1} THEN CAST({base} * {1 if c.startswith('ind_') else 10} AS DOUBLE) END"
    return out


def provider_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = panels.signal_panel(spark, sf_dir).join(panels.monthly_bars(spark, sf_dir).select("symbol", "date", "discount"), ["symbol", "date"])
    return base.selectExpr("*", *(f"{x} AS {c}" for c, x in _synthetic("DOUBLE").items()))


_PROVIDER_SQL = panels.SIGNALS_SQL + ", wide AS (SELECT p.*, b.discount, " + ", ".join(f"{x.replace('(close', '(p.close').replace('/ open', '/ p.open').replace('(volume', '(p.volume').replace('month(date)', 'month(p.date)').replace('+ discount', '+ b.discount')} AS {c}" for c, x in _synthetic("DOUBLE").items()) + " FROM panel p JOIN bars b USING (symbol, date))"


def _provider_query(formulas: dict):
    formulas = {k.lower(): x for k, x in formulas.items()}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_kernels(provider_panel(spark, sf_dir), formulas, keep=["symbol", "date"])
        return text_date(made.select("symbol", "date", *(F.expr(significant(f"`{n}`", "DOUBLE('Infinity')")).alias(n) for n in formulas)))

    return query


for _name, _part in provider.groups().items():
    QUERIES[f"provider_{_name}"], ORACLES[f"provider_{_name}"] = _provider_query(_part), twins.provider_twin(_name, _PROVIDER_SQL)

# ---- recursive smoothing


def macd_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_kernels(panels.monthly_bars(spark, sf_dir), {n: technical.recursive()[n] for n in technical.SMOOTHED}, keep=["symbol", "date"])
    return text_date(rounded(made, technical.SMOOTHED))


def _ema(name: str, x: str, a: str, source: str) -> str:
    """A recursive CTE with the smoothed x of a numbered series (symbol, n)."""
    return f"""{name}(symbol, n, v, k) AS (SELECT symbol, n, {x}, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END FROM {source} WHERE n = 1
      UNION ALL SELECT s.symbol, s.n, CASE WHEN s.{x} IS NULL THEN e.v WHEN e.v IS NULL THEN s.{x} ELSE {a} * s.{x} + (1 - {a}) * e.v END, e.k + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END
      FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.n = e.n + 1)"""


def _macd_rsi_sql() -> str:
    a = lambda n: f"(2.0::DOUBLE / {n + 1})"
    w = lambda n: f"(1.0::DOUBLE / {n})"
    # A missing row keeps the state but shows nothing; fewer observed rows than the span show nothing either.
    at = lambda e, x, least: f"CASE WHEN {x} IS NOT NULL AND {e}.k >= {least} THEN {e}.v END"
    return f"""WITH RECURSIVE {panels.BARS_SQL},
    num AS (SELECT symbol, date, close, high, low, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n,
      lag(close) OVER (PARTITION BY symbol ORDER BY date) AS c1, high - lag(high) OVER (PARTITION BY symbol ORDER BY date) AS up, lag(low) OVER (PARTITION BY symbol ORDER BY date) - low AS down FROM bars),
    s AS (SELECT *, greatest(close - c1, 0) AS gain, greatest(c1 - close, 0) AS loss, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm,
      CASE WHEN c1 IS NULL THEN abs(high - low) ELSE greatest(abs(high - low), abs(high - c1), abs(low - c1)) END AS tr FROM (SELECT *, CASE WHEN c1 IS NULL THEN NULL ELSE 1 END AS g FROM num)),
    s1 AS (SELECT symbol, date, n, close, CASE WHEN c1 IS NULL THEN NULL ELSE gain END AS gain, CASE WHEN c1 IS NULL THEN NULL ELSE loss END AS loss, pdm, mdm, tr FROM s),
    {_ema('e12', 'close', a(12), 's1')}, {_ema('e26', 'close', a(26), 's1')}, {_ema('g6', 'gain', w(6), 's1')}, {_ema('l6', 'loss', w(6), 's1')}, {_ema('g14', 'gain', w(14), 's1')}, {_ema('l14', 'loss', w(14), 's1')}, {_ema('g24', 'gain', w(24), 's1')}, {_ema('l24', 'loss', w(24), 's1')},
    {_ema('pd', 'pdm', w(14), 's1')}, {_ema('md', 'mdm', w(14), 's1')}, {_ema('atr', 'tr', w(14), 's1')}, {_ema('t1', 'close', a(15), 's1')},
    s2 AS (SELECT s1.symbol, s1.date, s1.n, {at('e12', 's1.close', 12)} - {at('e26', 's1.close', 26)} AS line, {at('t1', 's1.close', 15)} AS x1,
      100 * {at('pd', 's1.pdm', 14)} / ({at('atr', 's1.tr', 14)} + 1e-12) AS pdi, 100 * {at('md', 's1.mdm', 14)} / ({at('atr', 's1.tr', 14)} + 1e-12) AS mdi,
      {at('g6', 's1.gain', 6)} AS ag6, {at('l6', 's1.loss', 6)} AS al6, {at('g14', 's1.gain', 14)} AS ag14, {at('l14', 's1.loss', 14)} AS al14, {at('g24', 's1.gain', 24)} AS ag24, {at('l24', 's1.loss', 24)} AS al24
      FROM s1 JOIN e12 USING (symbol, n) JOIN e26 USING (symbol, n) JOIN g6 USING (symbol, n) JOIN l6 USING (symbol, n) JOIN g14 USING (symbol, n) JOIN l14 USING (symbol, n) JOIN g24 USING (symbol, n) JOIN l24 USING (symbol, n) JOIN pd USING (symbol, n) JOIN md USING (symbol, n) JOIN atr USING (symbol, n) JOIN t1 USING (symbol, n)),
    s3 AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-12) AS dx FROM s2),
    {_ema('sig', 'line', a(9), 's3')}, {_ema('adx', 'dx', w(14), 's3')}, {_ema('t2', 'x1', a(15), 's3')},
    s4 AS (SELECT s3.symbol, s3.n, {at('t2', 's3.x1', 15)} AS x2 FROM s3 JOIN t2 USING (symbol, n)),
    {_ema('t3', 'x2', a(15), 's4')},
    s5 AS (SELECT s4.symbol, s4.n, {at('t3', 's4.x2', 15)} AS x3 FROM s4 JOIN t3 USING (symbol, n)),
    s6 AS (SELECT symbol, n, (x3 / lag(x3) OVER (PARTITION BY symbol ORDER BY n) - 1) * 100 AS trix FROM s5),
    {_ema('ts', 'trix', a(9), 's6')},
    out AS (SELECT s3.symbol, CAST(s3.date AS VARCHAR) AS date, line AS macd_line_12_26_9, {at('sig', 's3.line', 9)} AS macd_signal_12_26_9, line - {at('sig', 's3.line', 9)} AS macd_hist_12_26_9,
      {', '.join(f"CASE WHEN coalesce(ag{n} > 1e-12, false) = false AND coalesce(al{n} > 1e-12, false) = false THEN 50 WHEN coalesce(al{n} > 1e-12, false) = false THEN 100 ELSE 100 - 100 / (1 + ag{n} / (al{n} + 1e-12)) END AS rsi_{n}" for n in (6, 14, 24))},
      {at('adx', 's3.dx', 14)} AS adx_14, pdi AS plus_di_14, mdi AS minus_di_14, trix AS trix_15,
      {at('ts', 's6.trix', 9)} AS trix_signal_15_9, trix - {at('ts', 's6.trix', 9)} AS trix_hist_15_9
      FROM s3 JOIN sig USING (symbol, n) JOIN adx USING (symbol, n) JOIN s6 USING (symbol, n) JOIN ts USING (symbol, n))
    SELECT symbol, date, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in technical.SMOOTHED)} FROM out"""


QUERIES["macd_rsi"], ORACLES["macd_rsi"] = macd_rsi, _macd_rsi_sql()


def all_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 517 built-in factors of the panel, as a store would hold them."""
    return text_date(generate(provider_panel(spark, sf_dir)))


QUERIES["all_factors"] = all_factors


def registry_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source columns each built-in family reads."""
    families = {"alpha158": alpha158.factors(), "purified": purified.factors(), "temporal": temporal.factors(), "technical": technical.windowed(), "provider": provider.factors()}
    rows = [(name, c) for name, f in families.items() for c in sorted({s for x in f.values() for s in sources(x)})]
    return spark.createDataFrame(rows, "family string, source string").groupBy("family").agg(F.count("*").alias("n_sources"))


QUERIES["registry_projection"] = registry_projection
ORACLES["registry_projection"] = "SELECT family, CAST(n AS BIGINT) AS n_sources FROM (VALUES ('alpha158', 6), ('purified', 10), ('temporal', 6), ('technical', 4), ('provider', 120)) v(family, n)"
