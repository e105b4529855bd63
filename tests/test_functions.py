"""Rolling primitives, factor families and the expression language on literal series."""

import math

import numpy as np
import pandas as pd
import pytest

from alphaloom.functions import dsl
from alphaloom.functions.expr import blend, call, col, corr, finite, with_formulas
from alphaloom.functions.factors import alpha158, provider, technical
from alphaloom.functions.factors.registry import canonical, generate, registry, sources
from alphaloom.operators.industry import compound
from alphaloom.operators.labels import forward_return, horizons

nan, inf = math.nan, math.inf


def series(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, i, *(None if isinstance(v[i], float) and math.isnan(v[i]) else float(v[i]) for v in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "symbol int, date int, " + ", ".join(f"{c} double" for c in columns))


def values(spark, formula, **columns):
    out = with_formulas(series(spark, **columns), {"out": formula}).orderBy("date").collect()
    return [nan if r["out"] is None else r["out"] for r in out]


def close(a, b, tolerance=1e-12):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (math.isnan(x) and math.isnan(y)) or x == y or abs(x - y) <= tolerance, (a, b)


X = col("x")


@pytest.mark.parametrize(
    "formula, x, want",
    [
        (X.rank(4), [1, 2, 2, nan, 3, 1.5, 1.5, 4], [1, 1, 0.8333333333333334, nan, 1, 1 / 3, 0.5, 1]),
        (finite(X).rank(3), [1, inf, 2, nan, -inf, 2], [1, nan, 1, nan, nan, 1]),
        (X.place_of(3, True), [1, nan, 2, 2, 0], [1, 2, 2, 1, 1]),
        (X.place_of(3, False), [1, nan, 2, 2, 0], [1, 2, 2, 1, 3]),
        (X.since(3, True), [1, 3, 2, nan, 5, 4, 6], [nan, nan, 1, nan, nan, nan, 0]),
        (X.deviation(3), [1, 3, 5, nan, 9], [nan, nan, 4 / 3, nan, nan]),
        (compound(X, 3), [0.10, nan, -0.05, 0.02], [0.10, 0.10, 0.045, 0.95 * 1.02 - 1]),
        (X.std(3), [1, nan, 3, 3, 3], [nan, nan, math.sqrt(2), 0, 0]),
        (X.sum(3, 2), [1, nan, nan, 4, 5], [nan, nan, nan, nan, 9]),
        (X.quantile(3, 0.5), [1, 4, nan, 2], [1, 2.5, 2.5, 3]),
        (X.slope(4), [1, 2, nan, 4, 5], [nan, 1, 1, 1.5, 1.5]),
        (X.fit(3), [2, 2, 2, 3, 4], [nan, nan, nan, 0.75, 1]),
        (X.residual(3), [1, 2, 3, 7], [nan, 0, 0, 0.5]),
        (X.age(), [0, 1, 0, nan, 2, 0], [nan, 0, 1, 2, 0, 1]),
        (X.streak(), [0, 1, 1, nan, 2, -1], [0, 1, 2, 0, 1, 0]),
        (1.0 / X, [0, 2, nan], [inf, 0.5, nan]),
        (X / X, [0, 2], [nan, 1]),
        (corr(X, X * 2.0, 3), [1, 1, 1, 2], [nan, nan, nan, 1]),
        (X.diff().mean(2).lag(1), [1, 2, 4, 7], [nan, nan, 1, 1.5]),
    ],
)
def test_primitives(spark, formula, x, want):
    close(values(spark, formula, x=x), want)


def test_blend_is_gated_and_not_renormalised(spark):
    formula = blend([(0.6, col("a")), (-0.4, col("b"))])
    close(values(spark, formula, a=[1, nan, 1, nan], b=[1, 1, nan, nan]), [0.2, nan, 0.6, nan])


def test_correlations_of_close_and_constant_values(spark):
    """Close values keep their digits, and a constant that sums round has no correlation, in SQL and in the kernels."""
    from alphaloom.functions.kernel import with_kernels

    panel = series(spark, x=[1.0, 1.0 + 1e-8, nan, 1.0 + 3e-8], y=[0.3, 0.1, 0.9, -0.3], flat=[1 / 9, 1 / 9, 1 / 9, 1 / 9], other=[1 / 3, 0.05, 0.7, -0.4])
    formulas = {"near": corr(X, col("y"), 4), "none": corr(col("other"), col("flat"), 4)}
    for make in (with_formulas, with_kernels):
        out = make(panel, formulas).orderBy("date").collect()
        close([nan if r["near"] is None else r["near"] for r in out], [nan, -1, -1, -1], 1e-7)
        assert [r["none"] for r in out] == [None] * 4


def test_one_exchange_for_many_nested_windows(spark):
    panel = spark.range(100).selectExpr("id % 5 AS symbol", "id AS date", *(f"CAST(id + {k} AS DOUBLE) AS {c}" for k, c in enumerate(("open", "high", "low", "close", "volume", "amount", "vwap"))))
    df = with_formulas(panel, alpha158.factors(), keep=["symbol", "date"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and plan.count("Sort [symbol") == 1


def test_registry():
    every = registry(canonicalize=False)
    assert len(every) == 537 and len(registry()) == 517 and len(registry(False)) == 263
    kept = set(registry())
    assert "RSV5" in kept and "TEMP_rsv_5" not in kept and "TEMP_rsv_1" in kept
    assert canonical(["RSV5", "TEMP_rsv_5", "LGBM_ret_20", "TEMP_ret_20", "X"]) == ["RSV5", "LGBM_ret_20", "X"]
    assert set().union(*map(sources, provider.factors().values())) <= set(provider.columns())


def test_bars(spark):
    o, h, l, c = [10, 11, 12], [12, 12, 13], [9, 10, 11], [11, 10.5, 12.5]
    close(values(spark, alpha158.bars()["KMID"], open=o, high=h, low=l, close=c)[:1], [0.1])
    close(values(spark, alpha158.prices((1,), ("open",))["OPEN1"], open=o, high=h, low=l, close=c), [nan, 10 / 10.5, 11 / 12.5])


def test_generate_over_a_short_panel(spark):
    n = 70
    panel = series(spark, open=[10 + i % 7 for i in range(n)], high=[12 + i % 7 for i in range(n)], low=[9 + i % 7 for i in range(n)], close=[11 + i % 5 for i in range(n)], volume=[100 + i for i in range(n)], amount=[1000 + 3 * i for i in range(n)])
    out = generate(panel, ["RSV5", "TEMP_rsv_5", "TECH_rsi_6", "LGBM_ret_20", "TS_ep", "TECH_cci_20", "VWAP0"])
    assert out.columns == ["symbol", "date", "RSV5", "TECH_rsi_6", "LGBM_ret_20", "TS_ep", "TECH_cci_20", "VWAP0"] and out.count() == n
    assert out.where("TS_ep = -1").count() == n and dict(out.dtypes)["RSV5"] == "float"
    with pytest.raises(ValueError):
        generate(panel, ["nothing"])


def smooth(x: pd.Series, alpha: float, least: int) -> pd.Series:
    """Recursive mean seeded with the first observed value; missing rows stay missing and do not decay it."""
    return x.ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=least).mean().where(x.notna())


def span(x: pd.Series, n: int) -> pd.Series:
    return smooth(x, 2 / (n + 1), n)


def smoothed(bars: pd.DataFrame) -> pd.DataFrame:
    """The recursive indicators of one symbol's bars in date order."""
    c, h, l = bars["close"], bars["high"], bars["low"]
    out = {}
    line = span(c, 12) - span(c, 26)
    signal = span(line, 9)
    out["macd_line_12_26_9"], out["macd_signal_12_26_9"], out["macd_hist_12_26_9"] = line, signal, line - signal
    move = c.diff()
    for n in technical.RSI:
        gain, loss = smooth(move.clip(lower=0), 1 / n, n), smooth((-move).clip(lower=0), 1 / n, n)
        no_gain, no_loss = ~(gain > 1e-12), ~(loss > 1e-12)
        out[f"rsi_{n}"] = (100 - 100 / (1 + gain / (loss + 1e-12))).where(~no_loss, 100.0).where(~(no_gain & no_loss), 50.0)
    up, down = h.diff(), -l.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    c1 = c.shift(1)
    span_ = pd.concat([(h - l).abs(), (h - c1).abs(), (l - c1).abs()], axis=1).max(axis=1)
    width = smooth(span_, 1 / 14, 14)
    p, m = (100 * smooth(x, 1 / 14, 14) / (width + 1e-12) for x in (plus, minus))
    out["adx_14"], out["plus_di_14"], out["minus_di_14"] = smooth(100 * (p - m).abs() / (p + m + 1e-12), 1 / 14, 14), p, m
    third = span(span(span(c, 15), 15), 15)
    trix = (third / third.shift(1) - 1) * 100
    signal = span(trix, 9)
    out["trix_15"], out["trix_signal_15_9"], out["trix_hist_15_9"] = trix, signal, trix - signal
    return pd.DataFrame(out)


def test_recursive_smoothing_equals_the_recurrence():
    rng = np.random.default_rng(0)
    x = rng.normal(10, 1, 60)
    x[[3, 17, 18]] = np.nan
    alpha, least, level, seen, want = 0.2, 5, None, 0, []
    for v in x:
        if np.isnan(v):
            want.append(np.nan)
            continue
        level, seen = v if level is None else alpha * v + (1 - alpha) * level, seen + 1
        want.append(level if seen >= least else np.nan)
    assert np.allclose(smooth(pd.Series(x), alpha, least), want, equal_nan=True)
    flat = smoothed(pd.DataFrame({"close": [5.0] * 40, "high": [5.0] * 40, "low": [5.0] * 40}))
    assert (flat["rsi_6"] == 50).all() and flat["adx_14"].dropna().eq(0).all()
    rising = smoothed(pd.DataFrame({"close": np.arange(40.0), "high": np.arange(40.0) + 1, "low": np.arange(40.0) - 1}))
    assert (rising["rsi_6"].iloc[10:] == 100).all()


# ---- expression language


def _dsl(spark, text, **columns):
    return values(spark, dsl.formula(dsl.parse(text)), **columns)


def test_expressions(spark):
    close(_dsl(spark, "close / delay(close, 2) - 1", close=[10, 11, 12, 15]), [nan, nan, 0.2, 15 / 11 - 1])
    assert _dsl(spark, "ts_mean(close,3)", close=[1, 3, 2, 4])[3] == 3
    close(_dsl(spark, "TS_RANK(close, 3)", close=[1, 3, 2, 4])[2:], [2 / 3, 1])
    close(_dsl(spark, "ts_mean(delta(close,1),2) * -1 + 2e0", close=[1, 3, 2, 4]), [nan, 0, 1.5, 1.5])
    close(_dsl(spark, "close / (close - 2)", close=[1, 2, inf]), [-1, nan, nan])
    close(_dsl(spark, "log(close) + sqrt(close) - -abs(close)", close=[1, -1, 0]), [2, nan, nan])
    close(_dsl(spark, "1 - 2 - 3 * (4 - 2) / 2", close=[0]), [-4])


@pytest.mark.parametrize(
    "text, words",
    [("lead(close,1)", "not allowed"), ("rank(close)", "cross-sectional"), ("close#volume", "unexpected character"), ("ts_mean(close)", "arguments"), ("ts_mean(close, 0)", "window"), ("ts_mean(close, n)", "window"), ("foo(close)", "unknown"), ("close +", "unexpected"), ("(close", "expected"), ("close close", "unexpected"), ("", "unexpected"), ("shift(close, 1)", "ahead")],
)
def test_expression_errors(text, words):
    with pytest.raises(dsl.ExpressionError, match=words):
        dsl.parse(text)


def test_profiles():
    ok = {"factors": [{"name": "a", "expr": "close / delay(open,5) - 1"}, {"name": "b", "expr": "ts_rank(volume,20)"}]}
    assert dsl.summary(list(dsl.profile(ok).values())) == {"columns": ["close", "open", "volume"], "functions": ["delay", "ts_rank"], "max_lookback": 20, "stage": "time_series"}
    for name, words in ((" label", "whitespace"), ("label", "can't"), ("label_x", "can't"), ("1a", "can't"), ("date", "can't")):
        with pytest.raises(dsl.ExpressionError, match=words):
            dsl.profile({"factors": [{"name": name, "expr": "close"}]})
    with pytest.raises(dsl.ExpressionError):
        dsl.profile({"factors": [ok["factors"][0]] * 2})
    with pytest.raises(dsl.ExpressionError):
        dsl.profile({"factors": []})
    assert dsl.projection([dsl.parse("vwap / close")]) == (["amount", "close", "date", "open", "symbol", "volume"], True)


# ---- labels


def test_labels(spark):
    o = [10, 10.5, 11, 10.8, 11.5, 12]
    close(values(spark, forward_return(1, traded=()), open=o)[:1], [11 / 10.5 - 1])
    three = values(spark, forward_return(3, traded=()), open=o)
    close(three[:3], [11.5 / 10.5 - 1, 12 / 11 - 1, nan])
    bad = values(spark, forward_return(1), open=[10, 10, 20, 22, 23], volume=[1, 1, 1, 0, 1], amount=[1, 1, 1, 1, 1])
    close(bad[:4], [nan] * 4)
    assert horizons("10, 5,5") == [1, 5, 10]
    with pytest.raises(ValueError):
        horizons("0")


def test_no_formula_looks_ahead(spark):
    """Changing rows after a date changes nothing up to it, labels aside."""
    n, cut = 40, 25
    base = {c: [10 + (i * k) % 7 + i / 50 for i in range(n)] for k, c in enumerate(("open", "high", "low", "close", "volume", "amount", "vwap", "turnover", "circ_mv", "pe_ttm", "pb"), 2)}
    later = {c: v[:cut] + [x * 3 + 1 for x in v[cut:]] for c, v in base.items()}
    names = {"RANK5": alpha158.rolling(5)["RANK5"], "BETA10": alpha158.rolling(10)["BETA10"], "CORR5": alpha158.rolling(5)["CORR5"], "obv": technical.windowed()["obv_flow_20"], "cci": technical.windowed()["cci_20"], "ln": call("ln", col("close"))}
    a, b = (with_formulas(series(spark, **d), names).orderBy("date").collect() for d in (base, later))
    for x, y in zip(a[:cut], b[:cut]):
        assert all(x[k] == y[k] for k in names)


def test_kernels_agree_with_sql(spark):
    """All factors by numpy kernels over Arrow batches and by SQL windows, on a panel with holes."""
    from alphaloom.functions.kernel import with_kernels

    rng = np.random.default_rng(4)
    names = sorted({s for x in registry(canonicalize=False).values() for s in sources(x)})
    rows = []
    for symbol, n in ((1, 1), (2, 70), (3, 40), (4, 130)):
        for i in range(n):
            rows.append((symbol, i, *(None if rng.random() < 0.05 else float(np.round(rng.choice([rng.normal(5, 2), 3.0, 0.0], p=[0.9, 0.07, 0.03]), 3)) for _ in names)))
    panel = spark.createDataFrame(rows, "symbol int, date int, " + ", ".join(f"{c} double" for c in names)).repartition(3).cache()
    f = {k: x for k, x in registry(canonicalize=False).items() if k not in {f"TECH_{s}" for s in technical.SMOOTHED}}
    frames = [make(panel, f, keep=["symbol", "date"]).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for make in (with_formulas, with_kernels)]
    for k in f:
        a, b = (np.where(np.isfinite(x), x, np.nan) for x in (fr[k].to_numpy(float) for fr in frames))
        big = np.abs(a) > 1e6  # over denominators that are only EPS, noise is what is left
        assert (np.isnan(a) == np.isnan(b))[~big].all(), k
        ok = ~np.isnan(a) & ~big & ~np.isnan(b)
        assert np.allclose(a[ok], b[ok], rtol=1e-6, atol=1e-6), k
    bars = panel.select("symbol", "date", "close", "high", "low").toPandas().sort_values(["symbol", "date"])
    by_hand = pd.concat([smoothed(g[["close", "high", "low"]].astype(float)) for _, g in bars.groupby("symbol")]).reset_index(drop=True)
    again = with_kernels(panel, technical.recursive(), keep=["symbol", "date"]).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for k in technical.SMOOTHED:
        a, b = (np.where(np.isfinite(x), x, np.nan) for x in (by_hand[k].to_numpy(float), again[k].to_numpy(float)))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), k
