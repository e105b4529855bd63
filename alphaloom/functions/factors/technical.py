"""Technical indicators: those that smooth recursively, which only the kernels know, and those over windows."""

from __future__ import annotations

from ..expr import EPS, Node, call, col, fill, flag, when

RSI = (6, 14, 24)
SMOOTHED = ["macd_line_12_26_9", "macd_signal_12_26_9", "macd_hist_12_26_9", *(f"rsi_{n}" for n in RSI), "adx_14", "plus_di_14", "minus_di_14", "trix_15", "trix_signal_15_9", "trix_hist_15_9"]


def recursive() -> dict[str, Node]:
    """The recursive indicators; SQL windows have no recursion. A mean is seeded with the first observed value, and missing rows stay missing and don't decay it."""
    h, l, c = map(col, ("high", "low", "close"))
    ewm = lambda x, alpha, least: Node("ewm", x, alpha, least)
    by_span = lambda x, n: ewm(x, 2 / (n + 1), n)
    line = by_span(c, 12) - by_span(c, 26)
    signal = by_span(line, 9)
    out = {"macd_line_12_26_9": line, "macd_signal_12_26_9": signal, "macd_hist_12_26_9": line - signal}
    move = c.diff()
    for n in RSI:
        gain, loss = ewm(call("higher", move, 0.0), 1 / n, n), ewm(call("higher", -move, 0.0), 1 / n, n)
        no_gain, no_loss = (call("not", call("fill_false", x > EPS)) for x in (gain, loss))
        out[f"rsi_{n}"] = when(no_gain & no_loss, 50.0, when(no_loss, 100.0, 100.0 - 100.0 / (1.0 + gain / (loss + EPS))))
    up, down = h.diff(), l.lag(1) - l
    plus, minus = (when(call("fill_false", (a > b) & (a > 0.0)), a, 0.0) for a, b in ((up, down), (down, up)))
    c1 = c.lag(1)
    width = ewm(call("highest", call("highest", call("abs", h - l), call("abs", h - c1)), call("abs", l - c1)), 1 / 14, 14)
    p, m = (100.0 * ewm(x, 1 / 14, 14) / (width + EPS) for x in (plus, minus))
    out["adx_14"], out["plus_di_14"], out["minus_di_14"] = ewm(100.0 * call("abs", p - m) / (p + m + EPS), 1 / 14, 14), p, m
    trix = by_span(by_span(by_span(c, 15), 15), 15).change(1) * 100.0
    signal = by_span(trix, 9)
    out["trix_15"], out["trix_signal_15_9"], out["trix_hist_15_9"] = trix, signal, trix - signal
    return out


def windowed() -> dict[str, Node]:
    o, h, l, c, v = map(col, ("open", "high", "low", "close", "volume"))
    out: dict[str, Node] = {}
    for w in (20, 60):
        m, s = c.mean(w, w), c.std(w, w)
        out[f"boll_pos_{w}_2"], out[f"boll_width_{w}_2"], out[f"boll_zscore_{w}_2"] = (c - m) / (2.0 * s + EPS), 4.0 * s / (call("abs", m) + EPS), (c - m) / (s + EPS)
    price = call("float_sum3", h, l, c)
    flow, before = price * fill(v, 0.0), price.lag(1)
    rise, fall = (when(x, y, 0.0) for x, y in ((call("fill_false", price > before), flow), (call("fill_false", price < before), call("abs", flow))))
    out["mfi_14"] = 100.0 - 100.0 / (1.0 + rise.sum(14, 14) / (fall.sum(14, 14) + EPS))
    mean = price.mean(20, 20)
    out["cci_20"] = (price - mean) / (0.015 * price.deviation(20) + EPS)
    high, low = h.max(14, 14), l.min(14, 14)
    out["willr_14"] = -100.0 * (high - c) / (high - low + EPS)
    up, down = (100.0 * (25.0 - x) / 25.0 for x in (h.since(25, True), l.since(25, False)))
    out["aroon_up_25"], out["aroon_down_25"], out["aroon_osc_25"] = up, down, up - down
    for w in (20, 60):
        flow = fill(call("sign", c.diff()) * v, 0.0)
        out[f"obv_flow_{w}"] = flow.sum(w, w) / (fill(v, 0.0).sum(w, w) + EPS)
    return out


def factors() -> dict[str, Node]:
    return {f"TECH_{k}": x for k, x in (recursive() | windowed()).items()}
