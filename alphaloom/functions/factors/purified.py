"""Purified return, risk, liquidity and valuation factors."""

from __future__ import annotations

from ..expr import EPS, Node, call, col, corr, fill, flag, nonzero, sure, when


def inverse(x: Node) -> Node:
    """1 / x where x is positive."""
    return when(x > 0.0, 1.0 / x)


def true_range(c: Node, h: Node, l: Node) -> Node:
    """The largest known of the day's span and the two gaps to the last close."""
    c1 = c.lag(1)
    return call("highest", call("highest", h - l, call("abs", h - c1)), call("abs", l - c1))


def factors(returns=(20, 60), averages=(20, 60, 120), std=60, atr=14, short=20) -> dict[str, Node]:
    raw, h, l, v, amount, vwap = (col(x) for x in ("close", "high", "low", "volume", "amount", "vwap"))
    c, vol = nonzero(raw), nonzero(v)
    ret = c.change(1)
    out = {f"ret_{w}": c.change(w) for w in returns}
    out |= {f"dist_ma{w}": c / nonzero(c.mean(w)) - 1.0 for w in averages}
    pe, pb = col("pe_ttm"), col("pb")
    out |= {
        f"std_{std}": ret.std(std),
        f"atr_{atr}": true_range(raw, h, l).mean(atr) / c,
        f"amihud_{short}": (call("abs", ret) / (call("abs", amount) + EPS)).mean(short),
        f"vol_ratio_{short}": vol / nonzero(vol.mean(short)),
        f"corr_cv_{short}": corr(c, v, short),
        "vwap_ratio": c / nonzero(vwap) - 1.0,
        "log_mcap": call("ln", call("higher", col("circ_mv"), 0.0) + 1.0),
        "ep_ttm": fill(inverse(pe), -1.0), "is_loss": sure(pe <= 0.0), "ep_ttm_clean": inverse(pe), "ep_ttm_invalid": flag(pe <= 0.0),
        "bp": fill(inverse(pb), -1.0), "bp_clean": inverse(pb), "bp_invalid": flag(pb <= 0.0),
        f"turnover_{short}": col("turnover").mean(short),
        f"dist_high_{short}": c / nonzero(h.max(short)) - 1.0,
        f"dist_low_{short}": c / nonzero(l.min(short)) - 1.0,
    }
    return {f"LGBM_{k}": x for k, x in out.items()}
