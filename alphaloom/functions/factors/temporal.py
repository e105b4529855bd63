"""Eleven temporal shapes at seven windows."""

from __future__ import annotations

from ..expr import EPS, Node, call, col, corr, nonzero

# Fixed values.
WINDOWS = (1, 5, 10, 20, 30, 60, 120)


def shapes(w: int) -> dict[str, Node]:
    c, h, l, v = (nonzero(col(x)) for x in ("close", "high", "low", "volume"))
    ret, high, low = c.change(1), h.max(w), l.min(w)
    out = {
        "ret": c.change(w),
        "ma_gap": c / nonzero(c.mean(w)) - 1.0,
        "std": ret.std(w),
        "rsv": (c - low) / (high - low + EPS),
        "price_rank": c.rank(w),
        "volume_ratio": v / nonzero(v.mean(w)) - 1.0,
        "turnover_mean": col("turnover").mean(w),
        "amihud": (call("abs", ret) / (call("abs", col("amount")) + EPS)).mean(w),
        "high_gap": c / nonzero(high) - 1.0,
        "low_gap": c / nonzero(low) - 1.0,
        "corr_cv": corr(c, call("ln", v + 1.0), w),
    }
    return {f"TEMP_{k}_{w}": x for k, x in out.items()}


def factors(windows=WINDOWS) -> dict[str, Node]:
    out: dict[str, Node] = {}
    for w in windows:
        out |= shapes(w)
    return out
