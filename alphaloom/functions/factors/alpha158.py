"""The 158-factor family over price and volume."""

from __future__ import annotations

from ..expr import EPS, Node, call, col, corr, sure, when

# The published windows and factor names, by group.
WINDOWS = (5, 10, 20, 30, 60)
GROUPS = {
    "trend": ("ROC", "MA", "STD", "BETA", "RSQR", "RESI"),
    "range": ("MAX", "MIN", "QTLU", "QTLD", "RANK", "RSV", "IMAX", "IMIN", "IMXD"),
    "relation": ("CORR", "CORD", "CNTP", "CNTN", "CNTD"),
    "sums": ("SUMP", "SUMN", "SUMD"),
    "volume": ("VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD"),
}


def bars() -> dict[str, Node]:
    """Shapes of single bars."""
    o, h, l, c = map(col, ("open", "high", "low", "close"))
    spread = h - l + EPS
    top, bottom = call("higher", o, c), call("lower", o, c)
    shapes = {"KMID": (c - o, True), "KLEN": (h - l, False), "KUP": (h - top, True), "KLOW": (bottom - l, True), "KSFT": (2.0 * c - h - l, True)}
    out = {}
    for name, (size, both) in shapes.items():
        out[name] = size / o
        if both:
            out[f"{name}2"] = size / spread
    return out


def prices(windows=(0,), fields=("open", "high", "low", "vwap")) -> dict[str, Node]:
    return {f"{f.upper()}{w}": col(f).lag(w) / col("close") for f in fields for w in windows}


def volumes(windows=()) -> dict[str, Node]:
    return {f"VOLUME{w}": col("volume").lag(w) / (col("volume") + EPS) for w in windows}


def guarded(x: Node, y: Node, n: int) -> Node:
    """Correlation, missing where either series hardly moves in the frame."""
    quiet = lambda z: call("fill_false", z.std(n) <= 2e-5)
    return when(call("not", quiet(x)) & call("not", quiet(y)), corr(x, y, n))


def _parts(x: Node, w: int) -> tuple[Node, Node, Node]:
    """Rising, falling and net shares of the moves of x."""
    move = x.diff()
    whole = call("abs", move).sum(w) + EPS
    up, down = call("higher", move, 0.0).sum(w), call("higher", -move, 0.0).sum(w)
    return up / whole, down / whole, (up - down) / whole


def rolling(w: int) -> dict[str, Node]:
    h, l, c, v = map(col, ("high", "low", "close", "volume"))
    low, high = l.min(w), h.max(w)
    first, last = h.place_of(w, True), l.place_of(w, False)
    c1, v1 = c.lag(1), v.lag(1)
    rises, falls = sure(c > c1).mean(w), sure(c < c1).mean(w)
    swing = call("abs", c / c1 - 1.0) * v
    sump, sumn, sumd = _parts(c, w)
    vsump, vsumn, vsumd = _parts(v, w)
    out = {
        "ROC": c.lag(w) / c, "MA": c.mean(w) / c, "STD": c.std(w) / c, "BETA": c.slope(w) / c, "RSQR": c.fit(w), "RESI": c.residual(w) / c,
        "MAX": high / c, "MIN": low / c, "QTLU": c.quantile(w, 0.8) / c, "QTLD": c.quantile(w, 0.2) / c, "RANK": c.rank(w), "RSV": (c - low) / (high - low + EPS),
        "IMAX": first / w, "IMIN": last / w, "IMXD": (first - last) / w,
        "CORR": guarded(c, call("ln", v + 1.0), w), "CORD": guarded(c / c1, call("ln", v / v1 + 1.0), w), "CNTP": rises, "CNTN": falls, "CNTD": rises - falls,
        "SUMP": sump, "SUMN": sumn, "SUMD": sumd,
        "VMA": v.mean(w) / (v + EPS), "VSTD": v.std(w) / (v + EPS), "WVMA": swing.std(w) / (swing.mean(w) + EPS), "VSUMP": vsump, "VSUMN": vsumn, "VSUMD": vsumd,
    }
    return {f"{k}{w}": x for k, x in out.items()}


def factors(windows=WINDOWS) -> dict[str, Node]:
    out = bars() | prices()
    for w in windows:
        out |= rolling(w)
    return out
