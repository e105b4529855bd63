"""Small SVG charts of series that are one point a date: cumulative returns, drawdowns and a table of monthly returns."""

from __future__ import annotations

from html import escape


def lines(series: dict[str, list[tuple[str, float]]], title: str = "", width: int = 900, height: int = 360) -> str:
    """A chart with a line for each named series of (date text, value)."""
    points = [v for s in series.values() for _, v in s if v == v]
    low, high = (min(points), max(points)) if points else (0.0, 1.0)
    span, n = (high - low) or 1.0, max((len(s) for s in series.values()), default=1)
    x, y = (lambda k: 50 + k * (width - 70) / max(1, n - 1)), (lambda v: height - 30 - (v - low) * (height - 70) / span)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="10" y="20">{escape(title)}</text>']
    for j, (name, s) in enumerate(series.items()):
        hue = j * 137 % 360
        path = " ".join(f"{x(k):.1f},{y(v):.1f}" for k, (_, v) in enumerate(s) if v == v)
        out.append(f'<polyline fill="none" stroke="hsl({hue},60%,45%)" points="{path}"/><text x="{60 + 150 * j}" y="{height - 8}" fill="hsl({hue},60%,45%)">{escape(name)}</text>')
    out += [f'<text x="2" y="{y(v):.1f}" font-size="10">{v:.3g}</text>' for v in (low, high)]
    return "".join(out) + "</svg>"


def heatmap(months: dict[tuple[int, int], float], title: str = "") -> str:
    """Monthly returns as a grid of years and months."""
    years = sorted({y for y, _ in months})
    top = max((abs(v) for v in months.values()), default=1.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="700" height="{60 + 24 * len(years)}"><text x="10" y="20">{escape(title)}</text>']
    for (y, m), v in sorted(months.items()):
        a, b = 60 + 50 * (m - 1), 36 + 24 * years.index(y)
        out.append(f'<rect x="{a}" y="{b}" width="48" height="22" fill="hsl({120 if v >= 0 else 0},60%,{95 - 45 * abs(v) / top:.0f}%)"/><text x="{a + 4}" y="{b + 15}" font-size="10">{100 * v:.1f}</text>')
    out += [f'<text x="10" y="{51 + 24 * k}" font-size="11">{y}</text>' for k, y in enumerate(years)]
    return "".join(out) + "</svg>"
