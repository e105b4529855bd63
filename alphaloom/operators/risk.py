"""Risk schedules: how much of the account is invested on each date, from past information only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import observed


@dataclass(frozen=True)
class Curve:
    kind: str = "linear"  # linear, convex, concave or sigmoid
    power: float = 2.0
    steepness: float = 10.0
    center: float = 0.5

    def of(self, s: Column) -> Column:
        if self.kind == "linear":
            return s
        if self.kind == "convex":
            return F.pow(s, F.lit(self.power))
        if self.kind == "concave":
            return 1 - F.pow(1 - s, F.lit(self.power))
        if self.kind == "sigmoid":
            at = lambda x: 1 / (1 + math.exp(-self.steepness * (x - self.center)))
            raw = 1 / (1 + F.exp(-self.steepness * (s - self.center)))
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - at(0.0)) / max(at(1.0) - at(0.0), 1e-12)))
        raise ValueError(f"unknown risk curve {self.kind}")


def signal_schedule(signals: DataFrame, low: float, high: float, least: float, most: float, quantiles: tuple[float | None, float | None] = (None, None), curve: Curve = Curve(), date: str = "date") -> DataFrame:
    """date, signal and risk. Thresholds may be quantiles of the finite signals of earlier dates; while they don't part, the
    fixed ones hold. A series of one row per date."""
    if high <= low:
        raise ValueError("the upper signal must exceed the lower one")
    v = observed("signal")
    past = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    at = [F.coalesce(F.percentile(v, F.lit(q)).over(past), F.lit(d)) if q is not None else F.lit(d) for q, d in zip(quantiles, (low, high))]
    rows = signals.select(date, "signal", at[0].alias("_a"), at[1].alias("_b"))
    apart = F.col("_b") > F.col("_a")
    a, b = F.when(apart, F.col("_a")).otherwise(F.lit(low)), F.when(apart, F.col("_b")).otherwise(F.lit(high))
    x = F.nanvl("signal", F.lit(None).cast("double"))
    share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a))), F.lit(0.0))
    share = F.when(x.isNull(), F.lit(0.0)).otherwise(share)
    return rows.select(date, "signal", (least + curve.of(share) * (most - least)).alias("risk"))


def benchmark_schedule(returns: DataFrame, fast: int, slow: int, bull: float, neutral: float, bear: float, fallback: float, date: str = "date", value: str = "ret") -> DataFrame:
    """date and risk: bull above the fast mean of the benchmark's value, neutral above the slow one, else bear; known a day later."""
    if max(1, fast) >= max(1, slow):
        raise ValueError("the fast window must be shorter than the slow one")
    w = Window.orderBy(date)
    nav = returns.select(date, F.product(1 + F.coalesce(observed(value), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nav"))
    mean = lambda n: F.avg("nav").over(w.rowsBetween(-(max(1, n) - 1), 0))
    raw = F.when(F.col("nav") >= mean(fast), F.lit(bull)).when(F.col("nav") >= mean(slow), F.lit(neutral)).otherwise(F.lit(bear))
    nav = nav.withColumn("_raw", raw)
    return nav.select(date, F.coalesce(F.lag("_raw").over(w), F.lit(fallback)).alias("risk"))


def combined(*schedules: DataFrame, date: str = "date") -> DataFrame:
    """The lowest risk of several schedules on each date."""
    out = schedules[0].select(date, "risk")
    for s in schedules[1:]:
        out = out.join(s.select(date, F.col("risk").alias("_r")), date, "left").select(date, F.least("risk", "_r").alias("risk"))
    return out


def price_confirm(closes: DataFrame, window: int, date: str = "date", instrument: str = "instrument") -> DataFrame:
    """date, instrument and confirmed: the close is below its full-window mean."""
    w = Window.partitionBy(instrument).orderBy(date).rowsBetween(-(window - 1), 0)
    v = observed("close")
    ok = (F.count(v).over(w) == window) & (v < F.avg(v).over(w))
    return closes.select(date, instrument, F.coalesce(ok, F.lit(False)).alias("confirmed"))


def benchmark_returns(levels: DataFrame, date: str = "date", value: str = "close") -> DataFrame:
    """date and ret: change of a level; none after a level of zero."""
    before = F.lag(value).over(Window.orderBy(date))
    return levels.select(date, F.when(before != 0, F.col(value) / before - 1).alias("ret"))
