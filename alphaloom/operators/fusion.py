"""Fusing two score tables over the pairs that both know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crosssection import average_rank, group_count
from .joins import fused_pairs


def fuse(primary: DataFrame, secondary: DataFrame, mode: str = "multiply", transform: tuple[str, str] = ("raw", "raw"), power: tuple[float, float] = (1.0, 1.0), weight: float = 0.5, least: float = 0.0, date: str = "date", instrument: str = "instrument") -> DataFrame:
    """date, instrument and score: product, weighted mean, or the first score where the second reaches `least`."""
    pairs = fused_pairs(primary, secondary, (date, instrument))
    value = {}
    for name, kind, p in zip("ab", transform, power):
        x = F.col(name) if kind == "raw" else average_rank(F.col(name), date) / group_count(F.col(name), date)
        value[name] = x
    pairs = pairs.withColumns({"fa": value["a"], "fb": value["b"]})
    a, b = (F.signum(c) * F.pow(F.abs(c), F.lit(p)) if p != 1.0 else F.col(c) for c, p in zip(("fa", "fb"), power))
    score = {"multiply": a * b, "blend": (1 - weight) * a + weight * b, "filter": F.when(F.col("fb") >= least, a)}[mode]
    return pairs.select(date, instrument, score.alias("score")).where("score IS NOT NULL")
