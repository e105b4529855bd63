"""Streams of events as bars, sessions and smoothed values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Bars of an event stream by user and window; late events count until the watermark has passed."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), F.col("user_id").cast("string").alias("symbol"))
    k = F.struct("ts", "event_id")
    made = out.agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count("*").alias("volume"))
    return made.select("symbol", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: start, end and events."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def smoothed(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """The recursive mean of each user's values after each micro-batch; its state is one number a user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (None, 0)
        for f in frames:
            for v in f.sort_values(["ts", "event_id"])["value"]:
                if v == v:
                    level = v if level is None else alpha * v + (1 - alpha) * level
                    n += 1
        if level is not None:
            state.update((level, n))
        yield pd.DataFrame({"user_id": [key[0]], "level": [level], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, level double, n long", "level double, n long", "update", "NoTimeout")
