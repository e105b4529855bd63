"""What drives batches of diagnostics and backtests: periods, segments, provenance, checks of bundles and feature profiles."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crosssection import observed

#: Symbol prefixes of ordinary shares on the two exchanges (fixed values).
SHARES = ("600", "601", "603", "605", "688", "000", "001", "002", "003", "300", "301")


def period(config: dict, name: str) -> tuple[date, date]:
    """First and last date of train, valid, test or all of a configuration {"train": [start, end], ...}."""
    spans = {k: tuple(map(date.fromisoformat, v)) for k, v in config.items()}
    if name == "all":
        return min(a for a, _ in spans.values()), max(b for _, b in spans.values())
    if name not in spans:
        raise ValueError(f"no period {name}")
    return spans[name]


def segments(scheme: str, start: date, end: date, config: dict | None = None, custom: list[tuple[str, date, date]] | None = None) -> list[tuple[str, date, date]]:
    """Named date segments: none, config_split, yearly or custom; the first of equal names stays."""
    if scheme == "none":
        found = []
    elif scheme == "config_split":
        found = [(k, *period(config or {}, k)) for k in config or {}]
    elif scheme == "yearly":
        found = [(str(y), max(start, date(y, 1, 1)), min(end, date(y, 12, 31))) for y in range(start.year, end.year + 1)]
    elif scheme == "custom":
        found = list(custom or [])
    else:
        raise ValueError(f"unknown segment scheme {scheme}")
    return list({s[0]: s for s in reversed(found)}.values())[::-1]


def presets(name: str) -> list[dict]:
    """Runs that a preset stands for: label space and whether features are industry-neutral."""
    if name == "full_space":
        return [{"label_space": "raw", "neutral": False}, {"label_space": "industry_excess", "neutral": True}]
    if name == "quality_event_flow":
        return [{"label_space": s, "neutral": False} for s in ("raw", "industry_excess", "benchmark_excess")]
    raise ValueError(f"unknown preset {name}")


def from_training(manifest: dict) -> None:
    """Raises unless diagnostics saw training dates only: profiles must not be made of what comes later."""
    if manifest.get("period") != "train":
        raise ValueError(f"diagnostics of the period {manifest.get('period')} can't make a feature profile")


def feature_profile(name: str, ordered: list[str], n: int, source: dict) -> str:
    """A feature profile document of the first n selected features, with where they come from."""
    from_training(source)
    return json.dumps({"name": name, "columns": ordered[:n], "source": source}, indent=1)


def one_day_labels(metadata: dict) -> None:
    """Raises unless a bundle proves that its backtest labels span one day."""
    if metadata.get("backtest_label_horizon") != 1:
        raise ValueError("backtest labels must be one-day returns")


def unique_pairs(df: DataFrame, date_column: str = "date", instrument: str = "instrument") -> DataFrame:
    """df, failing on the first duplicate of a date and instrument that is read."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(date_column, instrument))
    return df.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, "a date and instrument stands twice").isNull()).drop("_n")


def matrix_summary(df: DataFrame, value: str = "score", date_column: str = "date", instrument: str = "instrument") -> DataFrame:
    """rows, dates, instruments, cells, finite, missing and density of a long matrix."""
    out = df.agg(F.count("*").alias("rows"), F.countDistinct(date_column).alias("dates"), F.countDistinct(instrument).alias("instruments"), F.count(observed(value)).alias("finite"))
    cells = F.col("dates") * F.col("instruments")
    return out.withColumns({"cells": cells, "missing": cells - F.col("finite"), "density": F.when(cells > 0, F.col("finite") / cells)})


def labelled_dates(df: DataFrame, label: str = "label", date_column: str = "date") -> DataFrame:
    """Rows of the dates that have at least one finite label."""
    dates = df.where(observed(label).isNotNull()).select(date_column).distinct()
    return df.join(dates, date_column, "left_semi")


def shares(symbol: Column) -> Column:
    """Whether a six-digit code is an ordinary share."""
    return symbol.rlike("^(" + "|".join(SHARES) + ")")


def latest_open(calendar: DataFrame, target: str, fresh: int = 40) -> date:
    """The last open date up to a target; an error if it is more than `fresh` days before it."""
    last = calendar.where(F.col("is_open") & (F.col("date") <= F.lit(target).cast("date"))).agg(F.max("date")).first()[0]
    if last is None or (date.fromisoformat(target) - last).days > fresh:
        raise ValueError(f"the calendar ends long before {target}")
    return last


def yearly_risk(daily: DataFrame, keys: tuple[str, ...] = ("run",), date_column: str = "date", value: str = "net_return") -> DataFrame:
    """Per run and year: return, volatility, worst day and deepest drawdown within the year."""
    from .metrics import YEAR, compounded, with_nav

    rows = daily.withColumn("year", F.year(date_column).cast("long"))
    v = observed(value)
    return with_nav(rows, value, (*keys, "year"), date_column).groupBy(*keys, "year").agg(compounded(v).alias("ret"), (F.stddev_samp(v) * F.sqrt(F.lit(float(YEAR)))).alias("volatility"), F.min(v).alias("worst_day"), F.min("drawdown").alias("max_drawdown"))
