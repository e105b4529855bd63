"""Walk-forward windows, training frames, learners and validation metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import observed


def window_indices(start: int, train: int, valid: int, embargo: int) -> tuple[int, int, int, int] | None:
    """(train first, train last, valid first, valid last) before a test start; None without enough history."""
    valid_last = start - embargo - 1
    valid_first = valid_last - valid + 1
    train_last = valid_first - 1
    train_first = train_last - train + 1
    return (train_first, train_last, valid_first, valid_last) if train_first >= 0 else None


def rolling_windows(dates: DataFrame, train: int, valid: int, test: int, embargo: int, date: str = "date") -> DataFrame:
    """window_id and the first and last dates of train, valid and test; a window begins every `test` dates of the calendar.

    The calendar has a row per trading date, so it is one array whatever the panel's size; windows are places in it.
    """
    n, first = F.size("days"), train + valid + embargo
    starts = F.when(n > first, F.sequence(F.lit(first), n - 1, F.lit(test)))
    out = dates.agg(F.array_sort(F.collect_set(date)).alias("days")).select("days", F.explode(starts).alias("s"))
    at = {"train_start": F.col("s") - embargo - valid - train, "train_end": F.col("s") - embargo - valid - 1, "valid_start": F.col("s") - embargo - valid, "valid_end": F.col("s") - embargo - 1, "test_start": F.col("s"), "test_end": F.least(F.col("s") + test - 1, n - 1)}
    return out.select(((F.col("s") - first) / test).cast("long").alias("window_id"), *(F.get("days", i.cast("int")).alias(k) for k, i in at.items()))


def trainable(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows without an infinite feature and with a finite label."""
    return predictable(df, features).where(observed(label).isNotNull())


def predictable(df: DataFrame, features: list[str]) -> DataFrame:
    for f in features:
        df = df.where(~F.coalesce(F.abs(F.col(f)) == float("inf"), F.lit(False)))
    return df


Learner = Callable[[pd.DataFrame, pd.DataFrame, list[str]], Callable[[pd.DataFrame], np.ndarray]]


def ridge(train: pd.DataFrame, valid: pd.DataFrame, features: list[str], strength: float = 1.0) -> Callable[[pd.DataFrame], np.ndarray]:
    """Weighted ridge regression on standardised features, missing ones as the mean."""
    x = train[features].to_numpy(float)
    mean, std = np.nanmean(np.where(np.isnan(x).all(0), 0.0, x), axis=0), np.nanstd(np.where(np.isnan(x).all(0), 0.0, x), axis=0) + 1e-9
    z = lambda f: np.nan_to_num((f[features].to_numpy(float) - mean) / std)
    w = train["sample_weight"].to_numpy(float) if "sample_weight" in train else np.ones(len(train))
    a, y = z(train), train["label"].to_numpy(float)
    center = np.average(y, weights=w) if len(y) else 0.0
    beta = np.linalg.solve((a * w[:, None]).T @ a + strength * np.eye(len(features)), (a * w[:, None]).T @ (y - center)) if len(y) else np.zeros(len(features))
    return lambda f: z(f) @ beta + center


def walk_forward(rows: DataFrame, windows: DataFrame, features: list[str], learner: Learner = ridge, date: str = "date", instrument: str = "symbol", report: str = "prediction") -> DataFrame:
    """window_id, date, instrument and prediction of each window's test rows, by a learner fitted on its train and valid rows.

    With report "importance" (feature and gain) or "history" (round and validation metric) what the learner tells of itself instead. A
    window is a group: its rows are bounded by the window's length and the number of instruments, not by the history, and
    travel as single-precision features.
    """
    from .joins import windows_of

    some = rows.select(date, instrument, "label", *(F.col(f).cast("float").alias(f) for f in features), *(["sample_weight"] if "sample_weight" in rows.columns else []))
    dealt = windows_of(some, windows.select("window_id", *(f"{p}_{e}" for p in ("train", "valid", "test") for e in ("start", "end"))), date)
    schemas = {
        "prediction": f"window_id long, {date} {dict(rows.dtypes)[date]}, {instrument} {dict(rows.dtypes)[instrument]}, prediction double",
        "importance": "window_id long, feature string, gain double", "history": "window_id long, round int, metric double",
    }

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part = {p: group[group["part"] == p].sort_values([date, instrument]) for p in ("train", "valid", "test")}
        known = {p: part[p][np.isfinite(part[p]["label"].astype(float))] for p in ("train", "valid")}
        test = part["test"]
        if not len(known["train"]) or not len(test):
            return pd.DataFrame({c.split()[0]: [] for c in schemas[report].split(", ")})
        model = learner(known["train"], known["valid"], features)
        if report == "importance":
            told = getattr(model, "importance", {})
            return pd.DataFrame({"window_id": key[0], "feature": list(told), "gain": list(told.values())})
        if report == "history":
            told = getattr(model, "history", [])
            return pd.DataFrame({"window_id": key[0], "round": range(1, len(told) + 1), "metric": told})
        return pd.DataFrame({"window_id": test["window_id"], date: test[date], instrument: test[instrument], "prediction": model(test)})

    return dealt.groupBy("window_id").applyInPandas(run, schemas[report])


def topk_summary(df: DataFrame, k: int, date: str = "date", prediction: str = "prediction", label: str = "label", tie: str = "instrument", earlier: bool = False, opportunity: str | None = None) -> DataFrame:
    """One row: means over dates of what the k highest predictions bring. Of equal predictions at the border the later instruments are
    among the k, or the earlier; the first among the k is always the earlier one. `opportunity` is a column of 0, 1 or missing."""
    both = df.where(observed(prediction).isNotNull() & observed(label).isNotNull()).withColumn("_o", observed(opportunity) if opportunity else F.lit(None).cast("double"))
    border = Window.partitionBy(date).orderBy(F.desc(prediction), F.asc(tie) if earlier else F.desc(tie))
    placed = both.withColumn("_top", F.row_number().over(border) <= max(1, k))
    first = F.row_number().over(Window.partitionBy(date).orderBy(F.desc("_top"), F.desc(prediction), tie)) == 1
    placed = placed.withColumn("_first", first)
    y, top, one = F.col(label), F.col("_top"), F.col("_first")
    daily = placed.groupBy(date).agg(
        F.max(F.when(one, y)).alias("top1"), F.avg(F.when(top, y)).alias("top"), F.avg(y).alias("all"), F.percentile(F.when(top, y), F.lit(0.5)).alias("median"), F.min(F.when(top, y)).alias("least"),
        F.avg(F.when(top, (y > 0).cast("double"))).alias("positive"), F.max(F.when(one, F.col("_o"))).alias("top1_opportunity"), F.avg(F.when(top, F.col("_o"))).alias("opportunity"),
    )
    mean = lambda c, name: F.avg(c).alias(f"valid_{name}")
    return daily.agg(
        F.count("*").alias("valid_topk_days"), mean("top1", "top1_label_mean"), mean((F.col("top1") > 0).cast("double"), "top1_positive_rate"), mean("top", "topk_label_mean"), mean("median", "topk_label_median"),
        mean("least", "topk_min_label_mean"), mean("positive", "topk_positive_rate"), mean(F.col("top") - F.col("all"), "topk_excess_mean"), mean("top1_opportunity", "top1_opportunity_rate"), mean("opportunity", "topk_opportunity_rate"),
    )


def of_predictions(labels: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("date", "instrument")) -> DataFrame:
    """The label rows whose date and instrument were predicted."""
    return labels.join(predictions.select(*keys).distinct(), list(keys), "left_semi")


def baselines(scores: DataFrame, weights: DataFrame, date: str = "date", instrument: str = "symbol") -> DataFrame:
    """Four reference scores of long rows (date, instrument, feature, x) with weights (feature, rank_ic): mean of z-scores, of
    z-scores with the sign of the training rank IC, of rank percentages, and of rank percentages weighted by it."""
    from .crosssection import average_rank, group_count

    w = Window.partitionBy("feature", date)
    v = observed("x")
    std = F.stddev_pop(v).over(w)
    rows = scores.withColumns({"z": F.when(std > 1e-12, (v - F.avg(v).over(w)) / std).otherwise(F.when(v.isNotNull(), F.lit(0.0))), "r": average_rank(v, "feature", date) / group_count(v, "feature", date)})
    rows = rows.join(weights.select("feature", "rank_ic"), "feature", "left")
    ic = F.coalesce("rank_ic", F.lit(0.0))
    return rows.groupBy(date, instrument).agg(F.avg("z").alias("average"), F.avg(F.signum(ic) * F.col("z")).alias("sign_aligned"), F.avg("r").alias("rank_average"), F.sum(ic * F.col("r")).alias("rank_ic_weighted"))


def effective(df: DataFrame, features: list[str], label: str = "label") -> Column:
    """Whether a row takes part in training: a finite label and no infinite feature (missing ones may be)."""
    return reduce(lambda a, f: a & ~F.coalesce(F.abs(F.col(f)) == float("inf"), F.lit(False)), features, observed(label).isNotNull())


def with_edge(df: DataFrame, mode: str, threshold: float = 0.0, features: list[str] | None = None, benchmark: DataFrame | None = None, out: str = "edge", date: str = "date") -> DataFrame:
    """df with the edge of each effective row: its label, that less a threshold, or less its industry's mean over
    effective rows or the benchmark's forward return (date, forward) too. An empty industry, or a date without a benchmark, has none."""
    v = F.when(effective(df, features or []), F.col("label"))
    if mode == "positive":
        return df.withColumn(out, v)
    if mode == "threshold":
        return df.withColumn(out, v - threshold)
    if mode == "industry_excess":
        named = F.coalesce(F.col("industry") != "", F.lit(False))
        return df.withColumn(out, F.when(named, v - F.avg(v).over(Window.partitionBy(date, "industry")) - threshold))
    if mode == "benchmark_excess":
        if benchmark is None:
            raise ValueError("an excess over the benchmark takes a benchmark")
        known = benchmark.select(date, observed("forward").alias("_forward"))
        return df.join(known, date, "left").withColumn(out, v - F.col("_forward") - threshold).drop("_forward")
    raise ValueError(f"unknown opportunity mode {mode}")
