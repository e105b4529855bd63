"""Feature selection: thresholds, exact duplicates, robust merges and correlation pruning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors.registry import DUPLICATES
from .crosssection import observed


@dataclass(frozen=True)
class Thresholds:
    coverage: float = 0.95
    rank_ic: float = 0.02
    rank_ic_ir: float = 0.10
    monthly_rate: float = 0.45
    segment_hit: float | None = None
    segment_range: float | None = None
    no_flip: bool = False


def _column(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def scored(df: DataFrame) -> DataFrame:
    """Summaries with absolute metrics, the monthly directional rate (or its fallback) and the prefix priority."""
    p = _column(df, "monthly_rank_ic_positive_rate")
    monthly = _column(df, "monthly_rank_ic_directional_hit_rate") if "monthly_rank_ic_directional_hit_rate" in df.columns else F.when(p.isNotNull(), F.greatest(p, 1 - p))
    name = F.col("feature")
    priority = F.when(name.startswith("TS_"), 0).when(name.startswith("LGBM_"), 1).when(name.startswith("TECH_"), 2).when(name.startswith("TEMP_"), 4).otherwise(3)
    return df.withColumns({
        "rank_ic_abs_mean": F.abs("rank_ic_mean"), "rank_ic_ir_abs": F.abs("rank_ic_ir"), "monotonicity_abs_mean": F.abs(_column(df, "monotonicity_mean")), "monthly_rank_ic_directional_hit_rate": monthly,
        "prefix_priority": priority.cast("long"), "direction_flip": F.coalesce(_column(df, "direction_flip", "boolean"), F.lit(False)),
        **{c: _column(df, c) for c in ("segment_monthly_directional_hit_mean", "segment_rank_ic_abs_max", "segment_rank_ic_mean_range")},
    })


def order() -> list[Column]:
    """Best first; missing values last in either direction."""
    down = lambda c: F.desc_nulls_last(c)
    return [
        F.col("direction_flip").asc(), down("segment_monthly_directional_hit_mean"), F.asc_nulls_last("segment_rank_ic_mean_range"), down("segment_rank_ic_abs_max"), down("rank_ic_ir_abs"),
        down("rank_ic_abs_mean"), down("monotonicity_abs_mean"), down("monthly_rank_ic_directional_hit_rate"), down("coverage_pct"), F.asc("prefix_priority"), F.asc("feature"),
    ]


def passing(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Scored rows that no threshold rules out; a missing metric rules nothing out."""
    bad = [F.col("coverage_pct") < t.coverage, (F.col("rank_ic_abs_mean") < t.rank_ic) & (F.col("rank_ic_ir_abs") < t.rank_ic_ir), F.col("monthly_rank_ic_directional_hit_rate") < t.monthly_rate]
    if t.segment_hit is not None:
        bad.append(F.col("segment_monthly_directional_hit_mean") < t.segment_hit)
    if t.segment_range is not None:
        bad.append(F.col("segment_rank_ic_mean_range") > t.segment_range)
    if t.no_flip:
        bad.append(F.col("direction_flip"))
    for b in bad:
        df = df.where(~F.coalesce(b, F.lit(False)))
    return df


def without_duplicates(df: DataFrame, groups: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Scored rows with kept, dropped_by and duplicate_group: of each group of same factors the best-ordered one stays."""
    groups = sorted({tuple(sorted((k, v))) for k, v in DUPLICATES.items()}) if groups is None else groups
    keys = df.sparkSession.createDataFrame([(f, "|".join(g)) for g in groups for f in g], "feature string, duplicate_group string")
    df = df.join(F.broadcast(keys), "feature", "left")  # the list of known duplicates, a fixed few
    group = F.coalesce("duplicate_group", "feature")
    w = Window.partitionBy(group).orderBy(*order())
    first = F.first("feature").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"kept": F.row_number().over(w) == 1, "dropped_by": F.when(F.row_number().over(w) > 1, first)})


# Metrics of which the lower counts, the higher, and the smaller size with the agreed direction.
_LOWER = ["observation_count", "valid_observation_count", "coverage_pct", "avg_daily_coverage_pct", "date_count", "effective_date_count", "monotonic_date_count", "rank_ic_positive_rate", "rank_ic_directional_hit_rate", "monthly_rank_ic_positive_rate", "monthly_rank_ic_directional_hit_rate", "monthly_rank_ic_months", "monotonicity_positive_rate", "top_bottom_spread_positive_rate", "segment_monthly_directional_hit_mean", "segment_monthly_directional_hit_min", "segment_rank_ic_abs_max", "segment_rank_ic_abs_min"]
_HIGHER = ["ic_std", "rank_ic_std", "segment_rank_ic_mean_range"]
_SIGNED = ["ic_mean", "ic_ir", "rank_ic_mean", "rank_ic_ir", "monthly_rank_ic_mean", "monotonicity_mean", "top_bottom_spread_mean"]


def robust(raw: DataFrame, neutral: DataFrame) -> DataFrame:
    """Raw and industry-neutral summaries merged cautiously: the worse of each metric, and a direction only where both agree."""
    a = raw.select("feature", *(F.col(c).alias(f"{c}_raw") for c in raw.columns if c != "feature"))
    b = neutral.select("feature", *(F.col(c).alias(f"{c}_neutral") for c in neutral.columns if c != "feature"))
    both = a.join(b, "feature")
    side = lambda c, s: _column(both, f"{c}_{s}")
    sign = lambda s: F.coalesce(F.signum(side("rank_ic_mean", s)), F.lit(0.0))
    agree = (sign("raw") == sign("neutral")) & (sign("raw") != 0)
    direction = F.when(agree, sign("raw")).otherwise(F.lit(0.0))
    low = lambda c: F.least(side(c, "raw"), side(c, "neutral"))
    size = lambda c, f: f(F.abs(side(c, "raw")), F.abs(side(c, "neutral")))
    ratio = lambda x, y: F.when(F.abs(y) > 1e-12, x / y)
    flip = lambda s: F.coalesce(_column(both, f"direction_flip_{s}", "boolean"), F.lit(False))
    out = {"direction_consistent": agree, "direction_flip": flip("raw") | flip("neutral") | ~agree, "raw_direction": sign("raw"), "neutral_direction": sign("neutral"), "suggested_direction": direction}
    out |= {c: low(c) for c in _LOWER} | {c: F.greatest(side(c, "raw"), side(c, "neutral")) for c in _HIGHER} | {c: direction * size(c, F.least) for c in _SIGNED}
    for c, short in (("rank_ic_mean", "rank_ic_abs"), ("rank_ic_ir", "rank_ic_ir_abs")):
        out[f"neutral_retention_{short}"] = ratio(F.abs(side(c, "neutral")), F.abs(side(c, "raw")))
        out[f"robust_{short}_ratio"] = ratio(size(c, F.least), size(c, F.greatest))
    return both.select("feature", *(v.alias(k) for k, v in out.items())).withColumns({"rank_ic_abs_mean": F.abs("rank_ic_mean"), "rank_ic_ir_abs": F.abs("rank_ic_ir"), "ic_ir_abs": F.abs("ic_ir")})


_MOMENTS = ["n", "x", "y", "xy", "xx", "yy"]


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b and corr of every pair of features over the rows where both are finite, from raw moments.

    Moments of all pairs are matrix products of a batch; a task sends one row per feature, whatever its rows. The plan doesn't grow with the features.
    """
    f = len(features)
    names = pa.array(features)

    def moments(batches):
        total = [np.zeros((f, f)) for _ in _MOMENTS]
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) if batch.num_rows else np.zeros((0, f))
            known = np.isfinite(x)
            x, m = np.where(known, x, 0.0), known.astype(np.float64)
            cross, square = x.T @ m, (x * x).T @ m
            for t, part in zip(total, (m.T @ m, cross, cross.T, x.T @ x, square, square.T)):
                t += part
        yield pa.record_batch([pa.array(np.arange(f)), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)], names=["i", *_MOMENTS])

    def added(batches):
        rows: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, i in enumerate(batch.column(0).to_pylist()):
                parts = [np.asarray(c[k].values) for c in batch.columns[1:]]
                rows[i] = [a + b for a, b in zip(rows[i], parts)] if i in rows else parts
        for i, (n, x, y, xy, xx, yy) in rows.items():
            j = np.arange(i + 1, f)
            dx, dy = (n * xx - x * x)[j], (n * yy - y * y)[j]
            ok = (n[j] >= 2) & (dx > 0) & (dy > 0)
            corr = np.full(len(j), np.nan)
            corr[ok] = (n * xy - x * y)[j][ok] / np.sqrt(dx[ok] * dy[ok])
            yield pa.record_batch([names.take(pa.array(np.full(len(j), i))), names.take(pa.array(j)), pa.array(corr, from_pandas=True)], names=["a", "b", "corr"])

    schema = "i long, " + ", ".join(f"{m} array<double>" for m in _MOMENTS)
    sums = df.select(*(F.col(c).cast("double").alias(c) for c in features)).mapInArrow(moments, schema)
    return sums.repartition("i").mapInArrow(added, "a string, b string, corr double")


def prune_correlated(df: DataFrame, ordered: list[str], most: float = 0.97) -> tuple[list[str], list[tuple[str, str]]]:
    """(kept, dropped with the feature that rules it out): features in score order, each dropped if it is too close to a kept one.

    The driver holds a number for each pair of candidate features, whatever the number of rows.
    """
    corr = {(r["a"], r["b"]): r["corr"] for r in correlations(df, ordered).collect()} if len(ordered) > 1 else {}
    kept: list[str] = []
    dropped: list[tuple[str, str]] = []
    for f in ordered:
        near = [(abs(c), k) for k in kept if (c := corr.get((k, f), corr.get((f, k)))) is not None]
        close = max(near, default=(0.0, ""))
        if close[0] >= most:
            dropped.append((f, close[1]))
        else:
            kept.append(f)
    return kept, dropped


def build_profile(df: DataFrame, summaries: DataFrame, n: int, thresholds: Thresholds = Thresholds(), most: float = 0.97, neutral: DataFrame | None = None) -> dict[str, object]:
    """From summaries to a feature list: the robust merge (with neutral ones), thresholds, exact duplicates, correlated features, and the first n.

    selected, dropped_duplicates and dropped_correlated (feature, the one that rules it out), and how many were left after each step.
    """
    merged = scored(summaries if neutral is None else robust(summaries, neutral))
    fit = passing(merged, thresholds)
    told = without_duplicates(fit)
    ordered = [r["feature"] for r in told.where("kept").orderBy(*order()).select("feature").collect()]
    twins = [(r["feature"], r["dropped_by"]) for r in told.where("NOT kept").select("feature", "dropped_by").orderBy("feature").collect()]
    kept, close = prune_correlated(df, ordered, most)
    steps = {"candidates": merged.count(), "passing": len(ordered) + len(twins), "without_duplicates": len(ordered), "without_correlated": len(kept), "selected": len(kept[:n])}
    return {"selected": kept[:n], "dropped_duplicates": twins, "dropped_correlated": close, "steps": steps}
