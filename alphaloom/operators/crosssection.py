"""Cross-sectional transforms: ranks, scores and bins within a date."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .grouped import column_ranks, whole_groups


def observed(x: str | Column) -> Column:
    """x where it is finite, else missing."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(c) < float("inf"), c)


def average_rank(value: Column, *keys: str) -> Column:
    """Average rank (from 1) among the known values of a group; missing stays missing."""
    known = value.isNotNull()
    groups = [*map(F.col, keys), known]
    first = F.rank().over(Window.partitionBy(*groups).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    return F.when(known, first + (ties - 1) / F.lit(2.0))


def group_count(value: Column, *keys: str) -> Column:
    return F.count(value).over(Window.partitionBy(*map(F.col, keys)))


def rank_pct(df: DataFrame, columns: list[str], date: str = "date", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Each column as its average rank within a date over the number of finite values; non-finite values stay as they are.

    A date's rows come together once, and all columns are ranked in one pass over them.
    """
    names = [c for c in columns if c not in exclude]
    if not names:
        return df
    source = df.select(F.col(date).alias("_by"), *(F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns))
    places = [1 + df.columns.index(c) for c in names]

    def run(batches):
        for part in whole_groups(batches, 1):
            x = np.column_stack([part.column(k).to_numpy() for k in places])
            known = np.isfinite(x)
            share = column_ranks(np.where(known, x, np.nan)) / np.maximum(known.sum(axis=0), 1)
            missing = np.column_stack([part.column(k).chunk(0).is_null().to_numpy(zero_copy_only=False) for k in places])
            made = dict(zip(places, range(len(places))))
            arrays = [pa.array(np.where(known[:, made[k]], share[:, made[k]], x[:, made[k]]), pa.float64(), mask=missing[:, made[k]]) if k in made else part.column(k).chunk(0) for k in range(1, part.num_columns)]
            yield pa.record_batch(arrays, names=df_columns)

    df_columns = df.columns
    return source.repartition("_by").sortWithinPartitions("_by").mapInArrow(run, StructType(source.schema.fields[1:]))


def zscore_clip(df: DataFrame, column: str, out: str, clip: float = 0.0, date: str = "date") -> DataFrame:
    """Population z-score within a date, clipped to ±clip if positive; a constant cross-section is 0."""
    v = observed(column)
    w = Window.partitionBy(date)
    std = F.stddev_pop(v).over(w)
    z = F.when(std > 1e-12, (v - F.avg(v).over(w)) / std).otherwise(F.lit(0.0))
    if clip > 0:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return df.withColumn(out, F.when(v.isNotNull(), z))


def quantile_bin(value: Column, bins: int, *keys: str) -> Column:
    """0-based bin of a value by its average rank within a group: equal shares, not ntile."""
    share = average_rank(value, *keys) / group_count(value, *keys)
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins - 1e-12))).cast("long"))


def transformed(df: DataFrame, mode: str, column: str = "score", clip: float = 3.0, date: str = "date") -> DataFrame:
    """A score column as is ("none"), as rank_pct or as zscore_clip."""
    if mode == "none":
        return df
    if mode == "rank_pct":
        v = observed(column)
        return df.withColumn(column, average_rank(v, date) / group_count(v, date))
    if mode == "zscore_clip":
        return zscore_clip(df, column, column, clip, date)
    raise ValueError(f"unknown score transform {mode}")


def top_k(df: DataFrame, k: int, column: str = "score", date: str = "date", tie: str = "instrument") -> DataFrame:
    """The k highest finite scores of each date and their place."""
    w = Window.partitionBy(date).orderBy(F.col(column).desc(), tie)
    return df.where(observed(column).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def signal_strength(df: DataFrame, mode: str, k: int = 1, floor: float | None = None, column: str = "score", date: str = "date") -> DataFrame:
    """Per date top1, topk_sum or topk_mean (over min(k, n)) of the scores above the floor; without any, missing, or 0 for the sum."""
    v = observed(column)
    v = v if floor is None else F.when(v > floor, v)
    best = F.slice(F.sort_array(F.collect_list(v), asc=False), 1, 1 if mode == "top1" else k)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # Only the k best of a date are gathered: the rows are cut before the aggregation.
    place = F.row_number().over(Window.partitionBy(date).orderBy(v.desc_nulls_last()))
    cut = df.withColumn("_p", place).where(F.col("_p") <= (1 if mode == "top1" else k)).groupBy(date).agg(best.alias("b"))
    value = {"top1": F.get("b", F.lit(0)), "topk_sum": total("b"), "topk_mean": F.when(F.size("b") > 0, total("b") / F.size("b"))}[mode]
    return cut.select(date, value.alias("signal"))
