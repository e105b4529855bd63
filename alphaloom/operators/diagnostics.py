"""Single-factor diagnostics: daily information coefficients, bucket returns, summaries, segments and missingness."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .crosssection import average_rank, observed, quantile_bin
from .grouped import column_ranks, whole_groups

#: Features that one unpivot carries; more are done in chunks, to bound the growth of rows.
CHUNK = 64
# The group of a feature by what its name begins with or holds ("~"), provider features first without their TS_; the first match holds.
_PROVIDER = [
    ("tushare_semantic_alpha", ["sem_"]),
    ("tushare_industry", ["industry_", "stock_vs_industry", "stock_industry", "stock_relative_strength"]),
    ("tushare_financial_quality", ["fi_", *(f"latest_{x}" for x in ("eps", "dt_eps", "bps", "ocfps", "roe", "roa", "grossprofit", "netprofit", "debt", "q_", "tr_", "or_", "op_", "ocf"))]),
    ("tushare_event_forecast_express", ["fc_", "exp_", "latest_fc", "latest_exp"]),
    ("tushare_limit_state", ["~limit", "gap_", "hit_", "near_", "days_since_last"]),
    ("tushare_flow_liquidity", ["~turnover", "~amihud", "free_", "volume_ratio", "downside_"]),
    ("tushare_valuation_dividend", ["ep", "sp", "bp", "dividend", "latest_div", "has_dividend", "has_stock_dividend"]),
]
_OTHERS = [("lgbm_purified", ["LGBM_"]), ("temporal", ["TEMP_"]), ("technical", ["TECH_"]), ("alpha360", ["A360_"])]


def _grouped(name: Column, groups: list, rest: str) -> Column:
    fits = lambda p: name.contains(p[1:]) if p.startswith("~") else name.startswith(p)
    return reduce(lambda out, g: F.when(reduce(lambda a, b: a | b, map(fits, g[1])), g[0]).otherwise(out), reversed(groups), F.lit(rest))


def feature_group(name: Column) -> Column:
    """The group that a feature's name says it belongs to."""
    return F.when(name.startswith("TS_"), _grouped(F.substr(name, F.lit(4)), _PROVIDER, "tushare_other")).otherwise(_grouped(name, _OTHERS, "alpha158"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate, to twelve digits (so that none is 0, not noise); missing for fewer than two rows or a constant side."""
    varies = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))), 12))


def long_form(df: DataFrame, features: list[str], ids: tuple[str, ...] = ("date", "symbol", "label")) -> DataFrame:
    """A row per feature and row of df: feature, x, y (finite values only, else missing)."""
    parts = []
    for k in range(0, len(features), CHUNK):
        chunk = features[k : k + CHUNK]
        values = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in chunk))
        parts.append(values.unpivot(list(ids), chunk, "feature", "x"))
    long = reduce(DataFrame.union, parts)
    return long.withColumn("x", observed("x")).withColumn("y", observed("label"))


def daily_ic(long: DataFrame) -> DataFrame:
    """feature, date, rows, n (finite pairs), ic and rank_ic; both correlations are missing unless both are known."""
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(pair, F.col("x")), F.when(pair, F.col("y"))
    ranked = long.select("feature", "date", x.alias("x"), y.alias("y")).withColumns({"rx": average_rank(F.col("x"), "feature", "date"), "ry": average_rank(F.col("y"), "feature", "date")})
    out = ranked.groupBy("feature", "date").agg(F.count("*").alias("rows"), F.count("x").alias("n"), correlation("x", "y").alias("ic"), correlation("rx", "ry").alias("rank_ic"))
    both = F.col("ic").isNotNull() & F.col("rank_ic").isNotNull()
    return out.select("feature", "date", "rows", "n", F.when(both, F.col("ic")).alias("ic"), F.when(both, F.col("rank_ic")).alias("rank_ic"))


def bucket_returns(long: DataFrame, bins: int = 5) -> DataFrame:
    """feature, date, bucket (0-based), n and mean label, of dates with at least two different x and `bins` finite pairs."""
    pairs = long.where("x IS NOT NULL AND y IS NOT NULL")
    w = Window.partitionBy("feature", "date")
    kept = pairs.withColumns({"_n": F.count("x").over(w), "_varies": F.min("x").over(w) < F.max("x").over(w), "varied_y": F.min("y").over(w) < F.max("y").over(w)}).where((F.col("_n") >= bins) & F.col("_varies"))
    kept = kept.withColumn("bucket", quantile_bin(F.col("x"), bins, "feature", "date"))
    return kept.groupBy("feature", "date", "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("mean_label"), F.max("varied_y").alias("varied_y"))


def daily_spread(buckets: DataFrame) -> DataFrame:
    """feature, date, spread (last populated bucket less the first) and monotonicity (rank correlation of buckets and means)."""
    ranked = buckets.withColumn("r", average_rank(F.col("mean_label"), "feature", "date")).withColumn("b", F.col("bucket").cast("double"))
    ranked = ranked.withColumn("b", average_rank(F.col("b"), "feature", "date"))
    out = ranked.groupBy("feature", "date").agg(F.count("*").alias("k"), (F.max_by("mean_label", "bucket") - F.min_by("mean_label", "bucket")).alias("spread"), correlation("b", "r").alias("monotonicity"), F.max("varied_y").alias("varied_y"))
    return out.where("k >= 2").drop("k")


def monthly_rank_ic(daily: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Mean rank IC by feature and month end."""
    return daily.where("rank_ic IS NOT NULL").groupBy(*keys, F.last_day("date").alias("month")).agg(F.avg("rank_ic").alias("rank_ic"), F.count("*").alias("days"))


def rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def icir(x: str) -> Column:
    return F.when(F.stddev_samp(x) > 1e-8, F.avg(x) / F.stddev_samp(x))


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    """As `correlation`; NaN where that is missing."""
    if len(x) < 2 or x.min() == x.max() or y.min() == y.max():
        return np.nan
    a, b = x - x.mean(), y - y.mean()
    return round(float(np.clip(a @ b / np.sqrt((a @ a) * (b @ b)), -1, 1)), 12)


def daily_shapes(df: DataFrame, features: list[str], bins: int = 5, keys: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """What `daily_ic` and `daily_spread` give, side by side: a row for each feature and date (and keys).

    A date's rows come together once and wide, as Arrow batches, whatever the number of features; spread, monotonicity and
    varied_y are missing where there are no buckets.
    """
    by = [*keys, "date"]
    source = df.select(*by, observed(label).cast("double").alias("_y"), *(observed(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)))
    names = pa.array(features)
    kinds = [source.schema[c] for c in by]
    schema = StructType([*kinds, StructField("feature", StringType()), *(StructField(c, LongType()) for c in ("rows", "n")), *(StructField(c, DoubleType()) for c in ("ic", "rank_ic", "spread", "monotonicity")), StructField("varied_y", BooleanType())])

    def one(part: pa.Table) -> pa.RecordBatch:
        y = part.column(len(by)).to_numpy()
        out = []
        for k in range(len(features)):
            x = part.column(len(by) + 1 + k).to_numpy()
            both = ~(np.isnan(x) | np.isnan(y))
            a, b = x[both], y[both]
            n = len(a)
            ic = rank_ic = spread = shape = np.nan
            varied = None
            if n:
                r, q = column_ranks(np.column_stack([a, b])).T
                ic, rank_ic = _correlation(a, b), _correlation(r, q)
                if np.isnan(ic) or np.isnan(rank_ic):
                    ic = rank_ic = np.nan
                if n >= bins and a.min() < a.max():
                    bucket = np.clip(np.floor(r / n * bins - 1e-12), 0, bins - 1).astype(int)
                    often, total = np.bincount(bucket, minlength=bins), np.bincount(bucket, b, minlength=bins)
                    held = np.flatnonzero(often)
                    means = total[held] / often[held]
                    if len(held) > 1:
                        spread, shape, varied = means[-1] - means[0], _correlation(*column_ranks(np.column_stack([held, means])).T), bool(b.min() < b.max())
            out.append((part.num_rows, n, ic, rank_ic, spread, shape, varied))
        columns = list(zip(*out))
        first = part.slice(0, 1)
        ids = [pa.concat_arrays([first.column(k).chunk(0)] * len(features)) for k in range(len(by))]
        doubles = [pa.array(c, pa.float64(), from_pandas=True) for c in columns[2:6]]
        return pa.record_batch([*ids, names, pa.array(columns[0]), pa.array(columns[1]), *doubles, pa.array(columns[6], pa.bool_())], names=schema.names)

    def run(batches):
        for part in whole_groups(batches, len(by)):
            yield one(part)

    return source.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def wide_summary(df: DataFrame, features: list[str], bins: int = 5, keys: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    """`summary` of many features of a wide frame, in one pass by date."""
    shapes = daily_shapes(df, features, bins, keys, label)
    if keys:
        shapes = shapes.withColumn("feature", F.concat_ws("\x01", *keys, "feature"))
    return _summarised(shapes, shapes.where("spread IS NOT NULL"), keys)


def summary(long: DataFrame, bins: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """The 28 metrics of each feature (within each segment, if `keys` names one)."""
    if keys:
        long = long.withColumn("feature", F.concat_ws("\x01", *keys, "feature"))
    return _summarised(daily_ic(long), daily_spread(bucket_returns(long, bins)), keys)


def _summarised(daily: DataFrame, spread: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    spread = spread.where("varied_y AND monotonicity IS NOT NULL")
    base = daily.groupBy("feature").agg(
        F.sum("rows").alias("observation_count"), F.sum("n").alias("valid_observation_count"), F.avg(F.col("n") / F.col("rows")).alias("avg_daily_coverage_pct"),
        F.count("*").alias("date_count"), F.count("ic").alias("effective_date_count"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), icir("ic").alias("ic_ir"),
        rate(F.col("ic") > 0).alias("_p"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("ic_positive_rate"),
        F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_samp("rank_ic").alias("rank_ic_std"), icir("rank_ic").alias("rank_ic_ir"),
        F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double"))).alias("rank_ic_positive_rate"),
        F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") < 0).cast("double"))).alias("_negative"),
    ).drop("_p")
    months = monthly_rank_ic(daily).groupBy("feature").agg(F.avg("rank_ic").alias("monthly_rank_ic_mean"), rate(F.col("rank_ic") > 0).alias("monthly_rank_ic_positive_rate"), rate(F.col("rank_ic") < 0).alias("_monthly_negative"), F.count("*").alias("monthly_rank_ic_months"))
    shape = spread.groupBy("feature").agg(
        F.count("*").alias("monotonic_date_count"), F.avg("monotonicity").alias("monotonicity_mean"), rate(F.col("monotonicity") > 0).alias("monotonicity_positive_rate"),
        F.avg("spread").alias("top_bottom_spread_mean"), rate(F.col("spread") > 0).alias("top_bottom_spread_positive_rate"),
    )
    direction = F.when(F.col("rank_ic_mean") > 1e-8, 1).when(F.col("rank_ic_mean") < -1e-8, -1).otherwise(0).cast("long")
    out = base.join(months, "feature", "left").join(shape, "feature", "left").withColumn("suggested_direction", direction)
    hit = lambda up, down: F.when(F.col("suggested_direction") == 1, F.col(up)).when(F.col("suggested_direction") == -1, F.col(down))
    out = out.withColumns({
        "coverage_pct": F.col("valid_observation_count") / F.col("observation_count"), "rank_ic_directional_hit_rate": hit("rank_ic_positive_rate", "_negative"),
        "monthly_rank_ic_directional_hit_rate": hit("monthly_rank_ic_positive_rate", "_monthly_negative"), "rank_ic_abs_mean": F.abs("rank_ic_mean"), "rank_ic_ir_abs": F.abs("rank_ic_ir"), "ic_ir_abs": F.abs("ic_ir"),
        "monotonic_date_count": F.coalesce("monotonic_date_count", F.lit(0)), "monthly_rank_ic_months": F.coalesce("monthly_rank_ic_months", F.lit(0)),
    }).drop("_negative", "_monthly_negative")
    if keys:
        parts = F.split("feature", "\x01")
        out = out.withColumns({k: parts[j] for j, k in enumerate(keys)} | {"feature": parts[len(keys)]})
    return out.withColumn("feature_group", feature_group(F.col("feature")))


def segment_summaries(long: DataFrame, segments: DataFrame, bins: int = 5) -> DataFrame:
    """`summary` within each date segment (segment, start, end)."""
    from .joins import days_of

    return summary(long.join(days_of(segments, "start", "end"), "date"), bins, ("segment",))


def segment_comparison(by_segment: DataFrame) -> DataFrame:
    """Per feature: range and extremes of rank IC over segments, direction counts and flip, monthly hit mean and minimum."""
    size, d = F.abs("rank_ic_mean"), F.col("suggested_direction")
    agg = by_segment.groupBy("feature").agg(
        F.max(size).alias("segment_rank_ic_abs_max"), F.min(size).alias("segment_rank_ic_abs_min"), (F.max("rank_ic_mean") - F.min("rank_ic_mean")).alias("segment_rank_ic_mean_range"),
        F.max_by("segment", F.when(size.isNotNull(), F.struct(size, "segment"))).alias("best_segment_by_abs_rank_ic"), F.min_by("segment", F.when(size.isNotNull(), F.struct(size, "segment"))).alias("worst_segment_by_abs_rank_ic"),
        F.count(F.when(d > 0, 1)).alias("positive_direction_segments"), F.count(F.when(d < 0, 1)).alias("negative_direction_segments"), F.count(F.when(d != 0, 1)).alias("nonzero_direction_segments"),
        F.avg("monthly_rank_ic_directional_hit_rate").alias("segment_monthly_directional_hit_mean"), F.min("monthly_rank_ic_directional_hit_rate").alias("segment_monthly_directional_hit_min"),
    )
    return agg.withColumn("direction_flip", (F.col("positive_direction_segments") > 0) & (F.col("negative_direction_segments") > 0))


def missing_by_year(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", F.year("date").cast("long").alias("year")).agg(F.count("*").alias("rows"), (F.count("*") - F.count("x")).alias("missing")).withColumn("missing_pct", F.col("missing") / F.col("rows"))


def topped(summaries: DataFrame, n: int) -> DataFrame:
    """The n features with the highest absolute rank IC, then IR, coverage and name."""
    return summaries.orderBy(F.desc_nulls_last("rank_ic_abs_mean"), F.desc_nulls_last("rank_ic_ir_abs"), F.desc_nulls_last("coverage_pct"), "feature").limit(n)


def segment_pivot(by_segment: DataFrame, names: list[str], metrics: list[str]) -> DataFrame:
    """A row per feature with a column metric__segment for each metric and segment."""
    cells = [F.max(F.when(F.col("segment") == s, F.col(m))).alias(f"{m}__{s}") for m in metrics for s in names]
    return by_segment.groupBy("feature").agg(*cells)


def enriched(summaries: DataFrame, by_feature: DataFrame) -> DataFrame:
    """Summaries with what segments say of a feature; of columns that both have, the segments' value replaces the summary's wherever the feature is there."""
    more = [c for c in by_feature.columns if c != "feature"]
    side = by_feature.select("feature", F.struct(*more).alias("_side"))
    both = summaries.join(side, "feature", "left")
    known = F.col("_side").isNotNull()
    pick = lambda c: F.when(known, F.col(f"_side.{c}")).otherwise(F.col(c)) if c in summaries.columns else F.col(f"_side.{c}")
    return both.select(*(pick(c).alias(c) if c in more else F.col(c) for c in summaries.columns), *(pick(c).alias(c) for c in more if c not in summaries.columns))


#: Orders that a batch's tops are listed in (fixed values).
TOPS = {"top_abs_rankic": "rank_ic_abs_mean", "top_rankic": "rank_ic_mean", "top_rankic_ir": "rank_ic_ir"}


def batch_report(summaries: DataFrame, features: list[str] | None = None, n: int = 50, least_rank_ic: float = 0.02, least_coverage: float = 0.9) -> dict[str, DataFrame]:
    """Of a batch's summaries (or some features of them): the whole, the n first in each order, and how many pass both thresholds."""
    some = summaries if features is None else summaries.where(F.col("feature").isin(features))
    passes = (F.col("rank_ic_abs_mean") >= least_rank_ic) & (F.col("coverage_pct") >= least_coverage)
    tops = {k: some.orderBy(F.desc_nulls_last(c), F.desc_nulls_last("coverage_pct"), "feature").limit(n) for k, c in TOPS.items()}
    return {"summary": some, **tops, "counts": some.agg(F.count("*").alias("features"), F.count(F.when(passes, 1)).alias("passing"))}


def merged_batches(batches: dict[str, DataFrame]) -> DataFrame:
    """Counts or summaries of several runs as one table with the run's name first; columns that a run lacks are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.select(F.lit(k).alias("run"), "*") for k, f in batches.items()))
