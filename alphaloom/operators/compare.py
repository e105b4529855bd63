"""Comparison of runs: bucket shapes, validation bins, importance, gates, pairs of strategies and their holdings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import average_rank, observed
from .diagnostics import correlation


#: The bucket of the best scores, and those that count as the middle (fixed values).
TOP, MIDDLE = 1, (3, 4, 5, 6, 7)


def bucket_shape(buckets: DataFrame, keys: tuple[str, ...] = ("run",), top: int = TOP, middle: tuple[int, ...] = MIDDLE) -> DataFrame:
    """Of score buckets (bucket and mean_label): labels of the top, the bottom (highest number) and the middle buckets and their
    differences, the best and the worst bucket, the place of the top one by label, and the rank correlation of buckets and
    labels. Of equal labels the higher bucket is the best, the lower the worst, and the lower takes the earlier place. A run without the top bucket fails."""
    v = F.col("mean_label")
    w = Window.partitionBy(*keys)
    rows = buckets.where(observed("mean_label").isNotNull()).withColumns({"_r": average_rank(v, *keys), "_b": average_rank(F.col("bucket").cast("double"), *keys), "_last": F.max("bucket").over(w), "_place": F.row_number().over(w.orderBy(F.desc("mean_label"), "bucket"))})
    is_top, is_middle = F.col("bucket") == top, F.col("bucket").isin(list(middle))
    out = rows.groupBy(*keys).agg(
        F.max("bucket").cast("long").alias("bottom_bucket"), F.max(F.when(is_top, v)).alias("top_label_mean"), F.max(F.when(F.col("bucket") == F.col("_last"), v)).alias("bottom_label_mean"),
        F.avg(F.when(is_middle, v)).alias("middle_label_mean"), F.max(F.when(is_middle, v)).alias("middle_best_label_mean"),
        F.max_by("bucket", F.struct("mean_label", "bucket")).cast("long").alias("best_bucket"), F.max(v).alias("best_bucket_label_mean"),
        F.min_by("bucket", F.struct("mean_label", "bucket")).cast("long").alias("worst_bucket"), F.min(v).alias("worst_bucket_label_mean"),
        F.max(F.when(is_top, F.col("_place"))).cast("long").alias("top_bucket_label_rank"), correlation("_b", "_r").alias("bucket_label_spearman"),
    )
    found = F.assert_true(F.col("top_label_mean").isNotNull(), "there is no top bucket")
    less = lambda c: F.col("top_label_mean") - F.col(c)
    return out.where(found.isNull()).withColumns({"top_bucket": F.lit(top).cast("long"), "top_minus_bottom": less("bottom_label_mean"), "top_minus_middle_mean": less("middle_label_mean"), "top_minus_middle_best": less("middle_best_label_mean")})


def score_buckets(rows: DataFrame, bins: int = 10, keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    """Mean label of score bins within dates; bucket 1 holds the highest scores."""
    from .crosssection import quantile_bin

    known = rows.where(observed("score").isNotNull() & observed("label").isNotNull())
    known = known.withColumn("bucket", bins - quantile_bin(F.col("score"), bins, *keys, date))
    return known.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.avg("label").alias("mean_label"))


#: Validation metrics that may steer risk (fixed values).
SIGNALS = ("valid_topk_positive_rate", "valid_topk_excess_mean", "valid_topk_label_mean", "valid_topk_min_label_mean", "best_valid_daily_rank_ic")


def validation_terciles(rows: DataFrame, metric: str = "metric", value: str = "ret", keys: tuple[str, ...] = ("run",), order: str = "period_start", excess: str | None = None) -> DataFrame:
    """Low, mid and high thirds by a validation metric: the first two of n / 3 rows; none below nine rows. Mean metric and return (and excess), and how many returns are positive."""
    parts = [metric, value] + ([excess] if excess else [])
    known = rows.where(reduce(lambda a, b: a & b, (observed(c).isNotNull() for c in parts)))
    w = Window.partitionBy(*keys)
    placed = known.withColumns({"_n": F.count("*").over(w), "_p": F.row_number().over(w.orderBy(metric, order)) - 1}).where("_n >= 9")
    third = F.floor(F.col("_n") / 3)
    name = F.when(F.col("_p") < third, "low").when(F.col("_p") < 2 * third, "mid").otherwise("high")
    more = [F.avg(excess).alias("excess_mean")] if excess else []
    positive = (F.col(value) > 0).cast("double")
    return placed.withColumn("bin", name).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(metric).alias("metric_mean"), F.avg(value).alias("ret_mean"), *more, F.sum(positive).cast("long").alias("positive_count"), F.avg(positive).alias("positive_rate"))


def windows_with_rebalances(windows: DataFrame, rebalances: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Training windows (window_start and metrics) with the rebalance period that begins on the same day: period_start, ret and excess. Others have none and fall out."""
    one = rebalances.groupBy(*keys, "period_start").agg(*(F.max_by(c, "period_end").alias(c) for c in ("ret", "excess")))
    return windows.withColumnRenamed("window_start", "period_start").join(one, [*keys, "period_start"])


def signal_bins(aligned: DataFrame, metrics: tuple[str, ...] = SIGNALS, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """`validation_terciles` of every metric that there is, from `windows_with_rebalances`: signal_metric and bin."""
    present = [m for m in metrics if m in aligned.columns]
    ids = [*keys, "period_start", "ret", "excess"]
    long = aligned.select(*ids, *(F.col(m).cast("double").alias(m) for m in present)).unpivot(ids, present, "signal_metric", "metric")
    return validation_terciles(long, keys=(*keys, "signal_metric"), excess="excess")


def validation_edges(bins: DataFrame, keys: tuple[str, ...] = ("run", "signal_metric")) -> DataFrame:
    """What the high third brings over the low one, where both exist."""
    of = lambda name, c: F.max(F.when(F.col("bin") == name, F.col(c)))
    out = bins.groupBy(*keys).agg(*(of(b, c).alias(f"{b}_{c}") for b in ("high", "low") for c in ("ret_mean", "excess_mean", "positive_rate"))).where("high_ret_mean IS NOT NULL AND low_ret_mean IS NOT NULL")
    return out.select(*keys, (F.col("high_ret_mean") - F.col("low_ret_mean")).alias("high_low_return_spread"), (F.col("high_excess_mean") - F.col("low_excess_mean")).alias("high_low_excess_spread"), F.col("high_positive_rate").alias("high_positive_rebalance_rate"), F.col("low_positive_rate").alias("low_positive_rebalance_rate"))


# The family of a feature by what its name begins with ("^"), ends with ("$") or holds; the first match holds.
_FAMILIES = [
    ("ts_stock_vs_industry", ["^TS_stock_vs_industry_"]), ("ts_industry_state", ["^TS_industry_"]), ("ts_relative_value_quality", ["$_minus_industry", "_minus_industry_"]),
    ("ts_valuation", ["^TS_dividend", "^TS_bp", "^TS_sp", "^TS_ep"]), ("liquidity", ["amihud", "turnover"]), ("lgbm", ["^LGBM_"]), ("temporal", ["^TEMP_"]), ("technical", ["^TECH_"]),
]


def feature_family(name: Column) -> Column:
    """The family that a feature's importance counts for."""
    fits = lambda p: name.startswith(p[1:]) if p[0] == "^" else name.endswith(p[1:]) if p[0] == "$" else name.contains(p)
    return reduce(lambda out, g: F.when(reduce(lambda a, b: a | b, map(fits, g[1])), g[0]).otherwise(out), reversed(_FAMILIES), F.lit("other"))


def family_shares(importance: DataFrame, family: Column, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Share of each feature family in a run's importance."""
    rows = importance.withColumn("family", family).groupBy(*keys, "family").agg(F.sum("importance").alias("importance"))
    total = F.sum("importance").over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.when(total > 0, F.col("importance") / total))


def importance_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """feature, importance and competition rank in either run; a feature that a run doesn't know has 0 there."""
    both = a.select("feature", F.col("importance").alias("a")).join(b.select("feature", F.col("importance").alias("b")), "feature", "full_outer").na.fill(0.0, ["a", "b"])
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c))).cast("long")
    return both.withColumns({"rank_a": place("a"), "rank_b": place("b"), "difference": F.col("a") - F.col("b")})


def side_by_side(frames: dict[str, DataFrame], key: str, values: list[str]) -> DataFrame:
    """Inner join of runs on a period; values carry the run's name."""
    parts = [f.select(key, *(F.col(v).alias(f"{name}_{v}") for v in values)) for name, f in frames.items()]
    return reduce(lambda x, y: x.join(y, key), parts)


def holdings(text: Column) -> Column:
    """Instruments of a holdings mapping: JSON, or 'name: value' pairs in braces with either quotes."""
    tidy = F.regexp_replace(text, "'", '"')
    return F.coalesce(F.map_keys(F.from_json(tidy, "map<string,double>")), F.array().cast("array<string>"))


def overlap(a: DataFrame, b: DataFrame, date: str = "date") -> DataFrame:
    """date and the sizes of union, intersection and differences of two runs' held sets (held), and their Jaccard share (1 if both are empty)."""
    both = a.select(date, F.col("held").alias("x")).join(b.select(date, F.col("held").alias("y")), date)
    size = lambda c: F.size(c).cast("long")
    out = both.select(date, size(F.array_union("x", "y")).alias("n_union"), size(F.array_intersect("x", "y")).alias("n_common"), size(F.array_except("x", "y")).alias("n_only_a"), size(F.array_except("y", "x")).alias("n_only_b"))
    return out.withColumn("jaccard", F.when(F.col("n_union") == 0, F.lit(1.0)).otherwise(F.col("n_common") / F.col("n_union")))


def gates(metrics: DataFrame, least: dict[str, float], most: dict[str, float] | None = None) -> DataFrame:
    """Whether each run passes all gates, and which it fails; a missing metric fails."""
    bad = [F.when(~F.coalesce(F.col(c) >= v, F.lit(False)), F.lit(c)) for c, v in least.items()] + [F.when(~F.coalesce(F.col(c) <= v, F.lit(False)), F.lit(c)) for c, v in (most or {}).items()]
    failed = F.array_compact(F.array(*bad))
    return metrics.withColumns({"failed_gates": F.array_join(failed, ","), "promoted": F.size(failed) == 0})


# Bounds of the promotion gates, and the baselines that a candidate must beat, the ones at fixed risk before the others.
THRESHOLDS = {
    "min_annualized_return": 0.30, "min_sharpe_ratio": 1.50, "max_drawdown_floor": -0.15, "max_top5_positive_share": 0.50, "min_bucket_top_minus_bottom": 0.0, "min_yearly_bucket_top_minus_bottom": -0.005,
    "max_calibrated_best_bucket": 2, "max_calibrated_top_bucket_rank": 2, "min_validation_high_low_return_spread": 0.01, "min_validation_high_bin_win_rate": 0.60, "min_excess_annualized": 0.0, "min_rebalance_win": 0.55,
}
FIXED_RISK = ("fixed_risk_rank_avg_factor_baseline", "fixed_risk_rank_ic_weighted_factor_baseline")
CORE = ("rank_avg_factor_baseline", "rank_ic_weighted_factor_baseline")


def promotion(runs: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """A row per run with its candidate_role, the number of gates passed and failed, and the failed ones, from one row of figures per run.

    `runs`: run, annualized_return, sharpe_ratio, max_drawdown, top5_positive_share, what `bucket_shape` gives, min_yearly_top_minus_bottom,
    high_low_return_spread and high_positive_rebalance_rate (of valid_topk_excess_mean), and for each baseline there is
    {baseline}_excess and {baseline}_win. A missing number counts as 0, a missing bucket or rank as 999, and without any yearly buckets their gate fails.
    """
    t = THRESHOLDS | (thresholds or {})
    has = set(runs.columns)
    x = lambda c, rest=0.0: F.coalesce(F.col(c).cast("double"), F.lit(float(rest))) if c in has else F.lit(float(rest))
    named = {
        "return_quality": (x("annualized_return") >= t["min_annualized_return"]) & (x("sharpe_ratio") >= t["min_sharpe_ratio"]),
        "drawdown_control": x("max_drawdown") >= t["max_drawdown_floor"],
        "concentration_control": x("top5_positive_share") <= t["max_top5_positive_share"],
        "bucket_separates_bad_tail": x("top_minus_bottom") > t["min_bucket_top_minus_bottom"],
        "bucket_calibrated_for_sizing": (x("best_bucket", 999) <= t["max_calibrated_best_bucket"]) & (x("top_bucket_label_rank", 999) <= t["max_calibrated_top_bucket_rank"]) & (x("top_minus_middle_best") >= 0.0),
        "yearly_bucket_not_inverted": x("min_yearly_top_minus_bottom", "-inf") >= t["min_yearly_bucket_top_minus_bottom"],
        "validation_metric_supports_risk_gate": (x("high_low_return_spread") >= t["min_validation_high_low_return_spread"]) & (x("high_positive_rebalance_rate") >= t["min_validation_high_bin_win_rate"]),
    }
    # A baseline that a run has no figures of sets no gate; the core ones count only where no fixed-risk one does.
    known = lambda b: (F.col(f"{b}_excess").isNotNull() | F.col(f"{b}_win").isNotNull()) if f"{b}_excess" in has else F.lit(False)
    any_fixed = reduce(lambda a, b: a | b, map(known, FIXED_RISK))
    counts = {b: known(b) if b in FIXED_RISK else known(b) & ~any_fixed for b in (*FIXED_RISK, *CORE)}
    beaten = {b: (x(f"{b}_excess") >= t["min_excess_annualized"]) & (x(f"{b}_win") >= t["min_rebalance_win"]) for b in counts}
    lost = [F.when(c & ~beaten[b], F.lit(f"beats_{b}")) for b, c in counts.items()]
    failed = F.array_compact(F.array(*(F.when(~p, F.lit(n)) for n, p in named.items()), *lost))
    total = F.lit(len(named)) + reduce(lambda a, b: a + b, (c.cast("int") for c in counts.values()))
    behind = reduce(lambda a, b: a | b, (c & ~beaten[b] for b, c in counts.items()))
    tail, valid = named["bucket_separates_bad_tail"], named["validation_metric_supports_risk_gate"]
    role = (
        F.when(~named["return_quality"], "research_archive").when(behind, "portfolio_candidate_requires_router").when(named["bucket_calibrated_for_sizing"] & valid, "ranker_and_sizer")
        .when(tail & valid, "pool_selector_with_validation_gate").when(tail, "pool_selector_only").otherwise("portfolio_candidate_requires_router")
    )
    return runs.select("run", role.alias("candidate_role"), (total - F.size(failed)).cast("long").alias("passed_count"), total.cast("long").alias("total_count"), F.array_join(F.array_sort(failed), ",").alias("failed_gates"))


def candidate_pool(portfolio: DataFrame, monthly: DataFrame, buckets: DataFrame, yearly_buckets: DataFrame, edges: DataFrame | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """`promotion` of runs from their reports: portfolio figures (and baselines) by run, months (run, month, ret), score buckets by run and by run and year, and `validation_edges`."""
    from .metrics import concentration

    yearly = bucket_shape(yearly_buckets, ("run", "year")).groupBy("run").agg(F.min("top_minus_bottom").alias("min_yearly_top_minus_bottom"))
    out = portfolio.join(concentration(monthly).select("run", "top5_positive_share"), "run", "left").join(bucket_shape(buckets), "run", "left").join(yearly, "run", "left")
    if edges is not None:
        out = out.join(edges.where("signal_metric = 'valid_topk_excess_mean'").select("run", "high_low_return_spread", "high_positive_rebalance_rate"), "run", "left")
    return promotion(out, thresholds)


def metric_of(document: Column, name: str) -> Column:
    """A metric of a JSON document; an object's `risk` field is meant where the metric is an object."""
    whole = F.get_json_object(document, f"$.{name}")
    inner = F.get_json_object(document, f"$.{name}.risk")
    return F.coalesce(inner, whole).try_cast("double")


def metric_pair(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, a, b and difference of two runs' single rows of figures."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("x.*")
    return long(a, "a").join(long(b, "b"), "metric").withColumn("difference", F.col("a") - F.col("b"))


def training_table(windows: DataFrame, columns: list[str], keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Per run the number of windows, the median number of features, and mean, median, least and most of training columns that there are."""
    have = [c for c in columns if c in windows.columns]
    agg = [f(observed(c)).alias(f"{c}_{n}") for c in have for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, F.lit(0.5))), ("min", F.min), ("max", F.max))]
    features = [F.percentile("feature_count", F.lit(0.5)).alias("feature_count_median")] if "feature_count" in windows.columns else []
    return windows.groupBy(*keys).agg(F.count("*").alias("window_count"), *features, *agg)


def period_pair(frames: dict[str, DataFrame], key: str, values: list[str], differences: list[str]) -> DataFrame:
    """`side_by_side` of two runs, with the first's lead in some values; a missing number counts as 0 in it."""
    x, y = frames
    zero = lambda n, c: F.coalesce(observed(f"{n}_{c}"), F.lit(0.0))
    return side_by_side(frames, key, values).withColumns({f"{c}_diff": zero(x, c) - zero(y, c) for c in differences})


def yearly_pair(monthly: DataFrame, column: str = "ret_diff", key: str = "month") -> DataFrame:
    """Of a monthly comparison: per year the number of months, in how many the first leads, and the mean, worst and best lead."""
    v = F.col(column)
    return monthly.groupBy(F.year(key).cast("long").alias("year")).agg(F.count("*").alias("months"), F.count(F.when(v > 0, 1)).alias("months_ahead"), F.avg(v).alias("mean_lead"), F.min(v).alias("worst_lead"), F.max(v).alias("best_lead"))


def trace_pair(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), date: str = "date") -> DataFrame:
    """`overlap` of the holdings after each date of two traces (of `simulate.run_scenarios`), with their risk, their numbers of trades and the lead in value growth."""
    grown = lambda df: df.withColumns({"net_return": F.col("end_value") / F.col("start_value") - 1, "buy_count": F.size("buy_list").cast("long"), "sell_count": F.size("sell_list").cast("long"), "held": F.map_keys("holdings_after")})
    x, y = grown(a), grown(b)
    pair = period_pair({names[0]: x, names[1]: y}, date, ["net_return", "risk_degree", "buy_count", "sell_count"], ["net_return"])
    return pair.join(overlap(x, y, date), date)


def strategy_pair(a: dict[str, DataFrame], b: dict[str, DataFrame], names: tuple[str, str] = ("a", "b"), metrics: list[str] | None = None) -> dict[str, DataFrame]:
    """All comparisons of two runs by the reports that both have: metrics, training, buckets, yearly_buckets, monthly (and yearly), daily, importance and trace."""
    have, out = set(a) & set(b), {}
    labelled = lambda k: reduce(DataFrame.unionByName, (f[k].withColumn("run", F.lit(n)) for n, f in zip(names, (a, b))))
    if "metrics" in have:
        out["metrics"] = metric_pair(a["metrics"], b["metrics"], metrics or [c for c, t in a["metrics"].dtypes if t in ("double", "bigint", "int", "float") and c in b["metrics"].columns])
    if "training" in have:
        out["training"] = training_table(labelled("training"), list(SIGNALS))
    if "buckets" in have:
        out["buckets"], out["bucket_shape"] = labelled("buckets"), bucket_shape(labelled("buckets"))
    if "yearly_buckets" in have:
        out["yearly_bucket_shape"] = bucket_shape(labelled("yearly_buckets"), ("run", "year"))
    if "monthly" in have:
        out["monthly"] = period_pair({names[0]: a["monthly"], names[1]: b["monthly"]}, "month", ["ret"], ["ret"])
        out["yearly"] = yearly_pair(out["monthly"])
    if "daily" in have:
        out["daily"] = period_pair({names[0]: a["daily"], names[1]: b["daily"]}, "date", ["net_return"], ["net_return"])
    if "importance" in have:
        out["importance"] = importance_compare(a["importance"], b["importance"])
    if "trace" in have:
        out["trace"] = trace_pair(a["trace"], b["trace"], names)
    return out
