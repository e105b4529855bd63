"""Forward-return labels, label spaces, label transforms and sample weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Node, call, col, finite, when, with_formulas
from .crosssection import average_rank, group_count, observed

#: Larger absolute returns are taken for errors.
CAP = 0.35


def horizons(text: str) -> list[int]:
    """'5,10' -> [1, 5, 10]: positive, distinct, sorted, 1 always among them."""
    found = {int(x) for x in text.split(",") if x.strip()}
    if any(h < 1 for h in found):
        raise ValueError("a horizon must be positive")
    return sorted(found | {1})


def forward_return(h: int, cap: float = CAP, traded: tuple[str, ...] = ("volume", "amount")) -> Node:
    """From the next open to the open h rows later; both days must have traded."""
    a, b = finite(col("open")).lead(1), finite(col("open")).lead(1 + h)
    value = when((a > 0.0) & (b > 0.0), b / a - 1.0)
    for c in traded:
        x, y = finite(col(c)).lead(1), finite(col(c)).lead(1 + h)
        value = when((x > 0.0) & (y > 0.0), value)
    return when(call("abs", value) <= cap, value)


def labelled(panel: DataFrame, hs: list[int], cap: float = CAP) -> DataFrame:
    """The panel with label (one step) and label_{h}d of each horizon, stored in single precision."""
    traded = tuple(c for c in ("volume", "amount") if c in panel.columns)
    formulas = {"label": forward_return(1, cap, traded)} | {f"label_{h}d": forward_return(h, cap, traded) for h in hs}
    return with_formulas(panel, formulas).withColumns({n: F.col(n).cast("float") for n in formulas})


def industry_excess(df: DataFrame, column: str = "label", threshold: float = 0.0, out: str = "label", date: str = "date") -> DataFrame:
    """Label less its date and industry mean and a threshold; missing without an industry."""
    v = observed(column)
    mean = F.avg(v).over(Window.partitionBy(date, "industry"))
    return df.withColumn(out, F.when(F.col("industry").isNotNull(), v - mean - threshold))


def forward_compound(series: DataFrame, h: int, value: str = "ret", date: str = "date") -> DataFrame:
    """date, forward: product of the next h returns less 1; all must be finite. A single series: one row a date."""
    w = Window.orderBy(date).rowsBetween(1, h)
    v = observed(value)
    return series.select(date, F.when(F.count(v).over(w) == h, F.product(1 + v).over(w) - 1).alias("forward"))


def benchmark_excess(df: DataFrame, benchmark: DataFrame, h: int, column: str = "label", threshold: float = 0.0, out: str = "label", date: str = "date") -> DataFrame:
    """Label less the benchmark's forward return and a threshold; missing where the benchmark has none."""
    joined = df.join(forward_compound(benchmark, h, date=date), date, "left")
    return joined.withColumn(out, observed(column) - F.col("forward") - threshold).drop("forward")


def cross_section_benchmark(df: DataFrame, column: str = "label", date: str = "date") -> DataFrame:
    """Mean of the finite values of each date."""
    return df.groupBy(date).agg(F.avg(observed(column)).alias("ret")).where("ret IS NOT NULL")


def neutral(df: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """Features less their date and industry mean; rows without an industry stay as they are."""
    w = Window.partitionBy(date, "industry")
    return df.withColumns({f: F.when(F.col("industry").isNotNull(), F.col(f) - F.coalesce(F.avg(observed(f)).over(w), F.lit(0.0))).otherwise(F.col(f)) for f in features})


def opportunity_label(edge: Column) -> Column:
    """1 for a positive edge, 0 for any other finite one."""
    return F.when(observed(edge) > 0, F.lit(1.0)).when(observed(edge) <= 0, F.lit(0.0))


def cross_section_rank(df: DataFrame, column: str = "label", out: str = "label", date: str = "date") -> DataFrame:
    """(rank - 1) / (n - 1) - 0.5 within a date; a single value is 0."""
    v = observed(column)
    n = group_count(v, date)
    return df.withColumn(out, F.when(v.isNotNull(), F.when(n > 1, (average_rank(v, date) - 1) / (n - 1) - 0.5).otherwise(F.lit(0.0))))


def robust_scale(df: DataFrame, column: str, out: str = "scale", least: float = 1e-4, date: str = "date") -> DataFrame:
    """Per date the first of these that is at least `least`, else `least`: 1.4826 times the median absolute deviation, the population deviation, the median size."""
    v = observed(column)
    w = Window.partitionBy(date)
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(w)
    df = df.withColumn("_m", middle(v))
    scales = [middle(F.abs(v - F.col("_m"))) * 1.4826, F.stddev_pop(v).over(w), middle(F.abs(v))]
    return df.withColumn(out, F.coalesce(*(F.when(s >= least, s) for s in scales), F.lit(least))).drop("_m")


def profit_tanh(df: DataFrame, column: str = "label", out: str = "label", band: float = 0.0, multiplier: float = 1.0, least: float = 1e-4, date: str = "date") -> DataFrame:
    """tanh of the label beyond a neutral band, in units of the date's robust scale."""
    v = observed(column)
    soft = F.signum(v) * F.greatest(F.abs(v) - band, F.lit(0.0))
    scaled = robust_scale(df, column, "_scale", least, date)
    return scaled.withColumn(out, F.tanh(soft / (F.col("_scale") * multiplier))).drop("_scale")


def profit_bucket(label: Column, band: float, tail: float) -> Column:
    """Number of bounds that a label has passed, from -2 to 2: the upper ones, +band and +tail, count from their own value on, as the lower -tail does; -band itself is neutral."""
    v = observed(label)
    return ((v >= band).cast("double") + (v >= tail).cast("double")) - ((v < -band).cast("double") + (v <= -tail).cast("double"))


def buyability(edge: Column, margin: float | None = None) -> Column:
    """1 above the margin, 0 below its negative, missing from one to the other; without a margin 1 for positive edges and 0 for all others."""
    e = observed(edge)
    return opportunity_label(edge) if margin is None else F.when(e > margin, F.lit(1.0)).when(e < -margin, F.lit(0.0))


def opportunity_weights(df: DataFrame, edge: str, scale: float = 0.01, power: float = 1.0, floor: float = 0.0, per_date: bool = True, out: str = "weight", date: str = "date") -> DataFrame:
    """1 + (|edge| / scale)^power, at least the floor, with mean 1 within each date and over all rows."""
    raw = F.greatest(F.lit(1.0) + F.pow(F.abs(observed(edge)) / scale, F.lit(power)), F.lit(floor))
    df = df.withColumn(out, raw)
    if per_date:
        df = df.withColumn(out, F.col(out) / F.avg(out).over(Window.partitionBy(date)))
    return df.withColumn(out, F.col(out) / df.agg(F.avg(out)).scalar())


def decay_weights(df: DataFrame, half_life: float, floor: float = 0.0, out: str = "weight", date: str = "date") -> DataFrame:
    """floor + (1 - floor) * 0.5^(age in days / half life), with mean 1; age counts from the latest date."""
    age = F.datediff(df.agg(F.max(date)).scalar(), F.col(date))
    df = df.withColumn(out, F.lit(floor) + (1 - floor) * F.pow(F.lit(0.5), age / F.lit(float(half_life))))
    return df.withColumn(out, F.col(out) / df.agg(F.avg(out)).scalar())


def combined_weights(*weights: Column) -> Column:
    """The product of sample weights in single precision; None stands for no weight."""
    given = [w.cast("float") for w in weights if w is not None]
    return reduce(lambda a, b: a * b, given) if given else F.lit(None).cast("float")


def relevance(df: DataFrame, bins: int, column: str = "label", out: str = "relevance", date: str = "date") -> DataFrame:
    """Ranking relevance 0..bins-1 (two bins at least) by rank within a date; missing labels, and dates with one label or with equal ones, are 0."""
    v, bins = observed(F.col(column).cast("float")), max(2, bins)
    w = Window.partitionBy(date)
    n, low, high = F.count(v).over(w), F.min(v).over(w).cast("double"), F.max(v).over(w).cast("double")
    place = F.floor((average_rank(v, date) - 1) * bins / n + 1e-8)
    flat = (n <= 1) | (high - low <= 1e-8 + 1e-5 * F.abs(low))
    return df.withColumn(out, F.when(v.isNull() | flat, F.lit(0)).otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1))).cast("long"))


def _whole(v: Column) -> Column:
    return F.abs(v - F.rint(v)) <= 1e-6 + 1e-5 * F.abs(F.rint(v))


def already_relevance(df: DataFrame, most: int, column: str = "label") -> bool:
    """Whether labels serve as relevance as they are: all known ones whole numbers, from 2 to `most` different ones."""
    v = observed(F.col(column).cast("float"))
    seen = df.agg(F.coalesce(F.bool_and(_whole(v)), F.lit(False)).alias("whole"), F.countDistinct(F.rint(v)).alias("n")).first()
    return bool(seen["whole"]) and 2 <= seen["n"] <= most


def direct_relevance(df: DataFrame, column: str = "label", out: str = "relevance") -> DataFrame:
    """Whole labels shifted to begin at 0, missing ones 0; fails on the first that isn't whole."""
    v = observed(F.col(column).cast("float"))
    least = df.agg(F.min(F.rint(v))).scalar()
    shifted = F.when(_whole(v), F.rint(v) - least).otherwise(F.raise_error(F.lit("direct relevance labels must be whole numbers")))
    return df.withColumn(out, F.when(v.isNull(), F.lit(0)).otherwise(shifted).cast("long"))


def group_sizes(df: DataFrame, date: str = "date") -> DataFrame:
    return df.groupBy(date).agg(F.count("*").alias("size"))
