"""Industry context: daily aggregates of an industry's members, the market, and their rolling history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Node, call, col, finite, when, with_formulas
from .crosssection import observed
from .joins import calendar

#: Rolling windows of returns, and of the other means.
WINDOWS, MEANS = (5, 20, 60), (20, 60)


def compound(r: Node, n: int) -> Node:
    """exp of the summed log returns, less 1; a return below -0.999999 counts as that."""
    x = finite(r)
    return call("exp", when(x > -0.999999, call("ln", 1.0 + x), when(x <= -0.999999, call("ln", 1.0 - 0.999999))).sum(n)) - 1.0


def daily(members: DataFrame, ret: str = "ret", means: list[str] | None = None) -> DataFrame:
    """date, industry: member count, mean return, excess over the market, share of rises, dispersion, and means of other columns.

    Members without a finite return are left out of everything. The market is the mean of all members of a date.
    """
    known = members.where(observed(ret).isNotNull())
    own = known.groupBy("date", "industry").agg(
        F.count("*").alias("ind_member_count"), F.avg(ret).alias("ind_daily_ret"), F.avg((F.col(ret) > 0).cast("double")).alias("ind_pos_rate"), F.stddev_samp(ret).alias("ind_dispersion"),
        *(F.avg(observed(c)).alias(f"ind_{c}_mean") for c in means or []), F.sum(ret).alias("_sum"),
    )
    # The market's mean comes from the industries' sums: no second pass over the members.
    market = own.groupBy("date").agg((F.sum("_sum") / F.sum("ind_member_count")).alias("market_ret"))
    out = own.drop("_sum").join(market, "date")
    return out.withColumn("ind_excess_daily_ret", F.col("ind_daily_ret") - F.col("market_ret"))


def rolling(context: DataFrame, means: tuple[str, ...] = ()) -> DataFrame:
    """The daily context with compounded returns, volatility, excess over the market's compounded return, and mean rates, by industry."""
    r = col("ind_daily_ret")
    f: dict[str, Node] = {}
    for w in WINDOWS:
        f |= {f"ind_ret_{w}": compound(r, w), f"ind_std_{w}": finite(r).std(w), f"ind_pos_rate_{w}": finite(col("ind_pos_rate")).mean(w), f"ind_dispersion_{w}": finite(col("ind_dispersion")).mean(w)}
    for w in MEANS:
        f |= {f"ind_{c}_mean_{w}": finite(col(f"ind_{c}_mean")).mean(w) for c in means}
    out = with_formulas(context, f, by="industry", order="date")
    market = context.select("date", "market_ret").distinct().withColumn("_all", F.lit(1))
    market = with_formulas(market, {f"_market_{w}": compound(col("market_ret"), w) for w in WINDOWS}, by="_all", order="date", keep=["date"])
    out = out.join(market, "date")
    return out.withColumns({f"ind_excess_ret_{w}": F.col(f"ind_ret_{w}") - F.col(f"_market_{w}") for w in WINDOWS}).drop(*(f"_market_{w}" for w in WINDOWS))


def with_context(panel: DataFrame, context: DataFrame) -> DataFrame:
    """The panel with the latest context row of each symbol's industry, of the same date or before.

    The context is small (industries by dates): it is carried on over the calendar of both frames, and the panel joins it by
    date and industry, so no task holds the members of an industry.
    """
    values = [c for c in context.columns if c not in ("date", "industry")]
    days = calendar(panel.select("date").union(context.select("date")))
    axes = context.select("industry").distinct().withColumn("date", F.explode(days))
    known = axes.join(context.withColumn("_known", F.struct(*values)).select("date", "industry", "_known"), ["date", "industry"], "left")
    w = Window.partitionBy("industry").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = known.withColumn("_known", F.last("_known", ignorenulls=True).over(w)).where("_known IS NOT NULL")
    return panel.join(carried, ["date", "industry"], "left").select(*panel.columns, *(F.col(f"_known.{c}").alias(c) for c in values))
