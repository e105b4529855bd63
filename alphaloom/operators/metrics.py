"""Portfolio metrics and return series of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import observed

#: Trading days of a year.
YEAR = 242


def compounded(x: Column) -> Column:
    return F.product(1 + x) - 1


def with_nav(daily: DataFrame, value: str = "net_return", keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    """daily with nav, peak (at least 1) and drawdown."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("nav", F.product(1 + F.coalesce(observed(value), F.lit(0.0))).over(w))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(w)))
    return out.withColumn("drawdown", F.when(F.col("peak") > 0, F.col("nav") / F.col("peak") - 1).otherwise(F.lit(0.0)))


def portfolio(daily: DataFrame, keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    """A row of metrics per run, of columns net_return, turnover and account_value."""
    r, t = observed("net_return"), observed("turnover")
    out = with_nav(daily, keys=keys, date=date).groupBy(*keys).agg(
        F.count(r).alias("trading_days"), F.coalesce(compounded(r), F.lit(0.0)).alias("total_return"), (F.coalesce(F.avg(r), F.lit(0.0)) * YEAR).alias("annualized_return"),
        (F.coalesce(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))).alias("annualized_volatility"), F.min(F.least(F.lit(0.0), F.col("drawdown"))).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))), F.lit(0.0)).alias("win_rate"), F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_turnover"), F.max_by("account_value", date).alias("final_account_value"),
    )
    sharpe = F.when(F.col("annualized_volatility") > 0, F.col("annualized_return") / F.col("annualized_volatility")).otherwise(F.lit(0.0))
    return out.withColumn("sharpe_ratio", sharpe)


def by_month(daily: DataFrame, value: str = "net_return", keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    return daily.groupBy(*keys, F.last_day(date).alias("month")).agg(compounded(observed(value)).alias("ret"), F.count("*").alias("days"))


def by_year(daily: DataFrame, value: str = "net_return", keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    return daily.groupBy(*keys, F.year(date).cast("long").alias("year")).agg(compounded(observed(value)).alias("ret"), F.count("*").alias("days"))


def by_rebalance(daily: DataFrame, freq: int, value: str = "net_return", keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    """Returns of blocks of `freq` dates from the first on."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1
    rows = daily.withColumn("block", F.floor(place / freq).cast("long"))
    return rows.groupBy(*keys, "block").agg(F.min(date).alias("period_start"), F.max(date).alias("period_end"), compounded(observed(value)).alias("ret"))


def concentration(parts: DataFrame, value: str = "ret", keys: tuple[str, ...] = ("run",), order: str = "month") -> DataFrame:
    """Share of the 3 and 5 best periods in the sum of the positive returns, and in the sum of all."""
    v = observed(value)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(v), order)
    rows = parts.withColumn("_p", F.row_number().over(w))
    up = F.when(v > 0, v).otherwise(F.lit(0.0))
    share = lambda n, x: F.sum(F.when(F.col("_p") <= n, x))
    out = rows.groupBy(*keys).agg(F.sum(up).alias("_up"), F.sum(v).alias("_all"), *(share(n, up).alias(f"_u{n}") for n in (3, 5)), *(share(n, v).alias(f"_a{n}") for n in (3, 5)))
    ratio = lambda a, b: F.when(F.abs(F.col(b)) > 1e-12, F.col(a) / F.col(b))
    return out.select(*keys, *(ratio(f"_u{n}", "_up").alias(f"top{n}_positive_share") for n in (3, 5)), *(ratio(f"_a{n}", "_all").alias(f"top{n}_total_share") for n in (3, 5)))


def drawdown_period(daily: DataFrame, keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    """The deepest drawdown of each run: its trough date, and the date of the peak before it."""
    rows = with_nav(daily, keys=keys, date=date)
    trough = rows.groupBy(*keys).agg(F.min(F.struct("drawdown", F.col(date).alias("d"))).alias("t")).select(*keys, F.col("t.drawdown").alias("max_drawdown"), F.col("t.d").alias("trough_date"))
    at = rows.join(trough, list(keys)).where(F.col(date) <= F.col("trough_date"))
    peak = at.groupBy(*keys, "max_drawdown", "trough_date").agg(F.max(F.when(F.col("nav") >= F.col("peak") - 1e-15, F.col(date))).alias("peak_date"))
    return peak.select(*keys, "max_drawdown", "peak_date", "trough_date")


# The report's names of what a simulation gives.
_REPORT = {
    "gross_return": "gross_return", "net_return": "net_return", "return": "net_return", "turnover": "turnover", "cost": "cost", "bench": "bench", "buy_count": "buy_count", "sell_count": "sell_count", "holdings": "holdings",
    "frozen_holdings": "frozen_holdings", "account_value": "account_value", "risk_degree": "risk_degree", "effective_n_drop": "effective_n_drop", "risk_control_signal": "risk_signal", "desticky_active": "desticky_active",
    "intraperiod_exit_count": "exit_count", "intraperiod_exit_score_candidate_count": "exit_candidates", "intraperiod_exit_price_confirm_required_count": "confirm_required", "intraperiod_exit_price_confirm_blocked_count": "confirm_blocked",
    "intraperiod_exit_price_confirm_bypassed_remaining_steps_count": "confirm_bypassed_steps", "intraperiod_exit_price_confirm_bypassed_force_exit_count": "confirm_bypassed_force", "intraperiod_exit_remaining_steps": "remaining_steps",
    "intraperiod_exit_signal_mean": "signal_mean", "intraperiod_exit_signal_min": "signal_min", "intraperiod_exit_residual_mean": "residual_mean", "intraperiod_exit_residual_min": "residual_min", "intraperiod_exit_residual_max": "residual_max",
    "intraperiod_exit_saved_return": "saved_return", "intraperiod_exit_missed_return": "missed_return", "intraperiod_exit_beneficial_count": "beneficial_count", "intraperiod_exit_harmful_count": "harmful_count",
}
#: When price confirmations look and act, as the report says it (fixed values).
TIMING = {"intraperiod_exit_price_confirm_signal_timing": "", "intraperiod_exit_price_confirm_execution_timing": ""}


def full_report(simulated: DataFrame, baselines: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = ("scenario",), date: str = "date", timing: dict[str, str] | None = None) -> DataFrame:
    """The daily report of simulations: 36 columns by date, then {baseline}_return of other simulations, 0 where they have no date."""
    made = simulated.select(*keys, F.col(date).alias("datetime"), *(F.col(c).alias(n) for n, c in _REPORT.items()), *(F.lit(v).alias(k) for k, v in (TIMING | (timing or {})).items()))
    w = Window.partitionBy(*keys).orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns({f"cum_{c}_return": F.product(1 + F.coalesce(observed(f"{c}_return"), F.lit(0.0))).over(w) - 1 for c in ("gross", "net")})
    for name, frame in (baselines or {}).items():
        made = made.join(frame.select(F.col(date).alias("datetime"), F.col("net_return").alias(f"{name}_return")), "datetime", "left").withColumn(f"{name}_return", F.coalesce(f"{name}_return", F.lit(0.0)))
    return made


def daily_report(daily: DataFrame, others: dict[str, DataFrame] | None = None, keys: tuple[str, ...] = ("run",), date: str = "date") -> DataFrame:
    """daily with cumulative gross and net returns, and other runs' net returns on the same dates (0 where they have none)."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumns({f"cumulative_{c}": F.product(1 + F.coalesce(observed(f"{c}_return"), F.lit(0.0))).over(w) - 1 for c in ("gross", "net")})
    for name, frame in (others or {}).items():
        out = out.join(frame.select(date, F.col("net_return").alias(name)), date, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out
