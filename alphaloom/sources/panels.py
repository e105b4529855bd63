"""Panels of daily or monthly bars: one row per symbol and date, all measures doubles, missing values NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BARS = """
SELECT CAST(l_suppkey AS {text}) AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  min_by(price, k) AS open, max(price) AS high, min(price) AS low, max_by(price, k) AS close,
  CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount,
  CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS discount, CAST(sum(CAST(l_tax AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS tax, count(*) AS trades
FROM (SELECT *, l_extendedprice / l_quantity AS price, {row}(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM {lineitem})
GROUP BY l_suppkey, date_trunc('month', l_shipdate)
"""

#: A DuckDB CTE with the same monthly bars.
BARS_SQL = "bars AS (" + _BARS.format(text="VARCHAR", row="row", lineitem="lineitem") + ")"


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of `lineitem`: the supplier is the symbol, the unit price of an order line a trade."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(_BARS.format(text="STRING", row="struct", lineitem="{line}"), line=line)


_SIGNALS = """
SELECT b.symbol, b.date, open, high, low, close, volume, amount, amount / volume AS vwap,
  volume / sum(volume) OVER (PARTITION BY b.symbol) AS turnover, trades / CAST(10 AS DOUBLE) AS turnover_free,
  100 * tax - 3 AS pe_ttm, 100 * discount - 4 AS pb, 100 * tax - 2 AS pe, 100 * discount - 3 AS ps, 50 * tax - 1 AS ps_ttm,
  100 * discount AS dv_ratio, CASE WHEN trades % 3 > 0 THEN 80 * tax END AS dv_ttm,
  volume * 10 AS circ_mv, volume * 12 AS total_mv, CAST(trades * 100 AS DOUBLE) AS total_share, CAST(trades * 80 AS DOUBLE) AS circ_share, CAST(trades * 50 AS DOUBLE) AS free_share,
  CAST(trades AS DOUBLE) / 5 AS volume_ratio, (high - low) / low * 100 AS amplitude, (close / open - 1) * 100 AS pct_chg, open AS pre_close,
  open * 1.5 AS up_limit, open * 0.6 AS down_limit, n.n_name AS nation, r.r_name AS industry
FROM {bars} b JOIN {supplier} s ON CAST(s.s_suppkey AS {text}) = b.symbol JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""

_NUMBERS = {"1.5": "CAST(1.5 AS DOUBLE)", "0.6": "CAST(0.6 AS DOUBLE)"}


def _plain(sql: str) -> str:
    for a, b in _NUMBERS.items():
        sql = sql.replace(f"open * {a}", f"open * {b}")
    return sql


#: DuckDB CTEs with bars and the same signals.
SIGNALS_SQL = BARS_SQL + ", panel AS (" + _plain(_SIGNALS).format(bars="bars", supplier="supplier", nation="nation", region="region", text="VARCHAR") + ")"


def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly bars with valuation, liquidity, limit and industry columns made from the same order lines."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sql = _plain(_SIGNALS).format(bars="{bars}", supplier="{supplier}", nation="{nation}", region="{region}", text="STRING")
    return spark.sql(sql, bars=monthly_bars(spark, sf_dir), supplier=read("supplier"), nation=read("nation"), region=read("region"))


_DAILY = """
SELECT CAST(user_id AS {text}) AS symbol, CAST(ts AS DATE) AS date, min_by(value, k) AS open, max_by(value, k) AS close, max(value) AS high, min(value) AS low,
  CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS amount
FROM (SELECT *, {row}(ts, event_id) AS k FROM {events}) GROUP BY user_id, CAST(ts AS DATE)
"""
DAILY_SQL = "daily AS (" + _DAILY.format(text="VARCHAR", row="row", events="events") + ")"


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of `events`: the user is the symbol."""
    return spark.sql(_DAILY.format(text="STRING", row="struct", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns as doubles with NaN as missing."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    names = [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and (columns is None or c in columns)]
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names})
