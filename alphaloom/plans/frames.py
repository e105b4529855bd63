"""Frames that several registered queries start from, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Node, call, col, duck_sql, rounded, with_formulas
from ..functions.kernel import with_kernels
from ..operators.labels import forward_return
from ..sources import panels

#: The synthetic panel's prices are not autocorrelated; its labels need a wider cap than real ones.
CAP = 5.0
CLOSE, VOLUME = col("close"), col("volume")
SCORED = {"score": CLOSE.change(3), "score2": call("ln", VOLUME + 1.0) - call("ln", VOLUME.mean(6) + 1.0), "score3": CLOSE / CLOSE.mean(6) - 1.0, "label": forward_return(1, CAP), "label_3": forward_return(3, CAP), "ret": CLOSE.change(1)}


def text_date(df: DataFrame, *names: str) -> DataFrame:
    """Dates as text, the one form that all engines print alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names or ("date",)})


def formulas_query(formulas: dict[str, Node], source: str = "panel", digits: int = 6) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(query, DuckDB SQL) of formulas over the bars or signals, named in lower case."""
    formulas = {k.lower(): f for k, f in formulas.items()}
    panel, ctes = {"panel": (panels.signal_panel, panels.SIGNALS_SQL), "bars": (panels.monthly_bars, panels.BARS_SQL), "daily": (panels.daily_events, panels.DAILY_SQL)}[source]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_kernels(panel(spark, sf_dir), formulas, keep=["symbol", "date"])
        return text_date(rounded(made, formulas, digits))

    return query, f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({duck_sql(source, formulas, ['symbol', 'date'], digits, ctes=ctes)})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, instrument, symbol, industry, nation, close and scores, labels and returns, rounded so that ties are ties everywhere."""
    made = with_formulas(panels.signal_panel(spark, sf_dir), SCORED, keep=["symbol", "date", "industry", "nation", "close", "volume"])
    return rounded(made, SCORED).withColumn("instrument", F.col("symbol"))


SCORED_SQL = panels.SIGNALS_SQL + ", scored AS (SELECT *, symbol AS instrument FROM (" + duck_sql("panel", SCORED, ["symbol", "date", "industry", "nation", "close", "volume"]) + "))"


def significant(x: str, infinity: str) -> str:
    """SQL of both engines: x to six decimals, and beyond 1 to seven digits, for columns whose sizes differ by powers of ten."""
    unit = f"power(CAST(10 AS DOUBLE), floor(log10(abs({x}))))"
    return f"CASE WHEN abs({x}) < {infinity} THEN CASE WHEN abs({x}) >= 1 THEN round({x} / {unit}, 6) * {unit} ELSE round({x}, 6) + CAST(0 AS DOUBLE) END END"


def avg_rank_sql(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NOT NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE END"


def r6(x: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({x}) < CAST('Infinity' AS DOUBLE) THEN round({x}, {digits}) + 0.0 END"
