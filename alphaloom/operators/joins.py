"""Joins of panels with side tables: as-of, intervals, industry context, fused scores and aligned axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of rows with equal keys the one with the highest sequence number; ties by the whole row."""
    ties = [F.col(c).desc_nulls_last() for c in df.columns if c not in (*keys, sequence)]
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(sequence).desc_nulls_last(), *ties))
    return df.withColumn("_row", row).where("_row = 1").drop("_row")


def as_of(left: DataFrame, events: DataFrame, by: str = "symbol", on: str = "date", event_date: str = "ann_date", sequence: str | None = None, strict: bool = True, days: str | None = None, values: list[str] | None = None) -> DataFrame:
    """`left` with the values of the latest event of its symbol that is available.

    Strict: an event counts from the first row after its date, otherwise from its own date. Later dates win, then higher
    sequence numbers. One union, one exchange by symbol and one sort; no join.
    """
    values = [c for c in events.columns if c not in (by, event_date, sequence)] if values is None else values
    order = F.col(sequence) if sequence else F.lit(0)
    side = F.struct(F.col(event_date).alias("_at"), *values)
    rows = left.select(F.col(by).alias("_by"), F.col(on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("long").alias("_seq"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(events.select(side.alias("s")).schema["s"].dataType).alias("_event"))
    more = events.where(F.col(event_date).isNotNull()).select(F.col(by).alias("_by"), F.col(event_date).alias("_t"), F.lit(1 if strict else 0).alias("_side"), order.cast("long").alias("_seq"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), side.alias("_event"))
    w = Window.partitionBy("_by").orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.union(more).withColumn("_event", F.last("_event", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    age = [F.datediff("_left." + on, "_event._at").cast("double").alias(days)] if days else []
    return out.select("_left.*", *(F.col(f"_event.{c}").alias(c) for c in values), *age)


def in_universe(panel: DataFrame, intervals: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Rows whose date lies in a closed interval (start, end; either may be open) of their symbol."""
    i = intervals.select(F.col("symbol").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    fits = (F.col(symbol) == F.col("_s")) & (F.col("_a").isNull() | (F.col(date) >= F.col("_a"))) & (F.col("_b").isNull() | (F.col(date) <= F.col("_b")))
    return panel.join(i, fits, "left_semi")


def with_industry(panel: DataFrame, industries: DataFrame, policy: str = "missing", symbol: str = "symbol") -> DataFrame:
    """The panel with each symbol's industry; unmapped symbols have none ("missing"), "UNKNOWN" ("unknown") or one of their own ("own")."""
    fill: dict[str, Column] = {"missing": F.lit(None), "unknown": F.lit("UNKNOWN"), "own": F.concat(F.lit("own:"), F.col(symbol))}
    return panel.join(industries.select(symbol, "industry"), symbol, "left").withColumn("industry", F.coalesce("industry", fill[policy]))


def fused_pairs(primary: DataFrame, secondary: DataFrame, keys: tuple[str, ...] = ("date", "instrument")) -> DataFrame:
    """Inner join of two score tables (score) on the pairs where neither is missing: a and b."""
    clean = lambda df, name: df.select(*keys, F.nanvl("score", F.lit(None).cast("double")).alias(name)).where(F.col(name).isNotNull())
    return clean(primary, "a").join(clean(secondary, "b"), list(keys))


def shared_axes(*frames: DataFrame, date: str = "date", instrument: str = "instrument") -> list[DataFrame]:
    """Each frame reduced to the dates and the instruments that all of them have."""
    out = []
    for k, f in enumerate(frames):
        for axis in (date, instrument):
            for j, g in enumerate(frames):
                if j != k:
                    f = f.join(g.select(axis).distinct(), axis, "left_semi")
        out.append(f.select(frames[k].columns))
    return out


def calendar(frame: DataFrame, date: str = "date") -> Column:
    """All dates of a frame in order, as an array: a scalar subquery. A calendar has a row per trading date, whatever the frame's size."""
    return frame.agg(F.array_sort(F.collect_set(date))).scalar()


def dense(frame: DataFrame, value: str = "score", date: str = "date", instrument: str = "instrument") -> DataFrame:
    """A row for each of the frame's dates and instruments; only for matrices that must be dense. The calendar is unfolded for each instrument: no product of tables."""
    axes = frame.select(instrument).distinct().withColumn(date, F.explode(calendar(frame, date)))
    return axes.join(frame.select(date, instrument, value), [date, instrument], "left").select(date, instrument, value)


def aligned(dates: DataFrame, series: DataFrame, value: str, fill: float = 0.0, date: str = "date") -> DataFrame:
    """Each date with the value of a series, or the fill."""
    return dates.join(series.select(date, value), date, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def days_of(spans: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """spans with a row for each day from start to end: ranges of dates become an equi-join on the day."""
    return spans.withColumn(date, F.explode(F.sequence(start, end))).drop(start, end)


def windows_of(rows: DataFrame, windows: DataFrame, date: str = "date") -> DataFrame:
    """Rows in the train, valid or test span of each rolling window: window_id and part. Windows overlap, so rows may repeat."""
    spans = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("a"), F.col(f"{p}_end").alias("b")) for p in ("train", "valid", "test")))
    long = windows.select("window_id", F.explode(spans).alias("s")).select("window_id", "s.part", "s.a", "s.b")
    return rows.join(days_of(long, "a", "b", date), date)


def metric_of_date(dates: DataFrame, records: DataFrame, date: str = "date") -> DataFrame:
    """Each date with the metric of the last record (by record_no) whose span [start, end] holds it."""
    days = days_of(records.select("record_no", "metric", "start", "end"), "start", "end", date)
    return dates.join(days.groupBy(date).agg(F.max_by("metric", "record_no").alias("metric")), date, "left")
