"""Cleaning and normalising collected bars: adjustment, sanitising, lifecycles and universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import keep_last

__all__ = ["adjusted", "backfilled", "bucket_of", "chunks", "complete", "daily_sanitized", "effective_end", "exchange_code", "keep_last", "lifecycle", "numeric", "parsed_date", "pending", "six_digits", "split_pending", "universe_records", "valuation_sanitized", "with_vwap"]

#: Shards of a bucket store.
BUCKETS = 128


def parsed_date(c: Column) -> Column:
    """DATE of the accepted text forms: YYYYMMDD, YYYY-MM-DD, and either with a time of day."""
    head = F.regexp_extract(F.trim(c), r"^(\d{4})-?(\d{2})-?(\d{2})(?:[ T].*)?$", 0)
    return F.when(head != "", F.try_to_date(F.regexp_replace(F.regexp_extract(head, r"^[\d-]{8,10}", 0), "-", ""), "yyyyMMdd"))


def numeric(c: Column) -> Column:
    """A double, or missing where the text is no number."""
    return F.nanvl(F.trim(c.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def six_digits(c: Column) -> Column:
    return F.lpad(F.regexp_replace(c, "[^0-9]", ""), 6, "0")


def exchange_code(c: Column) -> Column:
    """Symbol with its exchange suffix; an error for prefixes that neither exchange has."""
    s = six_digits(c)
    return F.when(s.rlike("^(600|601|603|605|688)"), F.concat(s, F.lit(".SH"))).when(s.rlike("^(00[0-3]|300|301)"), F.concat(s, F.lit(".SZ"))).otherwise(F.raise_error(F.concat(F.lit("no exchange for "), s)))


def bucket_of(symbol: Column, buckets: int = BUCKETS) -> Column:
    """Shard of a symbol: CRC-32 modulo the number of buckets."""
    return (F.crc32(symbol.cast("binary")) % buckets).cast("long")


def with_vwap(df: DataFrame) -> DataFrame:
    """vwap: the column if there is one, else amount / volume, or the close where that says nothing."""
    if "vwap" in df.columns:
        return df
    if "amount" not in df.columns:
        return df.withColumn("vwap", F.col("close"))
    ratio = F.col("amount") / F.when(F.col("volume") != 0, F.col("volume"))
    return df.withColumn("vwap", F.coalesce(F.when(F.abs(ratio) < float("inf"), ratio), F.col("close")))


def adjusted(daily: DataFrame, basic: DataFrame, factor: DataFrame, limits: DataFrame) -> DataFrame:
    """Back-adjusted bars of raw daily rows and their side tables, all by (ts_code, trade_date); units become single shares and currency."""
    keys = ["ts_code", "trade_date"]
    extra = limits.withColumnRenamed("pre_close", "raw_limit_pre_close")
    df = daily.join(basic, keys, "left").join(factor, keys, "left").join(extra, keys, "left")
    f = F.coalesce("adj_factor", F.lit(1.0))
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    price = {c: F.col(c) * f for c in ("open", "high", "low", "close")}
    df = df.withColumns({**{f"raw_{c}": F.col(c) for c in (*price, "pre_close")}, **price, "adj_factor": f})
    before = F.lag("close").over(w)
    df = df.withColumn("pre_close", F.coalesce(before, F.col("raw_pre_close") * F.col("adj_factor")))
    ok = F.col("pre_close") > 0
    scaled = {c: F.col(c) * 10000 for c in ("total_mv", "circ_mv", "total_share", "float_share", "free_share") if c in df.columns}
    df = df.withColumns({
        **scaled, "amount": F.col("amount") * 1000, "change": F.col("close") - F.col("pre_close"), "pct_chg": F.when(ok, (F.col("close") / F.col("pre_close") - 1) * 100),
        "amplitude": F.when(ok, (F.col("high") - F.col("low")) / F.col("pre_close") * 100), "limit_pre_close": F.col("raw_limit_pre_close") * F.col("adj_factor"),
        "up_limit": F.col("up_limit") * F.col("adj_factor"), "down_limit": F.col("down_limit") * F.col("adj_factor"),
    })
    renames = {"turnover_rate": "turnover", "turnover_rate_f": "turnover_free", "float_share": "circ_share"}
    return df.drop("raw_limit_pre_close").withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def daily_sanitized(df: DataFrame) -> DataFrame:
    """Bars with prices filled from the close, volumes from 0, derived changes, and negative quantities made missing."""
    w = Window.partitionBy("symbol").orderBy("date")
    fill = {c: F.coalesce(c, "close") for c in ("open", "high", "low")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("volume", "amount", "turnover") if c in df.columns}
    df = df.withColumns(fill).withColumn("_before", F.lag("close").over(w))
    before = F.when(F.col("_before") != 0, F.col("_before"))
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    df = df.withColumns({
        "pct_chg": F.coalesce(have("pct_chg"), (F.col("close") / before - 1) * 100), "change": F.coalesce(have("change"), F.col("close") - F.col("_before")),
        "amplitude": F.coalesce(have("amplitude"), (F.col("high") - F.col("low")) / before * 100), **{c: F.when(F.col(c) >= 0, F.col(c)) for c in ("volume", "amount", "turnover") if c in df.columns},
    })
    return df.drop("_before")


def valuation_sanitized(df: DataFrame) -> DataFrame:
    """Share and value pairs, both missing where either is negative or the circulating part exceeds the whole."""
    for whole, part in (("total_share", "circ_share"), ("total_mv", "circ_mv")):
        bad = F.coalesce((F.col(whole) < 0) | (F.col(part) < 0) | (F.col(part) > F.col(whole)), F.lit(False)) | F.coalesce(F.col(whole) < 0, F.lit(False)) | F.coalesce(F.col(part) < 0, F.lit(False))
        df = df.withColumns({whole: F.when(~bad, F.col(whole)), part: F.when(~bad, F.col(part))})
    return df


def with_valuation(daily: DataFrame, valuation: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Daily rows with their valuation; the daily calendar stays, a missing close comes from the valuation."""
    v = valuation.withColumnRenamed("close", "_close") if "close" in valuation.columns else valuation.withColumn("_close", F.lit(None).cast("double"))
    return daily.join(v, list(keys), "left").withColumn("close", F.coalesce("close", "_close")).drop("_close")


#: First date that price limits are published for (fixed value).
LIMITS_FROM = "2007-01-04"


def lifecycle(target: Column) -> Column:
    """not_yet_listed, delisted, suspended or active on a target date, of list_status, list_date, delist_date, last_trade, last_factor and last_limit.

    Delisted takes the status D as well as the date. Suspended is who no longer trades while the adjustment factors go on to the target, and
    so do the limits where there are any yet; data that is merely late leaves a symbol active.
    """
    reaches = lambda c: F.coalesce(F.col(c) >= target, F.lit(False))
    limits = (target < F.lit(LIMITS_FROM).cast("date")) | reaches("last_limit")
    return (
        F.when(F.col("list_date") > target, "not_yet_listed").when((F.col("list_status") == "D") & (F.col("delist_date") <= target), "delisted")
        .when((F.col("last_trade") < target) & reaches("last_factor") & limits, "suspended").otherwise("active")
    )


def effective_end(status: Column, target: Column) -> Column:
    """Date up to which a symbol can have data."""
    return F.when(status == "delisted", F.least("delist_date", "last_trade")).when(status == "suspended", F.col("last_trade")).otherwise(target)


def backfilled(expected: Column, earliest: Column, exhausted: Column) -> Column:
    """Whether a stage's history is as long as it can be: none is expected, it begins in time, or the provider was found exhausted for just this start."""
    return F.coalesce(expected.isNull() | (earliest <= expected), F.lit(False)) | F.coalesce(exhausted == expected, F.lit(False))


#: Stages that every symbol must have (fixed values).
STAGES = ("daily", "daily_basic", "adj_factor")


def complete(target: Column, expected: Column | None = None) -> Column:
    """Whether a symbol's stages hold all there is, of {stage}_latest and {stage}_earliest of the stages, stk_limit_latest and processed_latest.

    All stages must reach the target, limits too where there are any yet, and the processed bars must reach the daily ones. With an
    expected start the stages must begin by it, or be known as ready ({stage}_ready).
    """
    reaches = lambda c: F.coalesce(F.col(c) >= target, F.lit(False))
    out = reduce(lambda a, b: a & b, (reaches(f"{s}_latest") for s in STAGES)) & ((target < F.lit(LIMITS_FROM).cast("date")) | reaches("stk_limit_latest"))
    out = out & F.coalesce(F.col("processed_latest") >= F.col("daily_latest"), F.lit(False))
    if expected is not None:
        begins = lambda s: F.coalesce(F.col(f"{s}_earliest") <= expected, F.lit(False)) | F.coalesce(F.col(f"{s}_ready"), F.lit(False))
        out = out & (expected.isNull() | reduce(lambda a, b: a & b, map(begins, STAGES)))
    return out


def split_pending(symbols: DataFrame, target: Column, expected: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pending, completed) symbols of a table with status, effective_end and what `complete` reads; those not yet listed have nothing to collect."""
    done = F.coalesce(F.col("status") == "not_yet_listed", F.lit(False)) | complete(F.least("effective_end", target), expected)
    return symbols.where(~done), symbols.where(done)


def pending(symbols: DataFrame, manifest: DataFrame, target: Column) -> DataFrame:
    """Symbols whose stored data (max_date of a store's manifest) ends before their effective end; those not yet listed are complete."""
    out = symbols.join(manifest.select("symbol", "max_date"), "symbol", "left")
    end = F.least("effective_end", target) if "effective_end" in symbols.columns else target
    return out.where((F.coalesce("status", F.lit("active")) != "not_yet_listed") & (F.col("max_date").isNull() | (F.col("max_date") < end)))


def chunks(start: Column, end: Column, years: int = 12) -> Column:
    """Date ranges of `years` years that cover start to end, as an array of structs (start, end)."""
    firsts = F.sequence(start, end, F.expr(f"INTERVAL {years} YEARS"))
    return F.transform(firsts, lambda d: F.struct(d.alias("start"), F.least(F.date_sub(F.add_months(d, 12 * years), 1), end).alias("end")))


def universe_records(df: DataFrame, symbol: list[str], start: list[str], end: list[str], static: bool = False) -> DataFrame:
    """Distinct symbol, start and end from the first present of candidate columns; without dates only if a static universe is allowed."""
    first = lambda names: next((n for n in names if n in df.columns), None)
    s, a, b = first(symbol), first(start), first(end)
    if s is None:
        raise ValueError("no symbol column")
    if a is None and not static:
        raise ValueError("the universe has no dates, and a static one is not allowed")
    date = lambda c, d: F.coalesce(parsed_date(F.col(c).cast("string")) if c else F.lit(None).cast("date"), F.lit(d).cast("date"))
    return df.select(six_digits(F.col(s)).alias("symbol"), date(a, "2005-01-01").alias("start"), date(b, "2099-12-31").alias("end")).distinct().orderBy("symbol", "start", "end")
