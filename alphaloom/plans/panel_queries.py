"""Queries over sources, normalisation, joins, labels and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import col, rounded, with_formulas
from ..operators import collect, crosssection, industry, joins, labels, training
from ..sources import panels, stores
from .frames import CAP, SCORED_SQL, avg_rank_sql, formulas_query, r6, scored, text_date

QUERIES: dict = {}
ORACLES: dict = {}


def registered(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB equivalent."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    dates = [c for c, t in df.dtypes if t == "date"]
    out = rounded(df, [c for c, t in df.dtypes if t == "double"], digits)
    return text_date(out, *dates) if dates else out


_D = "CAST(date AS VARCHAR) AS date"


@registered(f"WITH {panels.BARS_SQL} SELECT symbol, {_D}, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "volume", "amount", "discount", "tax")) + ", trades FROM bars")
def bar_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(panels.monthly_bars(spark, sf_dir), 9)


@registered(f"WITH {panels.DAILY_SQL} SELECT symbol, {_D}, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "volume", "amount")) + " FROM daily")
def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(panels.daily_events(spark, sf_dir), 9)


@registered(f"WITH {panels.BARS_SQL} SELECT symbol, {_D}, round(CASE WHEN v <> 0 THEN amount / v ELSE close END, 9) + 0.0 AS vwap FROM (SELECT *, CASE WHEN trades % 4 = 0 THEN 0 ELSE volume END AS v FROM bars)")
def vwap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panels.monthly_bars(spark, sf_dir).withColumn("volume", F.when(F.col("trades") % 4 == 0, F.lit(0.0)).otherwise(F.col("volume")))
    return doubles(collect.with_vwap(bars).select("symbol", "date", "vwap"), 9)


# ---- raw collection: order lines as provider rows

_RAW_SQL = panels.BARS_SQL + """, raw AS (SELECT symbol AS ts_code, strftime(date, '%Y%m%d') AS trade_date, date, open, high, low, close, CASE WHEN trades % 5 = 0 THEN NULL ELSE open END AS pre_close, volume, amount,
  CASE WHEN trades % 3 <> 0 THEN 1 + (month(date) / 10.0::DOUBLE) END AS adj_factor, 1000 * discount AS total_mv, open * 1.5::DOUBLE AS up_limit, open * 0.5::DOUBLE AS down_limit, open AS limit_open, trades FROM bars)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panels.monthly_bars(spark, sf_dir)
    return b.select(
        F.col("symbol").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", F.when(F.col("trades") % 5 != 0, F.col("open")).alias("pre_close"), "volume", "amount",
        F.when(F.col("trades") % 3 != 0, 1 + F.month("date") / F.lit(10.0)).alias("adj_factor"), (1000 * F.col("discount")).alias("total_mv"), (F.col("open") * 1.5).alias("up_limit"), (F.col("open") * 0.5).alias("down_limit"), F.col("open").alias("limit_open"),
    )


@registered(f"""WITH {_RAW_SQL}, a AS (SELECT *, coalesce(adj_factor, 1.0::DOUBLE) AS f FROM raw), p AS (SELECT *, close * f AS c, lag(close * f) OVER (PARTITION BY ts_code ORDER BY trade_date) AS before FROM a),
q AS (SELECT *, coalesce(before, pre_close * f) AS pre FROM p)
SELECT ts_code, trade_date, {r6('c', 9)} AS close, {r6('pre', 9)} AS pre_close, {r6('CASE WHEN pre > 0 THEN (c / pre - 1) * 100 END')} AS pct_chg, {r6('CASE WHEN pre > 0 THEN (high * f - low * f) / pre * 100 END')} AS amplitude,
  {r6('amount * 1000', 3)} AS amount, {r6('total_mv * 10000', 3)} AS total_mv, {r6('up_limit * f', 9)} AS up_limit, {r6('limit_open * f', 9)} AS limit_pre_close FROM q""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, keys = _raw(spark, sf_dir), ["ts_code", "trade_date"]
    made = collect.adjusted(raw.select(*keys, "open", "high", "low", "close", "pre_close", "volume", "amount"), raw.select(*keys, "total_mv"), raw.where("adj_factor IS NOT NULL").select(*keys, "adj_factor"), raw.select(*keys, F.col("limit_open").alias("pre_close"), "up_limit", "down_limit"))
    out = made.select(*keys, "close", "pre_close", "pct_chg", "amplitude", "amount", "total_mv", "up_limit", "limit_pre_close")
    return rounded(rounded(rounded(out, ["pct_chg", "amplitude"]), ["close", "pre_close", "up_limit", "limit_pre_close"], 9), ["amount", "total_mv"], 3)


@registered(f"""WITH {panels.BARS_SQL}, h AS (SELECT symbol, date, close, CASE WHEN trades % 4 > 0 THEN high ELSE close END AS high, CASE WHEN trades % 4 > 0 THEN low ELSE close END AS low, CASE WHEN trades % 7 = 0 THEN 0.0::DOUBLE WHEN trades % 5 = 0 THEN NULL ELSE volume END AS volume FROM bars),
w AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS b FROM h)
SELECT symbol, {_D}, {r6('high', 9)} AS high, {r6('volume', 9)} AS volume, {r6('(close / nullif(b, 0) - 1) * 100')} AS pct_chg, {r6('close - b', 9)} AS change, {r6('(high - low) / nullif(b, 0) * 100')} AS amplitude FROM w""")
def daily_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panels.monthly_bars(spark, sf_dir)
    odd = b.select("symbol", "date", "close", F.when(F.col("trades") % 4 > 0, F.col("open")).alias("open"), *(F.when(F.col("trades") % 4 > 0, F.col(c)).alias(c) for c in ("high", "low")), F.when(F.col("trades") % 7 == 0, F.lit(None)).when(F.col("trades") % 5 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))
    made = collect.daily_sanitized(odd)
    return text_date(rounded(rounded(made.select("symbol", "date", "high", "volume", "pct_chg", "change", "amplitude"), ["pct_chg", "amplitude"]), ["high", "volume", "change"], 9))


@registered(f"""WITH {panels.SIGNALS_SQL}, v AS (SELECT symbol, date, total_mv - 300 AS total_mv, circ_mv - 200 AS circ_mv FROM panel), b AS (SELECT *, total_mv < 0 OR circ_mv < 0 OR circ_mv > total_mv AS bad FROM v)
SELECT symbol, {_D}, CASE WHEN NOT bad THEN total_mv END AS total_mv, CASE WHEN NOT bad THEN circ_mv END AS circ_mv FROM b""")
def valuation_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.signal_panel(spark, sf_dir).select("symbol", "date", (F.col("total_mv") - 300).alias("total_mv"), (F.col("circ_mv") - 200).alias("circ_mv"), "total_share", "circ_share")
    return text_date(collect.valuation_sanitized(p).select("symbol", "date", "total_mv", "circ_mv"))


@registered("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    return joins.keep_last(e, ["user_id", "event_type", "day"], "event_id").select("user_id", "event_type", "event_id", "value")


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code FROM orders""")
def parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in all accepted forms, and zero-padded codes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    form = F.when(F.col("o_orderkey") % 4 == 0, "no date").when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", collect.parsed_date(form).cast("string").alias("parsed"), collect.six_digits(F.concat(F.lit("c-"), F.col("o_custkey").cast("string"))).alias("code"))


_LIFE_SQL = """l AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-06-30' ELSE DATE '2008-06-30' END AS target, DATE '1992-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS list_date,
  CASE WHEN c_custkey % 3 = 0 THEN DATE '1997-01-01' + CAST(c_custkey % 700 AS INTEGER) END AS delist_date, CASE WHEN c_custkey % 5 = 0 THEN 'D' ELSE 'L' END AS list_status FROM customer),
t AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, max(CAST(o_orderdate AS DATE)) AS last_trade FROM orders GROUP BY 1),
j AS (SELECT l.*, last_trade, CASE WHEN k % 4 > 0 THEN target + CAST(k % 4 - 1 AS INTEGER) ELSE last_trade END AS last_factor, CASE WHEN k % 7 > 2 THEN target WHEN k % 7 = 2 THEN target - 1 END AS last_limit FROM l LEFT JOIN t USING (symbol))"""


def _lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for symbols, with targets before and after the first limits, and data that is late or goes on."""
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    k = F.col("c_custkey")
    day = lambda text, n: F.date_add(F.lit(text).cast("date"), n.cast("int"))
    target = F.when(k % 2 == 0, F.lit("1998-06-30").cast("date")).otherwise(F.lit("2008-06-30").cast("date"))
    life = c.select(k.alias("k"), k.cast("string").alias("symbol"), target.alias("target"), day("1992-01-01", k % 3000).alias("list_date"), F.when(k % 3 == 0, day("1997-01-01", k % 700)).alias("delist_date"), F.when(k % 5 == 0, "D").otherwise("L").alias("list_status"))
    last = o.groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.max(F.to_date("o_orderdate")).alias("last_trade"))
    df, k = life.join(last, "symbol", "left"), F.col("k")
    df = df.withColumns({"last_factor": F.when(k % 4 > 0, F.date_add("target", (k % 4 - 1).cast("int"))).otherwise(F.col("last_trade")), "last_limit": F.when(k % 7 > 2, F.col("target")).when(k % 7 == 2, F.date_sub("target", 1))})
    df = df.withColumn("status", collect.lifecycle(F.col("target")))
    return df.withColumn("effective_end", collect.effective_end(F.col("status"), F.col("target")))


_STATUS_SQL = """CASE WHEN list_date > target THEN 'not_yet_listed' WHEN list_status = 'D' AND delist_date <= target THEN 'delisted'
  WHEN last_trade < target AND last_factor >= target AND (target < DATE '2007-01-04' OR coalesce(last_limit >= target, false)) THEN 'suspended' ELSE 'active' END"""


@registered(f"""WITH {_LIFE_SQL}, s AS (SELECT *, {_STATUS_SQL} AS status FROM j)
SELECT symbol, status, CAST(CASE status WHEN 'delisted' THEN CASE WHEN last_trade < delist_date THEN last_trade ELSE delist_date END WHEN 'suspended' THEN last_trade ELSE target END AS VARCHAR) AS effective_end FROM s""")
def lifecycle_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_date(_lifecycles(spark, sf_dir).select("symbol", "status", "effective_end"), "effective_end")


@registered(f"""WITH {_LIFE_SQL}, s AS (SELECT *, CASE WHEN k % 13 > 0 THEN target END AS daily_latest, last_factor AS adj_factor_latest, CASE WHEN k % 17 > 0 THEN target + 1 END AS daily_basic_latest, CASE WHEN k % 8 > 0 THEN target - CAST(k % 8 - 2 AS INTEGER) END AS processed_latest, list_date + CAST(k % 4 AS INTEGER) AS earliest FROM j)
SELECT symbol, coalesce(daily_latest >= target, false) AND coalesce(daily_basic_latest >= target, false) AND coalesce(adj_factor_latest >= target, false) AND (target < DATE '2007-01-04' OR coalesce(last_limit >= target, false)) AND coalesce(processed_latest >= daily_latest, false) AND (earliest <= list_date OR k % 3 = 0) AS complete FROM s""")
def stage_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which symbols' stages hold all there is, histories included."""
    s, k, target = _lifecycles(spark, sf_dir), F.col("k"), F.col("target")
    begins = F.date_add("list_date", (k % 4).cast("int"))
    s = s.withColumns({
        "daily_latest": F.when(k % 13 > 0, target), "adj_factor_latest": F.col("last_factor"), "daily_basic_latest": F.when(k % 17 > 0, F.date_add(target, 1)), "stk_limit_latest": F.col("last_limit"),
        "processed_latest": F.when(k % 8 > 0, F.date_sub(target, (k % 8 - 2).cast("int"))), **{f"{x}_earliest": begins for x in collect.STAGES}, **{f"{x}_ready": k % 3 == 0 for x in collect.STAGES},
    })
    return s.select("symbol", collect.complete(target, F.col("list_date")).alias("complete"))


@registered(f"WITH {panels.BARS_SQL} SELECT symbol, count(*) AS rows, CAST(min(date) AS VARCHAR) AS min_date, CAST(max(date) AS VARCHAR) AS max_date FROM bars GROUP BY symbol")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_date(stores.manifest(panels.monthly_bars(spark, sf_dir)).drop("bucket"), "min_date", "max_date")


# The other engine has no CRC-32: it is worked out bit by bit, 8 steps to a character.
@registered("""WITH RECURSIVE s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code FROM lineitem),
c(symbol, code, step, crc) AS (SELECT symbol, code, 0, 4294967295::BIGINT FROM s UNION ALL
  SELECT symbol, code, step + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(crc, ascii(substr(code, step // 8 + 1, 1))::BIGINT) ELSE crc END AS x FROM c WHERE step < 48))
SELECT symbol, CAST(xor(crc, 4294967295::BIGINT) % 128 AS BIGINT) AS bucket FROM c WHERE step = 48""")
def symbol_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every symbol."""
    return panels.monthly_bars(spark, sf_dir).select("symbol").distinct().select("symbol", collect.bucket_of(F.lpad("symbol", 6, "0")).alias("bucket"))


@registered("SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('year', min(l_shipdate)) AS VARCHAR)[1:4] AS first_year, CAST(ceil((year(max(l_shipdate)) - year(min(l_shipdate)) + 1) / 2.0) AS BIGINT) AS n_chunks FROM lineitem GROUP BY l_suppkey")
def chunked_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-year request ranges from the first to the last year of every symbol."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    span = line.groupBy(F.col("l_suppkey").cast("string").alias("symbol")).agg(F.trunc(F.min("l_shipdate"), "year").alias("a"), F.last_day(F.add_months(F.trunc(F.max("l_shipdate"), "year"), 11)).alias("b"))
    return span.select("symbol", F.date_format("a", "yyyy").alias("first_year"), F.size(collect.chunks(F.col("a"), F.col("b"), 2)).cast("long").alias("n_chunks"))


# ---- joins

_EVENTS_SQL = "ann AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS ann_date, event_id, CASE WHEN event_id % 5 > 0 THEN value END AS announced FROM events)"


def _announced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("ann_date"), "event_id", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("announced"))


def _asof_sql(op: str) -> str:
    return f"""WITH {panels.DAILY_SQL}, {_EVENTS_SQL}, e AS (SELECT symbol, ann_date, max_by(event_id, event_id) AS event_id, arg_max(announced, event_id) AS a0, last(announced ORDER BY event_id) AS announced FROM ann GROUP BY symbol, ann_date)
    SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, e.announced, CAST(date_diff('day', e.ann_date, d.date) AS DOUBLE) AS days_since_ann FROM daily d ASOF LEFT JOIN e ON d.symbol = e.symbol AND d.date {op} e.ann_date"""


@registered(_asof_sql(">"))
def asof_sidecar_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.as_of(panels.daily_events(spark, sf_dir).select("symbol", "date"), _announced(spark, sf_dir), sequence="event_id", days="days_since_ann", values=["announced"])
    return text_date(made)


@registered(_asof_sql(">="))
def asof_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.as_of(panels.daily_events(spark, sf_dir).select("symbol", "date"), _announced(spark, sf_dir), sequence="event_id", strict=False, days="days_since_ann", values=["announced"])
    return text_date(made)


@registered(f"""WITH {panels.BARS_SQL}, u AS (SELECT symbol, CASE WHEN CAST(symbol AS BIGINT) % 3 > 0 THEN min(date) + INTERVAL 200 DAY END AS a, CASE WHEN CAST(symbol AS BIGINT) % 4 > 0 THEN max(date) - INTERVAL 300 DAY END AS b FROM bars WHERE CAST(symbol AS BIGINT) % 5 > 0 GROUP BY symbol)
SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, trades FROM bars b WHERE EXISTS (SELECT 1 FROM u WHERE u.symbol = b.symbol AND (u.a IS NULL OR b.date >= u.a) AND (u.b IS NULL OR b.date <= u.b))""")
def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panels.monthly_bars(spark, sf_dir)
    n = F.col("symbol").cast("long")
    u = bars.where(n % 5 > 0).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    u = u.select("symbol", F.when(n % 3 > 0, F.date_add("a", 200)).alias("start"), F.when(n % 4 > 0, F.date_sub("b", 300)).alias("end"))
    return text_date(joins.in_universe(bars, u).select("symbol", "date", "trades"))


_IND = ["turnover", "amplitude"]
_IND_SQL = f"""ind AS (SELECT date, industry, count(*) AS ind_member_count, avg(ret) AS ind_daily_ret, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ind_pos_rate, stddev_samp(ret) AS ind_dispersion, {', '.join(f'avg({c}) AS ind_{c}_mean' for c in _IND)} FROM members WHERE ret IS NOT NULL GROUP BY date, industry),
market AS (SELECT date, avg(ret) AS market_ret FROM members WHERE ret IS NOT NULL GROUP BY date), context AS (SELECT ind.*, market_ret, ind_daily_ret - market_ret AS ind_excess_daily_ret FROM ind JOIN market USING (date))"""
_MEMBERS_SQL = panels.SIGNALS_SQL + ", members AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM panel)"


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.signal_panel(spark, sf_dir)
    return industry.daily(with_formulas(p, {"ret": col("close").change(1)}), means=_IND)


@registered(f"WITH {_MEMBERS_SQL}, {_IND_SQL} SELECT {_D}, industry, ind_member_count, " + ", ".join(f"{r6(c)} AS {c}" for c in ("ind_daily_ret", "ind_pos_rate", "ind_dispersion", "ind_turnover_mean", "ind_amplitude_mean", "ind_excess_daily_ret", "market_ret")) + " FROM context")
def industry_daily_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_context(spark, sf_dir))


def _rolling_sql() -> str:
    w = lambda n, by="industry": f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    comp = lambda x, n, by: f"exp(sum(ln(1 + greatest({x}, -0.999999::DOUBLE))) {w(n, by)}) - 1"
    parts = [x for n in (5, 20, 60) for x in (f"{comp('ind_daily_ret', n, 'industry')} AS ind_ret_{n}", f"CASE WHEN count(ind_daily_ret) {w(n)} >= 2 THEN stddev_samp(ind_daily_ret) {w(n)} END AS ind_std_{n}", f"avg(ind_pos_rate) {w(n)} AS ind_pos_rate_{n}", f"avg(ind_dispersion) {w(n)} AS ind_dispersion_{n}")]
    parts += [f"avg(ind_turnover_mean) {w(n)} AS ind_turnover_mean_{n}" for n in (20, 60)]
    m = ", ".join(f"{comp('market_ret', n, 'one')} AS m{n}" for n in (5, 20, 60))
    names = [f"ind_{k}_{n}" for n in (5, 20, 60) for k in ("ret", "std", "pos_rate", "dispersion")] + [f"ind_turnover_mean_{n}" for n in (20, 60)]
    # The synthetic returns compound to huge numbers; their logarithms are compared.
    log = lambda x: f"sign({x}) * ln(1 + abs({x}))"
    return f"""WITH {_MEMBERS_SQL}, {_IND_SQL}, roll AS (SELECT date, industry, {', '.join(parts)} FROM context), mr AS (SELECT date, {m} FROM (SELECT *, 1 AS one FROM market))
    SELECT CAST(roll.date AS VARCHAR) AS date, industry, {', '.join(f'{r6(log(c))} AS {c}' for c in names)}, {', '.join(f"{r6(log(f'(ind_ret_{n} - m{n})'))} AS ind_excess_ret_{n}" for n in (5, 20, 60))} FROM roll JOIN mr USING (date)"""


@registered(_rolling_sql())
def industry_rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = industry.rolling(_context(spark, sf_dir), ("turnover",))
    names = [f"ind_{k}_{n}" for n in (5, 20, 60) for k in ("ret", "std", "pos_rate", "dispersion", "excess_ret")] + [f"ind_turnover_mean_{n}" for n in (20, 60)]
    return doubles(made.select("date", "industry", *((F.signum(c) * F.log1p(F.abs(F.col(c)))).alias(c) for c in names)))


@registered(f"""WITH {_MEMBERS_SQL}, {_IND_SQL}, late AS (SELECT * FROM context WHERE month(date) % 3 = 0)
SELECT p.symbol, CAST(p.date AS VARCHAR) AS date, {r6('l.ind_daily_ret')} AS ind_daily_ret, l.ind_member_count FROM panel p ASOF LEFT JOIN late l ON p.industry = l.industry AND p.date >= l.date""")
def industry_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the panel against a context that is known in every third month only, so that most rows look back."""
    late = _context(spark, sf_dir).where(F.month("date") % 3 == 0).select("date", "industry", "ind_daily_ret", "ind_member_count")
    return doubles(industry.with_context(panels.signal_panel(spark, sf_dir).select("symbol", "date", "industry"), late).drop("industry"))


@registered(f"WITH {SCORED_SQL}, a AS (SELECT * FROM scored WHERE month(date) <> 3), b AS (SELECT * FROM scored WHERE CAST(symbol AS BIGINT) % 3 > 0) SELECT {_D}, instrument, score FROM a WHERE date IN (SELECT date FROM b) AND instrument IN (SELECT instrument FROM b)")
def axis_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("date", "instrument", "score")
    a, _ = joins.shared_axes(s.where(F.month("date") != 3), s.where(F.col("instrument").cast("long") % 3 > 0))
    return text_date(a)


# ---- labels and cross-sections

_label_formulas = {f"label_{h}d": labels.forward_return(h, CAP) for h in labels.horizons("3,5")}
QUERIES["labels_open_to_open"], ORACLES["labels_open_to_open"] = formulas_query(_label_formulas)
QUERIES["labels_capped"], ORACLES["labels_capped"] = formulas_query({"label": labels.forward_return(1)})


def _scored_query(name: str, sql: str, make, keep=("date", "instrument")):
    """Registers a query over the scored panel; sql is a select over `scored`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return doubles(make(scored(spark, sf_dir)))

    QUERIES[name], ORACLES[name] = query, f"WITH {SCORED_SQL} {sql}"


_AR = avg_rank_sql
_scored_query("xs_rank_pct", f"SELECT {_D}, instrument, {r6('r / n')} AS score FROM (SELECT *, {_AR('score', 'date')} AS r, count(score) OVER (PARTITION BY date) AS n FROM scored)", lambda s: crosssection.rank_pct(s, ["score"]).select("date", "instrument", "score"))
_scored_query("xs_zscore_clip", f"SELECT {_D}, instrument, {r6('CASE WHEN score IS NOT NULL THEN CASE WHEN sd > 1e-12 THEN greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (score - m) / sd)) ELSE 0 END END')} AS z FROM (SELECT *, avg(score) OVER (PARTITION BY date) AS m, stddev_pop(score) OVER (PARTITION BY date) AS sd FROM scored)", lambda s: crosssection.zscore_clip(s, "score", "z", 2.0).select("date", "instrument", "z"))
_scored_query("xs_quantile_bins", f"SELECT {_D}, instrument, CAST(greatest(0, least(4, floor(r / n * 5 - 1e-12))) AS BIGINT) AS bin FROM (SELECT *, {_AR('score', 'date')} AS r, count(score) OVER (PARTITION BY date) AS n FROM scored) WHERE score IS NOT NULL", lambda s: s.where("score IS NOT NULL").select("date", "instrument", crosssection.quantile_bin(F.col("score"), 5, "date").alias("bin")))
_scored_query("industry_excess_label", f"SELECT {_D}, instrument, {r6('label - m - 0.0012345678')} AS label FROM (SELECT *, avg(label) OVER (PARTITION BY date, industry) AS m FROM scored)", lambda s: labels.industry_excess(s, threshold=0.0012345678).select("date", "instrument", "label"))
_scored_query("industry_neutral_feature", f"SELECT {_D}, instrument, {r6('(score - coalesce(m, 0)) / 7.1234567')} AS score FROM (SELECT *, avg(score) OVER (PARTITION BY date, industry) AS m FROM scored)", lambda s: labels.neutral(s, ["score"]).select("date", "instrument", (F.col("score") / 7.1234567).alias("score")))
_scored_query(
    "benchmark_excess_label",
    f", b AS (SELECT date, avg(ret) AS ret FROM scored GROUP BY date HAVING avg(ret) IS NOT NULL), f AS (SELECT date, CASE WHEN count(ret) OVER w = 2 THEN product(1 + ret) OVER w - 1 END AS fwd FROM b WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) SELECT CAST(s.date AS VARCHAR) AS date, instrument, {r6('label - fwd - 0.002')} AS label FROM scored s LEFT JOIN f USING (date)",
    lambda s: labels.benchmark_excess(s, labels.cross_section_benchmark(s, "ret"), 2, threshold=0.002).select("date", "instrument", "label"),
)
_scored_query("label_xs_rank", f"SELECT {_D}, instrument, {r6('CASE WHEN label IS NOT NULL THEN CASE WHEN n > 1 THEN (r - 1) / (n - 1) - 0.5 ELSE 0 END END')} AS label FROM (SELECT *, {_AR('label', 'date')} AS r, count(label) OVER (PARTITION BY date) AS n FROM scored)", lambda s: labels.cross_section_rank(s).select("date", "instrument", "label"))
_scored_query(
    "label_profit_tanh",
    f", m AS (SELECT date, median(label) AS m, stddev_pop(label) AS sd, median(abs(label)) AS sz FROM scored GROUP BY date), d AS (SELECT date, 1.4826 * median(abs(label - m)) AS mad FROM scored JOIN m USING (date) GROUP BY date) SELECT CAST(s.date AS VARCHAR) AS date, instrument, {r6('tanh(sign(label) * greatest(abs(label) - 0.05::DOUBLE, 0.0::DOUBLE) / ((CASE WHEN mad >= 0.3 THEN mad WHEN sd >= 0.3 THEN sd WHEN sz >= 0.3 THEN sz ELSE 0.3 END) * 1.5))')} AS label FROM scored s JOIN m USING (date) JOIN d USING (date)",
    lambda s: labels.profit_tanh(s, band=0.05, multiplier=1.5, least=0.3).select("date", "instrument", "label"),
)
# Labels in steps of a twentieth, so that some lie on every bound.
_STEPS = "(round(label * 20) / 20)"
_scored_query(
    "label_profit_bucket",
    f"SELECT {_D}, instrument, CAST(CASE WHEN x IS NULL THEN NULL WHEN x <= -0.5 THEN -2 WHEN x < -0.1 THEN -1 WHEN x >= 0.1 AND x < 0.5 THEN 1 WHEN x >= 0.5 THEN 2 ELSE 0 END AS DOUBLE) AS bucket, CAST(CASE WHEN x > 0.05 THEN 1 WHEN x < -0.05 THEN 0 END AS DOUBLE) AS beyond_margin, CAST(CASE WHEN x > 0 THEN 1 WHEN x IS NOT NULL THEN 0 END AS DOUBLE) AS buyable FROM (SELECT *, {_STEPS} AS x FROM scored)",
    lambda s: s.withColumn("x", F.expr(_STEPS)).select("date", "instrument", labels.profit_bucket(F.col("x"), 0.1, 0.5).alias("bucket"), labels.buyability(F.col("x"), 0.05).alias("beyond_margin"), labels.buyability(F.col("x")).alias("buyable")),
)
_scored_query(
    "sample_weights",
    f", w AS (SELECT *, greatest(1 + power(abs(label) / 0.5, 1.5), 1.2) AS raw FROM scored WHERE label IS NOT NULL), d AS (SELECT *, raw / avg(raw) OVER (PARTITION BY date) AS dw FROM w) SELECT {_D}, instrument, {r6('dw / (SELECT avg(dw) FROM d)')} AS weight FROM d",
    lambda s: labels.opportunity_weights(s.where("label IS NOT NULL"), "label", 0.5, 1.5, 1.2).select("date", "instrument", "weight"),
)
_scored_query(
    "time_decay_weights",
    f", w AS (SELECT *, 0.1 + 0.9 * power(0.5, date_diff('day', date, (SELECT max(date) FROM scored)) / 365.0::DOUBLE) AS raw FROM scored) SELECT {_D}, instrument, {r6('raw / (SELECT avg(raw) FROM w)')} AS weight FROM w",
    lambda s: labels.decay_weights(s, 365, 0.1).select("date", "instrument", "weight"),
)
_scored_query(
    "ranking_relevance",
    f"SELECT {_D}, instrument, CAST(CASE WHEN x IS NULL OR n <= 1 OR lo = hi THEN 0 ELSE least(4, greatest(0, floor((r - 1) * 5 / n + 1e-8))) END AS BIGINT) AS relevance FROM (SELECT *, {_AR('x', 'date')} AS r, count(x) OVER (PARTITION BY date) AS n, min(x) OVER (PARTITION BY date) AS lo, max(x) OVER (PARTITION BY date) AS hi FROM (SELECT *, CAST(label AS FLOAT) AS x FROM scored))",
    lambda s: labels.relevance(s, 5).select("date", "instrument", "relevance"),
)
_scored_query("ranking_groups", f"SELECT {_D}, count(*) AS size FROM scored WHERE label IS NOT NULL GROUP BY date", lambda s: labels.group_sizes(s.where("label IS NOT NULL")))
_scored_query(
    "opportunity_label",
    f", e AS (SELECT *, label IS NOT NULL AS ok FROM scored) SELECT {_D}, instrument, {r6('label - m - 0.0123456789')} AS edge, CAST(CASE WHEN label - m - 0.0123456789 > 0 THEN 1 WHEN label - m - 0.0123456789 <= 0 THEN 0 END AS DOUBLE) AS opportunity FROM (SELECT *, avg(label) FILTER (ok) OVER (PARTITION BY date, industry) AS m FROM e)",
    lambda s: training.with_edge(s, "industry_excess", 0.0123456789, ["score", "score2"]).select("date", "instrument", "edge", labels.opportunity_label(F.col("edge")).alias("opportunity")),
)
_scored_query(
    "opportunity_edges",
    f", b AS (SELECT date, avg(ret) AS ret FROM scored GROUP BY date HAVING avg(ret) IS NOT NULL), f AS (SELECT date, CASE WHEN count(ret) OVER w = 2 THEN product(1 + ret) OVER w - 1 END AS fwd FROM b WINDOW w AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) SELECT CAST(s.date AS VARCHAR) AS date, instrument, {r6('label')} AS positive, {r6('(label - 0.01)')} AS threshold, {r6('(label - fwd - 0.01)')} AS benchmark FROM scored s LEFT JOIN f USING (date)",
    lambda s: training.with_edge(training.with_edge(training.with_edge(s, "positive", out="positive"), "threshold", 0.01, out="threshold"), "benchmark_excess", 0.01, benchmark=labels.forward_compound(labels.cross_section_benchmark(s, "ret"), 2), out="benchmark").select("date", "instrument", "positive", "threshold", "benchmark"),
)


@registered("SELECT CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_date, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_date, count(*) AS rows FROM lineitem")
def footer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date, and the rows, of a store by the footers of its files."""
    path = f"{sf_dir}/lineitem.parquet"
    found = stores.date_range(spark, path, "l_shipdate")
    return stores.layout(spark, path).agg(F.lit(found[0][:10]).alias("first_date"), F.lit(found[1][:10]).alias("last_date"), F.sum("rows").alias("rows"))
