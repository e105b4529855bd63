"""Queries over the smaller operators: cleaning, filters, universes, alignment, curves and streams read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, collect, crosssection, diagnostics, joins, labels, risk, training
from ..sources import panels
from ..streaming import panels as streams
from .frames import SCORED_SQL, avg_rank_sql, r6, scored, text_date
from .panel_queries import doubles

QUERIES: dict = {}
ORACLES: dict = {}


def registered(sql: str | None = None, ctes: str = ""):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_totalprice AS DOUBLE) END AS value FROM orders")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text, some with blanks around them, some that are no numbers."""
    k, x = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    text = F.when(k % 5 < 2, x).when(k % 5 == 2, F.concat(F.lit(" "), x, F.lit(" "))).when(k % 5 == 3, "n/a").otherwise("nan")
    return _table(spark, sf_dir, "orders").select("o_orderkey", collect.numeric(text).alias("value"))


_CODES = "codes AS (SELECT c_custkey, lpad(CAST(((ARRAY[600, 601, 603, 605, 688, 0, 1, 2, 3, 300, 301, 900, 200])[1 + c_custkey % 13]) * 1000 + c_custkey % 1000 AS VARCHAR), 6, '0') AS code FROM customer)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    head = F.get(F.array(*(F.lit(x) for x in (600, 601, 603, 605, 688, 0, 1, 2, 3, 300, 301, 900, 200))), (k % 13).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.lpad((head * 1000 + k % 1000).cast("string"), 6, "0").alias("code"))


@registered("SELECT c_custkey, code FROM codes WHERE substr(code, 1, 3) NOT IN ('900', '200')", _CODES)
def share_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _codes(spark, sf_dir)
    return c.where(batches.shares(F.col("code")))


@registered("SELECT c_custkey, code || CASE WHEN code LIKE '6%' THEN '.SH' ELSE '.SZ' END AS listed FROM codes WHERE substr(code, 1, 3) NOT IN ('900', '200')", _CODES)
def exchange_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_symbols(spark, sf_dir).select("c_custkey", collect.exchange_code(F.concat(F.lit("x"), F.col("code"))).alias("listed"))


_GAPS = "gaps AS (SELECT *, CASE WHEN CAST(symbol AS BIGINT) % 4 = 0 AND score > 0.5 THEN CAST('Infinity' AS DOUBLE) ELSE score END AS f FROM scored)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("f", F.when((F.col("symbol").cast("long") % 4 == 0) & (F.col("score") > 0.5), F.lit(float("inf"))).otherwise(F.col("score")))


@registered(f"SELECT CAST(date AS VARCHAR) AS date, symbol, {r6('score2')} AS score2 FROM gaps WHERE label IS NOT NULL AND (f IS NULL OR f < CAST('Infinity' AS DOUBLE))", f"{SCORED_SQL}, {_GAPS}")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a label whose features are finite or missing."""
    return doubles(training.trainable(_gaps(spark, sf_dir), ["f", "score2"]).select("date", "symbol", "score2"))


@registered(f"SELECT CAST(date AS VARCHAR) AS date, symbol, {r6('score2')} AS score2 FROM gaps WHERE f IS NULL OR f < CAST('Infinity' AS DOUBLE)", f"{SCORED_SQL}, {_GAPS}")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(training.predictable(_gaps(spark, sf_dir), ["f", "score2"]).select("date", "symbol", "score2"))


@registered("SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN '2005-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start, CASE WHEN o_orderkey % 2 = 0 THEN '2099-12-31' ELSE CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) END AS \"end\" FROM orders")
def universe_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe records with open starts and ends, out of columns of other names."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("code"), F.when(k % 3 > 0, F.date_format(day, "yyyyMMdd")).alias("in_date"), F.when(k % 2 > 0, F.date_format(F.date_add(day, 30), "yyyy-MM-dd")).alias("out_date"))
    return text_date(collect.universe_records(o, ["symbol", "code"], ["start", "in_date"], ["end", "out_date"]), "start", "end")


_VALUED = f"{panels.SIGNALS_SQL}, v AS (SELECT symbol, date, close * 2 AS close, pe, pb FROM panel WHERE month(date) % 2 = 0), d AS (SELECT symbol, date, CASE WHEN day(date) = 1 AND month(date) % 4 > 0 THEN close END AS close FROM panel)"


@registered(f"SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, {r6('coalesce(d.close, v.close) / 7.1234567')} AS close, {r6('pe')} AS pe, {r6('pb')} AS pb FROM d LEFT JOIN v USING (symbol, date)", _VALUED)
def daily_with_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily calendar stays, missing closes come from the valuation."""
    p = panels.signal_panel(spark, sf_dir)
    daily = p.select("symbol", "date", F.when(F.month("date") % 4 > 0, F.col("close")).alias("close"))
    made = collect.with_valuation(daily, p.where(F.month("date") % 2 == 0).select("symbol", "date", (F.col("close") * 2).alias("close"), "pe", "pb"))
    return doubles(made.withColumn("close", F.col("close") / 7.1234567))


@registered("SELECT CAST(c_custkey AS VARCHAR) AS symbol, n_name AS missing, coalesce(n_name, 'UNKNOWN') AS unknown, coalesce(n_name, 'own:' || CAST(c_custkey AS VARCHAR)) AS own FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) n ON n_nationkey = c_nationkey")
def symbol_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways with unmapped symbols."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation").where("n_regionkey > 0")
    symbols = c.select(F.col("c_custkey").cast("string").alias("symbol"))
    known = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").cast("string").alias("symbol"), F.col("n_name").alias("industry"))
    out = symbols
    for policy in ("missing", "unknown", "own"):
        out = out.join(joins.with_industry(symbols, known, policy).withColumnRenamed("industry", policy), "symbol")
    return out


@registered(f"SELECT CAST(date AS VARCHAR) AS date, {r6('coalesce(ret, 0) / 7.1234567')} AS ret FROM (SELECT DISTINCT date FROM scored) LEFT JOIN (SELECT date, avg(ret) AS ret FROM scored WHERE month(date) <> 6 GROUP BY date HAVING avg(ret) IS NOT NULL) USING (date)", SCORED_SQL)
def benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates with the cross-section's mean return, 0 where there is none."""
    s = scored(spark, sf_dir)
    made = joins.aligned(s.select("date").distinct(), labels.cross_section_benchmark(s.where("month(date) <> 6"), "ret"), "ret")
    return doubles(made.withColumn("ret", F.col("ret") / 7.1234567))


@registered("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) - (SELECT min(p_size) FROM part WHERE p_partkey % 10 > 0) END AS relevance FROM part")
def direct_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, F.col("p_size").cast("double")).alias("label"))
    return labels.direct_relevance(p).select("p_partkey", "relevance")


@registered(f"SELECT CAST(date AS VARCHAR) AS date, instrument, {r6('r / n')} AS rank_pct, {r6('CASE WHEN score IS NOT NULL THEN CASE WHEN sd > 1e-12 THEN greatest(-1.5::DOUBLE, least(1.5::DOUBLE, (score - m) / sd)) ELSE 0 END END')} AS zscore, {r6('score')} AS plain FROM (SELECT *, {avg_rank_sql('score', 'date')} AS r, count(score) OVER (PARTITION BY date) AS n, avg(score) OVER (PARTITION BY date) AS m, stddev_pop(score) OVER (PARTITION BY date) AS sd FROM scored)", SCORED_SQL)
def score_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("date", "instrument", "score")
    made = [crosssection.transformed(s, mode, clip=1.5).withColumnRenamed("score", name) for mode, name in (("rank_pct", "rank_pct"), ("zscore_clip", "zscore"), ("none", "plain"))]
    return doubles(made[0].join(made[1], ["date", "instrument"]).join(made[2], ["date", "instrument"]))


_SIG = lambda x: f"1 / (1 + exp(-8 * ({x} - 0.4::DOUBLE)))"


@registered(f"SELECT p_partkey, {r6('x')} AS linear, {r6('x * x * x')} AS convex, {r6('1 - power(1 - x, 3)')} AS concave, {r6(f'''({_SIG('x')} - {_SIG('0.0::DOUBLE')}) / ({_SIG('1.0::DOUBLE')} - {_SIG('0.0::DOUBLE')})''')} AS sigmoid FROM (SELECT p_partkey, (p_partkey % 101) / 100.0::DOUBLE AS x FROM part)")
def risk_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("p_partkey") % 101) / 100
    made = _table(spark, sf_dir, "part").select("p_partkey", *(risk.Curve(k, 3.0, 8.0, 0.4).of(x).alias(k) for k in ("linear", "convex", "concave", "sigmoid")))
    return made.select("p_partkey", *((F.round(k, 6) + 0.0).alias(k) for k in ("linear", "convex", "concave", "sigmoid")))


@registered("SELECT s.symbol FROM (SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_custkey AS k FROM customer) s LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS symbol, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) m USING (symbol) WHERE k % 7 > 0 AND (d IS NULL OR d < CASE WHEN k % 2 = 0 THEN DATE '1997-06-30' ELSE DATE '1998-06-30' END)")
def pending_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose stored data ends before their effective end; each seventh isn't listed yet."""
    k = F.col("c_custkey")
    symbols = _table(spark, sf_dir, "customer").select(k.cast("string").alias("symbol"), F.when(k % 7 == 0, "not_yet_listed").otherwise("active").alias("status"), F.when(k % 2 == 0, F.lit("1997-06-30")).otherwise("1998-06-30").cast("date").alias("effective_end"))
    stored = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.max(F.to_date("o_orderdate")).alias("max_date"))
    return collect.pending(symbols, stored, F.lit("1998-06-30").cast("date")).select("symbol")


@registered("SELECT CAST(date AS VARCHAR) AS date, instrument, count(*) OVER (PARTITION BY date, instrument) AS n FROM scored", SCORED_SQL)
def unique_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores, if no date and instrument stands twice."""
    return text_date(batches.unique_pairs(scored(spark, sf_dir).select("date", "instrument")).withColumn("n", F.lit(1).cast("long")))


@registered(f"SELECT feature, n, row_number() OVER (ORDER BY n DESC, feature) AS place FROM (SELECT 'score' AS feature, count(score) AS n FROM scored UNION ALL SELECT 'score2', count(score2) FROM scored UNION ALL SELECT 'score3', count(score3) FROM scored) ORDER BY n DESC, feature LIMIT 2", SCORED_SQL)
def topped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features that are known best."""
    from pyspark.sql import Window

    counts = diagnostics.long_form(scored(spark, sf_dir), ["score", "score2", "score3"]).groupBy("feature").agg(F.count("x").alias("n"))
    ranked = counts.select("feature", "n", *(F.col("n").cast("double").alias(c) for c in ("rank_ic_abs_mean", "rank_ic_ir_abs", "coverage_pct")))
    return diagnostics.topped(ranked, 2).select("feature", "n", F.row_number().over(Window.orderBy(F.desc("n"), "feature")).cast("long").alias("place"))


@registered("SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY user_id, date_trunc('day', ts)")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's bars, with the table of events read as a whole."""
    return streams.bars(_table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd")).withColumnRenamed("start", "day")


@registered("""SELECT user_id, count(*) AS events, CAST(floor(epoch(min(ts))) AS BIGINT) AS started FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's sessions, with the table of events read as a whole."""
    return streams.sessions(_table(spark, sf_dir, "events")).select("user_id", "events", F.unix_timestamp("start").alias("started"))
