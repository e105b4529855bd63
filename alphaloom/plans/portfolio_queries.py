"""Queries over fusion, risk schedules, simulation, metrics, experiments and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, compare, crosssection, experiment, fusion, joins, metrics, risk, simulate
from .frames import SCORED_SQL, avg_rank_sql, r6, scored
from .panel_queries import doubles

QUERIES: dict = {}
ORACLES: dict = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SCORED_SQL} {sql}"
        return f

    return put


_D = "CAST(date AS VARCHAR) AS date"
_PAIRS = ", p AS (SELECT date, instrument, score AS a, score2 AS b FROM scored WHERE score IS NOT NULL AND score2 IS NOT NULL)"


def _two(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both scores; each is missing where its look-back is, on other rows than the other's."""
    return s.select("date", "instrument", "score"), s.select("date", "instrument", F.col("score2").alias("score"))


@registered(f"{_PAIRS} SELECT {_D}, instrument, {r6('(ra / n) * (rb / n)')} AS score FROM (SELECT *, {avg_rank_sql('a', 'date')} AS ra, {avg_rank_sql('b', 'date')} AS rb, count(*) OVER (PARTITION BY date) AS n FROM p)")
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(fusion.fuse(*_two(scored(spark, sf_dir)), "multiply", ("rank_pct", "rank_pct")))


@registered(f"{_PAIRS} SELECT {_D}, instrument, {r6('0.7 * a + 0.3 * sign(b) * power(abs(b), 2.0)')} AS score FROM p")
def score_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(fusion.fuse(*_two(scored(spark, sf_dir)), "blend", power=(1.0, 2.0), weight=0.3))


@registered(f"{_PAIRS} SELECT {_D}, instrument, {r6('a')} AS score FROM (SELECT *, {avg_rank_sql('b', 'date')} / count(*) OVER (PARTITION BY date) AS rb FROM p) WHERE rb >= 0.5")
def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(fusion.fuse(*_two(scored(spark, sf_dir)), "filter", ("raw", "rank_pct"), least=0.5))


_STRENGTH = ", st AS (SELECT date, avg(v) FILTER (p <= 3) AS topk_mean, coalesce(sum(v) FILTER (p <= 3), 0) AS topk_sum, max(v) AS top1 FROM (SELECT date, v, row_number() OVER (PARTITION BY date ORDER BY v DESC NULLS LAST) AS p FROM (SELECT date, CASE WHEN score > 0.1 THEN score END AS v FROM scored)) GROUP BY date)"


@registered(f"{_STRENGTH} SELECT {_D}, {r6('topk_mean / 7.1234567')} AS topk_mean, {r6('topk_sum')} AS topk_sum, {r6('top1')} AS top1 FROM st")
def signal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    parts = [crosssection.signal_strength(s, m, 3, 0.1).withColumnRenamed("signal", m) for m in ("topk_mean", "topk_sum", "top1")]
    return doubles(parts[0].join(parts[1], "date").join(parts[2], "date").withColumn("topk_mean", F.col("topk_mean") / 7.1234567))


@registered(f"""{_STRENGTH}, h AS (SELECT date, round(topk_mean, 6) AS s FROM st), q AS (SELECT date, s, coalesce(quantile_cont(s, 0.2) OVER w, 0.5) AS a, coalesce(quantile_cont(s, 0.8) OVER w, 2.0) AS b FROM h WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT date, s, CASE WHEN b > a THEN a ELSE 0.5 END AS a, CASE WHEN b > a THEN b ELSE 2.0 END AS b FROM q)
SELECT {_D}, {r6('0.2 + power(CASE WHEN s IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (s - a) / (b - a))) END, 2.0) * 0.7')} AS risk FROM t""")
def expanding_quantile_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = crosssection.signal_strength(scored(spark, sf_dir), "topk_mean", 3, 0.1).withColumn("signal", F.round("signal", 6))
    return doubles(risk.signal_schedule(signals, 0.5, 2.0, 0.2, 0.9, (0.2, 0.8), risk.Curve("convex", 2.0)).select("date", "risk"))


_BENCH = ", b AS (SELECT date, round(median(ret), 6) AS ret FROM scored GROUP BY date)"


def _bench(s: DataFrame) -> DataFrame:
    return s.groupBy("date").agg(F.round(F.percentile("ret", F.lit(0.5)), 6).alias("ret"))


@registered(f"""{_BENCH}, n AS (SELECT date, exp(sum(ln(1 + coalesce(ret, 0))) OVER (ORDER BY date)) AS nav FROM b), m AS (SELECT *, avg(nav) OVER (ORDER BY date ROWS 2 PRECEDING) AS f, avg(nav) OVER (ORDER BY date ROWS 8 PRECEDING) AS s, min(date) OVER () AS d0 FROM n)
SELECT {_D}, coalesce(lag(CASE WHEN date = d0 THEN 0.95 WHEN nav >= f THEN 0.95 WHEN nav >= s THEN 0.6 ELSE 0.3 END) OVER (ORDER BY date), 0.5)::DOUBLE AS risk FROM m""")
def benchmark_ma_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(risk.benchmark_schedule(_bench(scored(spark, sf_dir)), 3, 9, 0.95, 0.6, 0.3, 0.5))


@registered(f"SELECT {_D}, instrument, coalesce(n = 6 AND close < m, false) AS confirmed FROM (SELECT *, count(close) OVER w AS n, avg(close) OVER w AS m FROM scored WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS 5 PRECEDING))")
def price_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(risk.price_confirm(scored(spark, sf_dir), 6))


@registered(f"SELECT {_D}, instrument, CAST(p AS INTEGER) AS place, {r6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument) AS p FROM scored WHERE score IS NOT NULL) WHERE p <= 10")
def topk_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(crosssection.top_k(scored(spark, sf_dir), 10).select("date", "instrument", "place", "score"))


# ---- runs: equal-weighted daily top-k returns as two strategies, whose figures are compared

_RUNS_SQL = """, runs AS (SELECT run, date, avg(r) AS net_return, avg(r) + 0.001 AS gross_return, count(*) / 20.0::DOUBLE AS turnover, 1000.0::DOUBLE * count(*) AS account_value, list(instrument ORDER BY instrument) AS held FROM (
  SELECT 'a' AS run, date, instrument, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, coalesce(ret, 0))) AS r, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument) AS p FROM scored WHERE score IS NOT NULL
  UNION ALL SELECT 'b', date, instrument, greatest(-0.3::DOUBLE, least(0.3::DOUBLE, coalesce(ret, 0))), row_number() OVER (PARTITION BY date ORDER BY score3, instrument) FROM scored WHERE score3 IS NOT NULL) WHERE p <= CASE run WHEN 'a' THEN 10 ELSE 7 END GROUP BY run, date)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    up = s.withColumn("score", -F.col("score3"))
    r = F.greatest(F.lit(-0.3), F.least(F.lit(0.3), F.coalesce("ret", F.lit(0.0))))
    parts = [crosssection.top_k(f, k).select(F.lit(n).alias("run"), "date", "instrument", r.alias("r")) for n, f, k in (("a", s, 10), ("b", up, 7))]
    agg = parts[0].union(parts[1]).groupBy("run", "date").agg(F.avg("r").alias("net_return"), F.count("*").alias("n"), F.sort_array(F.collect_list("instrument")).alias("held"))
    return agg.select("run", "date", "net_return", (F.col("net_return") + 0.001).alias("gross_return"), (F.col("n") / 20).alias("turnover"), (1000.0 * F.col("n")).alias("account_value"), "held")


_NAV = ", nv AS (SELECT *, product(1 + net_return) OVER (PARTITION BY run ORDER BY date) AS nav FROM runs), dd AS (SELECT *, greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY run ORDER BY date)) AS peak FROM nv)"


@registered(f"""{_RUNS_SQL}{_NAV} SELECT run, count(net_return) AS trading_days, {r6('product(1 + net_return) - 1')} AS total_return, {r6('avg(net_return) * 242')} AS annualized_return, {r6('stddev_samp(net_return) * sqrt(242)')} AS annualized_volatility,
{r6('avg(net_return) * 242 / (stddev_samp(net_return) * sqrt(242))')} AS sharpe_ratio, {r6('min(least(0, nav / peak - 1))')} AS max_drawdown, {r6('avg(CAST(net_return > 0 AS INTEGER))')} AS win_rate, {r6('avg(turnover)')} AS avg_turnover, {r6('arg_max(account_value, date)')} AS final_account_value FROM dd GROUP BY run""")
def portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.portfolio(runs(spark, sf_dir)))


@registered(f"{_RUNS_SQL}{_NAV} SELECT run, {_D}, {r6('nav')} AS nav, {r6('nav / peak - 1')} AS drawdown FROM dd")
def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.with_nav(runs(spark, sf_dir)).select("run", "date", "nav", "drawdown"))


@registered(f"{_RUNS_SQL}{_NAV}, lo AS (SELECT run, min(nav / peak - 1) AS max_drawdown, arg_min(date, nav / peak - 1) AS t FROM dd GROUP BY run) SELECT run, {r6('max_drawdown')} AS max_drawdown, CAST((SELECT max(date) FROM dd WHERE dd.run = lo.run AND date <= t AND nav >= peak - 1e-15) AS VARCHAR) AS peak_date, CAST(t AS VARCHAR) AS trough_date FROM lo")
def drawdown_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.drawdown_period(runs(spark, sf_dir)))


@registered(f"{_RUNS_SQL} SELECT run, {_D}, {r6('net_return')} AS net_return, {r6('product(1 + gross_return) OVER w - 1')} AS cumulative_gross, {r6('product(1 + net_return) OVER w - 1')} AS cumulative_net, {r6('coalesce((SELECT b.net_return FROM runs b WHERE b.run = $$b$$ AND b.date = runs.date), 0)')} AS other FROM runs WHERE run = 'a' WINDOW w AS (PARTITION BY run ORDER BY date)".replace("$$b$$", "'b'"))
def daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    made = metrics.daily_report(r.where("run = 'a'"), {"other": r.where("run = 'b'")})
    return doubles(made.select("run", "date", "net_return", "cumulative_gross", "cumulative_net", "other"))


@registered(f"{_RUNS_SQL} SELECT run, CAST(last_day(date) AS VARCHAR) AS month, {r6('product(1 + net_return) - 1')} AS ret, count(*) AS days FROM runs GROUP BY run, last_day(date)")
def monthly_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.by_month(runs(spark, sf_dir)))


@registered(f"{_RUNS_SQL} SELECT run, year(date) AS year, {r6('product(1 + net_return) - 1')} AS ret, count(*) AS days FROM runs GROUP BY run, year(date)")
def yearly_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.by_year(runs(spark, sf_dir)))


_REB = ", rb AS (SELECT run, CAST(floor((p - 1) / 4) AS BIGINT) AS block, min(date) AS period_start, max(date) AS period_end, product(1 + net_return) - 1 AS ret FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY date) AS p FROM runs) GROUP BY run, floor((p - 1) / 4))"


@registered(f"{_RUNS_SQL}{_REB} SELECT run, block, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, {r6('ret')} AS ret FROM rb")
def rebalance_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.by_rebalance(runs(spark, sf_dir), 4))


@registered(f"{_RUNS_SQL}, m AS (SELECT run, last_day(date) AS month, product(1 + net_return) - 1 AS ret FROM runs GROUP BY run, last_day(date)), p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ret DESC, month) AS p FROM m) SELECT run, {r6('sum(greatest(ret, 0)) FILTER (p <= 3) / sum(greatest(ret, 0))')} AS top3_positive_share, {r6('sum(greatest(ret, 0)) FILTER (p <= 5) / sum(greatest(ret, 0))')} AS top5_positive_share, {r6('sum(ret) FILTER (p <= 3) / sum(ret)')} AS top3_total_share, {r6('sum(ret) FILTER (p <= 5) / sum(ret)')} AS top5_total_share FROM p GROUP BY run")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(metrics.concentration(metrics.by_month(runs(spark, sf_dir))))


_BUCKETS = f", k AS (SELECT *, {avg_rank_sql('score', 'date')} AS r, count(*) OVER (PARTITION BY date) AS c FROM scored WHERE score IS NOT NULL AND label IS NOT NULL), b AS (SELECT 10 - CAST(greatest(0, least(9, floor(r / c * 10 - 1e-12))) AS BIGINT) AS bucket, label FROM k), sb AS (SELECT bucket, avg(label) AS v FROM b GROUP BY bucket)"


@registered(f"""{_BUCKETS}, r AS (SELECT *, rank() OVER (ORDER BY v) AS vr, rank() OVER (ORDER BY v DESC) AS pl FROM sb), t AS (SELECT max(v) FILTER (bucket = 1) AS top, max(v) FILTER (bucket = 10) AS bottom, avg(v) FILTER (bucket BETWEEN 3 AND 7) AS m, max(v) FILTER (bucket BETWEEN 3 AND 7) AS mb, max(v) AS hi, min(v) AS lo,
arg_max(bucket, v) AS best, arg_min(bucket, v) AS worst, max(pl) FILTER (bucket = 1) AS place, covar_pop(bucket, vr) / (stddev_pop(bucket) * stddev_pop(vr)) AS rho FROM r)
SELECT CAST(1 AS BIGINT) AS top_bucket, CAST(10 AS BIGINT) AS bottom_bucket, {', '.join(f'{r6(x)} AS {n}' for n, x in (('top_label_mean', 'top'), ('bottom_label_mean', 'bottom'), ('top_minus_bottom', '(top - bottom)'), ('middle_label_mean', 'm'), ('middle_best_label_mean', 'mb'), ('top_minus_middle_mean', '(top - m)'), ('top_minus_middle_best', '(top - mb)'), ('best_bucket_label_mean', 'hi'), ('worst_bucket_label_mean', 'lo'), ('bucket_label_spearman', 'rho')))},
best AS best_bucket, worst AS worst_bucket, place AS top_bucket_label_rank FROM t""")
def bucket_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = compare.score_buckets(scored(spark, sf_dir).withColumn("run", F.lit("a")))
    return doubles(compare.bucket_shape(b).drop("run"))


@registered(f"{_RUNS_SQL}{_REB}, k AS (SELECT *, lag(ret) OVER (PARTITION BY run ORDER BY block) AS metric FROM rb), p AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY metric, period_start) - 1 AS p FROM k WHERE metric IS NOT NULL) SELECT run, CASE WHEN p < floor(n / 3) THEN 'low' WHEN p < 2 * floor(n / 3) THEN 'mid' ELSE 'high' END AS bin, count(*) AS n, CAST(count(*) FILTER (ret > 0) AS BIGINT) AS positive_count, {r6('count(*) FILTER (ret > 0) / count(*)')} AS positive_rate, {r6('avg(metric)')} AS metric_mean, {r6('avg(ret)')} AS ret_mean FROM p WHERE n >= 9 GROUP BY 1, 2")
def validation_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    blocks = metrics.by_rebalance(runs(spark, sf_dir), 4).withColumn("metric", F.lag("ret").over(Window.partitionBy("run").orderBy("block")))
    return doubles(compare.validation_terciles(blocks))


_IMP_SQL = ", im AS (SELECT CAST(p_partkey % 60 AS VARCHAR) AS feature, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS run, sum(CAST(p_size AS BIGINT))::DOUBLE AS importance FROM part GROUP BY 1, 2)"


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.groupBy((F.col("p_partkey") % 60).cast("string").alias("feature"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("run")).agg(F.sum("p_size").cast("double").alias("importance"))


@registered(f"{_IMP_SQL}, j AS (SELECT coalesce(x.feature, y.feature) AS feature, coalesce(x.importance, 0) AS a, coalesce(y.importance, 0) AS b FROM (SELECT * FROM im WHERE run = 'a') x FULL JOIN (SELECT * FROM im WHERE run = 'b') y ON x.feature = y.feature) SELECT feature, a, b, rank() OVER (ORDER BY a DESC) AS rank_a, rank() OVER (ORDER BY b DESC) AS rank_b, a - b AS difference FROM j")
def importance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = _importance(spark, sf_dir)
    return compare.importance_compare(im.where("run = 'a'"), im.where("run = 'b'"))


_FAMILY_SQL = "CASE WHEN p_name LIKE 'TS_stock_vs_industry_%' THEN 'ts_stock_vs_industry' WHEN p_name LIKE 'TS_industry_%' THEN 'ts_industry_state' WHEN p_name LIKE '%_minus_industry' THEN 'ts_relative_value_quality' WHEN starts_with(p_name, 'TS_dividend') OR starts_with(p_name, 'TS_bp') OR starts_with(p_name, 'TS_sp') OR starts_with(p_name, 'TS_ep') THEN 'ts_valuation' WHEN contains(p_name, 'amihud') OR contains(p_name, 'turnover') THEN 'liquidity' WHEN starts_with(p_name, 'LGBM_') THEN 'lgbm' WHEN starts_with(p_name, 'TEMP_') THEN 'temporal' WHEN starts_with(p_name, 'TECH_') THEN 'technical' ELSE 'other' END"
#: Feature names that the parts of the synthetic table stand for.
_NAMES = ["TS_stock_vs_industry_ret_5", "TS_industry_ret_20", "TS_bp_minus_industry", "TS_bp_ttm", "TS_dividend_z", "TS_turnover_gap", "LGBM_amihud_20", "LGBM_ret_20", "TEMP_std_60", "TECH_rsi_6", "KMID", "TS_sem_value"]
_NAMED_SQL = f", nm AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS run, ({_NAMES!r})[1 + CAST(p_partkey % {len(_NAMES)} AS INTEGER)] AS p_name, p_size FROM part)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(k % 2 == 0, "a").otherwise("b").alias("run"), F.get(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES)).cast("int")).alias("feature"), F.col("p_size").cast("double").alias("importance"))


@registered(f"{_NAMED_SQL} SELECT run, family, importance, {r6('importance / sum(importance) OVER (PARTITION BY run)')} AS share FROM (SELECT run, {_FAMILY_SQL} AS family, sum(CAST(p_size AS BIGINT))::DOUBLE AS importance FROM nm GROUP BY 1, 2)")
def family_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(compare.family_shares(_named(spark, sf_dir), compare.feature_family(F.col("feature"))))


_GROUPS = {"TS_stock_vs_industry_ret_5": "tushare_industry", "TS_industry_ret_20": "tushare_industry", "TS_bp_minus_industry": "tushare_valuation_dividend", "TS_bp_ttm": "tushare_valuation_dividend", "TS_dividend_z": "tushare_valuation_dividend", "TS_turnover_gap": "tushare_flow_liquidity", "LGBM_amihud_20": "lgbm_purified", "LGBM_ret_20": "lgbm_purified", "TEMP_std_60": "temporal", "TECH_rsi_6": "technical", "KMID": "alpha158", "TS_sem_value": "tushare_semantic_alpha"}


@registered(f"{_NAMED_SQL} SELECT p_name AS feature, CASE p_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _GROUPS.items()) + " END AS feature_group, count(*) AS n FROM nm GROUP BY 1, 2")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diagnostics import feature_group

    return _named(spark, sf_dir).groupBy("feature", feature_group(F.col("feature")).alias("feature_group")).agg(F.count("*").alias("n"))


_POOL_SQL = """, f AS (SELECT CAST(c_custkey AS VARCHAR) AS run, c_custkey AS k, CAST(c_acctbal AS DOUBLE) / 10000 AS b FROM customer),
p AS (SELECT *, b AS annualized_return, b * 5 AS sharpe_ratio, -abs(b) / 3 AS max_drawdown, abs(b) AS top5, CASE WHEN k % 9 > 0 THEN b - 0.2 END AS tmb, k % 4 + 1 AS best, k % 3 + 1 AS place, b - 0.5 AS tmm, CASE WHEN k % 11 > 0 THEN b - 0.4 END AS yearly,
  CASE WHEN k % 5 > 0 THEN b / 10 END AS spread, b AS winrate, CASE WHEN k % 6 = 0 THEN b - 0.6 END AS fx, CASE WHEN k % 6 = 0 THEN b END AS fw, CASE WHEN k % 2 = 0 THEN b - 0.7 END AS cx, CASE WHEN k % 2 = 0 THEN b - 0.1 END AS cw FROM f),
g AS (SELECT *, annualized_return >= 0.3 AND sharpe_ratio >= 1.5 AS g1, max_drawdown >= -0.15 AS g2, top5 <= 0.5 AS g3, coalesce(tmb, 0) > 0 AS g4, best <= 2 AND place <= 2 AND tmm >= 0 AS g5, coalesce(yearly >= -0.005, false) AS g6, coalesce(spread, 0) >= 0.01 AND winrate >= 0.6 AS g7,
  fx IS NOT NULL AS hf, fx IS NULL AND cx IS NOT NULL AS hc, coalesce(fx, 0) >= 0 AND coalesce(fw, 0) >= 0.55 AS g8, coalesce(cx, 0) >= 0 AND coalesce(cw, 0) >= 0.55 AS g9 FROM p),
x AS (SELECT *, concat_ws(',', CASE WHEN hf AND NOT g8 THEN 'beats_fixed_risk_rank_avg_factor_baseline' END, CASE WHEN hc AND NOT g9 THEN 'beats_rank_ic_weighted_factor_baseline' END, CASE WHEN NOT g5 THEN 'bucket_calibrated_for_sizing' END, CASE WHEN NOT g4 THEN 'bucket_separates_bad_tail' END, CASE WHEN NOT g3 THEN 'concentration_control' END,
  CASE WHEN NOT g2 THEN 'drawdown_control' END, CASE WHEN NOT g1 THEN 'return_quality' END, CASE WHEN NOT g7 THEN 'validation_metric_supports_risk_gate' END, CASE WHEN NOT g6 THEN 'yearly_bucket_not_inverted' END) AS failed,
  CAST(g1 AS INTEGER) + CAST(g2 AS INTEGER) + CAST(g3 AS INTEGER) + CAST(g4 AS INTEGER) + CAST(g5 AS INTEGER) + CAST(g6 AS INTEGER) + CAST(g7 AS INTEGER) + CAST(hf AND g8 AS INTEGER) + CAST(hc AND g9 AS INTEGER) AS passed, 7 + CAST(hf AS INTEGER) + CAST(hc AS INTEGER) AS total FROM g)"""


@registered(f"""{_POOL_SQL} SELECT run, CASE WHEN NOT g1 THEN 'research_archive' WHEN (hf AND NOT g8) OR (hc AND NOT g9) THEN 'portfolio_candidate_requires_router' WHEN g5 AND g7 THEN 'ranker_and_sizer' WHEN g4 AND g7 THEN 'pool_selector_with_validation_gate' WHEN g4 THEN 'pool_selector_only' ELSE 'portfolio_candidate_requires_router' END AS candidate_role,
CAST(passed AS BIGINT) AS passed_count, CAST(total AS BIGINT) AS total_count, failed AS failed_gates FROM x""")
def candidate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for runs, whose figures lie on both sides of every bound."""
    b, k = F.col("c_acctbal").cast("double") / 10000, F.col("c_custkey")
    given = {
        "annualized_return": b, "sharpe_ratio": b * 5, "max_drawdown": -F.abs(b) / 3, "top5_positive_share": F.abs(b), "top_minus_bottom": F.when(k % 9 > 0, b - 0.2), "best_bucket": k % 4 + 1, "top_bucket_label_rank": k % 3 + 1,
        "top_minus_middle_best": b - 0.5, "min_yearly_top_minus_bottom": F.when(k % 11 > 0, b - 0.4), "high_low_return_spread": F.when(k % 5 > 0, b / 10), "high_positive_rebalance_rate": b,
        "fixed_risk_rank_avg_factor_baseline_excess": F.when(k % 6 == 0, b - 0.6), "fixed_risk_rank_avg_factor_baseline_win": F.when(k % 6 == 0, b),
        "rank_ic_weighted_factor_baseline_excess": F.when(k % 2 == 0, b - 0.7), "rank_ic_weighted_factor_baseline_win": F.when(k % 2 == 0, b - 0.1),
    }
    return compare.promotion(spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("run"), *(v.alias(n) for n, v in given.items())))


@registered(f"{_RUNS_SQL}, s AS (SELECT x.date, x.held AS h, y.held AS g FROM runs x JOIN runs y USING (date) WHERE x.run = 'a' AND y.run = 'b'), c AS (SELECT date, len(list_intersect(h, g)) AS n_common, len(h) AS nh, len(g) AS ng FROM s) SELECT {_D}, nh + ng - n_common AS n_union, n_common, nh - n_common AS n_only_a, ng - n_common AS n_only_b, {r6('n_common / (nh + ng - n_common)')} AS jaccard FROM c")
def holdings_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return doubles(compare.overlap(r.where("run = 'a'"), r.where("run = 'b'")))


@registered(f"{_RUNS_SQL} SELECT CAST(x.date AS VARCHAR) AS date, {r6('x.net_return')} AS a_net_return, {r6('y.net_return')} AS b_net_return FROM runs x JOIN runs y USING (date) WHERE x.run = 'a' AND y.run = 'b'")
def run_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return doubles(compare.side_by_side({"a": r.where("run = 'a'"), "b": r.where("run = 'b'")}, "date", ["net_return"]))


@registered(f"{_RUNS_SQL}, m AS (SELECT run, avg(net_return) AS mean_return, avg(CAST(net_return > 0 AS INTEGER)) AS win_rate FROM runs GROUP BY run) SELECT run, concat_ws(',', CASE WHEN NOT mean_return >= 0.01 THEN 'mean_return' END, CASE WHEN NOT win_rate >= 0.99 THEN 'win_rate' END) AS failed_gates, mean_return >= 0.01 AND win_rate >= 0.99 AS promoted FROM m")
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = runs(spark, sf_dir).groupBy("run").agg(F.avg("net_return").alias("mean_return"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"))
    return compare.gates(m, {"mean_return": 0.01, "win_rate": 0.99}).select("run", "failed_gates", "promoted")


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric out of JSON documents."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", compare.metric_of(F.col("props"), "k").alias("k"))


@registered("SELECT run, run % 10 AS source_run FROM range(30) t(run)")
def prediction_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that share what determines their predictions use those of the first."""
    table = spark.range(30).select(F.col("id").alias("run"), (F.col("id") % 10).alias("depth"), (F.col("id") % 5).cast("string").alias("features"))
    return experiment.fingerprints(table, ["depth", "features"]).select("run", "source_run")


@registered("SELECT a AS topk, b AS n_drop, c AS weighting FROM (VALUES (5), (10)) x(a), (VALUES (1), (2), (3)) y(b), (VALUES ('equal'), ('rank')) z(c)")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = experiment.grid({}, {"topk": "{5,10}", "n_drop": [1, 2, 3], "weighting": ["equal", "rank"]})
    return spark.createDataFrame([(d["topk"], d["n_drop"], d["weighting"]) for d in g], "topk int, n_drop int, weighting string")


SETTINGS = {
    "equal": simulate.Settings(topk=10, n_drop=3, account=1e6), "rank_capped": simulate.Settings(topk=10, n_drop=3, account=1e6, weighting="rank", max_weight=0.15, max_group_weight=0.4),
    "monthly_exit": simulate.Settings(topk=10, n_drop=5, rebalance_freq=4, account=1e6, transform="rank_pct", exit_threshold=0.3, exit_transform="strategy"),
    "expected_exit": simulate.Settings(topk=10, n_drop=5, rebalance_freq=4, account=1e6, weighting="softmax", exit_mode="expected_return", exit_threshold=0.0, exit_transform="none", exit_min_history=50),
}


@registered()
def simulate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scenarios of the portfolio recurrence side by side (a recurrence of this kind is not a relational query)."""
    s = scored(spark, sf_dir).withColumn("label", F.greatest(F.lit(-0.3), F.least(F.lit(0.3), F.col("label"))))
    b = risk.benchmark_schedule(_bench(s), 3, 9, 0.95, 0.6, 0.3, 0.5)
    rows = s.join(b, "date").select("date", "instrument", "score", "label", "risk", F.hash("industry").cast("double").alias("grp"))
    rows = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, SETTINGS))))
    return doubles(simulate.run_scenarios(rows, SETTINGS))


@registered(f"SELECT CAST(d.date AS VARCHAR) AS date, instrument, {r6('score')} AS score FROM (SELECT DISTINCT date FROM scored) d CROSS JOIN (SELECT DISTINCT instrument FROM scored) i LEFT JOIN scored s USING (date, instrument)")
def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(joins.dense(scored(spark, sf_dir).select("date", "instrument", "score")))


@registered(f"SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT instrument) AS instruments, count(score) AS finite, count(DISTINCT date) * count(DISTINCT instrument) AS cells, count(DISTINCT date) * count(DISTINCT instrument) - count(score) AS missing, {r6('count(score) / (count(DISTINCT date) * count(DISTINCT instrument))')} AS density FROM scored")
def matrix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(batches.matrix_summary(scored(spark, sf_dir)))


@registered(f"SELECT {_D}, instrument, {r6('label')} AS label FROM scored WHERE date IN (SELECT date FROM scored WHERE label IS NOT NULL)")
def labelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(batches.labelled_dates(scored(spark, sf_dir)).select("date", "instrument", "label"))


@registered(f"{_RUNS_SQL}, y AS (SELECT *, year(date) AS year, product(1 + net_return) OVER (PARTITION BY run, year(date) ORDER BY date) AS nav FROM runs), p AS (SELECT *, greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY run, year ORDER BY date)) AS peak FROM y) SELECT run, year, {r6('product(1 + net_return) - 1')} AS ret, {r6('stddev_samp(net_return) * sqrt(242)')} AS volatility, {r6('min(net_return)')} AS worst_day, {r6('min(nav / peak - 1)')} AS max_drawdown FROM p GROUP BY run, year")
def yearly_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(batches.yearly_risk(runs(spark, sf_dir)))


_MONTHS_SQL = ", mm AS (SELECT run, last_day(date) AS month, product(1 + net_return) - 1 AS ret FROM runs GROUP BY run, last_day(date)), mp AS (SELECT month, x.ret AS a, y.ret AS b, x.ret - y.ret AS lead FROM (SELECT * FROM mm WHERE run = 'a') x JOIN (SELECT * FROM mm WHERE run = 'b') y USING (month))"


def _pair(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = runs(spark, sf_dir)
    of = lambda n: {"daily": r.where(f"run = '{n}'"), "monthly": metrics.by_month(r).where(f"run = '{n}'"), "metrics": metrics.portfolio(r).where(f"run = '{n}'")}
    return compare.strategy_pair(of("a"), of("b"), metrics=["total_return", "max_drawdown", "win_rate"])


@registered(f"{_RUNS_SQL}{_MONTHS_SQL} SELECT CAST(month AS VARCHAR) AS month, {r6('a')} AS a_ret, {r6('b')} AS b_ret, {r6('lead')} AS ret_diff FROM mp")
def monthly_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_pair(spark, sf_dir)["monthly"])


@registered(f"{_RUNS_SQL}{_MONTHS_SQL} SELECT year(month) AS year, count(*) AS months, count(*) FILTER (lead > 0) AS months_ahead, {r6('avg(lead)')} AS mean_lead, {r6('min(lead)')} AS worst_lead, {r6('max(lead)')} AS best_lead FROM mp GROUP BY year(month)")
def yearly_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_pair(spark, sf_dir)["yearly"])


@registered(f"{_RUNS_SQL}{_NAV}, f AS (SELECT run, product(1 + net_return) - 1 AS total_return, min(least(0, nav / peak - 1)) AS max_drawdown, avg(CAST(net_return > 0 AS INTEGER))::DOUBLE AS win_rate FROM dd GROUP BY run), l AS (UNPIVOT f ON total_return, max_drawdown, win_rate INTO NAME metric VALUE v) SELECT x.metric, {r6('x.v')} AS a, {r6('y.v')} AS b, {r6('(x.v - y.v)')} AS difference FROM l x JOIN l y USING (metric) WHERE x.run = 'a' AND y.run = 'b'")
def metric_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_pair(spark, sf_dir)["metrics"])


@registered(f"""{_RUNS_SQL}{_REB}, wn AS (SELECT run, period_start, ret, ret - 0.01 AS excess, lag(ret) OVER (PARTITION BY run ORDER BY block) AS valid_topk_excess_mean, -ret AS valid_topk_label_mean FROM rb), lg AS (UNPIVOT wn ON valid_topk_excess_mean, valid_topk_label_mean INTO NAME signal_metric VALUE m),
p AS (SELECT *, count(*) OVER (PARTITION BY run, signal_metric) AS n, row_number() OVER (PARTITION BY run, signal_metric ORDER BY m, period_start) - 1 AS p FROM lg WHERE m IS NOT NULL), hl AS (SELECT run, signal_metric, avg(ret) FILTER (p >= 2 * floor(n / 3)) AS hr, avg(ret) FILTER (p < floor(n / 3)) AS lr, avg(excess) FILTER (p >= 2 * floor(n / 3)) AS he, avg(excess) FILTER (p < floor(n / 3)) AS le, avg(CAST(ret > 0 AS INTEGER)) FILTER (p >= 2 * floor(n / 3)) AS hp, avg(CAST(ret > 0 AS INTEGER)) FILTER (p < floor(n / 3)) AS lp FROM p WHERE n >= 9 GROUP BY run, signal_metric)
SELECT run, signal_metric, {r6('(hr - lr)')} AS high_low_return_spread, {r6('(he - le)')} AS high_low_excess_spread, {r6('hp')} AS high_positive_rebalance_rate, {r6('lp')} AS low_positive_rebalance_rate FROM hl""")
def validation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows with the rebalances that begin on their day, in thirds of two metrics."""
    from pyspark.sql import Window

    blocks = metrics.by_rebalance(runs(spark, sf_dir), 4).withColumn("excess", F.col("ret") - 0.01)
    windows = blocks.select("run", F.col("period_start").alias("window_start"), F.lag("ret").over(Window.partitionBy("run").orderBy("block")).alias("valid_topk_excess_mean"), (-F.col("ret")).alias("valid_topk_label_mean"))
    return doubles(compare.validation_edges(compare.signal_bins(compare.windows_with_rebalances(windows, blocks))))


def _scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("label", F.greatest(F.lit(-0.3), F.least(F.lit(0.3), F.col("label"))))
    rows = s.join(risk.benchmark_schedule(_bench(s), 3, 9, 0.95, 0.6, 0.3, 0.5), "date")
    return rows.select(F.lit("equal").alias("scenario"), "date", "instrument", "score", "label", "risk", "score2")


@registered()
def daily_report_with_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole daily report of a strategy beside one baseline, at the strategy's risk and at a fixed one (a recurrence)."""
    rows = _scenario_rows(spark, sf_dir)
    rows, settings = simulate.with_baselines(rows.drop("score2"), {"avg": rows.select("date", "instrument", F.col("score2").alias("score"))}, "equal", {"equal": SETTINGS["equal"]})
    made = simulate.run_scenarios(rows, settings)
    of = lambda n: made.where(F.col("scenario") == n)
    return doubles(metrics.full_report(of("equal"), {n: of(n) for n in ("avg", "fixed_risk_avg")}).withColumnRenamed("datetime", "date"))


@registered()
def trade_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strategy sold, bought and held on each date (a recurrence)."""
    made = simulate.run_scenarios(_scenario_rows(spark, sf_dir).drop("score2"), {"equal": SETTINGS["equal"]}, trace=True)
    return doubles(made.select("date", "start_value", "end_value", F.size("holdings_before").alias("n_before"), F.size("holdings_after").alias("n_after"), F.size("sell_list").alias("n_sold"), F.size("buy_list").alias("n_bought"), "buy_value", "sell_value"))
