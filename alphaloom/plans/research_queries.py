"""Queries over diagnostics, feature selection, training windows and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import boosting, compare, diagnostics, joins, labels, prefilter, training
from .frames import SCORED_SQL, avg_rank_sql, r6, scored, text_date
from .panel_queries import doubles

QUERIES: dict = {}
ORACLES: dict = {}
FEATURES = ["score", "score2", "score3"]
BINS = 5


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SCORED_SQL} {sql}"
        return f

    return put


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.long_form(scored(spark, sf_dir).where("label IS NOT NULL"), FEATURES)


_PAIR = "x IS NOT NULL AND y IS NOT NULL"
_corr = lambda x, y: f"CASE WHEN count({x}) >= 2 AND min({x}) < max({x}) AND min({y}) < max({y}) THEN round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})))), 12) END"
_LONG_SQL = ", long AS (" + " UNION ALL ".join(f"SELECT date, symbol, '{f}' AS feature, {f} AS x, label AS y FROM scored WHERE label IS NOT NULL" for f in FEATURES) + ")"


def _daily_sql(source: str = "long", name: str = "daily", extra: str = "") -> str:
    k = f"feature{extra}, date"
    return f""", {name}_p AS (SELECT {k}, CASE WHEN {_PAIR} THEN x END AS x, CASE WHEN {_PAIR} THEN y END AS y FROM {source}),
    {name}_r AS (SELECT *, {avg_rank_sql('x', k)} AS rx, {avg_rank_sql('y', k)} AS ry FROM {name}_p),
    {name}_c AS (SELECT {k}, count(*) AS rows, count(x) AS n, {_corr('x', 'y')} AS ic0, {_corr('rx', 'ry')} AS ric0 FROM {name}_r GROUP BY {k}),
    {name} AS (SELECT {k}, rows, n, CASE WHEN ric0 IS NOT NULL THEN ic0 END AS ic, CASE WHEN ic0 IS NOT NULL THEN ric0 END AS rank_ic FROM {name}_c)"""


def _bucket_sql(source: str = "long", name: str = "buckets", extra: str = "") -> str:
    k = f"feature{extra}, date"
    return f""", {name}_k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {k}) AS c, min(x) OVER (PARTITION BY {k}) < max(x) OVER (PARTITION BY {k}) AS vx, min(y) OVER (PARTITION BY {k}) < max(y) OVER (PARTITION BY {k}) AS vy, {avg_rank_sql('x', k)} AS r FROM {source} WHERE {_PAIR}) WHERE c >= {BINS} AND vx),
    {name} AS (SELECT {k}, CAST(greatest(0, least({BINS - 1}, floor(r / c * {BINS} - 1e-12))) AS BIGINT) AS bucket, count(*) AS n, avg(y) AS mean_label, bool_or(vy) AS vy FROM {name}_k GROUP BY ALL)"""


def _spread_sql(source: str = "buckets", name: str = "spreads", extra: str = "") -> str:
    k = f"feature{extra}, date"
    return f""", {name}_r AS (SELECT *, {avg_rank_sql('mean_label', k)} AS mr, {avg_rank_sql('bucket', k)} AS br FROM {source}),
    {name} AS (SELECT {k}, arg_max(mean_label, bucket) - arg_min(mean_label, bucket) AS spread, {_corr('br', 'mr')} AS monotonicity, bool_or(vy) AS vy FROM {name}_r GROUP BY {k} HAVING count(*) >= 2)"""


@registered(f"{_LONG_SQL}{_daily_sql()} SELECT feature, CAST(date AS VARCHAR) AS date, rows, n, {r6('ic')} AS ic, {r6('rank_ic')} AS rank_ic FROM daily")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(diagnostics.daily_ic(_long(spark, sf_dir)))


@registered(f"{_LONG_SQL}{_bucket_sql()} SELECT feature, CAST(date AS VARCHAR) AS date, bucket, n, {r6('mean_label / 7.1234567')} AS mean_label FROM buckets")
def bucket_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diagnostics.bucket_returns(_long(spark, sf_dir), BINS)
    return doubles(made.select("feature", "date", "bucket", "n", (F.col("mean_label") / 7.1234567).alias("mean_label")))


@registered(f"{_LONG_SQL}{_bucket_sql()}{_spread_sql()} SELECT feature, CAST(date AS VARCHAR) AS date, {r6('spread / 7.1234567')} AS spread, {r6('monotonicity')} AS monotonicity FROM spreads")
def daily_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diagnostics.daily_spread(diagnostics.bucket_returns(_long(spark, sf_dir), BINS))
    return doubles(made.select("feature", "date", (F.col("spread") / 7.1234567).alias("spread"), "monotonicity"))


@registered(f"{_LONG_SQL}{_daily_sql()} SELECT feature, CAST(last_day(date) AS VARCHAR) AS month, {r6('avg(rank_ic)')} AS rank_ic, count(*) AS days FROM daily WHERE rank_ic IS NOT NULL GROUP BY feature, last_day(date)")
def monthly_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(diagnostics.monthly_rank_ic(diagnostics.daily_ic(_long(spark, sf_dir))))


@registered(", long AS (" + " UNION ALL ".join(f"SELECT date, '{f}' AS feature, {f} AS x FROM scored" for f in FEATURES) + f") SELECT feature, year(date) AS year, count(*) AS rows, count(*) - count(x) AS missing, {r6('(count(*) - count(x)) / count(*)')} AS missing_pct FROM long GROUP BY feature, year(date)")
def missing_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(diagnostics.missing_by_year(diagnostics.long_form(scored(spark, sf_dir), FEATURES)))


METRICS = ["coverage_pct", "avg_daily_coverage_pct", "ic_mean", "ic_std", "ic_ir", "ic_positive_rate", "rank_ic_mean", "rank_ic_std", "rank_ic_ir", "rank_ic_positive_rate", "rank_ic_directional_hit_rate", "rank_ic_abs_mean", "monthly_rank_ic_mean", "monthly_rank_ic_positive_rate", "monthly_rank_ic_directional_hit_rate", "monotonicity_mean", "monotonicity_positive_rate", "top_bottom_spread_mean", "top_bottom_spread_positive_rate", "rank_ic_ir_abs", "ic_ir_abs"]
COUNTS = ["observation_count", "valid_observation_count", "date_count", "effective_date_count", "monotonic_date_count", "monthly_rank_ic_months", "suggested_direction"]


def _summary_sql(extra: str = "", source: str = "long") -> str:
    k = f"feature{extra}"
    ir = lambda x: f"CASE WHEN stddev_samp({x}) > 1e-8 THEN avg({x}) / stddev_samp({x}) END"
    pos = lambda x, op=">": f"avg(CASE WHEN {x} IS NOT NULL THEN CAST({x} {op} 0 AS INTEGER)::DOUBLE END)"
    return f"""{_daily_sql(source, extra=extra)}{_bucket_sql(source, extra=extra)}{_spread_sql(extra=extra)},
    sb AS (SELECT {k}, CAST(sum(rows) AS BIGINT) AS observation_count, CAST(sum(n) AS BIGINT) AS valid_observation_count, avg(n / rows) AS avg_daily_coverage_pct, count(*) AS date_count, count(ic) AS effective_date_count,
      avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, {ir('ic')} AS ic_ir, {pos('ic')} AS ic_positive_rate, avg(rank_ic) AS rank_ic_mean, stddev_samp(rank_ic) AS rank_ic_std, {ir('rank_ic')} AS rank_ic_ir, {pos('rank_ic')} AS rank_ic_positive_rate, {pos('rank_ic', '<')} AS neg FROM daily GROUP BY {k}),
    mo AS (SELECT {k}, last_day(date) AS m, avg(rank_ic) AS v FROM daily WHERE rank_ic IS NOT NULL GROUP BY {k}, last_day(date)),
    sm AS (SELECT {k}, avg(v) AS monthly_rank_ic_mean, {pos('v')} AS monthly_rank_ic_positive_rate, {pos('v', '<')} AS mneg, count(*) AS monthly_rank_ic_months FROM mo GROUP BY {k}),
    ss AS (SELECT {k}, count(*) AS monotonic_date_count, avg(monotonicity) AS monotonicity_mean, {pos('monotonicity')} AS monotonicity_positive_rate, avg(spread) AS top_bottom_spread_mean, {pos('spread')} AS top_bottom_spread_positive_rate FROM spreads WHERE vy AND monotonicity IS NOT NULL GROUP BY {k}),
    su AS (SELECT sb.*, monthly_rank_ic_mean, monthly_rank_ic_positive_rate, mneg, coalesce(monthly_rank_ic_months, 0) AS monthly_rank_ic_months, coalesce(monotonic_date_count, 0) AS monotonic_date_count, monotonicity_mean, monotonicity_positive_rate, top_bottom_spread_mean, top_bottom_spread_positive_rate,
      CAST(CASE WHEN rank_ic_mean > 1e-8 THEN 1 WHEN rank_ic_mean < -1e-8 THEN -1 ELSE 0 END AS BIGINT) AS suggested_direction FROM sb LEFT JOIN sm USING ({k}) LEFT JOIN ss USING ({k})),
    summary AS (SELECT *, valid_observation_count / observation_count AS coverage_pct, abs(rank_ic_mean) AS rank_ic_abs_mean, abs(rank_ic_ir) AS rank_ic_ir_abs, abs(ic_ir) AS ic_ir_abs,
      CASE suggested_direction WHEN 1 THEN rank_ic_positive_rate WHEN -1 THEN neg END AS rank_ic_directional_hit_rate, CASE suggested_direction WHEN 1 THEN monthly_rank_ic_positive_rate WHEN -1 THEN mneg END AS monthly_rank_ic_directional_hit_rate FROM su)"""


@registered(f"{_LONG_SQL}{_summary_sql()} SELECT feature, 'alpha158' AS feature_group, {', '.join(COUNTS)}, {', '.join(f'{r6(c)} AS {c}' for c in METRICS)} FROM summary")
def factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.wide_summary(scored(spark, sf_dir).where("label IS NOT NULL"), FEATURES, BINS).select("feature", "feature_group", *COUNTS, *METRICS), METRICS)


SEGMENTS = [("early", "1992-01-01", "1997-12-31"), ("late", "1998-01-01", "2003-12-31")]
_SEG_SQL = f"{_LONG_SQL}, seg AS (SELECT long.*, segment FROM long JOIN (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SEGMENTS) + f") s(segment, a, b) ON date BETWEEN a AND b){_summary_sql(', segment', 'seg')}"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame(SEGMENTS, "segment string, start string, end string").select("segment", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return diagnostics.segment_summaries(_long(spark, sf_dir), frame, BINS)


@registered(f"""{_SEG_SQL} SELECT feature, {r6('max(abs(rank_ic_mean))')} AS segment_rank_ic_abs_max, {r6('min(abs(rank_ic_mean))')} AS segment_rank_ic_abs_min, {r6('max(rank_ic_mean) - min(rank_ic_mean)')} AS segment_rank_ic_mean_range,
arg_max(segment, abs(rank_ic_mean)) AS best_segment_by_abs_rank_ic, arg_min(segment, abs(rank_ic_mean)) AS worst_segment_by_abs_rank_ic, count(*) FILTER (suggested_direction > 0) AS positive_direction_segments, count(*) FILTER (suggested_direction < 0) AS negative_direction_segments, count(*) FILTER (suggested_direction <> 0) AS nonzero_direction_segments,
{r6('avg(monthly_rank_ic_directional_hit_rate)')} AS segment_monthly_directional_hit_mean, {r6('min(monthly_rank_ic_directional_hit_rate)')} AS segment_monthly_directional_hit_min, count(*) FILTER (suggested_direction > 0) > 0 AND count(*) FILTER (suggested_direction < 0) > 0 AS direction_flip FROM summary GROUP BY feature""")
def segment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(diagnostics.segment_comparison(_segments(spark, sf_dir)))


_TH = prefilter.Thresholds(coverage=0.9, rank_ic=0.005, rank_ic_ir=0.02, monthly_rate=0.3)


@registered(f"{_LONG_SQL}{_summary_sql()} SELECT feature, {r6('rank_ic_abs_mean')} AS rank_ic_abs_mean, {r6('monthly_rank_ic_directional_hit_rate')} AS monthly_rate, CAST(3 AS BIGINT) AS prefix_priority FROM summary WHERE NOT coalesce(coverage_pct < 0.9, false) AND NOT coalesce(rank_ic_abs_mean < 0.005 AND rank_ic_ir_abs < 0.02, false) AND NOT coalesce(monthly_rank_ic_directional_hit_rate < 0.3, false)")
def prefilter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = prefilter.passing(prefilter.scored(diagnostics.summary(_long(spark, sf_dir), BINS)), _TH)
    return doubles(kept.select("feature", "rank_ic_abs_mean", F.col("monthly_rank_ic_directional_hit_rate").alias("monthly_rate"), "prefix_priority"))


@registered(f"{_LONG_SQL}{_summary_sql()}, o AS (SELECT feature, row_number() OVER (PARTITION BY feature IN ('score', 'score3') ORDER BY rank_ic_ir_abs DESC NULLS LAST) AS p, first(feature) OVER (PARTITION BY feature IN ('score', 'score3') ORDER BY rank_ic_ir_abs DESC NULLS LAST) AS f FROM summary) SELECT feature, p = 1 OR feature = 'score2' AS kept, CASE WHEN p > 1 AND feature <> 'score2' THEN f END AS dropped_by FROM o")
def duplicate_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefilter.scored(diagnostics.summary(_long(spark, sf_dir), BINS))
    return prefilter.without_duplicates(rows, [("score", "score3")]).select("feature", "kept", "dropped_by")


@registered("".join((", c AS (", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, sum({a}) AS x, sum({b}) AS y, sum({a} * {b}) AS xy, sum({a} * {a}) AS xx, sum({b} * {b}) AS yy FROM scored WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("score", "score2"), ("score", "score3"), ("score2", "score3"))), f") SELECT a, b, {r6('(n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y))')} AS corr FROM c")))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(prefilter.correlations(scored(spark, sf_dir), FEATURES))


@registered(""", m AS (SELECT abs(corr(score, score2)) AS c12, abs(corr(score, score3)) AS c13, abs(corr(score2, score3)) AS c23 FROM scored), k AS (SELECT *, NOT coalesce(c12 >= 0.6, false) AS keep2 FROM m),
l AS (SELECT *, greatest(c13, CASE WHEN keep2 THEN c23 END) AS near FROM k)
SELECT 'score' AS feature, true AS kept, CAST(NULL AS VARCHAR) AS dropped_by UNION ALL SELECT 'score2', keep2, CASE WHEN NOT keep2 THEN 'score' END FROM l
UNION ALL SELECT 'score3', NOT coalesce(near >= 0.6, false), CASE WHEN near >= 0.6 THEN CASE WHEN keep2 AND c23 >= c13 THEN 'score2' ELSE 'score' END END FROM l""")
def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pruning of correlated features in the order of FEATURES."""
    kept, dropped = prefilter.prune_correlated(scored(spark, sf_dir), FEATURES, 0.6)
    return spark.createDataFrame([(f, True, None) for f in kept] + [(f, False, by) for f, by in dropped], "feature string, kept boolean, dropped_by string")


_NEUTRAL = ", long2 AS (" + " UNION ALL ".join(f"SELECT date, symbol, '{f}' AS feature, {f} - coalesce(avg({f}) OVER (PARTITION BY date, industry), 0) AS x, label AS y FROM scored WHERE label IS NOT NULL" for f in FEATURES) + ")"


def _renamed(sql: str) -> str:
    """The CTEs of a summary under other names, to stand beside the first."""
    import re

    for name in ("daily_p", "daily_r", "daily_c", "daily", "buckets_k", "buckets", "spreads_r", "spreads", "sb", "mo", "sm", "ss", "su", "summary"):
        sql = re.sub(rf"\b{name}\b(?!_)", f"n_{name}", sql)
    return sql


@registered(f"""{_LONG_SQL}{_NEUTRAL}{_summary_sql()}{_renamed(_summary_sql(source='long2'))}, b AS (SELECT r.feature, r.rank_ic_mean AS a, n.rank_ic_mean AS c, r.rank_ic_ir AS ai, n.rank_ic_ir AS ci, r.coverage_pct AS ac, n.coverage_pct AS cc FROM summary r JOIN n_summary n USING (feature)),
d AS (SELECT *, sign(a) = sign(c) AND sign(a) <> 0 AS ok FROM b) SELECT feature, ok AS direction_consistent, NOT ok AS direction_flip, {r6('least(ac, cc)')} AS coverage_pct, {r6('CASE WHEN ok THEN sign(a) ELSE 0 END * least(abs(a), abs(c))')} AS rank_ic_mean, {r6('CASE WHEN ok THEN sign(a) ELSE 0 END * least(abs(ai), abs(ci))')} AS rank_ic_ir, {r6('abs(c) / abs(a)')} AS neutral_retention_rank_ic_abs FROM d""")
def robust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import neutral

    s = scored(spark, sf_dir).where("label IS NOT NULL")
    raw = diagnostics.summary(diagnostics.long_form(s, FEATURES), BINS)
    flat = diagnostics.summary(diagnostics.long_form(neutral(s, FEATURES), FEATURES), BINS)
    return doubles(prefilter.robust(raw, flat).select("feature", "direction_consistent", "direction_flip", "coverage_pct", "rank_ic_mean", "rank_ic_ir", "neutral_retention_rank_ic_abs"))


# ---- training

_WIN = (24, 6, 6, 2)  # train, valid, test and embargo dates
_WIN_SQL = f""", days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM scored)), n AS (SELECT count(*) AS n FROM days), st AS (SELECT unnest(range({_WIN[0] + _WIN[1] + _WIN[3]}, (SELECT n FROM n), {_WIN[2]})) AS s),
ix AS (SELECT CAST((s - {_WIN[0] + _WIN[1] + _WIN[3]}) / {_WIN[2]} AS BIGINT) AS window_id, s - {_WIN[3] + _WIN[1] + _WIN[0]} AS a, s - {_WIN[3] + _WIN[1]} - 1 AS b, s - {_WIN[3] + _WIN[1]} AS c, s - {_WIN[3]} - 1 AS d, s AS e, least(s + {_WIN[2]} - 1, (SELECT n FROM n) - 1) AS f FROM st),
win AS (SELECT window_id, {', '.join(f'(SELECT date FROM days WHERE i = ix.{k}) AS {n}' for k, n in zip('abcdef', ('train_start', 'train_end', 'valid_start', 'valid_end', 'test_start', 'test_end')))} FROM ix)"""
_ENDS = ["train_start", "train_end", "valid_start", "valid_end", "test_start", "test_end"]


def _windows(s: DataFrame) -> DataFrame:
    return training.rolling_windows(s, _WIN[0], _WIN[1], _WIN[2], _WIN[3])


@registered(f"{_WIN_SQL} SELECT window_id, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _ENDS)} FROM win")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_date(_windows(scored(spark, sf_dir)), *_ENDS)


@registered(f"{_WIN_SQL} SELECT window_id, part, count(*) AS rows, {r6('avg(label) / 7.1234567')} AS label_mean FROM (" + " UNION ALL ".join(f"SELECT window_id, '{p}' AS part, s.label FROM scored s JOIN win ON s.date BETWEEN {p}_start AND {p}_end" for p in ("train", "valid", "test")) + ") GROUP BY window_id, part")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    dealt = joins.windows_of(s.select("date", "label"), _windows(s))
    return doubles(dealt.groupBy("window_id", "part").agg(F.count("*").alias("rows"), (F.avg("label") / 7.1234567).alias("label_mean")))


@registered(f", m AS (SELECT * FROM (VALUES (1, DATE '1994-01-01', DATE '1996-12-31', 0.1::DOUBLE), (2, DATE '1996-06-01', DATE '1999-12-31', 0.2::DOUBLE)) v(record_no, a, b, metric)), d AS (SELECT DISTINCT date FROM scored) SELECT CAST(date AS VARCHAR) AS date, (SELECT arg_max(metric, record_no) FROM m WHERE d.date BETWEEN a AND b) AS metric FROM d")
def validation_metric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.createDataFrame([(1, "1994-01-01", "1996-12-31", 0.1), (2, "1996-06-01", "1999-12-31", 0.2)], "record_no int, start string, end string, metric double").withColumns({c: F.to_date(c) for c in ("start", "end")})
    return text_date(joins.metric_of_date(scored(spark, sf_dir).select("date").distinct(), records))


@registered(f""", p AS (SELECT *, CASE WHEN score2 IS NOT NULL THEN CAST(label > 0.1 AS INTEGER) END AS o, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument DESC) AS p FROM scored WHERE score IS NOT NULL AND label IS NOT NULL),
k AS (SELECT * FROM p WHERE p <= 5), f AS (SELECT date, arg_min(label, instrument) AS y, arg_min(o, instrument) AS o FROM (SELECT *, max(score) OVER (PARTITION BY date) AS m FROM k) WHERE score = m GROUP BY date),
d AS (SELECT date, avg(label) AS t, median(label) AS md, min(label) AS mn, avg(CAST(label > 0 AS INTEGER)) AS h, avg(o) AS orate FROM k GROUP BY date), a AS (SELECT date, avg(label) AS a FROM p GROUP BY date), one AS (SELECT f.y, f.o, d.*, a.a FROM f JOIN d USING (date) JOIN a USING (date))
SELECT count(*) AS valid_topk_days, {r6('avg(y)')} AS valid_top1_label_mean, {r6('avg(CAST(y > 0 AS INTEGER))')} AS valid_top1_positive_rate, {r6('avg(t)')} AS valid_topk_label_mean, {r6('avg(md)')} AS valid_topk_label_median, {r6('avg(mn)')} AS valid_topk_min_label_mean, {r6('avg(h)')} AS valid_topk_positive_rate, {r6('avg(t - a)')} AS valid_topk_excess_mean,
{r6('avg(o)')} AS valid_top1_opportunity_rate, {r6('avg(orate)')} AS valid_topk_opportunity_rate FROM one""")
def topk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("opportunity", F.when(F.col("score2").isNotNull(), (F.col("label") > 0.1).cast("double")))
    return doubles(training.topk_summary(s, 5, prediction="score", opportunity="opportunity"))


@registered(f"SELECT CAST(date AS VARCHAR) AS date, instrument, {r6('label')} AS label FROM scored WHERE (date, instrument) IN (SELECT (date, instrument) FROM scored WHERE score3 > 0.1)")
def labels_of_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return doubles(training.of_predictions(s.select("date", "instrument", "label"), s.where("score3 > 0.1")))


@registered()
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a ridge learner, window by window (a fit is not a relational query)."""
    s = scored(spark, sf_dir)
    return doubles(training.walk_forward(s, _windows(s), FEATURES))


@registered(f"""{_LONG_SQL}{_daily_sql()}, wt AS (SELECT feature, avg(rank_ic) AS w FROM daily GROUP BY feature), z AS (SELECT long.*, CASE WHEN stddev_pop(x) OVER k > 1e-12 THEN (x - avg(x) OVER k) / stddev_pop(x) OVER k WHEN x IS NOT NULL THEN 0 END AS z, {avg_rank_sql('x', 'feature, date')} / count(x) OVER k AS r FROM long WINDOW k AS (PARTITION BY feature, date))
SELECT CAST(date AS VARCHAR) AS date, symbol, {r6('avg(z)')} AS average, {r6('avg(sign(coalesce(w, 0)) * z)')} AS sign_aligned, {r6('avg(r)')} AS rank_average, {r6('sum(coalesce(w, 0) * r)')} AS rank_ic_weighted FROM z JOIN wt USING (feature) GROUP BY date, symbol""")
def factor_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    weights = diagnostics.daily_ic(long).groupBy("feature").agg(F.avg("rank_ic").alias("rank_ic"))
    return doubles(training.baselines(long.select("date", "symbol", "feature", "x"), weights))


@registered(f", k AS (SELECT *, {avg_rank_sql('score', 'date')} AS r, count(*) OVER (PARTITION BY date) AS c FROM scored WHERE score IS NOT NULL AND label IS NOT NULL), b AS (SELECT 10 - CAST(greatest(0, least(9, floor(r / c * 10 - 1e-12))) AS BIGINT) AS bucket, label FROM k) SELECT bucket, count(*) AS n, {r6('avg(label)')} AS mean_label FROM b GROUP BY bucket")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(compare.score_buckets(scored(spark, sf_dir).withColumn("run", F.lit("a"))).drop("run"))


_PIVOTED = ["rank_ic_mean", "coverage_pct"]


_PIVOT_SQL = ", ".join(r6(f"max({m}) FILTER (segment = '{n}')") + f" AS {m}__{n}" for m in _PIVOTED for n, _, _ in SEGMENTS)


@registered(f"{_SEG_SQL} SELECT feature, {_PIVOT_SQL} FROM summary GROUP BY feature")
def segment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(diagnostics.segment_pivot(_segments(spark, sf_dir), [n for n, _, _ in SEGMENTS], _PIVOTED))


@registered(f"{_SEG_SQL}, g AS (SELECT feature, max(abs(rank_ic_mean)) AS m, avg(coverage_pct) AS c FROM summary GROUP BY feature), w AS (SELECT feature, count(y) FILTER (x IS NOT NULL) / count(*) AS cov FROM long GROUP BY feature) SELECT w.feature, {r6('CASE WHEN g.feature IS NOT NULL THEN c ELSE cov END')} AS coverage_pct, {r6('m')} AS strongest FROM w LEFT JOIN (SELECT * FROM g WHERE feature <> 'score2') g USING (feature)")
def segment_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-period coverage, replaced by the segments' mean for the features that segments tell of."""
    side = _segments(spark, sf_dir).where("feature <> 'score2'").groupBy("feature").agg(F.max(F.abs("rank_ic_mean")).alias("strongest"), F.avg("coverage_pct").alias("coverage_pct"))
    whole = diagnostics.wide_summary(scored(spark, sf_dir).where("label IS NOT NULL"), FEATURES, BINS).select("feature", "coverage_pct")
    return doubles(diagnostics.enriched(whole, side))


@registered(f"{_LONG_SQL}{_summary_sql()} SELECT CAST(count(*) AS BIGINT) AS features, count(*) FILTER (rank_ic_abs_mean >= 0.005 AND coverage_pct >= 0.9) AS passing, (SELECT feature FROM summary ORDER BY rank_ic_mean DESC NULLS LAST LIMIT 1) AS first_by_rankic FROM summary")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = diagnostics.batch_report(diagnostics.wide_summary(scored(spark, sf_dir).where("label IS NOT NULL"), FEATURES, BINS), n=1, least_rank_ic=0.005)
    return report["counts"].withColumn("first_by_rankic", report["top_rankic"].select("feature").scalar())


@registered()
def walk_forward_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of boosted trees that stop early by daily rank correlation (a fit is not a relational query)."""
    s = scored(spark, sf_dir)
    return doubles(training.walk_forward(s, _windows(s), FEATURES, boosting.learner(boosting.Boosting(rounds=30, patience=8, leaves=8))))


@registered(f", w AS (SELECT *, 0.1 + 0.9 * power(0.5, date_diff('day', date, (SELECT max(date) FROM scored)) / 365.0::DOUBLE) AS raw FROM scored) SELECT CAST(date AS VARCHAR) AS date, instrument, round(CAST(CAST(raw / (SELECT avg(raw) FROM w) AS FLOAT) * CAST(abs(label) AS FLOAT) AS DOUBLE), 4) + 0.0 AS weight FROM w")
def weight_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labels.decay_weights(scored(spark, sf_dir), 365, 0.1)
    return text_date(s.select("date", "instrument", (F.round(labels.combined_weights(F.col("weight"), F.abs("label")).cast("double"), 4) + 0.0).alias("weight")))
