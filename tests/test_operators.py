"""Panel operators on literal rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import boosting, collect, compare, crosssection, diagnostics, experiment, fusion, industry, joins, labels, metrics, prefilter, risk, simulate, training
from alphaloom.sources import artifacts, panels, stores

nan = math.nan
day = lambda n: dt.date(2024, 1, n)


def one(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_strict_and_inclusive_as_of(spark):
    left = spark.createDataFrame([("a", day(2)), ("a", day(3)), ("a", day(5)), ("b", day(3))], "symbol string, date date")
    events = spark.createDataFrame([("a", day(3), 1, 1.0), ("a", day(3), 2, None), ("a", day(1), 0, 9.0), ("a", None, 3, 5.0), ("a", day(9), 4, 7.0)], "symbol string, ann_date date, seq long, v double")
    strict = one(joins.as_of(left, events, sequence="seq", days="age", values=["v"]), "symbol", "date")
    assert [(r["v"], r["age"]) for r in strict] == [(9.0, 1.0), (9.0, 2.0), (None, 2.0), (None, None)]
    loose = one(joins.as_of(left, events, sequence="seq", strict=False, values=["v"]), "symbol", "date")
    assert [r["v"] for r in loose] == [9.0, None, None, None]


def test_universe_industry_axes(spark):
    panel = spark.createDataFrame([(s, day(n)) for s in "abc" for n in (1, 5, 9)], "symbol string, date date")
    i = spark.createDataFrame([("a", day(2), None), ("b", None, day(5)), ("a", day(1), day(1))], "symbol string, start date, end date")
    assert [(r["symbol"], r["date"].day) for r in one(joins.in_universe(panel, i), "symbol", "date")] == [("a", 1), ("a", 5), ("a", 9), ("b", 1), ("b", 5)]
    m = spark.createDataFrame([("a", "x")], "symbol string, industry string")
    assert {r["industry"] for r in joins.with_industry(panel, m, "own").collect()} == {"x", "own:b", "own:c"}
    assert {r["industry"] for r in joins.with_industry(panel, m, "unknown").collect()} == {"x", "UNKNOWN"}
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0), (2, "y", 3.0)], "date int, instrument string, score double")
    b = spark.createDataFrame([(2, "x", 1.0), (3, "y", 1.0)], "date int, instrument string, score double")
    assert [len(f.collect()) for f in joins.shared_axes(a, b)] == [2, 1]
    assert joins.dense(a).count() == 4


def test_cross_sections(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, 1.0, 3.0, None, 2.0)] + [(2, 2.0), (2, 2.0), (2, nan), (3, float("inf")), (3, 4.0)], "date int, score double").withColumn("instrument", F.monotonically_increasing_id())
    got = [r["score"] for r in one(crosssection.rank_pct(df, ["score"]), "instrument")]
    assert got[:5] == [0.875, 0.25, 0.875, None, 0.5] and got[5:7] == [0.75, 0.75] and math.isnan(got[7]) and got[8:] == [float("inf"), 1.0]
    z = [r["z"] for r in one(crosssection.zscore_clip(df, "score", "z", 0.5), "instrument")]
    assert z[5:8] == [0.0, 0.0, None] and max(x for x in z if x is not None) == 0.5
    assert {(r["date"], r["place"], r["score"]) for r in crosssection.top_k(df, 1).collect()} == {(1, 1, 3.0), (2, 1, 2.0), (3, 1, 4.0)}
    s = {m: {r["date"]: r["signal"] for r in crosssection.signal_strength(df, m, 2, 2.5).collect()} for m in ("top1", "topk_sum", "topk_mean")}
    assert s["top1"] == {1: 3.0, 2: None, 3: 4.0} and s["topk_sum"] == {1: 6.0, 2: 0.0, 3: 4.0} and s["topk_mean"][1] == 3.0


def test_label_spaces(spark):
    rows = [(1, s, l, i) for s, l, i in (("A", 0.04, "I1"), ("B", 0.02, "I1"), ("C", -0.01, "I2"), ("D", -0.03, None))]
    df = spark.createDataFrame(rows, "date int, symbol string, label double, industry string")
    got = [r["label"] for r in one(labels.industry_excess(df), "symbol")]
    assert got[3] is None and got[:3] == pytest.approx([0.01, -0.01, 0.0])
    bench = labels.cross_section_benchmark(df)
    assert bench.first()["ret"] == pytest.approx(0.005)
    r = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, -0.01)], "date int, ret double")
    assert [x["forward"] for x in one(labels.forward_compound(r, 2), "date")] == [pytest.approx(1.02 * 0.99 - 1), None, None]
    ranked = labels.cross_section_rank(spark.createDataFrame([(1, 0.10), (1, 0.0), (1, -0.10), (2, 5.0)], "date int, label double"))
    assert [x["label"] for x in one(ranked, "date", F.desc("label"))] == [0.5, 0.0, -0.5, 0.0]
    n = labels.neutral(df.withColumn("f", F.col("label")), ["f"])
    assert [x["f"] for x in one(n, "symbol")] == pytest.approx([0.01, -0.01, 0.0, -0.03])


def test_weights_and_relevance(spark):
    df = spark.createDataFrame([(1, 0.03), (1, -0.01), (2, 0.02), (2, -0.04)], "date int, edge double")
    w = labels.opportunity_weights(df, "edge", 0.01)
    assert [r["m"] for r in one(w.groupBy("date").agg(F.avg("weight").alias("m")), "date")] == pytest.approx([1.0, 1.0])
    rel = labels.relevance(spark.createDataFrame([(1, 0.10), (1, 0.0), (1, -0.10), (2, 0.2), (2, 0.1), (2, 0.0), (3, 1.0), (3, 1.0)], "date int, label double"), 3)
    assert [r["relevance"] for r in one(rel, "date", F.desc("label"))] == [2, 1, 0, 2, 1, 0, 0, 0]
    d = labels.decay_weights(spark.createDataFrame([(day(1),), (day(11),)], "date date"), 10)
    assert [r["weight"] for r in one(d, "date")] == pytest.approx([0.5 / 0.75, 1 / 0.75])
    assert [r["relevance"] for r in one(labels.direct_relevance(spark.createDataFrame([(3.0,), (5.0,)], "label double")), "label")] == [0, 2]


def _diagnostic(spark):
    rows = [(d, s, l, x, -x, 1.0) for d in (1, 2, 3, 4) for s, l, x in (("A", 0.04, 4.0), ("B", 0.02, 3.0), ("C", -0.01, 2.0), ("D", -0.03, 1.0))]
    df = spark.createDataFrame([(dt.date(2024, d, 5), *r[1:]) for d, r in zip([r[0] for r in rows], rows)], "date date, symbol string, label double, signal double, inverse double, flat double")
    return diagnostics.long_form(df, ["signal", "inverse", "flat"])


def test_factor_summary_directions(spark):
    got = {r["feature"]: r for r in diagnostics.summary(_diagnostic(spark), 2).collect()}
    assert got["signal"]["rank_ic_mean"] > 0.99 and got["signal"]["suggested_direction"] == 1 and got["signal"]["monthly_rank_ic_months"] == 4
    assert got["inverse"]["rank_ic_mean"] < -0.99 and got["inverse"]["suggested_direction"] == -1 and got["inverse"]["rank_ic_directional_hit_rate"] == 1.0
    assert got["flat"]["effective_date_count"] == 0 and got["flat"]["suggested_direction"] == 0 and got["flat"]["monotonic_date_count"] == 0
    assert got["signal"]["coverage_pct"] == 1.0 and got["signal"]["rank_ic_ir"] is None
    assert got["signal"]["top_bottom_spread_mean"] == pytest.approx(0.05)


def test_segments_flip(spark):
    long = _diagnostic(spark)
    long = long.withColumn("x", F.when(F.month("date") > 2, -F.col("x")).otherwise(F.col("x")))
    seg = spark.createDataFrame([("early", dt.date(2024, 1, 1), dt.date(2024, 2, 28)), ("late", dt.date(2024, 3, 1), dt.date(2024, 4, 30))], "segment string, start date, end date")
    got = {r["feature"]: r for r in diagnostics.segment_comparison(diagnostics.segment_summaries(long, seg, 2)).collect()}
    assert got["signal"]["direction_flip"] and got["signal"]["segment_rank_ic_mean_range"] == pytest.approx(2.0) and not got["flat"]["direction_flip"]


def _summaries(spark, rows):
    return spark.createDataFrame([(f, c, r, i, m, 0.1, n) for f, c, r, i, m, n in rows], "feature string, coverage_pct double, rank_ic_mean double, rank_ic_ir double, monthly_rank_ic_positive_rate double, monotonicity_mean double, label string")


def test_prefilter(spark):
    df = prefilter.scored(_summaries(spark, [("TS_a", 0.99, 0.03, 0.2, 0.7, ""), ("b", 0.5, 0.03, 0.2, 0.7, ""), ("c", 0.99, 0.001, 0.01, 0.7, ""), ("TEMP_d", 0.99, -0.03, -0.2, 0.3, ""), ("e", None, None, None, None, "")]))
    assert {r["feature"] for r in prefilter.passing(df).collect()} == {"TS_a", "TEMP_d", "e"}
    assert [r["feature"] for r in df.orderBy(*prefilter.order()).collect()] == ["TS_a", "TEMP_d", "b", "c", "e"]
    twins = prefilter.scored(_summaries(spark, [("RSV5", 0.99, 0.03, 0.2, 0.7, ""), ("TEMP_rsv_5", 0.99, 0.03, 0.3, 0.7, ""), ("x", 0.99, 0.03, 0.3, 0.7, "")]))
    got = {r["feature"]: (r["kept"], r["dropped_by"]) for r in prefilter.without_duplicates(twins).collect()}
    assert got == {"TEMP_rsv_5": (True, None), "RSV5": (False, "TEMP_rsv_5"), "x": (True, None)}


def test_robust_merge_needs_agreement(spark):
    raw = _summaries(spark, [("a", 0.99, 0.04, 0.4, 0.7, ""), ("b", 0.9, 0.04, 0.4, 0.7, ""), ("c", 1.0, 0.1, 0.1, 0.5, "")])
    flat = _summaries(spark, [("a", 0.95, 0.02, 0.5, 0.6, ""), ("b", 0.9, -0.02, 0.5, 0.6, "")])
    got = {r["feature"]: r for r in prefilter.robust(raw, flat).collect()}
    assert set(got) == {"a", "b"} and got["a"]["rank_ic_mean"] == 0.02 and got["a"]["rank_ic_ir"] == 0.4 and got["a"]["coverage_pct"] == 0.95
    assert got["a"]["neutral_retention_rank_ic_abs"] == pytest.approx(0.5) and got["b"]["direction_flip"] and got["b"]["suggested_direction"] == 0


def test_correlation_pruning(spark):
    rng = np.random.default_rng(0)
    a, c = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(2 * x + 1e-3 * y), float(y) if k else None) for k, (x, y) in enumerate(zip(a, c))], "a double, b double, c double")
    assert prefilter.prune_correlated(df, ["a", "b", "c"]) == (["a", "c"], [("b", "a")])
    assert prefilter.prune_correlated(df, ["c"]) == (["c"], [])


def test_windows_and_validation(spark):
    assert training.window_indices(100, 60, 10, 21) == (9, 68, 69, 78) and training.window_indices(90, 60, 10, 21) is None
    days = spark.createDataFrame([(day(n),) for n in range(1, 21)], "date date")
    w = one(training.rolling_windows(days, 5, 3, 4, 2), "window_id")
    assert [(r["train_start"].day, r["train_end"].day, r["valid_start"].day, r["valid_end"].day, r["test_start"].day, r["test_end"].day) for r in w] == [(1, 5, 6, 8, 11, 14), (5, 9, 10, 12, 15, 18), (9, 13, 14, 16, 19, 20)]
    df = spark.createDataFrame([(1, "a", 0.01, 0.2), (1, "b", 0.03, 0.9), (2, "a", -0.02, 0.1), (2, "b", 0.04, 0.8)], "date int, instrument string, label double, prediction double")
    top = training.topk_summary(df.withColumn("o", F.lit(1.0)), 1, opportunity="o").first()
    assert top["valid_topk_days"] == 2 and top["valid_topk_excess_mean"] == pytest.approx(0.02)
    assert all(top[f"valid_{c}"] == pytest.approx(0.035) for c in ("top1_label_mean", "topk_label_mean", "topk_label_median", "topk_min_label_mean"))
    assert all(top[f"valid_{c}"] == 1.0 for c in ("top1_positive_rate", "topk_positive_rate", "top1_opportunity_rate", "topk_opportunity_rate"))
    ties = spark.createDataFrame([(1, "a", 1.0, 0.9), (1, "b", 2.0, 0.8), (1, "c", 100.0, 0.8), (1, "d", 0.0, 0.1)], "date int, instrument string, label double, prediction double")
    assert training.topk_summary(ties, 2).first()["valid_topk_label_mean"] == 50.5 and training.topk_summary(ties, 2, earlier=True).first()["valid_topk_label_mean"] == 1.5
    level = spark.createDataFrame([(1, "a", 1.0, 0.5), (1, "b", 2.0, 0.5), (1, "c", 5.0, 0.5)], "date int, instrument string, label double, prediction double")
    assert training.topk_summary(level, 2).first()["valid_top1_label_mean"] == 2.0
    rows = spark.createDataFrame([(1.0, 0.1), (float("inf"), 0.1), (None, 0.1), (1.0, nan)], "f double, label double")
    assert training.trainable(rows, ["f"]).count() == 2 and training.predictable(rows, ["f"]).count() == 3


def test_learner_recovers_a_line(spark):
    rows = [(day(d), f"s{k}", 2.0 * k + d / 10, float(k)) for d in range(1, 21) for k in range(8)]
    df = spark.createDataFrame(rows, "date date, symbol string, label double, f double")
    out = training.walk_forward(df, training.rolling_windows(df, 5, 3, 4, 2), ["f"])
    assert out.count() == 80
    got = out.where("window_id = 0").groupBy("symbol").agg(F.avg("prediction").alias("p")).orderBy("symbol").collect()
    assert np.all(np.diff([r["p"] for r in got]) > 1.5)


# ---- simulation


def test_costs_and_selection():
    assert [simulate.cost(x, 0.001, 5) for x in (0, -1, 100, 10_000)] == [0, 0, 5, 10]
    assert simulate.affordable(1001, 0.001, 5) == 996 and simulate.affordable(0, 0.001, 5) == 0 and simulate.affordable(100, 0, 0) == 100
    no = np.zeros(4, bool)
    assert simulate.dropout(np.array([3, 2, 1, 4.0]), [0, 1], no, 2, 1) == ([1], [3])
    assert simulate.dropout(np.array([-1, -2, nan]), [0, 1, 2], np.array([False, True, False]), 2, 1, None, 0.0) == ([0, 2], [])
    assert simulate.dropout(np.array([nan, nan]), [0], no[:2], 1, 1) == ([], [])
    assert simulate.dropout(np.array([3, 2, 1, 4.0]), [0, 1], no, 2, 1, keep=3) == ([], [])


def test_weights_and_caps():
    assert simulate.target_weights(np.array([3.0, 1.0]), "rank", None, None, None).tolist() == pytest.approx([2 / 3, 1 / 3])
    assert simulate.capped(np.array([8.0, 1.0, 1.0]), 0.5).tolist() == pytest.approx([0.5, 0.25, 0.25])
    assert simulate.capped(np.array([1.0, 1.0]), 0.3).sum() == pytest.approx(0.6)
    w = simulate.group_capped(np.array([0.4, 0.4, 0.2]), np.array([1, 1, 2]), 0.5)
    assert w.tolist() == pytest.approx([0.25, 0.25, 0.5])
    rng = np.random.default_rng(1)
    for _ in range(200):
        raw = rng.random(rng.integers(1, 12))
        cap = rng.uniform(0.05, 1)
        w = simulate.capped(raw, cap)
        assert (w <= cap + 1e-9).all() and w.sum() <= 1 + 1e-9 and (w.sum() > 1 - 1e-9 or np.isclose(w, cap).all())
        g = simulate.group_capped(w, rng.integers(0, 3, len(w)), 0.5)
        assert g.sum() <= 1 + 1e-9


def test_simulation_smoke_and_invariants():
    s = simulate.Settings(topk=2, n_drop=1, account=1000.0, open_rate=0, close_rate=0, min_cost=0, risk_degree=1.0)
    out = simulate.simulate(np.array([[3, 2, 1], [1, 2, 3.0]]), np.array([[0.1, 0.0, 0.0], [0.0, 0.05, 0.02]]), s)
    assert out["buy_count"].tolist() == [2, 2]
    assert out["gross_return"].iloc[0] == pytest.approx(0.05) and out["sell_count"].iloc[1] >= 1
    rng = np.random.default_rng(2)
    scores, label = rng.normal(size=(60, 30)), rng.normal(0, 0.02, size=(60, 30))
    label[rng.random(label.shape) < 0.05] = nan
    for settings in (simulate.Settings(topk=5, n_drop=2, account=1e5), simulate.Settings(topk=5, n_drop=2, account=1e5, rebalance_freq=5, weighting="softmax", max_weight=0.3, exit_threshold=-0.5, exit_transform="strategy"), simulate.Settings(topk=5, n_drop=2, account=1e5, rebalance_freq=5, exit_threshold=0.0, exit_transform="none", exit_mode="expected_return", exit_min_history=20)):
        out = simulate.simulate(scores, label, settings)
        assert (out["cash"] >= -1e-6).all() and (out["holdings"] <= 5 + out["frozen_holdings"].max()).all()
        value = settings.account * np.cumprod(1 + out["net_return"])
        assert np.allclose(value, out["account_value"])
        later = label.copy()
        later[40:] = 0.5
        again = simulate.simulate(scores, later, settings)
        assert (again["buy_count"][:40] == out["buy_count"][:40]).all() and np.allclose(again["turnover"][:35], out["turnover"][:35])
        if settings.exit_threshold is not None:
            assert out["exit_count"].sum() > 0


def test_scenarios_side_by_side(spark):
    rows = [(s, d, f"i{k}", float((d * k) % 5), 0.01 * k) for s in ("a", "b") for d in range(6) for k in range(4)]
    df = spark.createDataFrame(rows, "scenario string, date int, instrument string, score double, label double")
    out = simulate.run_scenarios(df, {"a": simulate.Settings(topk=2, n_drop=1), "b": simulate.Settings(topk=1, n_drop=1)})
    assert out.count() == 12 and {r["holdings"] for r in out.where("scenario = 'b'").collect()} == {1.0}


# ---- fusion, risk, metrics


def test_fusion_over_shared_pairs(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 4.0), (2, "x", 1.0), (2, "y", nan)], "date int, instrument string, score double")
    b = spark.createDataFrame([(1, "x", 10.0), (1, "y", 5.0), (2, "x", 3.0), (2, "y", 4.0)], "date int, instrument string, score double")
    got = one(fusion.fuse(a, b, "multiply", ("rank_pct", "rank_pct")), "date", "instrument")
    assert [r["score"] for r in got] == [0.5, 0.5, 1.0]


def test_risk_schedules(spark):
    s = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, nan), (4, 0.5)], "date int, signal double")
    assert [r["risk"] for r in one(risk.signal_schedule(s, 0.0, 1.0, 0.2, 0.8), "date")] == pytest.approx([0.2, 0.8, 0.2, 0.5])
    q = [r["risk"] for r in one(risk.signal_schedule(s, 0.0, 2.0, 0.0, 1.0, (0.0, 1.0)), "date")]
    assert q == pytest.approx([0.0, 0.5, 0.0, 0.5])
    for kind in ("linear", "convex", "concave", "sigmoid"):
        got = [r["risk"] for r in one(risk.signal_schedule(s.where("date <> 3"), 0.0, 1.0, 0.0, 1.0, curve=risk.Curve(kind)), "date")]
        assert got[:2] == pytest.approx([0.0, 1.0]) and 0 < got[2] < 1
    b = spark.createDataFrame([(1, 0.0), (2, -0.1), (3, -0.1), (4, 0.5)], "date int, ret double")
    assert [r["risk"] for r in one(risk.benchmark_schedule(b, 1, 3, 0.9, 0.5, 0.1, 0.7), "date")] == [0.7, 0.9, 0.9, 0.9]
    with pytest.raises(ValueError):
        risk.benchmark_schedule(b, 3, 3, 1, 1, 1, 1)
    c = spark.createDataFrame([(1, "x", 3.0), (2, "x", 2.0), (3, "x", None), (4, "x", 1.0)], "date int, instrument string, close double")
    assert [r["confirmed"] for r in one(risk.price_confirm(c, 2), "date")] == [False, True, False, False]


def test_metrics(spark):
    d = spark.createDataFrame([("r", day(1), 0.10, 0.5, 110.0), ("r", day(2), -0.05, 0.1, 104.5), ("r", day(3), 0.02, None, 106.59)], "run string, date date, net_return double, turnover double, account_value double")
    m = metrics.portfolio(d).first()
    assert m["total_return"] == pytest.approx(0.0659) and m["win_rate"] == pytest.approx(2 / 3) and m["max_drawdown"] == pytest.approx(-0.05) and m["avg_turnover"] == pytest.approx(0.3) and m["final_account_value"] == 106.59
    p = metrics.drawdown_period(d).first()
    assert (p["peak_date"].day, p["trough_date"].day) == (1, 2)
    assert metrics.by_month(d).first()["ret"] == pytest.approx(0.0659)


# ---- collection


def test_adjustment(spark):
    raw = spark.createDataFrame([("a", "20240102", 10.0, 10.0, 10.0, 10.0, 9.5, 1.5), ("a", "20240103", 12.0, 12.0, 12.0, 12.0, 10.0, 2.0)], "ts_code string, trade_date string, open double, high double, low double, close double, pre_close double, amount double")
    basic = spark.createDataFrame([("a", "20240103", 1200.0, 80.0)], "ts_code string, trade_date string, total_mv double, float_share double")
    factor = spark.createDataFrame([("a", "20240102", 1.0), ("a", "20240103", 2.0)], "ts_code string, trade_date string, adj_factor double")
    limits = spark.createDataFrame([("a", "20240103", 10.0, 13.2, 6.0)], "ts_code string, trade_date string, pre_close double, up_limit double, down_limit double")
    got = one(collect.adjusted(raw, basic, factor, limits), "trade_date")
    assert got[1]["close"] == 24 and got[1]["pre_close"] == 10 and got[1]["pct_chg"] == pytest.approx(140) and got[0]["amount"] == 1500 and got[1]["total_mv"] == 12_000_000
    assert got[1]["circ_share"] == 800_000 and got[1]["limit_pre_close"] == 20 and got[1]["up_limit"] == pytest.approx(26.4) and got[0]["pre_close"] == 9.5 and got[0]["total_mv"] is None


def test_sanitizing(spark):
    d = spark.createDataFrame([("a", 1, None, None, None, 10.0, -1.0), ("a", 2, 11.0, 12.5, 10.8, 12.0, None)], "symbol string, date int, open double, high double, low double, close double, volume double")
    got = one(collect.daily_sanitized(d), "date")
    assert got[0]["open"] == 10 and got[0]["volume"] is None and got[1]["volume"] == 0 and got[1]["pct_chg"] == pytest.approx(20) and got[1]["change"] == 2 and got[1]["amplitude"] == pytest.approx(17)
    v = spark.createDataFrame([(10.0, 5.0, 1.0, 2.0), (-1.0, 5.0, None, 2.0)], "total_share double, circ_share double, total_mv double, circ_mv double")
    assert [tuple(r) for r in collect.valuation_sanitized(v).collect()] == [(10.0, 5.0, None, None), (None, None, None, 2.0)]


def test_text_forms(spark):
    df = spark.createDataFrame([("20240105",), ("2024-01-05",), ("2024-01-05 10:00:00.5",), ("2024-01-05T10:00:00Z",), ("nope",), ("",), (None,), ("20241399",)], "t string")
    assert [r[0] for r in df.select(collect.parsed_date(F.col("t"))).collect()] == [day(5)] * 4 + [None] * 4
    codes = spark.createDataFrame([("1",), ("600000.SH",), ("sz300001",)], "c string")
    assert [tuple(r) for r in codes.select(collect.six_digits(F.col("c")), collect.exchange_code(F.col("c")), collect.bucket_of(collect.six_digits(F.col("c")))).collect()] == [("000001", "000001.SZ", 112), ("600000", "600000.SH", 123), ("300001", "300001.SZ", __import__("zlib").crc32(b"300001") % 128)]
    with pytest.raises(Exception, match="no exchange"):
        spark.createDataFrame([("999999",)], "c string").select(collect.exchange_code(F.col("c"))).collect()
    assert [r[0] for r in spark.createDataFrame([(" 1.5 ",), ("x",), ("nan",)], "c string").select(collect.numeric(F.col("c"))).collect()] == [1.5, None, None]
    w = spark.createDataFrame([(10.0, 2.0, 7.0), (10.0, 0.0, 7.0), (None, 2.0, 7.0)], "amount double, volume double, close double")
    assert [r["vwap"] for r in collect.with_vwap(w).collect()] == [5.0, 7.0, 7.0]


def test_lifecycle_pending_chunks_universe(spark):
    target = F.lit("2024-01-10").cast("date")
    life = "symbol string, list_status string, list_date date, delist_date date, last_trade date, last_factor date, last_limit date"
    df = spark.createDataFrame([
        ("a", "L", day(20), None, None, None, None), ("b", "D", day(1), day(5), day(4), None, None), ("c", "L", day(1), None, day(8), day(10), day(10)), ("d", "L", day(1), None, day(10), day(10), day(10)),
        ("e", "L", day(1), day(5), day(8), None, None), ("f", "L", day(1), None, day(8), day(10), day(9)), ("g", "D", day(1), day(5), None, None, None),
    ], life)
    df = df.withColumn("status", collect.lifecycle(target))
    assert [r["status"] for r in one(df, "symbol")] == ["not_yet_listed", "delisted", "suspended", "active", "active", "active", "delisted"]
    early = spark.createDataFrame([("L", None, None, dt.date(2006, 1, 8), dt.date(2006, 1, 10), None)], life.removeprefix("symbol string, "))
    assert [early.select(collect.lifecycle(F.lit(d).cast("date"))).first()[0] for d in ("2006-01-10", "2007-01-04")] == ["suspended", "active"]
    m = spark.createDataFrame([("b", day(4)), ("d", day(10)), ("c", day(8)), ("e", day(8))], "symbol string, max_date date")
    df = df.withColumn("effective_end", collect.effective_end(F.col("status"), target))
    assert [r["effective_end"] for r in one(df, "symbol")] == [day(10), day(4), day(8), day(10), day(10), day(10), day(5)]
    assert {r["symbol"] for r in collect.pending(df, m, target).collect()} == {"e", "f", "g"}
    stages = spark.createDataFrame([("x", day(10), day(10), day(10), day(10), day(10)), ("y", day(10), day(10), day(10), day(9), day(10)), ("z", day(10), day(10), day(10), day(10), day(9)), ("n", None, day(10), day(10), day(10), day(10))], "symbol string, daily_latest date, daily_basic_latest date, adj_factor_latest date, stk_limit_latest date, processed_latest date")
    stages = stages.withColumns({"status": F.lit("active"), "effective_end": target})
    todo, done = collect.split_pending(stages, target)
    assert {r["symbol"] for r in done.collect()} == {"x"} and todo.count() == 3
    begun = stages.withColumns({f"{s}_earliest": F.lit(d).cast("date") for s, d in zip(collect.STAGES, ("2020-01-01", "2020-01-02", "2020-01-01"))} | {f"{s}_ready": F.col("symbol") == "?" for s in collect.STAGES})
    assert collect.split_pending(begun, target, F.lit("2020-01-01").cast("date"))[1].count() == 0 and collect.split_pending(begun, target, F.lit("2020-01-02").cast("date"))[1].count() == 1
    f = spark.createDataFrame([(day(5), day(5), None), (day(5), day(6), None), (day(5), None, day(5)), (day(5), day(6), day(4)), (None, None, None)], "expected date, earliest date, exhausted date")
    assert [r[0] for r in f.select(collect.backfilled(F.col("expected"), F.col("earliest"), F.col("exhausted"))).collect()] == [True, False, True, False, True]
    c = spark.range(1).select(collect.chunks(F.lit("2000-01-01").cast("date"), F.lit("2025-06-30").cast("date")).alias("c")).first()["c"]
    assert [(x["start"].year, str(x["end"])) for x in c] == [(2000, "2011-12-31"), (2012, "2023-12-31"), (2024, "2025-06-30")]
    u = spark.createDataFrame([("1", "20240101", None), ("1", "20240101", None)], "code string, in_date string, out_date string")
    assert [tuple(map(str, r)) for r in collect.universe_records(u, ["symbol", "code"], ["in_date"], ["out_date"]).collect()] == [("000001", "2024-01-01", "2099-12-31")]
    with pytest.raises(ValueError):
        collect.universe_records(u.select("code"), ["code"], ["in_date"], ["out_date"])


def test_industry_context(spark):
    m = spark.createDataFrame([(d, i, r) for d in (1, 2, 3) for i, r in (("x", 0.1 * d), ("x", 0.0), ("y", -0.1), ("y", None))], "date int, industry string, ret double")
    got = {(r["date"], r["industry"]): r for r in industry.rolling(industry.daily(m)).collect()}
    assert got[1, "x"]["ind_member_count"] == 2 and got[1, "y"]["ind_member_count"] == 1 and got[1, "x"]["ind_daily_ret"] == pytest.approx(0.05) and got[1, "x"]["market_ret"] == pytest.approx(0.0)
    assert got[2, "x"]["ind_ret_5"] == pytest.approx(1.05 * 1.1 - 1) and got[1, "x"]["ind_std_5"] is None


# ---- stores, artifacts, experiments, comparisons


def test_bucket_store(spark, sf, tmp_path):
    panel = panels.monthly_bars(spark, sf)
    path = str(tmp_path / "store")
    stores.write(panel, path, 8)
    back = stores.read(spark, path)
    assert back.count() == panel.count()
    some = stores.read(spark, path, ["symbol", "date", "close"], symbols=["1", "2"], start="1996-01-01", buckets=8)
    assert {r["symbol"] for r in some.select("symbol").distinct().collect()} <= {"1", "2"} and "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()
    files = stores.layout(spark, path)
    assert stores.layout_summary(files).first()["files"] >= 1 and files.agg(F.sum("rows")).first()[0] == panel.count() and files.where("row_groups < 1 OR columns < 5").count() == 0
    assert stores.incomplete_files(spark, path, ["close", "bucket"]).count() == 0 and stores.incomplete_files(spark, path, ["close", "nothing"]).first()["missing"] == ["nothing"]
    dates = panel.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    assert stores.date_range(spark, path) == tuple(dates) and stores.discover(spark, path) == sorted(stores.discover(spark, path)) != []
    wanted = spark.createDataFrame([("1",), ("2",)], "symbol string").join(panel.select("symbol", "date"), "symbol").where("month(date) = 3")
    assert stores.closes(spark, path, wanted, buckets=8).count() == wanted.count() and stores.closes(spark, path, wanted.where("false"), buckets=8).count() == 0
    few = panel.where("symbol IN ('1', '2')")
    kept = {r[0] for r in few.select(collect.bucket_of(F.col("symbol"), 8)).distinct().collect()}
    stores.write(few, path, 8, only=True)
    assert {r["bucket"] for r in stores.read(spark, path).select("bucket").distinct().collect()} == kept
    stores.write_metadata(spark, path, {"rows": 1})
    assert stores.read_metadata(spark, path) == {"rows": 1}
    small = stores.downcast(spark.createDataFrame([(1, 2**40, 0.5)], "a long, b long, c double"))
    assert [t for _, t in small.dtypes] == ["int", "bigint", "float"]
    assert stores.missing_columns(back, ["close", "nothing"]) == ["nothing"] and stores.read(spark, path, ["close", "nothing"], strict=False).columns == ["close"]
    with pytest.raises(ValueError):
        stores.read(spark, path, ["nothing"])
    meta = stores.metadata(panel, ["f"], ["label"], "strict")
    stores.checked(meta, ["f"], "label", "strict")
    for bad in ((["g"], None, None), (["f"], "x", None), (["f"], None, "loose")):
        with pytest.raises(ValueError):
            stores.checked(meta, *bad)


def test_artifacts(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("date,close\n2024-01-02,1\n2024-01-03,x\n2024-01-02,2\n20240104,3\n")
    assert [(r["date"].day, r["value"]) for r in one(artifacts.benchmark(spark, str(p)), "date")] == [(2, 2.0), (4, 3.0)]
    (tmp_path / "e.csv").write_text("date,close\n")
    for name in ("e.csv", "x.json"):
        with pytest.raises(ValueError):
            artifacts.benchmark(spark, str(tmp_path / name))
    u = tmp_path / "u.txt"
    u.write_text("A\t2024-01-01\tnan\nB\t\t2024-02-01\n")
    assert [(r["symbol"], str(r["start"]), str(r["end"])) for r in one(artifacts.universe(spark, str(u)), "symbol")] == [("A", "2024-01-01", "None"), ("B", "None", "2024-02-01")]
    assert artifacts.parquet_if_any(spark, str(tmp_path / "none")) is None
    artifacts.csv_report(spark.createDataFrame([(1.5, "a"), (None, "b")], "x double, n string").coalesce(1), str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))
    assert "1.500000000000,a" in text


def test_experiments(spark):
    g = experiment.grid({"a": {"b": 1}}, {"a": {"b": "{1,2}"}, "c": [3, 4]})
    assert [(d["a"]["b"], d["c"]) for d in g] == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert experiment.grid({"x": 1}, cases=[{"x": 2}]) == [{"x": 2}]
    runs = [{"model": {"k": 1}, "backtest": 1}, {"model": {"k": 1}, "backtest": 2}, {"model": {"k": 2}}]
    assert experiment.deduplicated(runs) == [(0, 0), (1, 0), (2, 2)]
    profiles = {"base": {"columns": ["a", "b"]}, "more": {"extends": "base", "add_columns": ["c"]}, "most": {"extends": "more", "add_columns": ["d", "a"], "drop_columns": ["b"], "x": 1}}
    assert experiment.resolved(profiles, "most")["features"] == ["a", "c", "d"]
    with pytest.raises(ValueError):
        experiment.resolved({"a": {"extends": "a"}}, "a")
    assert experiment.repeated(["a", "b"], {"a": 3}) == ["a", "a__rep2", "a__rep3", "b"] and experiment.slug("A b--C!") == "a-b-c"
    assert experiment.parameter_grid(spark, {"x": [1, 2], "y": ["a"]}).count() == 2


def test_comparisons(spark):
    b = spark.createDataFrame([("r", 1, 0.04), ("r", 2, 0.02), ("r", 3, -0.01)], "run string, bucket int, mean_label double")
    s = compare.bucket_shape(b, middle=(2,)).first()
    assert (s["best_bucket"], s["worst_bucket"], s["top_bucket_label_rank"], s["bottom_bucket"]) == (1, 3, 1, 3) and s["bucket_label_spearman"] == -1.0 and s["middle_label_mean"] == 0.02
    assert s["top_minus_bottom"] == pytest.approx(0.05) and s["top_minus_middle_best"] == pytest.approx(0.02) and compare.bucket_shape(b, middle=(7,)).first()["middle_label_mean"] is None
    flat = spark.createDataFrame([("r", 1, 0.1), ("r", 2, 0.2), ("r", 3, 0.2), ("r", 4, 0.1)], "run string, bucket int, mean_label double")
    t = compare.bucket_shape(flat).first()
    assert (t["best_bucket"], t["worst_bucket"], t["top_bucket_label_rank"]) == (3, 1, 3)
    with pytest.raises(Exception, match="no top bucket"):
        compare.bucket_shape(b.where("bucket > 1")).collect()
    h = spark.createDataFrame([(1, "{'a': 1.0, 'b': 2}"), (2, "")], "date int, t string").select("date", compare.holdings(F.col("t")).alias("held"))
    o = one(compare.overlap(h, h.withColumn("held", F.array(F.lit("b"), F.lit("c"))).where("date = 1").union(h.where("date = 2"))), "date")
    assert (o[0]["n_union"], o[0]["n_common"], o[0]["n_only_a"], o[0]["n_only_b"]) == (3, 1, 1, 1) and o[1]["jaccard"] == 1.0
    rows = spark.createDataFrame([("r", i, float(i), float(-i)) for i in range(10)], "run string, period_start int, metric double, ret double")
    assert {r["bin"]: r["n"] for r in compare.validation_terciles(rows).collect()} == {"low": 3, "mid": 3, "high": 4} and compare.validation_terciles(rows.limit(8)).count() == 0
    m = spark.createDataFrame([("{\"x\": 1.5}",), ("{\"x\": {\"risk\": 2}}",), ("{}",)], "d string")
    assert [r[0] for r in m.select(compare.metric_of(F.col("d"), "x")).collect()] == [1.5, 2.0, None]
    g = compare.gates(spark.createDataFrame([(1.0, None)], "a double, b double"), {"a": 0.5, "b": 0.0}).first()
    assert g["failed_gates"] == "b" and not g["promoted"]


def test_candidate_pool(spark):
    """Roles from reports: all gates held, then one after the other lost."""
    good = {"annualized_return": 0.5, "sharpe_ratio": 2.0, "max_drawdown": -0.1}
    lost = {"a": {}, "b": {"annualized_return": 0.1}, "c": {"max_drawdown": -0.5}, "d": {"rank_avg_factor_baseline_win": 0.5}, "e": {"fixed_risk_rank_avg_factor_baseline_excess": 0.1, "fixed_risk_rank_avg_factor_baseline_win": 0.6, "rank_avg_factor_baseline_win": 0.5}}
    names = [*good, *(f"{b}_{x}" for b in ("rank_avg_factor_baseline", "fixed_risk_rank_avg_factor_baseline") for x in ("excess", "win"))]
    rows = [(r, *({**good, "rank_avg_factor_baseline_excess": 0.1, "rank_avg_factor_baseline_win": 0.6, **x}.get(n) for n in names)) for r, x in lost.items()]
    portfolio = spark.createDataFrame(rows, "run string, " + ", ".join(f"{n} double" for n in names))
    monthly = spark.createDataFrame([(r, m, 0.01) for r in lost for m in range(12)], "run string, month int, ret double")
    buckets = spark.createDataFrame([(r, b, 0.1 / b) for r in lost for b in range(1, 11)], "run string, bucket int, mean_label double")
    yearly = buckets.withColumn("year", F.lit(2020))
    aligned = spark.createDataFrame([(r, i, float(i), 0.01 * i, 0.0) for r in "abcd" for i in range(1, 13)], "run string, window_start int, valid_topk_excess_mean double, ret double, excess double")
    windows, periods = aligned.select("run", "window_start", "valid_topk_excess_mean"), aligned.select("run", F.col("window_start").alias("period_start"), F.col("window_start").alias("period_end"), "ret", "excess")
    bins = compare.signal_bins(compare.windows_with_rebalances(windows, periods))
    assert bins.count() == 12
    got = {r["run"]: r for r in compare.candidate_pool(portfolio, monthly, buckets, yearly, compare.validation_edges(bins)).collect()}
    assert {k: r["candidate_role"] for k, r in got.items()} == {"a": "ranker_and_sizer", "b": "research_archive", "c": "ranker_and_sizer", "d": "portfolio_candidate_requires_router", "e": "pool_selector_only"}
    assert got["a"]["failed_gates"] == "" and (got["a"]["passed_count"], got["a"]["total_count"]) == (8, 8) and got["c"]["failed_gates"] == "drawdown_control" and got["d"]["failed_gates"] == "beats_rank_avg_factor_baseline"
    assert got["e"]["failed_gates"] == "validation_metric_supports_risk_gate"


def test_labels_at_the_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in (-0.5, -0.3, -0.1, 0.0, 0.1, 0.3, 0.5)] + [(None,), (nan,)], "v double")
    got = [tuple(r) for r in df.select(labels.profit_bucket(F.col("v"), 0.1, 0.5), labels.buyability(F.col("v")), labels.buyability(F.col("v"), 0.1)).collect()]
    assert got == [(-2, 0, 0), (-1, 0, 0), (0, 0, None), (0, 0, None), (1, 1, None), (1, 1, 1), (2, 1, 1), (None, None, None), (None, None, None)]
    scale = lambda v, least: labels.robust_scale(spark.createDataFrame([(1, x) for x in v], "date int, v double"), "v", least=least).first()["scale"]
    assert scale([1.0, 2.0, 4.0], 0.1) == pytest.approx(1.4826) and scale([0.0, 0.0, 0.0, 3.0], 0.1) == pytest.approx(np.std([0, 0, 0, 3])) and scale([2.0, 2.0], 0.1) == 2.0 and scale([0.0, 0.0], 0.1) == 0.1
    rel = labels.relevance(spark.createDataFrame([(1, 0.1), (1, None), (1, 0.3), (2, None)], "date int, label double"), 2)
    assert sorted(r["relevance"] for r in rel.collect()) == [0, 0, 0, 1]
    whole = spark.createDataFrame([(3.0,), (5.0,), (None,)], "label double")
    assert labels.already_relevance(whole, 2) and not labels.already_relevance(whole, 1) and not labels.already_relevance(spark.createDataFrame([(0.5,), (1.0,)], "label double"), 9)
    assert sorted(r["relevance"] for r in labels.direct_relevance(whole).collect()) == [0, 0, 2]
    with pytest.raises(Exception, match="whole numbers"):
        labels.direct_relevance(spark.createDataFrame([(0.5,), (1.0,)], "label double")).collect()
    w = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert w.select(labels.combined_weights(F.col("a"), F.col("b"))).first()[0] == 6.0 and w.select(labels.combined_weights(None, F.col("b"))).first()[0] == 3.0


def _water(raw, most):
    """Shares with caps, by handing what is over to the others until nothing is."""
    out, rest = np.zeros(len(raw)), [i for i in range(len(raw)) if raw[i] > 0]
    left = 1.0
    while rest and left > 1e-15:
        total = sum(raw[i] for i in rest)
        over = [i for i in rest if raw[i] / total * left > most[i]]
        for i in over or rest:
            out[i] = most[i] if over else raw[i] / total * left
        if not over:
            break
        left -= sum(most[i] for i in over)
        rest = [i for i in rest if i not in over]
    return out


def test_caps_equal_handing_over():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 12))
        raw = np.round(rng.random(n) * rng.integers(0, 2, n), 2)
        most = np.where(rng.random(n) < 0.2, np.inf, np.round(rng.random(n), 2) + 0.01)
        assert np.allclose(simulate.leveled(raw, most), _water(raw, np.minimum(most, 2.0)))
    w, g = np.array([0.4, 0.3, 0.2, 0.1]), np.array(["x", "x", None, "y"], object)
    assert simulate.group_capped(w, g, 0.5) == pytest.approx([0.5 * 4 / 7, 0.5 * 3 / 7, 1 / 3, 1 / 6])


def test_wide_diagnostics_equal_the_long_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(dt.date(2024, 1 + d % 6, 1 + d % 20), f"s{k}", None if rng.random() < 0.1 else round(float(rng.normal()), 2), *(None if rng.random() < 0.2 else float(rng.integers(0, 9)) for _ in range(3))) for d in range(12) for k in range(int(rng.integers(1, 20)))]
    df = spark.createDataFrame(rows, "date date, symbol string, label double, a double, b double, c double").dropDuplicates(["date", "symbol"])
    long, wide = diagnostics.summary(diagnostics.long_form(df, ["a", "b", "c"]), 3), diagnostics.wide_summary(df, ["a", "b", "c"], 3)
    for x, y in zip(one(long, "feature"), one(wide.select(long.columns), "feature")):
        for c in long.columns:
            assert x[c] == y[c] or x[c] == pytest.approx(y[c], abs=1e-9), c
    assert diagnostics.wide_summary(df.where("false"), ["a"], 3).count() == 0


def test_correlations_of_many_features(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 200))
    x[rng.random(x.shape) < 0.1] = np.nan
    import pandas as pd

    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(200)])
    got = {(r["a"], r["b"]): r["corr"] for r in prefilter.correlations(spark.createDataFrame(frame).repartition(3), list(frame.columns)).collect()}
    want = frame.corr()
    assert len(got) == 200 * 199 // 2 and all(abs(c - want.loc[a, b]) < 1e-9 for (a, b), c in got.items())


def test_reports_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.123456, None), ("c", float("nan"), 2)], "name string, x double, n int")
    assert artifacts.markdown_table(df, 1) == "| name | x | n |\n| --- | --- | --- |\n| a\\|b | 0.1235 |  |\n\n1 more rows"
    text = artifacts.readme("Title", {"runs": 2}, {"Table": df})
    assert text.startswith("# Title\n\n- runs: 2\n\n## Table\n\n| name") and text.count("|") > 8
    artifacts.tsv_report(df, str(tmp_path / "t"))
    artifacts.json_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).columns == df.columns
    assert artifacts.csv_rows(spark, _csv(tmp_path, "b,a\n1,2\n"), ["a"]).columns == ["b", "a"]
    for bad, need in (("b,a\n", []), ("b\n1\n", ["a"])):
        with pytest.raises(ValueError):
            artifacts.csv_rows(spark, _csv(tmp_path, bad), need)


def _csv(folder, text):
    import uuid

    path = folder / f"{uuid.uuid4().hex}.csv"
    path.write_text(text)
    return str(path)


def test_yaml_documents():
    text = """
# a profile
name: "base # not a comment"
extends: ~
on: true
windows: {train: 600, valid: [1, 2.5, 'x, y']}
factors:
  - name: a
    expr: ts_mean(close, 5) / close
  - name: b   # with a comment
    expr: 'it''s'
list:
- 1
- [a, b]
-
  deep:
    deeper: 1e-3
empty:
"""
    assert artifacts.document(text) == {
        "name": "base # not a comment", "extends": None, "on": True, "windows": {"train": 600, "valid": [1, 2.5, "x, y"]},
        "factors": [{"name": "a", "expr": "ts_mean(close, 5) / close"}, {"name": "b", "expr": "it's"}], "list": [1, ["a", "b"], {"deep": {"deeper": 0.001}}], "empty": None,
    }
    assert artifacts.document("") == {} and artifacts.document('{"a": 1}') == {"a": 1}
    for bad in ("a: 1\n  - b", "just words"):
        with pytest.raises(ValueError):
            artifacts.document(bad)


def test_segments_beside_summaries(spark):
    s = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 6.0)], "feature string, x double, y double")
    e = spark.createDataFrame([("a", None, 9.0)], "feature string, x double, z double")
    assert {r["feature"]: tuple(r)[1:] for r in diagnostics.enriched(s, e).collect()} == {"a": (None, 5.0, 9.0), "b": (2.0, 6.0, None)}
    m = diagnostics.merged_batches({"r": s, "t": e})
    assert m.columns == ["run", "feature", "x", "y", "z"] and m.count() == 3
    summaries = spark.createDataFrame([("a", 0.03, -0.03, -0.2, 0.95), ("b", 0.01, 0.01, 0.3, 0.99), ("c", 0.05, 0.05, 0.1, 0.5)], "feature string, rank_ic_abs_mean double, rank_ic_mean double, rank_ic_ir double, coverage_pct double")
    report = diagnostics.batch_report(summaries, ["a", "b", "c"], 2)
    assert [r["feature"] for r in report["top_abs_rankic"].collect()] == ["c", "a"] and [r["feature"] for r in report["top_rankic_ir"].collect()] == ["b", "c"]
    assert report["counts"].first()["passing"] == 1


def test_profile_of_summaries(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(a * 2), float(b)) for a, b in zip(x, rng.normal(size=300))], "RSV5 double, twin double, other double")
    rows = [("RSV5", 0.99, 0.04, 0.3, 0.7, ""), ("TEMP_rsv_5", 0.99, 0.03, 0.2, 0.7, ""), ("twin", 0.99, 0.03, 0.2, 0.7, ""), ("other", 0.99, 0.03, 0.2, 0.7, ""), ("weak", 0.2, 0.0, 0.0, 0.7, "")]
    made = prefilter.build_profile(df.withColumn("TEMP_rsv_5", F.col("RSV5")), _summaries(spark, rows), 2)
    assert made["selected"] == ["RSV5", "other"] and made["dropped_duplicates"] == [("TEMP_rsv_5", "RSV5")] and made["dropped_correlated"] == [("twin", "RSV5")]
    assert made["steps"] == {"candidates": 5, "passing": 4, "without_duplicates": 3, "without_correlated": 2, "selected": 2}


def test_boosted_trees():
    import pandas as pd

    rng = np.random.default_rng(9)

    def frame(dates, n=40):
        x = rng.normal(size=(len(dates) * n, 4))
        x[rng.random(x.shape) < 0.05] = np.nan
        y = np.where(np.nan_to_num(x[:, 0]) > 0, 1.0, -1.0) * np.nan_to_num(x[:, 1]) + 0.1 * rng.normal(size=len(x))
        return pd.DataFrame(x, columns=list("abcd")).assign(label=y, date=np.repeat(dates, n))

    train, valid, test = frame(range(30)), frame(range(30, 40)), frame(range(40, 50))
    for objective in ("l2", "l1", "huber", "ranking"):
        s = boosting.Boosting(objective, rounds=150, rate=0.1, patience=20, least_rows=5)
        model = boosting.fit(train, valid, list("abcd"), s)
        assert np.corrcoef(model(test[list("abcd")].to_numpy()), test["label"])[0, 1] > 0.8, objective
        assert model.importance[:2].sum() > 5 * model.importance[2:].sum() and len(model.trees) == int(np.argmax(model.history)) + 1
    sign = [f.assign(label=(f["label"] > 0).astype(float)) for f in (train, valid, test)]
    p = boosting.fit(*sign[:2], list("abcd"), boosting.Boosting("binary", rounds=80, rate=0.1, least_rows=5))(sign[2][list("abcd")].to_numpy())
    assert ((p > 0.5) == (sign[2]["label"] > 0)).mean() > 0.85 and 0 <= p.min() <= p.max() <= 1
    # A tree's values are those of its leaves, found row by row.
    codes = boosting.coded(train[list("abcd")].to_numpy(), model.edges)
    f, last, left, right, value = model.trees[0]
    for k in range(50):
        at = 0
        while f[at] >= 0:
            at = left[at] if codes[k, f[at]] <= last[at] else right[at]
        assert boosting.tree_values(model.trees[0], codes[k : k + 1])[0] == value[at]
    score, y, day = np.array([0.9, 0.8, 0.8, 0.1]), np.array([1.0, 2.0, 100.0, 0.0]), np.zeros(4, int)
    assert boosting.metric(boosting.Boosting(metric="valid_topk_label_mean", topk=2), score, y, day) == 1.5
    empty = boosting.fit(train.head(0), valid.head(0), list("abcd"))
    assert not empty.trees and (empty(test[list("abcd")].to_numpy()) == 0).all()


def test_boosted_windows_and_reports(spark):
    rows = [(day(d), f"s{k}", 2.0 * k + d / 10, float(k)) for d in range(1, 21) for k in range(8)]
    df = spark.createDataFrame(rows, "date date, symbol string, label double, f double")
    learn = boosting.learner(boosting.Boosting(rounds=40, rate=0.2, least_rows=1, patience=5))
    windows = training.rolling_windows(df, 5, 3, 4, 2)
    out = training.walk_forward(df, windows, ["f"], learn)
    got = out.where("window_id = 0").groupBy("symbol").agg(F.avg("prediction").alias("p")).orderBy("symbol").collect()
    assert out.count() == 80 and np.all(np.diff([r["p"] for r in got]) > 0.2)
    gains = training.walk_forward(df, windows, ["f"], learn, report="importance").collect()
    assert len(gains) == 3 and all(r["feature"] == "f" and r["gain"] > 0 for r in gains)
    assert training.walk_forward(df, windows, ["f"], learn, report="history").groupBy("window_id").count().count() == 3


def test_traces_and_baselines(spark):
    rows = spark.createDataFrame([("s", d, i, float((d * k) % 5), 0.01 * k, 0.5) for d in range(6) for k, i in enumerate("abcd")], "scenario string, date int, instrument string, score double, label double, risk double")
    settings = {"s": simulate.Settings(topk=2, n_drop=1, account=1000.0, min_cost=0.0)}
    plain, traced = simulate.run_scenarios(rows, settings), simulate.run_scenarios(rows, settings, trace=True)
    a, b = one(plain, "date"), one(traced, "date")
    assert [r["account_value"] for r in a] == [r["end_value"] for r in b] and [len(r["holdings_after"]) for r in b] == [r["holdings"] for r in a]
    for x, y in zip(b, b[1:]):
        assert x["holdings_after"] == y["holdings_before"] and x["cash_after"] == y["cash_before"]
    assert all(set(r["buy_list"]).isdisjoint(r["holdings_before"]) for r in b)
    more, known = simulate.with_baselines(rows, {"flat": rows.select("date", "instrument", F.lit(1.0).alias("score"))}, "s", settings)
    made = simulate.run_scenarios(more, known)
    got = {r["scenario"]: r["risk"] for r in made.groupBy("scenario").agg(F.max("risk_degree").alias("risk")).collect()}
    assert got == {"s": 0.5, "flat": 0.5, "fixed_risk_flat": 0.95}
    full = metrics.full_report(made.where("scenario = 's'"), {"flat": made.where("scenario = 'flat'")}, keys=("scenario",))
    assert len(full.columns) == 1 + 36 + 1 and full.count() == 6
    pair = compare.strategy_pair({"trace": traced.drop("scenario")}, {"trace": traced.drop("scenario")})["trace"]
    assert pair.where("jaccard = 1 AND net_return_diff = 0").count() == 6


def test_training_table_and_periods(spark):
    w = spark.createDataFrame([("a", 3, 0.1), ("a", 5, 0.3), ("b", 4, None)], "run string, feature_count int, valid_topk_label_mean double")
    got = {r["run"]: r for r in compare.training_table(w, list(compare.SIGNALS)).collect()}
    assert got["a"]["window_count"] == 2 and got["a"]["feature_count_median"] == 4 and got["a"]["valid_topk_label_mean_max"] == 0.3 and got["b"]["valid_topk_label_mean_mean"] is None


def test_column_ranks_and_whole_groups(spark):
    import pandas as pd

    from alphaloom.operators.grouped import column_ranks

    rng = np.random.default_rng(10)
    for n, k in ((1, 1), (7, 3), (40, 5)):
        x = rng.integers(0, 6, (n, k)).astype(float)
        x[rng.random(x.shape) < 0.3] = np.nan
        assert np.allclose(column_ranks(x), pd.DataFrame(x).rank().to_numpy(), equal_nan=True)
    rows = [(d, f"s{i}", *(None if rng.random() < 0.2 else float(rng.integers(0, 9)) for _ in range(3))) for d in range(30) for i in range(int(rng.integers(1, 12)))] + [(99, "x", float("inf"), nan, None)]
    df = spark.createDataFrame(rows, "date int, symbol string, a double, b double, c double").repartition(5)
    got = crosssection.rank_pct(df, ["a", "b"])
    want = df.toPandas()
    for c in ("a", "b"):
        want[c] = want.where(np.isfinite(want[c])).groupby(want["date"])[c].rank(pct=True).where(np.isfinite(want[c]), want[c])
    order = ["date", "symbol"]
    assert got.columns == df.columns
    for c in ("a", "b", "c"):
        assert np.allclose(got.toPandas().sort_values(order)[c].to_numpy(float), want.sort_values(order)[c].to_numpy(float), equal_nan=True), c


def test_layers_overrides_and_job_batches():
    files = {"p.yaml": {"x": {"b": 2}, "y": 1}}
    profiles = {"base": {"x": {"a": 1, "b": 1}, "z": 0}, "next": {"extends": "base", "path": "p.yaml", "y": 5}, "loop": {"extends": "pool"}, "pool": {"extends": "loop"}}
    assert experiment.layered(profiles, "next", files.__getitem__) == {"x": {"a": 1, "b": 2}, "z": 0, "y": 5}
    for bad in ("loop", "nothing"):
        with pytest.raises(ValueError):
            experiment.layered(profiles, bad)
    made = experiment.composed({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, overrides=("a.c=2.5", "d.e=text", "f=[1, 2]", "g=true"))
    assert made == {"a": {"b": 3, "c": 2.5}, "d": {"e": "text"}, "f": [1, 2], "g": True}
    with pytest.raises(ValueError):
        experiment.composed({}, overrides=("a",))
    loaded, ran = [], []

    def run(job):
        ran.append((job["matrix_id"], job["shared"]))
        if job["matrix_id"] == "c":
            raise RuntimeError("no data")

    jobs = [{"matrix_id": m, "bundle": b} for m, b in (("a", 1), ("b", 2), ("c", 1), ("d", 2), ("e", 1))]
    told = experiment.run_jobs(jobs, run, {"d"}, shared="bundle", load=lambda b: loaded.append(b) or f"bundle {b}")
    assert [(t["matrix_id"], t["status"]) for t in told] == [("a", "success"), ("b", "success"), ("c", "failed"), ("d", "skipped_done"), ("e", "success")] and told[2]["detail"] == "RuntimeError: no data"
    assert loaded == [1, 2] and ran == [("a", "bundle 1"), ("c", "bundle 1"), ("e", "bundle 1"), ("b", "bundle 2")]
