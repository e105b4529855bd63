"""Batch helpers, the provider source and charts."""

import datetime as dt
import sys

import pytest
from pyspark.sql import functions as F

from alphaloom.operators import batches
from alphaloom.sources import connectors, plots


def test_periods_segments_and_provenance():
    config = {"train": ["2020-01-01", "2021-12-31"], "test": ["2022-01-01", "2022-06-30"]}
    assert batches.period(config, "all") == (dt.date(2020, 1, 1), dt.date(2022, 6, 30))
    a, b = dt.date(2020, 3, 1), dt.date(2021, 2, 1)
    assert batches.segments("yearly", a, b) == [("2020", a, dt.date(2020, 12, 31)), ("2021", dt.date(2021, 1, 1), b)]
    assert batches.segments("custom", a, b, custom=[("x", a, b), ("x", b, b)]) == [("x", a, b)] and batches.segments("none", a, b) == []
    assert [s[0] for s in batches.segments("config_split", a, b, config)] == ["train", "test"]
    assert len(batches.presets("full_space")) == 2 and len(batches.presets("quality_event_flow")) == 3
    assert '"columns": [\n  "a"\n ]' in batches.feature_profile("p", ["a", "b"], 1, {"period": "train"})
    for bad in (lambda: batches.feature_profile("p", [], 1, {"period": "test"}), lambda: batches.period(config, "valid"), lambda: batches.segments("x", a, b), lambda: batches.presets("x"), lambda: batches.one_day_labels({"backtest_label_horizon": 5})):
        with pytest.raises(ValueError):
            bad()


def test_bundle_checks(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", None), (2, "x", float("nan"))], "date int, instrument string, score double")
    s = batches.matrix_summary(df).first()
    assert (s["cells"], s["finite"], s["missing"], s["density"]) == (4, 1, 3, 0.25)
    assert batches.unique_pairs(df).count() == 3
    with pytest.raises(Exception, match="stands twice"):
        batches.unique_pairs(df.union(df)).collect()
    assert batches.labelled_dates(df, "score").count() == 2
    c = spark.createDataFrame([(dt.date(2024, 1, 2), True), (dt.date(2024, 1, 6), False)], "date date, is_open boolean")
    assert batches.latest_open(c, "2024-01-10") == dt.date(2024, 1, 2)
    with pytest.raises(ValueError):
        batches.latest_open(c, "2024-06-10")
    assert [r[0] for r in spark.createDataFrame([("600000",), ("900000",)], "s string").select(batches.shares(F.col("s"))).collect()] == [True, False]


def test_provider_source(spark, tmp_path, monkeypatch):
    (tmp_path / "fake_provider.py").write_text("def daily(symbol, start, end):\n    for y in range(start.year, end.year + 1):\n        yield (symbol, y, float(y))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}:{':'.join(sys.path)}")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_provider.py"))
    spark.dataSource.register(connectors.ProviderSource)
    df = spark.read.format("provider").option("fetch", "fake_provider:daily").option("symbols", "a, b").option("start", "1990-01-01").option("end", "2024-12-31").schema("symbol string, year int, value double").load()
    assert df.count() == 70 and df.rdd.getNumPartitions() == 6
    (tmp_path / "flaky_provider.py").write_text("import os\ndef daily(symbol, start, end):\n    if symbol == 'bad' and not os.path.exists(os.path.join(os.path.dirname(__file__), 'up')):\n        raise ConnectionError\n    yield (symbol, start.year, 1.0)\n")
    reader = connectors.ProviderReader({"fetch": "flaky_provider:daily", "symbols": "good,bad", "start": "2020-01-01", "end": "2020-12-31", "tries": "2", "wait": "0", "on_failure": "skip", "cache": str(tmp_path / "pages")})
    asked = lambda: [r for p in reader.partitions() for r in reader.read(p)]
    assert asked() == [("good", 2020, 1.0)] and len(list((tmp_path / "pages").iterdir())) == 1
    (tmp_path / "up").write_text("")
    assert asked() == [("good", 2020, 1.0), ("bad", 2020, 1.0)] == asked()
    reader.options |= {"on_failure": "raise", "cache": ""}
    (tmp_path / "up").unlink()
    with pytest.raises(ConnectionError):
        asked()
    assert connectors.ranges(dt.date(2000, 2, 29), dt.date(2000, 3, 1)) == [(dt.date(2000, 2, 29), dt.date(2000, 3, 1))]


def test_charts():
    svg = plots.lines({"a": [("2024-01-01", 0.0), ("2024-01-02", 1.0)], "<b>": []}, "t")
    assert svg.startswith("<svg") and "&lt;b&gt;" in svg and svg.count("<polyline") == 2
    assert plots.heatmap({(2024, 1): 0.1, (2024, 2): -0.2}).count("<rect") == 2 and plots.lines({}).endswith("</svg>")
