"""Every registered panel query against its DuckDB twin, and the shape of some plans."""

import math

import duckdb
import pytest

from alphaloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_query_equals_its_twin(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    got, twin = tidy(df.select(*want.columns).collect()), tidy(want.fetchall())
    assert len(got) == len(twin)
    differ = [(a, b) for a, b in zip(got, twin) if a != b]
    assert not differ, differ[:2]


def test_correlations_without_variance_equal_the_twins(spark, sf, tmp_path):
    """Suppliers whose first months have equal volumes, and returns that rise and fall."""
    con = duckdb.connect()
    for t in ("supplier", "nation", "region"):
        con.execute(f"COPY (SELECT * FROM '{sf}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    volumes = {1: (7, 3, 3, 5), 2: (4, 3, 3, 3), 3: (9, 2, 2, 2), 4: (5, 7, 7, 7), 5: (1, 1, 2, 3)}
    lines = ", ".join(f"({s * 10 + m}, {s}, {float(v)}, {v * p}, TIMESTAMP '1995-0{m + 1}-03')" for s, vs in volumes.items() for m, (v, p) in enumerate(zip(vs, (90.0, 110.0, 80.0, 85.5))))
    con.execute(f"COPY (SELECT CAST(k AS BIGINT) AS l_orderkey, CAST(1 AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey, 1 AS l_linenumber, q::DOUBLE AS l_quantity, x::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax, d AS l_shipdate FROM (VALUES {lines}) v(k, s, q, x, d)) TO '{tmp_path}/lineitem.parquet'")
    for t in ("supplier", "nation", "region", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("provider_events", "provider_semantic"):
        want = con.sql(catalogue.ORACLES[name])
        got = tidy(catalogue.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect())
        assert len(got) == 20 and got == tidy(want.fetchall()), name


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES and n != "all_factors"])
def test_query_without_twin_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark, sf):
    plan = catalogue.QUERIES["flagship_factors"](spark, sf)._jdf.queryExecution().toString()
    assert "l_returnflag" not in plan.split("ReadSchema")[1] and "Python" not in plan


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_no_plan_multiplies_tables(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_windows_scan_their_tables_once(spark, sf):
    """The calendar and the rows of walk-forward windows come from one scan each."""
    plan = catalogue.QUERIES["walk_forward"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 8, plan.count("Scan parquet")


def test_only_deleted_modules_may_be_absent(monkeypatch):
    import importlib

    import __spark_entry__

    def lost(name):
        raise ModuleNotFoundError("gone", name=lost.name)

    monkeypatch.setattr(importlib, "import_module", lost)
    lost.name = "alphaloom.llm"
    assert __spark_entry__._optional("alphaloom.llm.queries") is None
    lost.name = "zstandard"
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("alphaloom.llm.queries")
