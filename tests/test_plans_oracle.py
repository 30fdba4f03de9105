"""Plan shape checks and the DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from veracity.plans.catalog import QUERIES
from veracity.plans.oracle import ORACLE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "ece" in df.columns and "auroc" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plan(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas",
                 "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{name}: {node}"


def test_scan_prunes_columns(spark):
    df = QUERIES["parse_main"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sdf.columns
    srows = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in sdf.collect()), key=repr)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(cols)
    idx = [rel.columns.index(c) for c in sorted(cols)]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == drows


def test_scan_pushes_filter(spark):
    plan = _plan(QUERIES["response_mask"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in plan


def test_report_is_partially_aggregated(spark):
    plan = _plan(QUERIES["calibration_batches"](spark, SF_SMALL))
    assert "partial_count" in plan and "partial_sum" in plan


def test_histogram_window_is_split(spark):
    """No window orders all distinct confidences in one partition: its keys hold the integer part."""
    plan = _plan(QUERIES["calibration_overall"](spark, SF_SMALL))
    assert "_b0" in plan
    for line in plan.splitlines():
        if "Window" in line and "conf" in line and "windowspecdefinition(" in line:
            assert "_b0" in line or "_b1" in line


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_single_partition_only_over_aggregates(spark, name):
    """A single-partition exchange may only gather already aggregated rows
    (partition counts, block totals, global aggregates), never raw rows."""
    lines = _plan(QUERIES[name](spark, SF_SMALL)).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1].strip().lstrip("+-: ")
            assert child.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")), (name, child[:80])


def test_every_test_module_imports():
    """A module that fails to import would hide all its tests."""
    import importlib.util
    import pathlib
    here = pathlib.Path(__file__).parent
    for path in sorted(here.glob("test_*.py")):
        if path != pathlib.Path(__file__):
            spec = importlib.util.spec_from_file_location(f"import_check_{path.stem}", path)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))


def test_base_queries_without_the_optional_packages(monkeypatch):
    """The base queries stay when a third-party module that only some operators need is missing."""
    import builtins
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.split(".")[0] == "zstandard" or name.startswith("veracity.llm"):
            raise ImportError(f"No module named {name!r}")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(E.queries()) == set(QUERIES)
    assert set(E.oracle_sql()) == set(ORACLE)
