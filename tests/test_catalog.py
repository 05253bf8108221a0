"""Every registered query against its SQL on DuckDB, whole results."""

import pytest

import oracle
from stitchwork.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    pytest.importorskip("duckdb")
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert oracle.compare(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


_PYTHON_KERNELS = {"x01_pixel_measures", "q07_pixel_qa"}
_WRITES_FIRST = {n for n in catalog.QUERIES if n[0] in "kst"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - _PYTHON_KERNELS - _WRITES_FIRST))
def test_plan_has_no_python_and_no_nested_loop(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan
