"""Every core query runs on the smallest tables; those with SQL give the same rows as DuckDB. Set LOOMSPARK_DATA for other tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import compare

from loomspark.plans import registry

DATA = os.environ.get("LOOMSPARK_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return compare.views(DATA)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert registry.queries()[name](spark, DATA).count() >= 0
    else:
        assert compare.differ(spark, con, registry.queries()[name], sql, DATA) is None


def test_core_does_without_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "loomspark"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "loomspark.llm" not in path.read_text(), path
