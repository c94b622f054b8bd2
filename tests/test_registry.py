"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from compare import connect, difference
import __spark_entry__ as entry_point
from jobfleet.queries import oracle, registry

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert registry.queries().keys() == oracle.oracle_sql().keys()
    assert registry.queries().keys() <= entry_point.queries().keys()


@needs_tables
@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_sql(spark, con, name):
    frame = entry_point.queries()[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert difference(frame, con, entry_point.oracle_sql()[name]) is None


@needs_tables
def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
