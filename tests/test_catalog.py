"""Every query with SQL against DuckDB on the smallest tables, and its plan."""

from __future__ import annotations

import re

import pytest

from cohortloom.catalog import QUERIES, SQL
from tests.compare import connect, difference
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df.toPandas(), con.execute(SQL[name]).df()) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)
    assert not found, found
