"""Dense tables are made and filled inside a patient's row, and pivots hold what keys have."""

from __future__ import annotations

import math
import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import shape, windows
from cohortloom.operators.aggregates import STATS
from cohortloom.plans import features
from cohortloom.session import materialize

KEYS = ["PATIENT", "CODE"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in (r[n] for n in names)]) for r in df.collect())


@pytest.fixture(scope="module")
def daily(spark):
    """Gaps, single values, days without a number, a patient without numbers and records without a patient."""
    rows = []
    for p in [*range(1, 12), None]:
        for c in ("a", "b", "c"):
            for k in range((p or 5) * (ord(c) - 88) % 7):
                at = date(2010, 1, 1) + timedelta(days=(k * k * 97 + (p or 0) * 31) % 1700)
                rows.append((p, at, c, None if p == 3 or k == 2 else float((k * 13 + (p or 0)) % 9)))
    rows += [(1, date(2010, 1, 1), "empty", None), (2, date(2010, 1, 1), None, 1.0), (1, date(2013, 12, 1), "late", 4.0), (3, date(2010, 1, 1), "a", None)]
    return spark.createDataFrame(rows, "PATIENT int, DATE date, CODE string, value double")


def test_nested_fills_equal_those_by_windows(spark, daily):
    nested, rows = materialize(features.nested_slices(daily)), features.slice_rows()
    long = materialize(windows.unfold(nested, KEYS, rows))
    assert long.count() == long.select(*KEYS, "slice").distinct().count() == daily.select("PATIENT").distinct().count() * 4 * 8
    assert long.filter("PATIENT is null and min is not null").isEmpty()
    for fill in (windows.fill_down, windows.fill_down_up):
        assert _rows(windows.unfold(fill(nested, KEYS, "slice", STATS, rows), KEYS, rows)) == _rows(fill(long, KEYS, "slice", STATS))
    for impute, keys in ((windows.impute_population_median, ["CODE"]), (windows.impute_never_observed, KEYS)):
        assert _rows(windows.unfold(impute(nested, *keys, STATS, rows), KEYS, rows)) == _rows(impute(long, *keys, STATS))
    whole = windows.impute_hierarchical(nested, *KEYS, rows=rows)
    assert _rows(windows.unfold(whole, KEYS, rows)) == _rows(windows.impute_hierarchical(long, *KEYS))


def test_dense_slices_are_neither_joined_nor_sorted(spark, daily):
    """Before, the grid was joined with the statistics and each fill sorted all of it."""
    nested, rows = features.nested_slices(daily), features.slice_rows()
    plan = _plan(windows.unfold(windows.fill_down_up(nested, KEYS, "slice", STATS, rows), KEYS, rows))
    assert "Join" not in plan
    # The one window is that of a patient's first day, before the grid is made.
    assert plan.count("Window ") == 1


def test_pivot_holds_only_what_a_key_has(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 4.0), (1, "b", None), (2, "b", 2.0), (None, "c", 3.0), (4, None, None)], "k int, name string, value double")
    got = shape.pivot_wide(df, ["k"], "name", "value", ["c", "a", "b"], "sum")
    assert got.columns == ["k", "c", "a", "b"]
    want = {(1, None, 5.0, None), (2, None, None, 2.0), (None, 3.0, None, None), (4, None, None, None)}
    assert {tuple(r) for r in got.collect()} == want
    # Before, each key held a value of each column in a hash map.
    assert "pivotfirst" not in _plan(shape.pivot_wide(df.filter("value <> 4"), ["k"], "name", "value", ["a", "b", "c"]))


def test_arrays_of_nested_rows_equal_those_of_the_long_table(spark, daily):
    events = spark.createDataFrame([(1, date(2012, 1, 1))], "PATIENT int, first_cvd_date date")
    nested = materialize(features.x_temp_nested(daily, events))
    long = materialize(features.x_temp(daily, events))
    found, want = features.feature_arrays(nested), features.feature_arrays(long)
    assert "Exchange" not in _plan(found).split("Subquery")[0]
    as_rows = lambda df: sorted((str(r.PATIENT), r.CVD, [x is not None and not math.isnan(x) and round(x, 9) for x in r.features]) for r in df.collect())
    assert as_rows(found) == as_rows(want)
