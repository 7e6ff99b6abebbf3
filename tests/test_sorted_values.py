"""Statistics of daily values by a sort, and model input that is made without storing the dense table."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from cohortloom.operators import aggregates
from cohortloom.plans import features
from cohortloom.session import materialize


@pytest.fixture(scope="module")
def daily(spark):
    """Gaps, ties, even and odd counts, a patient without numbers, records without a patient, a feature first seen too late."""
    rows = []
    for p in [*range(1, 10), None]:
        for c in ("a", "b"):
            for k in range(((p or 4) * (ord(c) - 90)) % 6):
                rows.append((p, date(2010, 1, 1) + timedelta(days=(k * k * 97 + (p or 0) * 31) % 1400), c, None if p == 3 or k == 2 else float(k * 13 % 5)))
    rows += [(1, date(2010, 1, 1), "empty", None), (2, date(2010, 1, 1), None, 1.0), (1, date(2013, 12, 31), "late", 4.0), (3, date(2010, 1, 1), "a", None)]
    return spark.createDataFrame(rows, "PATIENT int, DATE date, CODE string, value double")


def _rows(df):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_sorted_values_give_the_same_statistics(spark, daily):
    """Before, every group held a map of its values."""
    for keys in (["PATIENT", "CODE"], ["CODE"], ["PATIENT"]):
        by_sort = aggregates.stats4(daily, keys, "value", reduced=True)
        assert _rows(by_sort) == _rows(aggregates.stats4(daily, keys, "value"))
        assert "percentile" not in by_sort._jdf.queryExecution().executedPlan().toString()


def test_model_input_of_rows_that_are_not_stored(spark, daily):
    events = spark.createDataFrame([(1, date(2012, 1, 1))], "PATIENT int, first_cvd_date date")
    want = features.feature_arrays(materialize(features.x_temp_nested(daily, events)))
    found = features.feature_arrays(features.x_temp_nested(daily, events, known_only=True), complete=True)
    assert _rows(found) == _rows(want) and found.count() == daily.select("PATIENT").distinct().count()
    # No value of any patient in any slice: no rows, as there is nothing to learn from.
    none = daily.filter("PATIENT = 3")
    assert features.feature_arrays(materialize(features.x_temp_nested(none, events))).isEmpty()
    assert features.feature_arrays(features.x_temp_nested(none, events, known_only=True), complete=True).isEmpty()
