"""Code lists to cohort labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import aggregates, joins, sets


def code_table(conditions: DataFrame, list_a: DataFrame, list_b: DataFrame) -> DataFrame:
    """Row count per code and description, flagged by membership in either list."""
    listed = sets.union(list_a, list_b, "CODE")
    counted = aggregates.count_rows(conditions, ["CODE", "DESCRIPTION"])
    return joins.membership_flag(counted, listed, ["CODE"], "CVD")


def first_events(conditions: DataFrame, codes: DataFrame) -> DataFrame:
    """First day with a flagged code per patient.

    A semi-join: a code listed under several descriptions must not multiply rows.
    """
    cases = joins.keep_members(conditions, codes.filter(F.col("CVD") == 1), ["CODE"])
    return aggregates.first_event(cases, "PATIENT", "START", "first_cvd_date")


def first_events_of_lists(conditions: DataFrame, list_a: DataFrame, list_b: DataFrame) -> DataFrame:
    """The same straight from the two lists, without counting the codes first: one pass over the log."""
    cases = joins.keep_members(conditions, sets.union(list_a, list_b, "CODE"), ["CODE"])
    return aggregates.first_event(cases, "PATIENT", "START", "first_cvd_date")


def label_rows(rows: DataFrame, events: DataFrame, name: str = "CVD") -> DataFrame:
    """Ever/never label on every row of a patient."""
    return joins.membership_flag(rows, events, ["PATIENT"], name)


def label_observations(conditions: DataFrame, list_a: DataFrame, list_b: DataFrame, observations: DataFrame) -> DataFrame:
    """From two code lists and the condition log to labelled observations."""
    return label_rows(observations, first_events(conditions, code_table(conditions, list_a, list_b)))
