"""Profiles of history length, record counts and source overlap."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.dates import days_between
from cohortloom.functions.text import name_token, title_case
from cohortloom.operators import aggregates, joins, sets, windows


def history_before_event(records: DataFrame, events: DataFrame, time: str) -> DataFrame:
    """Longest lead in days and record count before a patient's first event."""
    timed = records.select("PATIENT", time).join(events, "PATIENT")
    lead = timed.withColumn("days_before", days_between(F.col(time), F.col("first_cvd_date"))).filter("days_before > 0")
    return lead.groupBy("PATIENT").agg(
        F.max("days_before").alias("total_days_before"), F.count(F.lit(1)).alias("num_visits_before")
    )


def history_summary(per_patient: DataFrame) -> DataFrame:
    """Mean and median of both measures over patients."""
    return aggregates.summary_over_entities(per_patient, ["total_days_before", "num_visits_before"])


def numbered_visits(records: DataFrame, time: str, ties: list[str], name: str = "visit_number") -> DataFrame:
    """Visit number of each record in a patient's time order."""
    return windows.sequence_numbers(records, "PATIENT", [time, *ties], name)


def counts_by_status(observations: DataFrame, events: DataFrame, years: int = 4) -> DataFrame:
    """Records per patient in the first years, with the patient's status.

    Records are counted per day first: the status and the horizon are then
    applied to days, not to records.
    """
    days = aggregates.count_rows(observations, ["PATIENT", "DATE"], "n")
    kept = windows.horizon_filter(days, "PATIENT", "DATE", years, "first_obs", reduced=True)
    totals = kept.groupBy("PATIENT").agg(F.sum("n").alias("total_obs"))
    return joins.membership_flag(totals, events, ["PATIENT"], "CVD_status", "CVD", "Non-CVD")


def entities_of_files(files: DataFrame, patients: DataFrame, name: str = "file") -> DataFrame:
    """Patients matched to file names ``FIRST_LAST_...`` by normalised first and last name."""
    named = files.select(
        title_case(name_token(F.col(name), 0)).alias("FIRST"), title_case(name_token(F.col(name), 1)).alias("LAST")
    )
    return joins.inner(named, patients, ["FIRST", "LAST"]).select("Id", "FIRST", "LAST")


def overlap_report(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Sizes of all sources and of their pairwise intersections."""
    return sets.pair_counts(sets.membership(sources), list(sources))


def overlap_combinations(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Entities per exact combination of sources."""
    return sets.combination_counts(sets.membership(sources), list(sources))
