"""Duplicate weights, timestamps at the horizon, files by name, and what the closure writes."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import hierarchy, joins, windows
from cohortloom.plans import features
from cohortloom.session import shared_root
from cohortloom.sources import read_keyed_folder, write_named_files

STATS = "chromosome string, base_pair_location string, other_allele string, effect_allele string, beta double, p_value double"


def test_duplicate_weights_are_an_error_unless_one_is_chosen(spark):
    rows = [("1", "10", "G", "A", 0.5, 0.01), ("1", "10", "G", "A", 0.7, 0.001), ("2", "20", "T", "C", 0.1, 0.5)]
    stats = spark.createDataFrame(rows, STATS)
    twice, once = (spark.createDataFrame([(s,)], "SNP_ID string") for s in ("1_10_A_G", "2_20_C_T"))
    with pytest.raises(Exception, match="several weights"):
        joins.attach_weights(twice, stats).collect()
    assert joins.attach_weights(twice, stats, duplicates="best").select("beta").collect()[0][0] == 0.7
    # A duplicate of a SNP that is not asked for does no harm.
    assert joins.attach_weights(once, stats).select("beta").collect()[0][0] == 0.1
    with pytest.raises(ValueError):
        joins.attach_weights(once, stats, duplicates="sum")


@pytest.mark.parametrize("reduced", [False, True])
def test_horizon_of_timestamps_and_days(spark, reduced):
    rows = [(1, datetime(2000, 3, 1, 12)), (1, datetime(2004, 3, 1, 11)), (1, datetime(2004, 3, 1, 12)), (1, datetime(2004, 3, 1, 13))]
    kept = windows.horizon_filter(spark.createDataFrame(rows, "id int, at timestamp"), "id", "at", 4, "first", reduced)
    assert [r["at"].hour for r in kept.orderBy("at").collect()] == [12, 11, 12]
    days = [(1, date(2000, 2, 29)), (1, date(2004, 2, 28)), (1, date(2004, 2, 29)), (1, date(2004, 3, 1))]
    kept = windows.horizon_filter(spark.createDataFrame(days, "id int, at date"), "id", "at", 4, "first", reduced)
    assert kept.count() == 3


def test_files_by_name(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 7).alias("who"), F.format_string(" v %d,", "id").alias("value"))
    path = f"{tmp_path}/named"
    write_named_files(df, "who", path, "a_b_{}_c.csv")
    assert sorted(p.name for p in Path(path).glob("*.csv")) == [f"a_b_{k}_c.csv" for k in range(7)]
    back = read_keyed_folder(spark, path, spark.createDataFrame([], "value string").schema, "who")
    assert sorted((int(r["who"]), r["value"]) for r in back.collect()) == sorted((k % 7, f" v {k},") for k in range(60))


def test_closure_writes_each_id_once(spark):
    """A chain of 60 levels in rounds of four: what is stored is the result, whatever the number of rounds."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(60, 0), (5, 5)], "parent long, child long")
    before = set(Path(shared_root(spark)).rglob("closure-*"))
    found = hierarchy.descendants(edges, spark.createDataFrame([(3,)], "id long"))
    (folder,) = set(Path(shared_root(spark)).rglob("closure-*")) - before
    assert found.count() == found.distinct().count() == 61
    assert sum(spark.read.parquet(str(p)).count() for p in folder.glob("round=*")) == 61
    # One scan of one table, not a union of rounds.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_medians_of_few_features_equal_those_of_all(spark):
    rows = [(p, date(2000, 1, 1 + d), f"c{c}", float((p * 7 + d * 3 + c) % 11)) for p in range(9) for d in range(5) for c in range(4) if (p + c) % 3]
    daily = spark.createDataFrame(rows + [(99, date(2000, 1, 1), "c3", 1.0)], "PATIENT long, DATE date, CODE string, value double")
    events = spark.createDataFrame([(1, date(2000, 1, 3))], "PATIENT long, first_cvd_date date")
    want = {(r["PATIENT"], r["feature"]): r["median"] for r in features.x_agg(daily, events).filter("feature in ('c0', 'c2')").collect()}
    assert {(r["PATIENT"], r["feature"]): r["median"] for r in features.dense_medians(daily, ["c0", "c2"]).collect()} == want
