"""Small cases written by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import dates, numbers, text
from cohortloom.operators import aggregates, genomics, joins, metrics, shape, windows
from cohortloom.operators.aggregates import STATS
from cohortloom.plans import features, profiling


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day(text_):
    return dt.date.fromisoformat(text_)


def test_deviation_of_one_value_is_zero_but_of_none_is_null(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "k string, v double")
    stats = aggregates.stats4(df, ["k"], "v").withColumn("sd", aggregates.single_value_sd(F.col("sd"), F.col("min")))
    got = {r["k"]: r["sd"] for r in stats.collect()}
    assert got == {"a": 0.0, "b": None}


def test_leap_day_plus_four_years(spark):
    got = one(spark, dates.plus_years(F.lit("2016-02-29").cast("date"), 4))
    assert got == day("2020-02-29")
    assert one(spark, dates.plus_years(F.lit("2016-02-29").cast("date"), 1)) == day("2017-02-28")


def test_age_rounds_down_below_zero(spark):
    got = one(spark, dates.age_years(F.lit("2000-01-02").cast("date"), F.lit("2000-01-01").cast("date")))
    assert got == -1


@pytest.mark.parametrize(
    "raw, want",
    [("12.5", 12.5), (" 7 ", 7.0), ("1e3", 1000.0), ("1d", None), ("2F", None), ("NaN", None), ("never", None), ("", None)],
)
def test_numbers_in_text(spark, raw, want):
    assert one(spark, numbers.to_number(F.lit(raw))) == want


def test_words_and_names(spark):
    assert [one(spark, text.parse_bool(F.lit(w))) for w in ("TRUE", "t", "Yes", "1", "no", None)] == [True] * 4 + [False] * 2
    assert one(spark, text.title_case(F.lit("mary-ann de vries"))) == "Mary-Ann De Vries"
    assert one(spark, text.observed_allele(F.lit("A>C"))) == "C"
    assert one(spark, text.observed_allele(F.lit(" G "))) == "G"
    assert one(spark, text.name_token(F.lit("A_B_77_dna.csv"), 2)) == "77"
    assert one(spark, text.name_token(F.lit("A_B"), 2)) is None
    assert one(spark, text.strip_stat_suffix(F.lit("8480-6_median"))) == "8480-6"


def test_first_row_and_first_per_column_differ(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b")], "k int, t int, v string")
    assert aggregates.first_row(df, "k", ["t"], ["v"]).first()["v"] is None
    assert aggregates.first_per_column(df, "k", ["t"], ["v"]).first()["v"] == "b"


def test_latest_value_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "k int, t int, v string")
    assert aggregates.last_row(df, "k", ["t", "v"], ["v"]).first()["v"] == "b"


def test_membership_of_null_key_is_no(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r["k"]: r["f"] for r in joins.membership_flag(df, keys, ["k"], "f").collect()} == {"a": 1, None: 0}


def observations(spark, rows):
    return spark.createDataFrame([(p, day(d), c, float(v) if v is not None else None) for p, d, c, v in rows], "PATIENT string, DATE date, CODE string, value double")


CASES = [
    # p1: value in slices 1 and 3 of a; b only in slice 2; c never
    ("p1", "2020-01-01", "a", 1),
    ("p1", "2021-01-10", "a", 5),
    ("p1", "2021-01-12", "a", 7),
    ("p1", "2020-07-20", "b", 10),
    # p2: only c, twice in slice 1, and a row of text only
    ("p2", "2020-03-01", "c", 3),
    ("p2", "2020-03-05", "c", 4),
    ("p2", "2020-03-05", "text", None),
]


def labelled(spark):
    return spark.createDataFrame([("p1", day("2022-01-01"))], "PATIENT string, first_cvd_date date")


def test_x_agg_is_dense_and_marks_what_was_missing(spark):
    long = features.x_agg(observations(spark, CASES), labelled(spark)).collect()
    assert len(long) == 2 * 3  # the text-only feature is no column
    got = {(r["PATIENT"], r["feature"]): r for r in long}
    assert got["p1", "a"]["median"] == 5.0 and got["p1", "a"]["missing"] == 0 and got["p1", "a"]["CVD"] == 1
    assert got["p1", "b"]["sd"] == 0.0
    never = got["p2", "a"]
    assert (never["min"], never["max"], never["median"], never["missing"], never["CVD"]) == (1.0, 7.0, 5.0, 1, 0)


def test_x_temp_fills_forward_then_backward_and_keeps_the_indicator(spark):
    rows = features.x_temp(observations(spark, CASES), labelled(spark)).collect()
    assert len(rows) == 2 * 3 * 8
    got = {(r["PATIENT"], r["feature"], r["slice"]): r for r in rows}
    assert [got["p1", "a", s]["median"] for s in range(1, 9)] == [1.0, 1.0] + [6.0] * 6
    assert [got["p1", "a", s]["missing"] for s in range(1, 9)] == [0, 1, 0, 1, 1, 1, 1, 1]
    assert [got["p1", "b", s]["median"] for s in range(1, 9)] == [10.0] * 8
    # c of p1 is never observed: median of p2's eight forward-filled slices
    assert {got["p1", "c", s]["median"] for s in range(1, 9)} == {3.5}
    # a of p2: median over p1's filled slices 1, 1, 6, 6, 6, 6, 6, 6
    assert {got["p2", "a", s]["median"] for s in range(1, 9)} == {6.0}


def test_both_ways_to_impute_agree(spark):
    daily = observations(spark, CASES)
    dense = windows.impute_hierarchical(features.dense_slices(daily), "PATIENT", "CODE")
    nested = features.x_temp(daily, labelled(spark))
    columns = ["slice", *STATS, "missing"]
    a = sorted(map(tuple, dense.select("PATIENT", "CODE", *columns).collect()))
    b = sorted(map(tuple, nested.select("PATIENT", "feature", *columns).collect()))
    assert a == b


def test_patient_with_text_only_is_kept(spark):
    rows = [("p9", "2020-01-01", "text", None), *CASES]
    long = features.x_agg(observations(spark, rows), labelled(spark))
    assert long.filter("PATIENT = 'p9'").agg(F.count("median"), F.min("missing")).first()[:] == (3, 1)


def test_wide_tables_match_the_long_ones(spark):
    daily = observations(spark, CASES)
    wide = features.x_agg_wide(features.x_agg(daily, labelled(spark)), ["c", "a", "b"])
    assert wide.columns[2:7] == ["a_sd", "a_min", "a_max", "a_median", "a_missing"]
    flat = features.x_temp_flat(features.x_temp(daily, labelled(spark)), ["a", "b", "c"])
    assert flat.filter("PATIENT = 'p1'").first()["a_median_slice3"] == 6.0
    with pytest.raises(Exception, match="not dense"):
        features.x_agg_wide(features.x_agg(daily, labelled(spark)), ["a", "b"]).collect()
    nested = features.x_temp_nested(daily, labelled(spark))
    assert sorted(features.x_temp_wide(nested, ["c", "b", "a"]).collect()) == sorted(flat.collect())
    assert features.x_temp_wide(nested, ["a", "b", "c"]).columns == flat.columns
    for names in (["a", "b"], ["a", "b", "d"], ["a", "b", "c", "d"]):
        with pytest.raises(Exception, match="other features"):
            features.x_temp_wide(nested, names).collect()


def test_nested_rows_need_no_shuffle_after_the_entries(spark):
    """The fill and the wide table are one pass over the stored patients."""
    nested = features.x_temp_nested(observations(spark, CASES), labelled(spark))
    for table in (nested, features.x_temp_wide(nested, ["a", "b", "c"])):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_last_day_of_the_horizon_counts(spark):
    df = spark.createDataFrame([("p", day(d)) for d in ("2016-02-29", "2020-02-29", "2020-03-01")], "PATIENT string, DATE date")
    for reduced in (False, True):
        assert windows.horizon_filter(df, "PATIENT", "DATE", reduced=reduced).count() == 2


def test_days_on_or_after_the_event_can_be_left_out(spark):
    rows = spark.createDataFrame(
        [("p1", day("2020-01-01"), "a", "d", "1"), ("p1", day("2022-01-01"), "a", "d", "2"), ("p2", day("2022-01-01"), "a", "d", "3")],
        "PATIENT string, DATE date, CODE string, DESCRIPTION string, VALUE string",
    )
    assert features.daily_values(rows, censor=labelled(spark)).count() == 2


CALLS = [
    ("s1", "1", 100, "A", '"C, G"', "A>C", "True"),
    ("s1", "1", 100, "A", '"C, G"', " C ", "yes"),
    ("s1", "2", 200, "T", '"C"', "T>C", "false"),
    ("s2", "1", 100, "A", '"C, G"', "A", "True"),
]
CALL_SCHEMA = "PATIENT_ID string, CHROMOSOME string, LOCATION int, ANCESTRAL_ALLELE string, VARIANT_ALLELE_LIST string, ALLELE string, VARIANT string"
STATS_ROWS = [("1", "100.0", "A", "C", 0.5, 1e-6), ("1", "100.0", "A", "G", None, 0.01), ("9", "1.0", "A", "C", 3.0, 1e-9)]
STATS_SCHEMA = "chromosome string, base_pair_location string, effect_allele string, other_allele string, beta double, p_value double"


def test_dosage_counts_matching_variants(spark):
    got = {(r[0], r[1]): r[2] for r in genomics.dosage(spark.createDataFrame(CALLS, CALL_SCHEMA)).collect()}
    assert got == {("s1", "1_100_A_C"): 2, ("s1", "1_100_A_G"): 0, ("s1", "2_200_T_C"): 0, ("s2", "1_100_A_C"): 0, ("s2", "1_100_A_G"): 0}


def test_scores_by_cutoff(spark):
    dosages = genomics.dosage(spark.createDataFrame(CALLS, CALL_SCHEMA))
    weights = joins.attach_weights(genomics.snp_universe(dosages), spark.createDataFrame(STATS_ROWS, STATS_SCHEMA))
    assert weights.count() == 3 and weights.filter("beta is null").count() == 2
    s1 = genomics.weighted_scores(dosages, weights).filter("PATIENT_ID = 's1'").first()
    assert tuple(s1)[1:] == (1.0, 1.0, 0.0, 1.0)
    strict = genomics.weighted_scores(dosages, weights, strict_null=True).filter("PATIENT_ID = 's1'").first()
    assert tuple(strict)[1:] == (None, 1.0, 0.0, 1.0)


def test_dense_scores_need_every_used_call(spark):
    dosages = genomics.dosage(spark.createDataFrame(CALLS, CALL_SCHEMA))
    weights = spark.createDataFrame([("1_100_A_C", 0.5, 0.01), ("2_200_T_C", 0.1, 1e-6)], "SNP_ID string, beta double, p_value double")
    got = {r[0]: tuple(r)[1:] for r in genomics.weighted_scores_dense(dosages, weights).collect()}
    assert got["s1"] == (1.0, 0.0, 0.0, 1.0)
    assert got["s2"] == (None, None, 0.0, None)


def test_aligned_weights_keep_the_sign_of_the_effect_allele(spark):
    snps = spark.createDataFrame([("1_5_A_C",), ("1_6_G_T",)], "SNP_ID string")
    stats = spark.createDataFrame([("1", "5.0", "A", "C", 0.2, 0.1), ("1", "6.0", "T", "G", 0.3, 0.1)], STATS_SCHEMA)
    got = {r["SNP_ID"]: r["beta"] for r in joins.attach_weights(snps, stats, align=True).collect()}
    assert got == {"1_5_A_C": -0.2, "1_6_G_T": 0.3}
    plain = {r["SNP_ID"]: r["beta"] for r in joins.attach_weights(snps, stats).collect()}
    assert plain == {"1_5_A_C": 0.2, "1_6_G_T": None}


def test_genotype_vectors_hold_positions_in_order(spark):
    dosages = genomics.dosage(spark.createDataFrame(CALLS, CALL_SCHEMA))
    index = spark.createDataFrame([("1_100_A_C", 1), ("1_100_A_G", 0), ("9_9_A_C", 2)], "SNP_ID string, snp_index int")
    got = {r[0]: (r[1], r[2]) for r in genomics.genotype_vectors(dosages, index).collect()}
    assert got == {"s1": ([0, 1], [0, 2]), "s2": ([0, 1], [0, 0])}


def test_duplicate_weights_keep_the_smallest_p_value(spark):
    rows = spark.createDataFrame([("x", 0.1, 0.5), ("x", 0.2, 0.01), ("x", 0.3, None)], "SNP_ID string, beta double, p_value double")
    assert tuple(joins.one_weight_per_snp(rows).select("beta", "p_value").first()) == (0.2, 0.01)


def test_interval_map_meets_a_block_over_many_bins_once(spark):
    blocks = spark.createDataFrame([("1", 0, 1000, 7)], "chrom string, lo int, hi int, off int")
    at = spark.createDataFrame([("1", 0), ("1", 999), ("1", 1000), ("1", 1001), ("2", 5)], "c string, pos int")
    got = joins.map_intervals(at, blocks, "c", "pos", bin_width=10)
    assert sorted(r["mapped_position"] for r in got.collect()) == [7, 1006, 1007]
    assert joins.map_intervals(at, blocks, "c", "pos", bin_width=10, keep_unmapped=True).count() == 5


def scored(spark, rows):
    return spark.createDataFrame([("r", y, float(p)) for y, p in rows], "run string, y int, p double")


def test_metrics_with_tied_scores(spark):
    df = scored(spark, [(1, 0.9), (0, 0.9), (1, 0.2), (0, 0.1)])
    m = metrics.binary_metrics(df, ["run"], "y", "p").first()
    assert m["roc_auc"] == pytest.approx(0.625)
    assert m["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert (m["precision"], m["recall"], m["f1"], m["balanced_accuracy"], m["accuracy"]) == (0.5, 0.5, 0.5, 0.5, 0.5)
    points = metrics.roc_points(df, ["run"], "y", "p").count()
    assert points == 4  # three distinct scores and the origin


def test_metrics_without_positive_predictions(spark):
    m = metrics.binary_metrics(scored(spark, [(1, 0.1), (0, 0.2)]), ["run"], "y", "p").first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "x double")
    got = {r["bin"]: r["n"] for r in aggregates.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 1, 4: 1}
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r["bin"]: r["n"] for r in aggregates.histogram(same, "x", 5).collect()} == {0: 2}


def test_all_null_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "k int, `8480.6` double, c string")
    assert shape.drop_all_null_columns(df, ["k"]).columns == ["k", "c"]


def test_names_with_dots_unpivot(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, `8480.6` double, b double")
    assert {r["feature"]: r["value"] for r in shape.unpivot_long(df, ["k"]).collect()} == {"8480.6": 2.0, "b": 3.0}


def test_history_ignores_records_on_the_event_day(spark):
    rows = spark.createDataFrame([("p1", day(d)) for d in ("2021-12-30", "2022-01-01", "2023-01-01")], "PATIENT string, START date")
    got = profiling.history_before_event(rows, labelled(spark), "START").collect()
    assert [tuple(r) for r in got] == [("p1", 2, 1)]


def test_tags_of_result_names(spark):
    df = spark.createDataFrame([(n,) for n in ("X_agg", "Xtemp_EF", "X_temp_earlyfusion")], "data_type string")
    got = {r["data_type"]: (r["Data"], r["Fusion"]) for r in metrics.tag_results(df).collect()}
    assert got == {"X_agg": ("X_agg", "None"), "Xtemp_EF": ("X_temp", "Early Fusion"), "X_temp_earlyfusion": ("X_temp", "Early Fusion")}


def test_pivot_of_an_unlisted_name_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", None)], "k int, name string, value double")
    assert sorted(map(tuple, shape.pivot_wide(df, ["k"], "name", "value", ["a", "b"]).collect())) == [(1, 1.0, 2.0), (2, None, None)]
    with pytest.raises(Exception, match="has no column: b"):
        shape.pivot_wide(df, ["k"], "name", "value", ["a"]).collect()


def test_a_feature_first_seen_after_the_last_slice_has_rows(spark):
    days = [(1, "2020-01-01", "early", 1.0), (1, "2023-12-20", "late", 2.0), (2, "2020-01-01", "early", 3.0)]
    daily = spark.createDataFrame(days, "PATIENT int, DATE string, CODE string, value double").withColumn("DATE", F.to_date("DATE"))
    events = spark.createDataFrame([], "PATIENT int, first_cvd_date date")
    rows = features.x_temp(daily, events, n_slices=2).collect()
    assert sorted((r.PATIENT, r.feature, r.slice) for r in rows) == [(p, f, n) for p in (1, 2) for f in ("early", "late") for n in (1, 2)]
    assert all(r.median is None and r.missing == 1 for r in rows if r.feature == "late")
