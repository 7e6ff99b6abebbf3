"""Feature tables: one row per patient and feature, or per patient, feature and slice.

Events are reduced to daily means before they are grouped by patient, so a
patient with very many records is bounded by days times codes. From there all
steps share one partitioning by patient. The features of a patient are then
kept as one nested row: the dense tables are generated from it without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import aggregates, joins, shape, windows
from cohortloom.operators.aggregates import STATS
from cohortloom.session import materialize

ALL_STATS = (*STATS, "missing")


def chosen_observations(observations: DataFrame, choice: DataFrame) -> DataFrame:
    """Observations whose description is marked ``Y`` in the feature choice list."""
    return joins.keep_members(observations, choice.filter(F.col("`keep.`") == "Y"), ["DESCRIPTION"])


def daily_values(
    observations: DataFrame, choice: DataFrame | None = None, years: int = 4, censor: DataFrame | None = None
) -> DataFrame:
    """(PATIENT, DATE, CODE, value) in the first ``years`` years of the chosen features.

    ``censor`` is an optional table (PATIENT, first_cvd_date): days on or after
    that date are then left out.
    """
    chosen = chosen_observations(observations, choice) if choice is not None else observations
    daily = aggregates.daily_mean(chosen, ["PATIENT", "DATE", "CODE"], "VALUE")
    kept = windows.horizon_filter(daily, "PATIENT", "DATE", years, "first_obs_date", reduced=True).drop("first_obs_date")
    if censor is None:
        return kept
    joined = kept.join(censor.select("PATIENT", "first_cvd_date"), "PATIENT", "left")
    return joined.filter(F.col("first_cvd_date").isNull() | (F.col("DATE") < F.col("first_cvd_date"))).drop("first_cvd_date")


def _with_label(per_patient: DataFrame, events: DataFrame) -> DataFrame:
    return joins.membership_flag(per_patient, events, ["PATIENT"], "CVD")


def _stats_row(*first: Column) -> Column:
    sd = aggregates.single_value_sd(F.col("sd"), F.col("min")).alias("sd")
    return F.struct(*first, sd, F.col("min"), F.col("max"), F.col("median"))


def _feature_list(nested: DataFrame) -> Column:
    """All features that have a value, as one array: the columns of the wide table."""
    names = nested.select(F.explode("features.feature").alias("feature")).distinct()
    return names.agg(F.array_sort(F.collect_set("feature")).alias("all_features")).scalar()


def x_agg(daily: DataFrame, events: DataFrame) -> DataFrame:
    """(PATIENT, CVD, feature, sd, min, max, median, missing), dense over patients and features.

    A feature a patient never has is marked missing and gets the population medians.
    """
    # Daily values meet once, by patient; the groups of features are inside that.
    per_feature = aggregates.stats4(daily.repartition("PATIENT"), ["PATIENT", "CODE"], "value", reduced=True)
    entry = F.when(F.col("median").isNotNull(), _stats_row(F.col("CODE").alias("feature")))
    nested = per_feature.groupBy("PATIENT").agg(F.collect_list(entry).alias("features"))
    nested = materialize(_with_label(nested, events), "x-agg")
    observed = nested.select(F.explode("features").alias("f")).select("f.*")
    medians = materialize(windows.population_medians(observed, "feature", STATS), "medians")
    names = [F.col(s).alias(f"typical_{s}") for s in STATS]
    dense = nested.withColumn("_all", _feature_list(nested)).select(
        "PATIENT",
        "CVD",
        F.explode(
            F.concat(
                F.transform(
                    F.array_except("_all", "features.feature"),
                    lambda f: F.struct(f.alias("feature"), *[F.lit(None).cast("double").alias(s) for s in STATS]),
                ),
                F.col("features"),
            )
        ).alias("f"),
    )
    joined = dense.select("PATIENT", "CVD", "f.*").join(medians.select("feature", *names), "feature")
    return joined.select(
        "PATIENT",
        "CVD",
        "feature",
        *[F.coalesce(s, f"typical_{s}").alias(s) for s in STATS],
        shape.missing_indicator(F.col("median")).alias("missing"),
    )


def dense_medians(daily: DataFrame, codes: Sequence[str]) -> DataFrame:
    """(PATIENT, feature, median) of a few features for every patient: those of ``x_agg``, without the other features.

    Only values of the listed codes are grouped and ranked.
    """
    daily = materialize(daily, "daily")
    own = daily.filter(F.col("CODE").isin(*codes)).groupBy("PATIENT", "CODE").agg(F.median("value").alias("median"))
    own = materialize(own.withColumnRenamed("CODE", "feature"), "factor-medians")
    typical = materialize(windows.population_medians(own, "feature", ["median"]), "medians").withColumnRenamed("median", "typical")
    listed = F.explode(F.array(*[F.lit(c) for c in codes])).alias("feature")
    every = daily.select("PATIENT").distinct().select("PATIENT", listed)
    filled = every.join(own, ["PATIENT", "feature"], "left").join(typical, "feature", "left")
    return filled.select("PATIENT", "feature", F.coalesce("median", "typical").alias("median"))


def _columns_from_cells(long: DataFrame, place: Sequence[str], cells: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Wide table from a dense long one: one shuffle gathers a patient's cells in order, then columns are picked by place.

    ``cells`` are the expected (feature[, slice]) in sorted order; their number
    is the width of the table, which bounds what is gathered per patient. A
    patient with other cells is an error, not a shifted row.
    """
    cell = F.struct(*place, *ALL_STATS)
    gathered = long.groupBy("PATIENT", "CVD").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    wrong = F.raise_error(F.lit("the long table is not dense over the listed columns"))
    expected = F.array(*[F.lit(f"{c[0]}|{c[1]}" if len(c) > 1 else c[0]) for c in cells])
    found = F.transform("cells", lambda c: F.concat_ws("|", *[c[p].cast("string") for p in place]))
    checked = gathered.withColumn("cells", F.when(found == expected, F.col("cells")).otherwise(wrong.cast(gathered.schema["cells"].dataType)))
    picked = [f"cells[{i}].{s}" for i in range(len(cells)) for s in ALL_STATS]
    return checked.selectExpr("PATIENT", "CVD", *[f"{p} as `{n}`" for p, n in zip(picked, names)])


def x_agg_wide(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """Columns ``<feature>_<sd|min|max|median|missing>`` per patient."""
    ordered = sorted(features)
    names = [f"{f}_{s}" for f in ordered for s in ALL_STATS]
    return _columns_from_cells(long, ["feature"], [(f,) for f in ordered], names)


def dense_slices(daily: DataFrame, days: int = 180, n_slices: int = 8) -> DataFrame:
    """(PATIENT, CODE, slice) for every slice, patient and feature, with the raw statistics."""
    return windows.unfold(nested_slices(daily, days, n_slices), ["PATIENT", "CODE"], slice_rows(n_slices))


def slice_rows(n_slices: int = 8) -> list[str]:
    """Names of the columns of ``nested_slices`` that hold a slice each."""
    return [f"slice{n}" for n in range(1, n_slices + 1)]


def nested_slices(daily: DataFrame, days: int = 180, n_slices: int = 8) -> DataFrame:
    """(PATIENT, CODE, slice1, slice2, ...) for every patient and feature: each slice is one struct (slice, sd, min, max, median).

    Only the statistics that exist are gathered; gaps and features that a patient never has are added inside the
    patient's row, so the dense table is neither joined, shuffled nor sorted. The daily values are read several
    times, so they are written once first.
    """
    daily = materialize(daily, "daily")
    sliced = windows.anchored_slices(daily, "PATIENT", "DATE", days, n_slices, reduced=True)
    per_slice = aggregates.stats4(sliced, ["PATIENT", "CODE", "slice"], "value")
    # Records without a patient give a patient without statistics.
    known = F.col("median").isNotNull() & F.col("PATIENT").isNotNull() & F.col("CODE").isNotNull()
    entries = F.collect_list(F.when(known, F.struct("slice", *STATS)))
    per_feature = per_slice.groupBy("PATIENT", "CODE").agg(entries.alias("entries"))
    listed = F.when(F.size("entries") > 0, F.struct("CODE", "entries"))
    nested = per_feature.groupBy("PATIENT").agg(F.collect_list(listed).alias("features"))
    valued = daily.filter(F.col("value").isNotNull()).select("CODE").distinct()
    names = valued.agg(F.array_sort(F.collect_set("CODE")).alias("names")).scalar()
    never = F.transform(F.array_except("_names", "features.CODE"), lambda f: F.struct(f.alias("CODE"), F.array().alias("entries")))
    every = F.concat("features", never.cast(nested.schema["features"].dataType))
    cells = nested.withColumn("_names", names).select("PATIENT", F.explode(every).alias("c")).select("PATIENT", "c.CODE", "c.entries")

    def at(n: int) -> Column:
        return F.get("entries", (F.array_position("_held", F.lit(n)) - 1).cast("int"))

    placed = cells.withColumn("_held", F.col("entries.slice")).select("PATIENT", "CODE", *[at(n + 1).alias(r) for n, r in enumerate(slice_rows(n_slices))])
    slices = [F.struct(F.lit(n + 1).alias("slice"), *[F.col(r)[s].alias(s) for s in STATS]).alias(r) for n, r in enumerate(slice_rows(n_slices))]
    return placed.select("PATIENT", "CODE", *slices)


def _carried(entry: Column, until: Column, since: Column) -> Column:
    """``entry`` once for each slice from ``since`` up to ``until``, the latter excluded."""
    return F.array_repeat(entry, (until - since).cast("int"))


def _slice_after(entries: Column, place: Column, n_slices: int) -> Column:
    return F.coalesce(F.get(entries["slice"], place + 1), F.lit(n_slices + 1))


def _patient_entries(daily: DataFrame, events: DataFrame, days: int, n_slices: int) -> DataFrame:
    """(PATIENT, CVD, features): a patient's features with their own slices, both in order."""
    sliced = windows.anchored_slices(daily, "PATIENT", "DATE", days, n_slices, reduced=True)
    per_slice = aggregates.stats4(sliced, ["PATIENT", "CODE", "slice"], "value", reduced=True)
    entry = F.when(F.col("median").isNotNull(), _stats_row(F.col("slice")))
    per_feature = per_slice.groupBy("PATIENT", "CODE").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    listed = F.when(F.size("entries") > 0, F.struct(F.col("CODE").alias("feature"), F.col("entries")))
    return _with_label(per_feature.groupBy("PATIENT").agg(F.collect_list(listed).alias("features")), events)


def _typical_row(daily: DataFrame, nested: DataFrame, n_slices: int) -> DataFrame:
    """One row ``typical``: every feature in order, with the population medians of the forward-filled table.

    An entry that is carried over several slices is one row with that weight. Features that are first seen after the
    last slice are in the list too, with null medians. The row's size is the number of features.
    """
    entries = nested.select(F.explode("features").alias("f")).select(
        "f.feature",
        F.explode(
            F.transform(
                "f.entries",
                lambda e, i: F.struct(e.alias("e"), (_slice_after(F.col("f.entries"), i, n_slices) - e["slice"]).alias("times")),
            )
        ).alias("w"),
    )
    entries = entries.select("feature", "w.times", *[F.col(f"w.e.{s}").alias(s) for s in STATS])
    medians = windows.population_medians(entries, "feature", STATS, F.col("times"))
    valued = daily.filter(F.col("value").isNotNull()).select(F.col("CODE").alias("feature")).distinct()
    row = F.struct(F.col("feature"), F.lit(0).alias("slice"), *[F.col(s) for s in STATS])
    return valued.join(medians, "feature", "left").agg(F.array_sort(F.collect_list(row)).alias("typical"))


def x_temp_nested(daily: DataFrame, events: DataFrame, days: int = 180, n_slices: int = 8, known_only: bool = False) -> DataFrame:
    """(PATIENT, CVD, cells): one row per patient with all features in order, each with all slices filled.

    ``cells`` is an array of (feature, slices); ``slices`` has (slice, sd, min, max, median, missing). The whole fill
    happens inside the row: a patient's features are merged with the one row of all features, and each entry is
    repeated until the next one. There is no window, join or shuffle after the entries have been gathered.

    With ``known_only`` features that no slice of any patient has are left out (without any feature, all rows): the rows
    can then be turned into model input as they are made, ``feature_arrays(complete=True)``, and need not be stored.
    """
    daily = materialize(daily, "daily")
    nested = materialize(_patient_entries(daily, events, days, n_slices), "x-temp")
    typical = materialize(_typical_row(daily, nested, n_slices), "typical")
    if known_only:
        # A feature has a median as soon as one slice of one patient has a value; one without a name has none.
        typical = typical.select(F.filter("typical", lambda f: f["median"].isNotNull()).alias("typical"))
        named = F.filter("features", lambda f: f["feature"].isNotNull())
        nested = nested.filter(F.size(typical.scalar()) > 0).withColumn("features", named)
    typical = typical.scalar()

    kind = nested.schema["features"].dataType.simpleString()
    never = F.transform(
        F.array_except("_typical.feature", "features.feature"), lambda f: F.struct(f.alias("feature"), F.array().alias("entries"))
    )
    every = F.array_sort(F.concat("features", never.cast(kind)))

    def slices_of(entries: Column, usual: Column) -> Column:
        # The first entry also fills the slices before it.
        runs = F.transform(
            entries, lambda e, i: _carried(e, _slice_after(entries, i, n_slices), F.when(i == 0, 1).otherwise(e["slice"]))
        )
        blank = F.struct(F.lit(0).alias("slice"), *[F.lit(None).cast("double").alias(s) for s in STATS])
        filled = F.when(F.size(entries) > 0, F.flatten(runs)).otherwise(F.array_repeat(blank, n_slices))
        return F.transform(
            filled,
            lambda e, j: F.struct(
                (j + 1).alias("slice"),
                *[F.coalesce(e[s], usual[s]).alias(s) for s in STATS],
                (e["slice"] != j + 1).cast("int").alias("missing"),
            ),
        )

    cell = lambda own, usual: F.struct(own["feature"].alias("feature"), slices_of(own["entries"], usual).alias("slices"))
    placed = nested.withColumn("_typical", typical).withColumn("_every", every)
    return placed.select("PATIENT", "CVD", F.zip_with("_every", "_typical", cell).alias("cells"))


def x_temp(daily: DataFrame, events: DataFrame, days: int = 180, n_slices: int = 8) -> DataFrame:
    """(PATIENT, CVD, feature, slice, sd, min, max, median, missing) with every slice of every patient.

    A slice takes its own value, else that of the last slice before, else of
    the next one. A patient who never has the feature gets the population
    medians of the forward-filled table; null for a feature that no slice of any
    patient has. The indicator tells what was missing before any fill.
    """
    nested = x_temp_nested(daily, events, days, n_slices)
    features = nested.select("PATIENT", "CVD", F.explode("cells").alias("c"))
    return features.select("PATIENT", "CVD", "c.feature", F.inline("c.slices"))


def _listed_cells(cells: Column, names: Sequence[str], kind: str) -> Column:
    """``cells`` if they are of exactly the listed features, else an error: never a shifted row."""
    wrong = F.raise_error(F.lit("the table has other features than the listed ones")).cast(kind)
    return F.when(cells["feature"] == F.array(*[F.lit(f) for f in names]), cells).otherwise(wrong)


def x_temp_wide(nested: DataFrame, features: Sequence[str], n_slices: int = 8) -> DataFrame:
    """Columns ``<feature>_<statistic>_slice<n>`` per patient, picked from the nested rows by place: no shuffle."""
    ordered = sorted(features)
    checked = nested.withColumn("cells", _listed_cells(F.col("cells"), ordered, nested.schema["cells"].dataType.simpleString()))
    picked = [
        f"cells[{i}].slices[{n - 1}].{s} as `{f}_{s}_slice{n}`"
        for i, f in enumerate(ordered)
        for n in range(1, n_slices + 1)
        for s in ALL_STATS
    ]
    return checked.selectExpr("PATIENT", "CVD", *picked)


def x_temp_flat(long: DataFrame, features: Sequence[str], n_slices: int = 8) -> DataFrame:
    """Columns ``<feature>_<statistic>_slice<n>`` per patient, from a stored long table; see also ``x_temp_wide``."""
    cells = [(f, n) for f in sorted(features) for n in range(1, n_slices + 1)]
    names = [f"{f}_{s}_slice{n}" for f, n in cells for s in ALL_STATS]
    return _columns_from_cells(long, ["feature", "slice"], cells, names)


def feature_arrays(table: DataFrame, keys: Sequence[str] = ("PATIENT", "CVD"), complete: bool = False) -> DataFrame:
    """Model input straight from a stored table: one array per patient in order of feature, slice, statistic.

    The table is long, or has nested rows of ``x_temp_nested``: then the arrays are built inside the row, without a
    shuffle. A feature that is null everywhere (first seen after the last slice) is no input of a model and is left out.
    Nested rows that are ``complete`` have no such feature: they are read once, and need not be stored.
    """
    if "cells" in table.columns and complete:
        return table.select(*keys, _cell_array())
    if "cells" in table.columns:
        return _nested_arrays(table, keys)
    place = [c for c in ("feature", "slice") if c in table.columns]
    known = table.groupBy("feature").agg(F.count("median").alias("n")).filter("n > 0").select("feature")
    cell = F.struct(*place, F.array(*[F.col(s).cast("double") for s in ALL_STATS]).alias("v"))
    ordered = F.array_sort(F.collect_list(cell))
    kept = joins.keep_members(table, known, ["feature"])
    return kept.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda c: c["v"])).alias("features"))


def _nested_arrays(nested: DataFrame, keys: Sequence[str]) -> DataFrame:
    medians = nested.select(F.explode("cells").alias("c")).select("c.feature", F.size(F.array_compact("c.slices.median")).alias("n"))
    known = medians.groupBy("feature").agg(F.max("n").alias("n")).filter("n > 0").agg(F.collect_set("feature")).scalar()
    kept = F.filter("cells", lambda c: F.array_contains("_known", c["feature"]))
    arrays = nested.withColumn("_known", known).withColumn("cells", kept).filter(F.size("cells") > 0)
    return arrays.select(*keys, _cell_array())


def _cell_array() -> Column:
    row = lambda s: F.array(*[s[x].cast("double") for x in ALL_STATS])
    return F.flatten(F.transform(F.flatten("cells.slices"), row)).alias("features")


def early_fusion(features: DataFrame, genotype: DataFrame) -> DataFrame:
    """Patients with both kinds of data, columns side by side."""
    return joins.on_renamed(features, genotype, {"PATIENT": "PATIENT_ID"})
