"""Entity-anchored time windows, fills and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.dates import plus_years, plus_years_at
from cohortloom.operators.aggregates import STATS, single_value_sd
from cohortloom.operators.ordering import group_medians, row_numbers
from cohortloom.operators.shape import group_window_min, missing_indicator, with_group_min
from cohortloom.session import materialize


def sequence_numbers(df: DataFrame, entity: str, order: Sequence[str], name: str) -> DataFrame:
    """Running number of an entity's rows in time order; a hot entity is cut over range partitions."""
    return row_numbers(df, [entity], [F.col(c) for c in order], name)


def horizon_filter(
    df: DataFrame, entity: str, time: str, years: int = 4, name: str = "first_date", reduced: bool = False
) -> DataFrame:
    """Rows up to ``years`` calendar years after the entity's first row, the end included.

    Of timestamps the time of day counts; of days the whole last day is in.

    ``reduced`` marks rows already aggregated to days, where a window is cheaper
    than a join because the count per entity is bounded.
    """
    anchored = group_window_min(df, [entity], time, name) if reduced else with_group_min(df, entity, time, name)
    timed = isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType))
    return anchored.filter(F.col(time) <= (plus_years_at if timed else plus_years)(F.col(name), years))


def slice_number(time: Column, start: Column, days: int = 180) -> Column:
    """Tumbling slice counted from 1 at the entity's own start."""
    return (F.floor(F.datediff(time, start) / F.lit(days)) + 1).cast("int")


def anchored_slices(
    df: DataFrame, entity: str, time: str, days: int = 180, n_slices: int = 8, reduced: bool = False
) -> DataFrame:
    """Add ``slice`` and keep slices 1..n."""
    anchored = group_window_min(df, [entity], time, "_start") if reduced else with_group_min(df, entity, time, "_start")
    sliced = anchored.withColumn("slice", slice_number(F.col(time), F.col("_start"), days)).drop("_start")
    return sliced.filter(F.col("slice") <= n_slices)


def _down(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _up(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)


def _replaced(df: DataFrame, rows: Sequence[str], values: Mapping[str, Sequence[Column]]) -> DataFrame:
    """The struct columns ``rows`` with the named fields replaced or added, a value for each of them."""
    names = df.schema[rows[0]].dataType.names
    names = [*names, *[n for n in values if n not in names]]
    return df.withColumns(
        {r: F.struct(*[(values[n][k] if n in values else F.col(r)[n]).alias(n) for n in names]) for k, r in enumerate(rows)}
    )


def _fields(rows: Sequence[str], column: str) -> list[Column]:
    return [F.col(r)[column] for r in rows]


def _carried(values: Sequence[Column]) -> list[Column]:
    """Each value, or the last one before it if it is null."""
    return [*accumulate(values, lambda last, x: F.coalesce(x, last))]


def unfold(df: DataFrame, keys: Sequence[str], rows: Sequence[str]) -> DataFrame:
    """One row for each of the struct columns ``rows``, their fields as columns."""
    return df.select(*keys, F.inline(F.array(*rows)))


def fill_down(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], rows: Sequence[str] | None = None) -> DataFrame:
    """Carry the last known value forward. A group is the few slices of one entity and feature.

    ``rows`` names the struct columns that hold a group's rows in order, if a group is one row of ``df``: then the
    columns are fields that are filled inside it, without a window, and ``keys`` and ``order`` only say what it is.
    """
    if rows is not None:
        return _replaced(df, rows, {c: _carried(_fields(rows, c)) for c in columns})
    w = _down(keys, order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_down_up(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], rows: Sequence[str] | None = None) -> DataFrame:
    """Forward fill, then backward fill of what is still missing at the start; ``rows`` as for ``fill_down``."""
    if rows is not None:
        down = fill_down(df, keys, order, columns, rows)
        return _replaced(down, rows, {c: _carried(_fields(rows, c)[::-1])[::-1] for c in columns})
    down, up = _down(keys, order), _up(keys, order)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(down), F.first(c, ignorenulls=True).over(up)) for c in columns}
    )


def _counted_rows(df: DataFrame, feature: str, columns: Sequence[str], rows: Sequence[str]) -> DataFrame:
    """(feature, _times, columns): the rows of each group that have a value, those that follow an equal one counted with it; stored."""
    whole = [F.struct(*[F.col(r)[c].cast("double").alias(c) for c in columns]).alias(r) for r in rows]
    held = df.select(feature, *whole)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(rows, rows[1:])]
    times = [F.lit(1)]
    for again in reversed(same):
        times.insert(0, F.when(again, times[0] + 1).otherwise(1))
    first = [F.lit(True), *[~again for again in same]]
    valued = [F.coalesce(*[F.col(r)[c] for c in columns]).isNotNull() for r in rows]
    listed = [F.when(f & v, F.struct(t.alias("_times"), *[F.col(r)[c].alias(c) for c in columns])) for f, v, t, r in zip(first, valued, times, rows)]
    found = held.select(feature, F.explode(F.array(*listed)).alias("_e")).filter(F.col("_e").isNotNull())
    return materialize(found.select(feature, "_e.*"), "counted")


def population_medians(
    df: DataFrame, feature: str, columns: Sequence[str], weight: Column | None = None, rows: Sequence[str] | None = None
) -> DataFrame:
    """Exact median of each column over all entities, one row per feature; a row counts ``weight`` times.

    A feature is a group of all entities, so this narrows brackets instead of
    gathering values; features without any value are absent. ``rows`` as for ``fill_down``.
    """
    if rows is not None:
        return population_medians(_counted_rows(df, feature, columns, rows), feature, columns, F.col("_times"))
    stat = F.array(*[F.struct(F.lit(c).alias("_stat"), F.col(c).cast("double").alias("_x")) for c in columns])
    counted = F.lit(1) if weight is None else weight
    long = df.select(feature, counted.alias("_times"), F.explode(stat).alias("_s")).select(feature, "_times", "_s._stat", "_s._x")
    medians = group_medians(long, [feature, "_stat"], "_x", "_med", None if weight is None else F.col("_times"))
    return medians.groupBy(feature).agg(*[F.max(F.when(F.col("_stat") == c, F.col("_med"))).alias(c) for c in columns])


def _with_medians(df: DataFrame, feature: str, columns: Sequence[str], rows: Sequence[str] | None) -> DataFrame:
    """``df`` with the medians of each column beside it."""
    medians = materialize(population_medians(df, feature, columns, rows=rows), "medians")
    return df.join(medians.withColumnsRenamed({c: f"_med_{c}" for c in columns}), feature, "left")


def impute_population_median(df: DataFrame, feature: str, columns: Sequence[str], rows: Sequence[str] | None = None) -> DataFrame:
    """Null to the feature's median over all rows; a feature without values stays null. ``rows`` as for ``fill_down``."""
    joined = _with_medians(df, feature, columns, rows)
    if rows is not None:
        filled = _replaced(joined, rows, {c: [F.coalesce(x, f"_med_{c}") for x in _fields(rows, c)] for c in columns})
    else:
        filled = joined.withColumns({c: F.coalesce(c, f"_med_{c}") for c in columns})
    return filled.drop(*[f"_med_{c}" for c in columns])


def impute_never_observed(df: DataFrame, entity: str, feature: str, columns: Sequence[str], rows: Sequence[str] | None = None) -> DataFrame:
    """Median over all rows for an entity that never has the feature; other nulls stay. ``rows`` as for ``fill_down``."""
    if rows is not None:
        joined = _with_medians(df, feature, columns, rows)
        usual = {c: F.when(F.coalesce(*_fields(rows, c)).isNull(), F.col(f"_med_{c}")) for c in columns}
        filled = _replaced(joined, rows, {c: [F.coalesce(x, usual[c]) for x in _fields(rows, c)] for c in columns})
        return filled.drop(*[f"_med_{c}" for c in columns])
    group = Window.partitionBy(entity, feature)
    joined = _with_medians(df, feature, columns, None)
    filled = joined.withColumns({f"_n_{c}": F.count(c).over(group) for c in columns}).withColumns(
        {c: F.when(F.col(f"_n_{c}") == 0, F.col(f"_med_{c}")).otherwise(F.col(c)) for c in columns}
    )
    return filled.drop(*[f"{p}{c}" for c in columns for p in ("_med_", "_n_")])


def impute_hierarchical(df: DataFrame, entity: str, feature: str, slice_: str = "slice", rows: Sequence[str] | None = None) -> DataFrame:
    """All imputation steps on a dense table of the four statistics, in their fixed order.

    Missing indicator from the raw median; deviation of a single value to zero;
    forward fill; median over all rows after that fill for an entity that never
    has the feature; forward and backward fill of the rest. ``rows`` as for ``fill_down``.
    """
    keys = [entity, feature]
    if rows is not None:
        missing = [missing_indicator(x) for x in _fields(rows, "median")]
        sd = [single_value_sd(*x) for x in zip(_fields(rows, "sd"), _fields(rows, "min"))]
        marked = _replaced(df, rows, {"missing": missing, "sd": sd})
    else:
        marked = df.withColumns(
            {"missing": missing_indicator(F.col("median")), "sd": single_value_sd(F.col("sd"), F.col("min"))}
        )
    carried = fill_down(marked, keys, slice_, STATS, rows)
    typical = impute_never_observed(materialize(carried, "carried"), entity, feature, STATS, rows)
    return fill_down_up(typical, keys, slice_, STATS, rows)
