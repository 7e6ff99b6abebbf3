"""Group aggregations. All combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.numbers import to_number

STATS = ("sd", "min", "max", "median")


def count_rows(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_distinct(df: DataFrame, keys: Sequence[str], column: str, name: str = "n_distinct", approx: float | None = None) -> DataFrame:
    """Distinct values per group (no keys: one row). ``approx`` is a relative error for a sketch."""
    measure = F.count_distinct(column) if approx is None else F.approx_count_distinct(column, approx)
    return df.groupBy(*keys).agg(measure.alias(name))


def summary_over_entities(per_entity: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Mean, median and maximum of per-entity integers, as one row.

    The exact median keeps one counter per distinct integer. Row counts per
    entity add up to the table size N, so at most sqrt(2N) of them differ.
    """
    return per_entity.agg(
        *[
            f(m).alias(f"{label}_{m}")
            for m in measures
            for label, f in (("mean", F.avg), ("median", F.median), ("max", F.max))
        ]
    )


def first_event(df: DataFrame, entity: str, time: str, name: str) -> DataFrame:
    """Earliest time per entity."""
    return df.groupBy(entity).agg(F.min(time).alias(name))


def first_per_column(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First non-null value of each column in time order, each column for itself."""
    key = F.struct(*order)
    picks = []
    for c in columns:
        filled = F.when(F.col(c).isNotNull(), key)
        picks.append(F.min_by(c, filled).alias(c))
    return df.groupBy(entity).agg(*picks)


def first_row(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First row of each entity in the given order, nulls and all."""
    row = F.struct(*columns)
    return df.groupBy(entity).agg(F.min_by(row, F.struct(*order)).alias("_row")).select(entity, "_row.*")


def last_row(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last row of each entity; ``order`` must break ties to be repeatable."""
    row = F.struct(*columns)
    return df.groupBy(entity).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(entity, "_row.*")


def daily_mean(df: DataFrame, keys: Sequence[str], value: str, name: str = "value") -> DataFrame:
    """Mean of the numeric values per entity, day and code; no number at all gives null."""
    return df.groupBy(*keys).agg(F.avg(to_number(F.col(value))).alias(name))


def stats4(df: DataFrame, keys: Sequence[str], value: str, reduced: bool = False) -> DataFrame:
    """Sample deviation, minimum, maximum and interpolated median; null where nothing is known.

    Meant for daily values: the count per group is bounded by the days of the horizon.

    ``reduced`` marks rows already aggregated to days: a group's values are then put in order by a sort, which costs
    less than a map of values for each group. Rows that are partitioned by some of the keys are not shuffled.
    """
    v = F.col(value)
    if not reduced:
        return df.groupBy(*keys).agg(
            F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median")
        )
    group = Window.partitionBy(*keys)
    place, n = F.row_number().over(group.orderBy(v.asc_nulls_last())), F.count(v).over(group)
    ranked = df.select(*keys, value, place.alias("_place"), n.alias("_n"))
    low, high = (F.max(F.when(F.col("_place") == k, v.cast("double"))) for k in (F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    return ranked.groupBy(*keys).agg(
        F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), (low * 0.5 + high * 0.5).alias("median")
    )


def single_value_sd(sd: Column, minimum: Column) -> Column:
    """Deviation of a single value: zero instead of null."""
    return F.when(minimum.isNotNull(), F.coalesce(sd, F.lit(0.0)))


def any_match(df: DataFrame, entity: Sequence[str], predicate: Column, name: str) -> DataFrame:
    """1 when any row of the entity matches."""
    return df.groupBy(*entity).agg(F.max(F.coalesce(predicate.cast("int"), F.lit(0))).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Frequency of each value, most frequent first."""
    return count_rows(df, [column], name).orderBy(F.desc(name), F.asc(column))


def distinct_map(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 50,
    by: Sequence[str] = (),
    clip: tuple[float, float] | None = None,
    width: float | None = None,
) -> DataFrame:
    """Counts in equal bins from the minimum, the maximum in the last bin.

    ``clip`` leaves out values beyond a range and fixes the edges; ``width``
    sets the bin width instead of the count. The bounds are one row, read as
    scalar subqueries.
    """
    x = F.col(column).cast("double")
    rows = df.filter(F.col(column).isNotNull())
    if clip:
        rows = rows.filter(x.between(*clip))
        low, high = F.lit(float(clip[0])), F.lit(float(clip[1]))
    else:
        bounds = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        low, high = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    rows = rows.select(*by, x.alias("_x"), low.alias("_lo"), high.alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    if width is not None:
        position = F.floor((F.col("_x") - F.col("_lo")) / F.lit(float(width)))
        step = F.lit(float(width))
    else:
        position = F.when(span == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_x") - F.col("_lo")) / (span / F.lit(bins))), F.lit(bins - 1))
        )
        step = span / F.lit(bins)
    return (
        rows.select(*by, position.cast("int").alias("bin"), (F.col("_lo") + position * step).alias("bin_start"))
        .groupBy(*by, "bin")
        .agg(F.min("bin_start").alias("bin_start"), F.count(F.lit(1)).alias("n"))
    )
