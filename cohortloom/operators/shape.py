"""Column choice, filters, flags and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.text import observed_allele, parse_bool, site_key
from cohortloom.operators.ordering import row_numbers


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
    copy: Mapping[str, str] | None = None,
) -> DataFrame:
    """Select, drop, rename and copy columns in one projection."""
    names = [c for c in (keep or df.columns) if c not in set(drop)]
    rename = rename or {}
    chosen = [F.col(f"`{c}`").alias(rename.get(c, c)) for c in names]
    return df.select(*chosen, *[F.col(f"`{src}`").alias(dst) for dst, src in (copy or {}).items()])


def first_match(x: Column, rules: Sequence[tuple[str, object]], otherwise: object) -> Column:
    """Value of the first rule whose regular expression occurs in the text."""
    result: Column | None = None
    for pattern, value in rules:
        hit = x.rlike(pattern)
        result = F.when(hit, F.lit(value)) if result is None else result.when(hit, F.lit(value))
    return F.lit(otherwise) if result is None else result.otherwise(F.lit(otherwise))


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def drop_all_null_features(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Drop features that have no value at all (long form)."""
    seen = df.filter(F.col(value).isNotNull()).select(feature).distinct()
    return df.join(seen, feature, "left_semi")


def drop_all_null_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that have no value at all (wide form): one pass counts all columns."""
    kept = set(keep)
    others = [c for c in df.columns if c not in kept]
    counts = df.selectExpr(*[f"count(`{c}`) as `{c}`" for c in others]).first().asDict()
    return df.select(*[f"`{c}`" for c in df.columns if c in kept or counts[c] > 0])


def missing_indicator(median: Column) -> Column:
    """1 where the median, and so every statistic of the feature, is absent."""
    return median.isNull().cast("int")


def add_missing_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``<feature>_missing`` right after ``<feature>_median`` (wide form)."""
    wanted = {f"{f}_median": f"{f}_missing" for f in features}
    out: list[str] = []
    for c in df.columns:
        out.append(f"`{c}`")
        if c in wanted:
            out.append(f"cast(`{c}` is null as int) as `{wanted[c]}`")
    return df.selectExpr(*out)


def known_values(df: DataFrame, column: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct values to serve as column names; more than ``limit`` is an error."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values: stay in long form or build vectors")
    return sorted(r[0] for r in rows)


def pivot_wide(
    df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Sequence[str], how: str = "first"
) -> DataFrame:
    """One column per listed name. The list saves the job that would look for the values; a value of another name is an error.

    The values that a key has are gathered as they are and placed by name at the end: what a task holds
    grows with its values, not with keys times columns.
    """
    kind = df.schema[name].dataType
    known = F.col(name).isin(list(columns)) | F.col(value).isNull()
    other = F.concat(F.lit(f"a value of {name} has no column: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))
    checked = F.when(F.coalesce(known, F.lit(False)), F.col(name)).otherwise(F.raise_error(other).cast(kind))
    rows = df.withColumn(name, checked)
    if how != "first":
        aggregate = {"avg": F.avg, "max": F.max, "sum": F.sum}[how]
        rows = rows.groupBy(*keys, name).agg(aggregate(F.col(value)).alias(value))
    cell = F.when(F.col(value).isNotNull(), F.struct(F.col(name).alias("name"), F.col(value).alias("value")))
    gathered = rows.groupBy(*keys).agg(F.collect_list(cell).alias("_cells"))
    placed = gathered.select(*keys, F.col("_cells.name").alias("_names"), F.col("_cells.value").alias("_values"))
    at = lambda c: F.get("_values", (F.array_position("_names", F.lit(c).cast(kind)) - 1).cast("int"))
    return placed.select(*keys, *[at(c).alias(str(c)) for c in columns])


def unpivot_long(
    df: DataFrame, keys: Sequence[str], name: str = "feature", value: str = "value", columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per column."""
    values = columns or [c for c in df.columns if c not in set(keys)]
    return df.unpivot([f"`{k}`" for k in keys], [f"`{c}`" for c in values], name, value)


def flatten_slices(
    df: DataFrame, entity: Sequence[str], columns: Sequence[str], slice_: str = "slice", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Long slice features to one row per entity with ``<feature>_slice<n>`` columns: a single pivot."""
    named = df.select(*entity, F.concat(F.col(feature), F.lit("_slice"), F.col(slice_)).alias("_name"), value)
    return pivot_wide(named, entity, "_name", value, columns)


def explode_alleles(calls: DataFrame) -> DataFrame:
    """One row per listed variant allele, with its site key and whether the call carries it."""
    listed = F.split(F.replace(F.col("VARIANT_ALLELE_LIST"), F.lit('"'), F.lit("")), ",")
    rows = calls.withColumn("VARIANT_ALLELE", F.explode(listed)).withColumn("VARIANT_ALLELE", F.trim("VARIANT_ALLELE"))
    return rows.withColumns(
        {
            "SNP_ID": site_key(F.col("CHROMOSOME"), F.col("LOCATION"), F.col("ANCESTRAL_ALLELE"), F.col("VARIANT_ALLELE")),
            "HAS_VARIANT": F.coalesce(
                (F.col("VARIANT_ALLELE") == observed_allele(F.col("ALLELE"))) & parse_bool(F.col("VARIANT")),
                F.lit(False),
            ),
        }
    )


def entity_batches(df: DataFrame, entity: str, size: int = 500, name: str = "batch") -> DataFrame:
    """Distinct entities in order of id, numbered into batches counted from 1."""
    numbered = row_numbers(df.select(entity).distinct(), [], [F.col(entity)], "_n")
    return numbered.select(entity, (F.floor((F.col("_n") - 1) / size) + 1).cast("int").alias(name))


def feature_vectors(df: DataFrame, entity: Sequence[str], index: str, value: str, name: str = "features") -> DataFrame:
    """Long features to one dense array per entity, in order of the feature index."""
    pairs = F.array_sort(F.collect_list(F.struct(index, value)))
    return df.groupBy(*entity).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def with_group_min(df: DataFrame, entity: str, time: str, name: str) -> DataFrame:
    """Group minimum on every row.

    Aggregated first and joined back, so that a hot entity is combined on the
    map side and its rows need not meet in one task.
    """
    firsts = df.groupBy(F.col(entity).alias("_entity")).agg(F.min(time).alias(name))
    # Rows without an entity are a group too.
    return df.join(firsts, F.col(entity).eqNullSafe(F.col("_entity"))).drop("_entity")


def group_window_min(df: DataFrame, entity: Sequence[str], time: str, name: str) -> DataFrame:
    """The same by a window, for rows already reduced to a bounded count per entity."""
    return df.withColumn(name, F.min(time).over(Window.partitionBy(*entity)))
