"""Ranks, running totals and order statistics that never sort a whole group in one task.

A window without a partition, or partitioned by a label, a feature or a hot
entity, puts all of a group into one task. The functions here give the same
exact results from range partitions or from narrowed value brackets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialize


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add inclusive running sums within ``keys`` along ``order``.

    Rows are range-partitioned by (keys, order), so a hot key is cut over many
    partitions. Only a key that began in an earlier partition needs an offset:
    at most one per partition, which bounds what is broadcast. ``order`` should
    be unique within a key; null keys are equal to each other.
    """
    keys = list(keys)
    renamed = [f"_key{i}" for i in range(len(keys))]
    same = F.lit(True)
    for key, other in zip(keys, renamed):
        same = same & F.col(key).eqNullSafe(F.col(other))
    placed = materialize(
        df.select("*", *[c.alias(f"_add_{n}") for n, c in sums.items()])
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id()),
        "range",
    )
    part_sums = [F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums]
    if keys:
        # First and last key of each partition: the only keys that can cross a boundary.
        edge = F.struct(*keys)
        edges = (
            placed.groupBy("_part")
            .agg(F.array(F.min(edge), F.max(edge)).alias("_edges"))
            .select(F.explode("_edges").alias("_edge"))
            .select("_edge.*")
            .distinct()
        )
        pieces = placed.join(F.broadcast(edges.toDF(*renamed)), same, "left_semi").groupBy(*keys, "_part").agg(*part_sums)
    else:
        pieces = placed.groupBy("_part").agg(*part_sums)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.select(*keys, "_part", *[F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in sums])
        .filter(F.coalesce(*[F.col(f"_off_{n}") for n in sums]).isNotNull())
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        *df.columns, "_part", *[F.sum(f"_add_{n}").over(within).alias(f"_run_{n}") for n in sums]
    )
    others = F.broadcast(offsets.withColumnsRenamed(dict(zip([*keys, "_part"], [*renamed, "_at"]))))
    return local.join(others, same & (F.col("_part") == F.col("_at")), "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            (F.col(f"_run_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """``row_number`` within ``keys`` (none: over the whole table), counted from 1."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: Mapping[str, Callable[[Column], Column]],
    result: Column | None = None,
    weight: Column | None = None,
    accuracy: int = 10_000,
    bracket_rows: int = 1_000_000,
) -> DataFrame:
    """Exact k-th smallest values per key, without sorting a key's rows.

    ``ranks`` names the wanted ranks as functions of the count. A row counts
    ``weight`` times (a whole number from 1; default once), so copies need not
    be made. Each key begins with one bracket, the whole line. While a bracket
    holds more than ``bracket_rows`` rows, a mergeable quantile sketch of its
    rows cuts it into cells, the cells are counted exactly, and those that
    hold a wanted rank are the next brackets. The sketch only says where to
    cut: cells cover the whole line, so no rank can fall outside them. A value
    that many rows share is a cell of its own and needs no further cut, so a
    round leaves about 1 / 128 of a bracket's rows. What is left is counted
    by distinct value.

    ``result`` is the value to return where it is finer than the numeric
    ``value`` (a hash text whose leading digits are ``value``); it must sort
    the same way. Null values are ignored. There is at least one key; keys must not be null.
    """
    keys = list(keys)
    counted = F.lit(1) if weight is None else weight
    rows = df.select(
        *keys,
        value.cast("double").alias("_v"),
        (value if result is None else result).alias("_r"),
        counted.cast("bigint").alias("_w"),
    ).filter(F.col("_v").isNotNull())
    whole = rows.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_held"))
    line = [F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi")]
    # Written out: a handful of keys is then broadcast, many are sort-merged.
    brackets = materialize(
        whole.select(*keys, "_n", *line, F.lit(False).alias("_point"), F.lit(0).cast("bigint").alias("_base"), "_held"), "brackets"
    )
    large = ~F.col("_point") & (F.col("_held") > bracket_rows)
    while not brackets.filter(large).isEmpty():
        narrowed = _narrowed(rows, keys, brackets.filter(large), ranks, accuracy)
        brackets = materialize(brackets.filter(~large).unionByName(narrowed), "brackets")
    values = _inside(rows, keys, brackets).groupBy(*keys, "_n", "_base", "_v", "_r").agg(F.sum("_w").alias("_c"))
    upto = Window.partitionBy(*keys, "_base").orderBy("_v", "_r").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_cum", F.col("_base") + F.sum("_c").over(upto))
    picks = [F.max(F.when(_holds(rank(F.col("_n"))), F.col("_r"))).alias(name) for name, rank in ranks.items()]
    return values.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)


def _holds(rank: Column) -> Column:
    """Whether a rank is among the ``_c`` counts that end at ``_cum``."""
    return (F.col("_cum") - F.col("_c") < rank) & (rank <= F.col("_cum"))


def _inside(rows: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """Rows with the bracket that holds them: a single value ``_lo`` (a point), or between ``_lo`` and ``_hi``, both excluded, null for no end."""
    within = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    return rows.join(brackets, list(keys)).filter(F.when(F.col("_point"), F.col("_v") == F.col("_lo")).otherwise(within))


#: Cuts of a bracket: one less than a power of two, as they are searched by halving.
_CUTS = 127


def _narrowed(
    rows: DataFrame, keys: Sequence[str], brackets: DataFrame, ranks: Mapping[str, Callable[[Column], Column]], accuracy: int
) -> DataFrame:
    """The cells of ``brackets`` that hold a wanted rank, as brackets."""
    own = [*keys, "_n", "_base"]
    shares = [(i + 1) / (_CUTS + 1) for i in range(_CUTS)]
    cuts = _inside(rows, keys, brackets).groupBy(*own, "_lo", "_hi", "_point").agg(
        F.percentile_approx("_v", shares, accuracy).alias("_cuts")
    )
    placed = _inside(rows, keys, materialize(cuts, "cuts"))
    # How many cuts are less than the value, by halving; then the cells are numbered: open, point, open, point, ...
    step, below = (_CUTS + 1) // 2, F.lit(0)
    placed = placed.withColumn("_below", below)
    while step:
        more = F.col("_v") > F.get("_cuts", F.col("_below") + (step - 1))
        placed = placed.withColumn("_below", F.when(more, F.col("_below") + step).otherwise(F.col("_below")))
        step //= 2
    on_cut = F.coalesce(F.col("_v") == F.get("_cuts", F.col("_below")), F.lit(False)).cast("int")
    cells = (
        placed.withColumn("_cell", 2 * F.col("_below") + on_cut)
        .groupBy(*own, "_lo", "_hi", "_cuts", "_cell")
        .agg(F.sum("_w").alias("_c"), F.count(F.lit(1)).alias("_held"))
    )
    # At most 2 * _CUTS + 1 rows for each bracket.
    upto = Window.partitionBy(*keys, "_base").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_cum", F.col("_base") + F.sum("_c").over(upto))
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | _holds(rank(F.col("_n")))
    place, point = F.shiftright("_cell", 1), F.col("_cell") % 2 == 1
    here, before = F.get("_cuts", place), F.get("_cuts", place - 1)
    return cells.filter(wanted).select(
        *keys,
        "_n",
        F.when(point, here).otherwise(F.coalesce(before, F.col("_lo"))).alias("_lo"),
        F.when(point, here).otherwise(F.coalesce(here, F.col("_hi"))).alias("_hi"),
        point.alias("_point"),
        (F.col("_cum") - F.col("_c")).alias("_base"),
        "_held",
    )


def group_medians(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", weight: Column | None = None
) -> DataFrame:
    """Exact interpolated median per key, a row counting ``weight`` times; keys with no value are absent."""
    halves = order_statistics(
        df,
        keys,
        F.col(f"`{value}`"),
        {
            "_low": lambda n: F.floor((n + 1) / 2),
            "_high": lambda n: F.floor(n / 2) + 1,
        },
        weight=weight,
    )
    return halves.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def sort_rows(df: DataFrame, *order: Column) -> DataFrame:
    """Global sort: range partitions, each sorted."""
    return df.orderBy(*order)


def preview(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of an order; each task keeps only its own ``n``."""
    return df.orderBy(*order).limit(n)


def shape_of(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def top_k(df: DataFrame, value: str, k: int, ties: Sequence[str] = (), by_abs: bool = True) -> DataFrame:
    """The ``k`` rows with the largest (absolute) value; ties by the named columns."""
    measure = F.abs(F.col(value)) if by_abs else F.col(value)
    return df.orderBy(measure.desc(), *[F.col(t) for t in ties]).limit(k)
