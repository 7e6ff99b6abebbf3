"""Distinct set operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, name: str) -> DataFrame:
    """First column as text under a common name: the lists name and type it differently."""
    return df.select(F.col(f"`{df.columns[0]}`").cast("string").alias(name))


def union(a: DataFrame, b: DataFrame, name: str = "id") -> DataFrame:
    return _one(a, name).union(_one(b, name)).distinct()


def intersect(a: DataFrame, b: DataFrame, name: str = "id") -> DataFrame:
    return _one(a, name).intersect(_one(b, name))


def difference(a: DataFrame, b: DataFrame, name: str = "id") -> DataFrame:
    return _one(a, name).subtract(_one(b, name))


def membership(sets: Mapping[str, DataFrame], name: str = "id") -> DataFrame:
    """One row per element with a 0/1 flag for each set: one shuffle for all sets."""
    tagged = None
    for label, df in sets.items():
        part = _one(df, name).select(name, *[F.lit(int(s == label)).alias(s) for s in sets])
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(name).agg(*[F.max(s).alias(s) for s in sets])


def combination_counts(flags: DataFrame, names: list[str]) -> DataFrame:
    """Elements per combination of sets."""
    return flags.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(flags: DataFrame, names: list[str]) -> DataFrame:
    """Size of every set (a = b) and of every pairwise intersection, from one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("set_a"), F.lit(b).alias("set_b"), F.col(f"`{a}|{b}`").cast("bigint").alias("n")) for a, b in pairs])
    return sums.select(F.explode(rows).alias("_r")).select("_r.*")
