"""Joins. Equi joins carry no hint: Catalyst broadcasts a side it knows to be small,
else sort-merges, and adaptive execution splits a skewed partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.dates import plus_years, plus_years_at
from cohortloom.functions.text import site_key
from cohortloom.session import materialize


def inner(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "inner")


def left_outer(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left")


def on_renamed(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Join where the right side names its keys differently; the left names are kept."""
    return left.join(right.withColumnsRenamed({r: l for l, r in keys.items()}), list(keys), how)


def keep_members(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(*on), list(on), "left_semi")


def drop_members(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    return df.join(keys.select(*on), list(on), "left_anti")


def membership_flag(
    df: DataFrame, keys: DataFrame, on: Sequence[str], name: str, yes: object = 1, no: object = 0
) -> DataFrame:
    """Add ``yes`` or ``no``: does the key occur in ``keys``. A null key does not."""
    marked = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    flagged = df.join(marked, list(on), "left")
    return flagged.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_hit"), F.lit(yes)).otherwise(F.lit(no)).alias(name))


def within_horizon(
    events: DataFrame, anchors: DataFrame, entity: str, time: str, anchor: str, years: int = 4
) -> DataFrame:
    """Events from an entity's anchor up to ``years`` calendar years later, both ends included.

    An equi join on the entity with the range as residual condition. The time of day counts
    if the anchor is a timestamp.
    """
    timed = isinstance(anchors.schema[anchor].dataType, (T.TimestampType, T.TimestampNTZType))
    end = (plus_years_at if timed else plus_years)(F.col(anchor), years)
    return events.join(anchors.select(entity, anchor), entity).filter(F.col(time).between(F.col(anchor), end))


def slice_grid(entities: DataFrame, n_slices: int, name: str = "slice") -> DataFrame:
    """Every distinct entity row times slices 1..n, as a generator instead of a cross join."""
    return entities.distinct().withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n_slices))))


def densify(df: DataFrame, entity: Sequence[str], n_slices: int, name: str = "slice") -> DataFrame:
    """Give every entity a row for each slice; slices without data are null."""
    grid = slice_grid(df.select(*entity), n_slices, name)
    return grid.join(df, [*entity, name], "left")


#: Each level of bins is this many times as wide as the one before; the last level is one bin for everything.
_WIDER, _LEVELS = 8, 15


def map_intervals(
    positions: DataFrame,
    blocks: DataFrame,
    chrom: str,
    position: str,
    bin_width: int = 100_000,
    keep_unmapped: bool = False,
) -> DataFrame:
    """Move positions to another coordinate system through blocks ``(chrom, lo, hi, off)``.

    Bins come in levels, each eight times as wide as the one before. A block is
    listed once, in the smallest bin that holds all of it, however long it is.
    A position probes one bin of each level that has blocks, so the range join
    becomes an equi join on (chromosome, level, bin) with the exact range as
    residual, and a position meets a block at most once. With
    ``keep_unmapped`` positions that no block holds are kept with a null.
    """
    # Written out: the levels are read from it too, and Catalyst sees its size.
    listed = materialize(
        blocks.select(F.col("chrom").alias("_chrom"), "lo", "hi", "off", _smallest_bin(F.col("lo"), F.col("hi"), bin_width).alias("_b")).select(
            "_chrom", "lo", "hi", "off", "_b.*"
        ),
        "blocks",
    )
    # At most ``_LEVELS + 1`` numbers.
    levels = listed.agg(F.collect_set("_level")).scalar()
    probes = positions.withColumn("_level", F.explode(levels)).withColumn("_bin", _bin_at(F.col(position), F.col("_level"), bin_width))
    p, b = probes.alias("p"), listed.alias("b")
    place = F.col(f"p.{position}")
    on = (F.col(f"p.{chrom}") == F.col("b._chrom")) & (F.col("p._level") == F.col("b._level")) & (F.col("p._bin") == F.col("b._bin"))
    columns = [F.col(f"p.{c}") for c in positions.columns]
    mapped = p.join(b, on & place.between(F.col("b.lo"), F.col("b.hi"))).select(*columns, (place + F.col("b.off")).alias("mapped_position"))
    if not keep_unmapped:
        return mapped
    found = mapped.select(chrom, position).distinct()
    left = positions.join(found, [chrom, position], "left_anti").select(*positions.columns)
    return mapped.unionByName(left.withColumn("mapped_position", F.lit(None).cast(mapped.schema["mapped_position"].dataType)))


def _bin_at(place: Column, level: Column, bin_width: int) -> Column:
    """Number of the bin of a level; the last level has bin 0 only."""
    width = (F.pow(F.lit(_WIDER), level) * bin_width).cast("bigint")
    return F.when(level == _LEVELS, F.lit(0).cast("bigint")).otherwise(F.floor(place / width).cast("bigint"))


def _smallest_bin(lo: Column, hi: Column, bin_width: int) -> Column:
    """(level, bin) of the smallest bin that holds both ends."""
    level = F.array_min(
        F.filter(
            F.sequence(F.lit(0), F.lit(_LEVELS)),
            lambda n: _bin_at(lo, n, bin_width) == _bin_at(hi, n, bin_width),
        )
    )
    return F.struct(level.alias("_level"), _bin_at(lo, level, bin_width).alias("_bin"))


def attach_weights(snps: DataFrame, sumstats: DataFrame, align: bool = False, duplicates: str = "raise") -> DataFrame:
    """Give each SNP its effect size; an unmatched SNP keeps a null weight.

    Several weights of a SNP of the list would count it several times: they are an error. With ``duplicates`` =
    "best" the one with the smallest p-value is taken.

    The default key is chromosome, position, effect allele, other allele. With
    ``align`` a row also matches with the two alleles exchanged: the counted
    variant is then the effect allele and the weight keeps its sign, while a
    match in the default order counts the other allele and changes sign.
    """
    stats = sumstats.withColumn("base_pair_location", F.split_part("base_pair_location", F.lit("."), F.lit(1)))
    fields = ["chromosome", "base_pair_location", "other_allele", "effect_allele", "beta", "p_value"]

    def keyed(first: str, second: str, sign: int) -> DataFrame:
        key = site_key(F.col("chromosome"), F.col("base_pair_location"), F.col(first), F.col(second))
        return stats.select(key.alias("SNP_ID"), *fields).withColumn("beta", F.lit(sign) * F.col("beta"))

    if align:
        weights = keyed("effect_allele", "other_allele", -1).unionByName(keyed("other_allele", "effect_allele", 1))
    else:
        weights = keyed("effect_allele", "other_allele", 1)
    if duplicates not in ("raise", "best"):
        raise ValueError(f"duplicates is {duplicates}, neither raise nor best")
    if duplicates == "best":
        return snps.join(one_weight_per_snp(weights), "SNP_ID", "left")
    counted = weights.groupBy("SNP_ID").agg(F.count("*").alias("_n"), F.min(F.struct(*fields)).alias("_w"))
    several = F.raise_error(F.concat(F.lit("several weights for SNP "), F.col("SNP_ID"))).cast(counted.schema["_w"].dataType)
    # Told after the join: only SNPs of the list matter.
    joined = snps.join(counted, "SNP_ID", "left").withColumn("_w", F.when(F.col("_n") > 1, several).otherwise(F.col("_w")))
    return joined.select(*[F.col(f"`{c}`") for c in snps.columns], "_w.*")


def one_weight_per_snp(weights: DataFrame) -> DataFrame:
    """Of several rows of a SNP keep the one with the smallest p-value."""
    others = [c for c in weights.columns if c != "SNP_ID"]
    order = F.struct(F.col("p_value").isNull(), "p_value", F.col("beta").isNull(), "beta", *[c for c in others if c not in ("p_value", "beta")])
    return weights.groupBy("SNP_ID").agg(F.min_by(F.struct(*others), order).alias("_w")).select("SNP_ID", "_w.*")
