"""Allele dosages and weighted scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ordering import row_numbers
from cohortloom.operators.shape import explode_alleles, pivot_wide
from cohortloom.session import materialize

# Significance cut-offs and the names of their score columns.
PRS_CUTOFFS: dict[str, float | None] = {"PRS_0.05": 0.05, "PRS_1e-5": 1e-5, "PRS_5e-8": 5e-8, "PRS_all": None}


def dosage(calls: DataFrame, entity: str = "PATIENT_ID") -> DataFrame:
    """Copies of the variant per entity and SNP, in long form."""
    return explode_alleles(calls).groupBy(entity, "SNP_ID").agg(F.sum(F.col("HAS_VARIANT").cast("int")).cast("int").alias("dosage"))


def snp_universe(dosages: DataFrame, template: object | None = None, entity: str = "PATIENT_ID") -> DataFrame:
    """SNPs that count: all that occur, or those of one template entity."""
    rows = dosages if template is None else dosages.filter(F.col(entity) == F.lit(template))
    return rows.select("SNP_ID").distinct()


def genotype_matrix(dosages: DataFrame, snps: Sequence[str], entity: str = "PATIENT_ID") -> DataFrame:
    """One column per SNP in sorted order; null where an entity has no call."""
    return pivot_wide(dosages, [entity], "SNP_ID", "dosage", sorted(snps))


def snp_index(dosages: DataFrame) -> DataFrame:
    """(SNP_ID, snp_index from 0): places of all SNPs in sorted order, numbered over range partitions; stored."""
    numbered = row_numbers(dosages.select("SNP_ID").distinct(), [], [F.col("SNP_ID")], "place")
    return materialize(numbered.select("SNP_ID", (F.col("place") - 1).cast("int").alias("snp_index")), "snp-index")


def genotype_vectors(dosages: DataFrame, index: DataFrame, entity: str = "PATIENT_ID") -> DataFrame:
    """Sparse form for many SNPs: (entity, positions, dosages), arrays ascending by position.

    ``index`` is the table of ``snp_index``. There is one row per entity and no column per SNP, so that a plan
    does not grow with the number of SNPs. A dosage of zero is kept: it is a call, not a gap.
    """
    pairs = F.array_sort(F.collect_list(F.struct("snp_index", "dosage")))
    return (
        dosages.join(index, "SNP_ID")
        .groupBy(entity)
        .agg(pairs.alias("_p"))
        .select(entity, F.col("_p.snp_index").alias("positions"), F.col("_p.dosage").alias("dosages"))
    )


def with_genotype(matrix: DataFrame, vectors: DataFrame, entity: str = "PATIENT", other: str = "PATIENT_ID") -> DataFrame:
    """Early fusion of feature arrays with sparse genotypes: entities with both, genotype columns beside the features."""
    return matrix.join(vectors.withColumnRenamed(other, entity), entity)


def dense_features(fused: DataFrame, n_snps: int, keep: Sequence[str] = ("PATIENT", "CVD")) -> DataFrame:
    """One array of record features and all dosages, for models that take dense rows; a SNP without a call is zero.

    Calls are spread between the gaps of ascending positions, so the work is in proportion to the array.
    """
    ends = F.concat(F.col("positions"), F.array(F.lit(n_snps)))
    starts = F.concat(F.array(F.lit(-1)), F.col("positions"))
    gaps = F.zip_with(ends, starts, lambda e, s: F.array_repeat(F.lit(0.0), e - s - 1))
    values = F.concat(F.transform("dosages", lambda d: F.array(d.cast("double"))), F.array(F.array().cast("array<double>")))
    dense = F.flatten(F.zip_with(gaps, values, lambda g, v: F.concat(g, v)))
    return fused.select(*keep, F.concat(F.col("features").cast("array<double>"), dense).alias("features"))


def weighted_scores(
    dosages: DataFrame,
    weights: DataFrame,
    entity: str = "PATIENT_ID",
    cutoffs: Mapping[str, float | None] = PRS_CUTOFFS,
    strict_null: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Sum of dosage times weight for each cut-off, all in one aggregation.

    Entities without a usable SNP score zero. With ``strict_null`` a score is
    null when one of its terms is: an absent weight under a cut-off.
    """
    term = F.col("dosage") * F.col("beta")
    joined = dosages.join(weights.select("SNP_ID", "beta", "p_value"), "SNP_ID", "left")

    def score(cutoff: float | None) -> Column:
        used = F.col("beta").isNotNull() if cutoff is None else F.col("p_value") <= F.lit(cutoff)
        total = F.coalesce(F.sum(F.when(used, term)), F.lit(0.0))
        if strict_null:
            total = F.when(F.coalesce(F.sum(F.when(used & term.isNull(), 1)), F.lit(0)) == 0, total)
        return total if digits is None else F.round(total, digits)

    return joined.groupBy(entity).agg(*[score(c).alias(n) for n, c in cutoffs.items()])


def weighted_scores_dense(
    dosages: DataFrame, weights: DataFrame, entity: str = "PATIENT_ID", cutoffs: Mapping[str, float | None] = PRS_CUTOFFS
) -> DataFrame:
    """Scores that are null when an entity lacks the call of any SNP the score uses.

    Instead of filling the grid of entities and SNPs, the number of usable
    SNPs an entity has is compared with the number the weights have.
    """
    use = {n: (F.col("beta").isNotNull() if c is None else F.coalesce(F.col("p_value") <= F.lit(c), F.lit(False))) for n, c in cutoffs.items()}
    flagged = weights.select("SNP_ID", "beta", *[u.cast("int").alias(f"_u_{n}") for n, u in use.items()])
    needed = flagged.agg(*[F.coalesce(F.sum(f"`_u_{n}`"), F.lit(0)).alias(n) for n in cutoffs])
    aggregates = []
    for n in cutoffs:
        used = F.col(f"`_u_{n}`") == 1
        aggregates.append(F.coalesce(F.sum(F.when(used, F.col("dosage") * F.col("beta"))), F.lit(0.0)).alias(n))
        aggregates.append(F.count(F.when(used & F.col("beta").isNotNull() & F.col("dosage").isNotNull(), 1)).alias(f"_have_{n}"))
    have = dosages.join(flagged, "SNP_ID", "left").groupBy(entity).agg(*aggregates)
    return have.select(
        entity, *[F.when(F.col(f"`_have_{n}`") == needed.select(f"`{n}`").scalar(), F.col(f"`{n}`")).alias(n) for n in cutoffs]
    )
