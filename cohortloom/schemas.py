"""Schemas of the input files. Codes are always strings: lists mix numbers and text."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

OBSERVATIONS = _struct(PATIENT=_S, DATE=_S, CODE=_S, DESCRIPTION=_S, VALUE=_S)
CONDITIONS = _struct(PATIENT=_S, START=_S, CODE=_S, DESCRIPTION=_S, ENCOUNTER=_S)
ENCOUNTERS = _struct(PATIENT=_S, START=_S, DESCRIPTION=_S)
PATIENTS = _struct(Id=_S, FIRST=_S, LAST=_S, BIRTHDATE=_S, GENDER=_S, RACE=_S)
MEDICATIONS = _struct(PATIENT=_S)
CODE_LIST = _struct(code=_S)
FEATURE_CHOICE = T.StructType([T.StructField("DESCRIPTION", _S), T.StructField("keep.", _S)])
GENOTYPE_CALLS = _struct(
    CHROMOSOME=_S,
    LOCATION=_S,
    ANCESTRAL_ALLELE=_S,
    VARIANT_ALLELE_LIST=_S,
    ALLELE=_S,
    VARIANT=_S,
)
SUMMARY_STATISTICS = _struct(
    chromosome=_S,
    base_pair_location=_S,
    effect_allele=_S,
    other_allele=_S,
    beta=_D,
    p_value=_D,
)
