"""Classical risk factors and their logistic risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.dates import age_years
from cohortloom.functions.numbers import fill_constant, natural_log
from cohortloom.functions.text import clean, map_values
from cohortloom.operators import aggregates, joins, models
from cohortloom.plans.genotype import SEX_CODES

# Codes of the three laboratory factors.
FACTOR_CODES = {"Total Cholesterol": "2093-3", "HDL-C": "2085-9", "Systolic Blood Pressure": "8480-6"}
# Coding of smoking status and race.
SMOKER_CODES = {"current smoker": 1, "former smoker": 1, "never smoker": 0}
RACE_CODES = {"white": 0, "black": 1, "asian": 0, "other": 0, "native": 0}
# Descriptions looked for.
DIABETES = "diabetes"
SMOKING = "tobacco smoking status nhis"


def risk_factors(
    x_agg: DataFrame,
    patients: DataFrame,
    encounters: DataFrame,
    conditions: DataFrame,
    observations: DataFrame,
    codes: Mapping[str, str] = FACTOR_CODES,
    diabetes: str = DIABETES,
    smoking: str = SMOKING,
    years: int = 4,
) -> DataFrame:
    """One row per patient: three medians, race, sex, age, diabetes and smoking in the window.

    ``x_agg`` is the long feature table, or its medians of the three codes (``features.dense_medians``).
    Descriptions are filtered before the joins, so only matching records are shuffled.
    """
    wanted = x_agg.filter(F.col("feature").isin(*codes.values()))
    medians = wanted.groupBy("PATIENT").agg(
        *[F.max(F.when(F.col("feature") == code, F.col("median"))).alias(name) for name, code in codes.items()]
    )
    first = aggregates.first_event(encounters, "PATIENT", "START", "FIRST_ENCOUNTER_DATE")
    people = patients.select(F.col("Id").alias("PATIENT"), "RACE", "GENDER", "BIRTHDATE")
    base = medians.join(people, "PATIENT", "left").join(first, "PATIENT", "left")

    sick = conditions.filter(clean(F.col("DESCRIPTION")) == diabetes).select("PATIENT", "START")
    sick = joins.within_horizon(sick, first, "PATIENT", "START", "FIRST_ENCOUNTER_DATE", years)
    has_diabetes = aggregates.any_match(sick, ["PATIENT"], F.lit(True), "Diabetes")

    smoke = observations.filter(clean(F.col("DESCRIPTION")) == smoking).select("PATIENT", "DATE", "VALUE")
    smoke = joins.within_horizon(smoke, first, "PATIENT", "DATE", "FIRST_ENCOUNTER_DATE", years)
    status = aggregates.last_row(smoke, "PATIENT", ["DATE", "VALUE"], ["VALUE"])
    smoker = status.select("PATIENT", map_values(clean(F.col("VALUE")), SMOKER_CODES).alias("Smoker"))

    joined = base.join(has_diabetes, "PATIENT", "left").join(smoker, "PATIENT", "left")
    return joined.select(
        "PATIENT",
        *codes,
        "RACE",
        "GENDER",
        "FIRST_ENCOUNTER_DATE",
        age_years(F.col("BIRTHDATE"), F.col("FIRST_ENCOUNTER_DATE"), years).alias("AGE"),
        fill_constant(F.col("Diabetes")).alias("Diabetes"),
        fill_constant(F.col("Smoker")).alias("Smoker"),
    )


# Inputs of the risk model.
RISK_INPUTS = (
    "BINARY SEX",
    "BINARY RACE",
    "Log Age",
    "Log Total Cholesterol",
    "Log HDL-C",
    "Log Systolic BP",
    "Diabetes",
    "Smoker",
)


def risk_inputs(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """Binary sex and race, logarithms and the label."""
    coded = factors.select(
        "PATIENT",
        map_values(F.col("GENDER"), SEX_CODES).alias("BINARY SEX"),
        map_values(F.col("RACE"), RACE_CODES).alias("BINARY RACE"),
        natural_log(F.col("AGE")).alias("Log Age"),
        natural_log(F.col("Total Cholesterol")).alias("Log Total Cholesterol"),
        natural_log(F.col("HDL-C")).alias("Log HDL-C"),
        natural_log(F.col("Systolic Blood Pressure")).alias("Log Systolic BP"),
        "Diabetes",
        "Smoker",
    )
    return coded.join(labels.select("PATIENT", "CVD"), "PATIENT", "left")


def risk_model(inputs: DataFrame):
    """Fitted model, in-sample probabilities (PATIENT, label, ASCVD) and coefficients."""
    rows = models.assemble(inputs, RISK_INPUTS, "CVD", ["PATIENT"])
    model = models.fit_logistic(rows)
    scored = models.score(model, rows, ["PATIENT", "label"]).select("PATIENT", "label", F.col("prob_class_1").alias("ASCVD"))
    return model, scored, models.coefficient_table(inputs.sparkSession, model, RISK_INPUTS)
