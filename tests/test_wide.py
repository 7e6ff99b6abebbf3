"""Fits of wide model inputs in few passes, and the order of the joins of large tables."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel

from cohortloom.catalog.views import Views
from cohortloom.operators import models
from cohortloom.plans import modelling
from cohortloom.session import materialize
from cohortloom.sources.files import load_model, save_model


def test_wide_logistic_ends_at_the_optimum(spark, tmp_path):
    """Slices that hardly differ from each other: the optimum, in a few dozen jobs where Spark ML's solver takes hundreds."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 5, 1)) + 0.03 * rng.normal(size=(400, 5, 8)).cumsum(axis=2)).reshape(400, 40) * np.repeat(10.0 ** np.arange(-1, 4), 8) / 10
    z = x / x.std(axis=0)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * (z[:, 7] - z[:, 0] + z[:, 15])))).astype(float)
    rows = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, a array<double>").repartition(4)
    train = materialize(models.from_arrays(rows, "a", "y"))
    spark.sparkContext.setJobGroup("wide", "wide")
    model = modelling.KINDS["logistic"].fit(train, "id", {"c": 10.0})
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("wide"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    w, b = model.coefficients.toArray(), model.intercept
    miss = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs((miss @ x + w / 10.0) / x.std(axis=0)).max() < 1e-2 and abs(miss.sum()) < 1e-2
    assert 0 < jobs < 100, jobs
    save_model(model, f"{tmp_path}/wide")
    assert np.array_equal(load_model(LogisticRegressionModel, f"{tmp_path}/wide").coefficients.toArray(), w)


def test_wide_logistic_of_one_class(spark):
    train = models.from_arrays(spark.createDataFrame([(1.0, [1.0, 2.0]), (1.0, [0.0, 5.0])], "y double, a array<double>"), "a", "y")
    p = models.score(models.fit_wide_logistic(train), train, ["label"]).toPandas()["prob_class_1"]
    assert p.tolist() == [1.0, 1.0]


def test_records_are_filtered_before_they_meet_the_orders(spark, folder):
    some = Views(spark, folder).observations().filter("DESCRIPTION = 'brand#9'")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "l_partkey" in joins[1]
