"""Properties of fitting, search, scoring and attribution."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortloom.catalog.queries import QUERIES
from cohortloom.catalog.views import Views
from cohortloom.operators import models, splits
from cohortloom.plans import fusion
from cohortloom.session import materialize


@pytest.fixture(scope="module")
def rows(spark, folder):
    return materialize(models.from_arrays(Views(spark, folder).ml(), "embedding", "y", ["id"]))


def _arrays(rows):
    data = rows.select(vector_to_array("features").alias("x"), "label").toPandas()
    return np.array(data["x"].tolist()), data["label"].to_numpy()


@pytest.mark.parametrize("penalised", [False, True])
def test_logistic_gradient_is_zero(rows, penalised):
    model = models.fit_logistic(rows, c=0.5, penalised_intercept=penalised)
    x, y = _arrays(rows)
    if penalised:
        x = np.hstack([x, np.ones((len(x), 1))])
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) + w / 0.5).max() < 1e-2
    if not penalised:
        assert abs((p - y).sum()) < 1e-2


def test_draws_are_repeatable_and_in_range():
    a, b = models.draw(models.BOOSTED_SPACE, 20), models.draw(models.BOOSTED_SPACE, 20)
    assert a == b
    for one in a:
        for name, (_, low, high, _) in models.BOOSTED_SPACE.items():
            assert low <= one[name] <= high
    assert all(d["n_estimators"] % 50 == 0 and d["max_depth"] % 10 == 5 for d in models.draw(models.FOREST_SPACE, 20))


def test_search_ranks_candidates(rows):
    found = models.search(rows, "id", lambda n_estimators, max_depth: models.random_forest(n_estimators, max_depth), [{"n_estimators": 5, "max_depth": 2}, {"n_estimators": 5, "max_depth": 5}], folds=2)
    assert len(found) == 2 and found[0][1] >= found[1][1]


def test_boosting_stops_on_its_own_part(rows):
    model = models.fit_boosted(rows, "id", {"n_estimators": 5, "max_depth": 2})
    scored = models.score(model, rows, ["id"]).agg(F.max(F.abs(F.col("prob_class_0") + F.col("prob_class_1") - 1))).first()[0]
    assert scored < 1e-9


def test_report_has_every_fold_and_the_mean(rows):
    report = models.cross_validated_report(rows, "id", lambda t: models.fit_logistic(t, max_iter=20), folds=3).toPandas().set_index("fold")
    assert sorted(report.index) == [-1, 0, 1, 2]
    assert report.loc[-1, "accuracy"] == pytest.approx(report.loc[[0, 1, 2], "accuracy"].mean())


def test_attributions_add_up(spark, rows):
    model = models.fit_logistic(rows, max_iter=20)
    arrays = rows.select("id", vector_to_array("features").alias("features"))
    explained = arrays.filter("id < 5")
    background = arrays.filter("id between 10 and 12")
    phi = models.permutation_attributions(model, explained, background, "id", 64).groupBy("id").agg(F.sum("shapley").alias("s"))
    prob = models.score(model, rows, ["id"]).select("id", F.col("prob_class_1").alias("f"))
    expected = prob.filter("id between 10 and 12").agg(F.avg("f")).first()[0]
    wrong = phi.join(prob, "id").filter(F.abs(F.col("s") - (F.col("f") - expected)) > 1e-9)
    assert phi.count() == 5 and wrong.count() == 0


def test_attributions_use_the_whole_background(spark, rows):
    model = models.fit_logistic(rows, max_iter=20)
    arrays = rows.select("id", vector_to_array("features").alias("features"))
    means = models.column_means(arrays, "features", 64)
    want = np.array([r["features"] for r in arrays.collect()], float).mean(0)
    assert means.first()["features"] == pytest.approx(want.tolist())
    # More than 100 rows, the former limit.
    background = arrays.limit(120)
    assert background.count() == 120
    phi = models.permutation_attributions(model, arrays.filter("id < 2"), background, "id", 64)
    total = phi.groupBy("id").agg(F.sum("shapley").alias("s"))
    prob = models.score(model, rows, ["id"]).select("id", F.col("prob_class_1").alias("f"))
    expected = prob.join(background, "id").agg(F.avg("f")).first()[0]
    assert total.join(prob, "id").filter(F.abs(F.col("s") - (F.col("f") - expected)) > 1e-9).count() == 0


def test_permutation_equals_linear_form_for_a_linear_output(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 5.0])], "id int, features array<double>")
    got = {(r["id"], r["feature"]): r["shapley"] for r in models.linear_attributions(df, "id", "features", [2.0, -1.0]).collect()}
    assert got == {(0, 0): -2.0, (0, 1): 1.5, (1, 0): 2.0, (1, 1): -1.5}


def test_tables_of_model_weights(spark, rows):
    model = models.fit_logistic(rows, max_iter=20)
    names = [f"x{i}" for i in range(64)]
    assert models.coefficient_table(spark, model, names).count() == 64
    forest = models.random_forest(5, 3).fit(rows)
    total = models.importance_table(spark, forest, names).agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)


def test_late_fusion(spark):
    table = spark.range(400).select(
        F.col("id").alias("PATIENT"),
        splits.hash_fraction(F.col("id"), 1).alias("EHR_CVD_score"),
        splits.hash_fraction(F.col("id"), 2).alias("PRS"),
    ).withColumn("CVD", (F.col("EHR_CVD_score") + 0.2 * F.col("PRS") > 0.6).cast("int"))
    result = fusion.fit_fusion(table, "scores", trials=2, folds=2)
    m = result.metrics.first()
    assert result.scored.count() in range(79, 82)
    assert m["roc_auc"] > 0.9 and 0 < m["auprc"] <= 1 and m["C_best"] == result.best_c


def test_depth_beyond_the_deepest_tree_is_an_error():
    with pytest.raises(ValueError):
        models.random_forest(5, 200)


def test_registered_report_has_ten_folds(spark, folder):
    assert sorted(r["fold"] for r in QUERIES["cv_report"](spark, folder).collect()) == [-1, *range(10)]
