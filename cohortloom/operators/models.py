"""Model fitting, search, scoring and attribution with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.param.shared import HasMaxIter, HasRegParam, HasTol
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators import many_logistic
from cohortloom.operators.boosting import PATIENCE, Boosted, fit_with_patience
from cohortloom.operators.metrics import binary_metrics
from cohortloom.operators.study import Space
from cohortloom.operators.splits import kfold_stratified, split_stratified
from cohortloom.session import discard, materialize


def assemble(df: DataFrame, inputs: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Wide columns to (keep, label, features). Rows with a null feature are an error of the caller."""
    rows = df.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(rows).select(*keep, "label", "features")


def from_arrays(df: DataFrame, array: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """An array column to (keep, label, features): no wide table in between."""
    return df.select(*keep, F.col(label).cast("double").alias("label"), array_to_vector(F.col(array).cast("array<double>")).alias("features"))


class PenalisedLogistic(Estimator, HasRegParam, HasMaxIter, HasTol):
    """Logistic regression without a free intercept, on features that end in a constant 1.

    Spark ML gives a feature without variance no weight. So every training row
    is there twice with half its weight, once mirrored: features negated and
    label exchanged. Each row's loss stays what it was, and the constant now varies.
    """

    def __init__(self, reg: float = 0.0, max_iter: int = 100, tol: float = 1e-6):
        super().__init__()
        self._setDefault(regParam=0.0, maxIter=100, tol=1e-6)
        self._set(regParam=reg, maxIter=max_iter, tol=tol)

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        x = vector_to_array(F.col("features"))
        mirror = F.struct((1.0 - F.col("label")).alias("label"), F.transform(x, lambda v: -v).alias("x"))
        both = dataset.select(F.explode(F.array(F.struct(F.col("label"), x.alias("x")), mirror)).alias("r"))
        rows = both.select("r.label", array_to_vector("r.x").alias("features"), F.lit(0.5).alias("half"))
        return LogisticRegression(
            regParam=self.getRegParam(),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=self.getMaxIter(),
            tol=self.getTol(),
            fitIntercept=False,
            weightCol="half",
        ).fit(rows)


def logistic(n_rows: int, c: float = 1.0, max_iter: int = 1000, penalised_intercept: bool = False) -> Estimator:
    """L2 logistic regression whose penalty equals an inverse strength ``c`` on summed losses.

    The intercept is free. With ``penalised_intercept`` it is the weight of a
    constant that ``with_constant`` appends to the features.
    """
    reg = 1.0 / (c * n_rows)
    if penalised_intercept:
        return PenalisedLogistic(reg, max_iter)
    return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6)


def with_constant(df: DataFrame) -> DataFrame:
    """Append a constant 1 to the features."""
    longer = F.concat(vector_to_array(F.col("features")), F.array(F.lit(1.0)))
    return df.withColumn("features", array_to_vector(longer))


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 1000, penalised_intercept: bool = False) -> LogisticRegressionModel:
    """Fit on (label, features); a penalised intercept is the last coefficient."""
    rows = with_constant(train) if penalised_intercept else train
    return logistic(train.count(), c, max_iter, penalised_intercept).fit(rows)


def fit_wide_logistic(train: DataFrame, c: float = 1.0, tol: float = 1e-7) -> LogisticRegressionModel:
    """``fit_logistic`` with a free intercept for many features of any scale.

    Spark ML's solver knows no curvature: unscaled features cost it thousands of passes, each a job. The optimum is found by
    ``many_logistic`` in tens of passes instead; bounds that leave nothing else make it a model of Spark ML.
    """
    about = train.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if about["low"] == about["high"]:
        return logistic(about["n"], c).fit(train)
    blocks = many_logistic.pack(train)
    weights = many_logistic.fit_many(blocks, [c], [many_logistic.NO_FOLD], tol=tol).weights[0]
    discard(blocks.table)
    only, intercept = DenseMatrix(1, len(weights) - 1, weights[:-1]), DenseVector(weights[-1:])
    return LogisticRegression(
        regParam=1.0 / (c * about["n"]),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1,
        lowerBoundsOnCoefficients=only,
        upperBoundsOnCoefficients=only,
        lowerBoundsOnIntercepts=intercept,
        upperBoundsOnIntercepts=intercept,
    ).fit(train)


# The deepest tree Spark ML grows.
MAX_DEPTH = 30


def _depth(max_depth: int) -> int:
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth is {max_depth}; trees end at {MAX_DEPTH}")
    return max_depth


def random_forest(n_estimators: int = 100, max_depth: int = 5, seed: int = 42) -> RandomForestClassifier:
    """A depth beyond what Spark ML grows is an error."""
    return RandomForestClassifier(
        numTrees=n_estimators,
        maxDepth=_depth(max_depth),
        featureSubsetStrategy="sqrt",
        seed=seed,
        cacheNodeIds=True,
        checkpointInterval=10,
    )


def boosted_trees(
    n_estimators: int = 100,
    learning_rate: float = 0.1,
    max_depth: int = 6,
    subsample: float = 1.0,
    colsample: float = 1.0,
    gamma: float = 0.0,
    min_child_weight: int = 1,
    seed: int = 42,
) -> GBTClassifier:
    """Gradient boosted trees of all rounds; ``boosting`` stops them early."""
    return GBTClassifier(
        maxIter=n_estimators,
        stepSize=learning_rate,
        maxDepth=_depth(max_depth),
        subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample) if colsample < 1.0 else "all",
        minInfoGain=gamma,
        minInstancesPerNode=min_child_weight,
        seed=seed,
    )


def boosted_with_patience(
    train: DataFrame, id_: str, params: Mapping[str, object], holdout: float = 0.15, seed: int = 42, patience: int = PATIENCE
) -> Boosted:
    """Final boosted fit that stops by a stratified part of the training rows, with the losses it stopped by."""
    parts = materialize(split_stratified(train, "label", id_, holdout, seed, "_part"), "boosted")
    grown, checked = parts.filter("_part = 'train'"), parts.filter("_part = 'test'")
    return fit_with_patience(grown, checked, partial(boosted_trees, seed=seed), params, patience)


def fit_boosted(
    train: DataFrame, id_: str, params: Mapping[str, object], holdout: float = 0.15, seed: int = 42, patience: int = PATIENCE
) -> Model:
    """The ensemble of ``boosted_with_patience``."""
    return boosted_with_patience(train, id_, params, holdout, seed, patience).model


# Search ranges. A forest's depth ends at the last step below what Spark ML grows.
FOREST_SPACE: Space = {"n_estimators": ("int", 50, 500, 50), "max_depth": ("int", 5, 25, 10)}
BOOSTED_SPACE: Space = {
    "n_estimators": ("int", 100, 1000, 1),
    "learning_rate": ("log", 0.01, 0.3, None),
    "max_depth": ("int", 3, 10, 1),
    "subsample": ("float", 0.6, 1.0, None),
    "colsample": ("float", 0.6, 1.0, None),
    "gamma": ("float", 0.0, 0.5, None),
    "min_child_weight": ("int", 1, 10, 1),
}
LOGISTIC_SPACE: Space = {"c": ("log", 1e-4, 10.0, None)}


def draw(space: Space, trials: int, seed: int = 42) -> list[dict[str, float | int]]:
    """Seeded random draws from a search space, for searches without a study."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        one: dict[str, float | int] = {}
        for name, (kind, low, high, step) in space.items():
            if kind == "int":
                one[name] = int(low + step * rng.randint(0, int((high - low) // step)))
            elif kind == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                one[name] = rng.uniform(low, high)
        out.append(one)
    return out


def fold_scores(
    folded: DataFrame,
    estimator: Callable[..., object],
    candidates: Sequence[Mapping[str, object]],
    folds: int = 10,
    parallelism: int = 4,
) -> list[float]:
    """Mean F1 of each candidate over the folds of (label, features, fold).

    ``estimator`` makes a Spark ML estimator from one candidate. All candidates
    share one base estimator and go through one cross validator, which fits
    them in parallel on the cluster.
    """
    made = [estimator(**c) for c in candidates]
    base = made[0]
    maps = [{base.getParam(p.name): v for p, v in m.extractParamMap().items()} for m in made]
    evaluator = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(
        estimator=base, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism
    ).fit(folded.select("label", "features", "fold"))
    return [float(m) for m in cv.avgMetrics]


def search(
    train: DataFrame,
    id_: str,
    estimator: Callable[..., object],
    candidates: Sequence[Mapping[str, object]],
    folds: int = 10,
    seed: int = 42,
    parallelism: int = 4,
) -> list[tuple[dict[str, object], float]]:
    """Candidates with their mean F1 over stratified folds, best first."""
    folded = materialize(kfold_stratified(train, "label", id_, folds, seed), "folds")
    scores = fold_scores(folded, estimator, candidates, folds, parallelism)
    return sorted(((dict(c), m) for c, m in zip(candidates, scores, strict=True)), key=lambda pair: -pair[1])


def score(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Probability of both classes and the decision at 0.5."""
    p = vector_to_array(F.col("probability"))
    return model.transform(df).select(
        *keep,
        p[0].alias("prob_class_0"),
        p[1].alias("prob_class_1"),
        (p[1] >= 0.5).cast("int").alias("predicted"),
    )


def cross_validated_report(df: DataFrame, id_: str, fit: Callable[[DataFrame], Model], folds: int = 10, seed: int = 42) -> DataFrame:
    """Metrics of every fold and their means (fold -1)."""
    folded = materialize(kfold_stratified(df, "label", id_, folds, seed), "folds")
    scored = []
    for k in range(folds):
        model = fit(folded.filter(F.col("fold") != k))
        scored.append(score(model, folded.filter(F.col("fold") == k), ["fold", "label"]))
    rows = materialize(reduce(DataFrame.unionByName, scored), "scored")
    per_fold = binary_metrics(rows, ["fold"], "label", "prob_class_1").select("fold", "accuracy", "roc_auc")
    means = per_fold.agg(F.lit(-1).alias("fold"), F.avg("accuracy").alias("accuracy"), F.avg("roc_auc").alias("roc_auc"))
    return per_fold.unionByName(means)


def named_weights(spark: SparkSession, names: Sequence[str], weights: Sequence[float], column: str) -> DataFrame:
    """A model's weights as a table: one row per model input, so bounded by the model itself."""
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], f"variable string, {column} double")


def coefficient_table(spark: SparkSession, model: LogisticRegressionModel, names: Sequence[str]) -> DataFrame:
    return named_weights(spark, names, model.coefficients.toArray(), "coefficient")


def importance_table(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    return named_weights(spark, names, model.featureImportances.toArray(), "importance")


def linear_attributions(df: DataFrame, id_: str, array: str, coefficients: Sequence[float]) -> DataFrame:
    """Exact Shapley values of a linear model on the log-odds: weight times distance from the mean.

    The means are one row, so they enter as scalar subqueries.
    """
    size = len(coefficients)
    means = df.agg(F.array(*[F.avg(F.col(array)[i].cast("double")) for i in range(size)]).alias("m"))
    weights = F.array(*[F.lit(float(c)) for c in coefficients])
    rows = df.select(id_, F.posexplode(array).alias("feature", "x"), means.scalar().alias("m"))
    phi = F.get(weights, F.col("feature")) * (F.col("x").cast("double") - F.get(F.col("m"), F.col("feature")))
    return rows.select(id_, "feature", phi.alias("shapley"))


def column_means(df: DataFrame, array: str, size: int) -> DataFrame:
    """One row whose ``features`` are the means of the array's elements over all rows."""
    return df.agg(F.array(*[F.avg(F.col(array)[i].cast("double")) for i in range(size)]).alias("features"))


def permutation_attributions(
    model: Model, rows: DataFrame, background: DataFrame, id_: str, size: int, seed: int = 42
) -> DataFrame:
    """Shapley values of the positive class by one permutation of the features and its reverse.

    Walking a permutation, features change one by one from a background row to
    the explained row; each step's change of the probability goes to the
    feature that moved. Averages are over the walk, its reverse and the
    background rows. ``rows`` and ``background`` have a ``features`` array.
    Every background row is used, and all are put beside each walk: for a large
    population give its ``column_means``. Each walk is exploded into model
    inputs, so the model runs as an ordinary distributed transform.
    """
    pool = materialize(background.agg(F.collect_list(F.col("features").cast("array<double>")).alias("_pool")), "pool")
    positions = F.sequence(F.lit(0), F.lit(size - 1))
    order = F.transform(
        F.array_sort(
            F.transform(
                positions, lambda i: F.struct(F.xxhash64(F.col(id_), i, F.lit(seed)).alias("h"), i.alias("i"))
            )
        ),
        lambda s: s["i"],
    )
    # Each walk is its order and, for every feature, the step at which it has moved.
    moved_at = F.transform(positions, lambda i: F.array_position("_forward", i).cast("int"))
    walks = (
        rows.select(id_, F.col("features").cast("array<double>").alias("_x"), order.alias("_forward"))
        .withColumn("_moved_at", moved_at)
        .withColumn(
            "_walk",
            F.explode(
                F.array(
                    F.struct(F.col("_forward").alias("order"), F.col("_moved_at").alias("at")),
                    F.struct(
                        F.reverse("_forward").alias("order"),
                        F.transform("_moved_at", lambda k: F.lit(size + 1) - k).alias("at"),
                    ),
                )
            ),
        )
        .withColumn("_order", F.col("_walk.order"))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(size))))
        .withColumn("_b", F.explode(pool.scalar()))
    )
    hybrid = F.transform(
        F.arrays_zip(F.col("_x").alias("x"), F.col("_b").alias("b"), F.col("_walk.at").alias("at")),
        lambda z: F.when(z["at"] <= F.col("_step"), z["x"]).otherwise(z["b"]),
    )
    inputs = walks.select(id_, "_order", "_step", array_to_vector(hybrid).alias("features"))
    p = vector_to_array(F.col("probability"))[1]
    # The output after step k counts for the feature moved at k and against the one moved next.
    gains = F.array(
        F.struct(F.get(F.col("_order"), F.col("_step") - 1).alias("feature"), p.alias("gain")),
        F.struct(F.get(F.col("_order"), F.col("_step")).alias("feature"), (-p).alias("gain")),
    )
    n_walks = F.lit(2) * F.size(pool.scalar())
    return (
        model.transform(inputs)
        .select(id_, F.explode(gains).alias("_g"))
        .select(id_, "_g.feature", "_g.gain")
        .filter(F.col("feature").isNotNull())
        .groupBy(id_, "feature")
        .agg((F.sum("gain")).alias("_sum"))
        .select(id_, "feature", (F.col("_sum") / n_walks).alias("shapley"))
    )


def mean_absolute(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("shapley")).alias("mean_abs_shapley"))
