"""Quality classifier: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

Tokens are runs of letters and digits, each run of other characters between blanks, and a mark
for a token that repeats its predecessor. Their 1- and 2-grams are hashed to ``DIMENSIONS``
weights; a text is the vector of its n-gram counts scaled to length 1, and its score a sparse
dot product. The per-coordinate updates are those of FTRL-Proximal (McMahan et al. 2013).

Defined results: empty and null texts have no n-gram and get the score of the intercept; null
labels teach nothing; repeated rows get equal rows; without a learning row the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import (
    SPACE,
    blocks,
    flat,
    held_out,
    labelled_sample,
    learnt_from,
    mix,
    read_table,
    ready,
    shingle_hashes,
    word_hashes,
)

#: Hashed coordinates; the weights are a broadcast of 4 bytes for each.
DIMENSIONS = 1 << 18
#: Labelled rows of each label that the fit takes: its bound, whatever the table's size.
SAMPLE_ROWS = 4000
EPOCHS = 4
#: Learning rate, its damping, and the strengths of the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
PREDICT = 0.5

_REPEAT = np.uint64(0x7265706561740001)
#: 0: blank, 1: letter, digit or byte over 127, 2: any other.
KIND = np.full(256, 2, np.uint8)
KIND[128:] = 1
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    KIND[_low:_high] = 1
KIND[SPACE] = 0


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens and for each row the index of its first one (and one more)."""
    if len(buf) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    kind = KIND[buf]
    new = np.empty(len(buf), bool)
    new[0], new[1:] = True, kind[1:] != kind[:-1]
    new[offs[:-1][offs[:-1] < len(buf)]] = True
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(buf))
    there = kind[at] > 0
    starts, ends = at[there], ends[there]
    return word_hashes(buf, starts, ends, lower=False), np.searchsorted(starts, offs)


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Coordinates and values of each text."""
    buf, offs = flat(column)
    for first, last in blocks(offs):
        words, bounds = _tokens(buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        if len(words):
            again = np.zeros(len(words), bool)
            again[1:] = words[1:] == words[:-1]
            again[bounds[:-1][bounds[:-1] < len(words)]] = False
            words = np.where(again, _REPEAT, words)
        pairs, at = shingle_hashes(words, bounds, 2)
        for k in range(last - first):
            grams = np.concatenate([mix(words[bounds[k] : bounds[k + 1]]), pairs[at[k] : at[k + 1]]])
            where, n = np.unique((grams & np.uint64(DIMENSIONS - 1)).astype(np.int64), return_counts=True)
            yield where, n / max(1e-12, float(np.sqrt((n.astype(float) ** 2).sum())))


class Leader:
    """FTRL-Proximal for logistic loss; coordinate ``DIMENSIONS`` is the intercept, which has no penalty."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        out = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, out)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, DIMENSIONS), np.append(x, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """Weights from (doc_id, text) and (doc_id, quality), intercept last; None without a learning row.

    The rows taken are bounded by ``SAMPLE_ROWS``; one executor task runs the updates over them
    and returns the weights, so that neither texts nor vectors reach the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    taken = labelled_sample(docs, labels, "quality", SAMPLE_ROWS).select(
        "text", "quality", F.xxhash64("doc_id", F.lit("order")).alias("place")
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            labels = batch.column("quality").to_pylist()
            seen += [(x, y) for x, y in zip(vectors(batch.column("text")), labels, strict=True)]
        if seen:
            model = Leader()
            for _ in range(EPOCHS):
                for (at, x), y in seen:
                    model.update(at, x, y)
            weights = model.weights(slice(None))
            taken = [sum(y == label for _, y in seen) for label in (0, 1)]
            if all(taken):
                # The sample may hold the labels in other shares than the table.
                weights[DIMENSIONS] += np.log(counts[1] / counts[0] * taken[0] / taken[1])
            found = weights.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["weights"])

    # The sampled rows alone are brought together: the documents are scanned and joined in all tasks.
    got = taken.repartition(1).sortWithinPartitions("place", "text").mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else None


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, text) to (doc_id, score)."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights)  # 4 bytes for each of DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            z = [0.0 if w is None else float(w[at] @ x) + float(w[DIMENSIONS]) for at, x in vectors(batch.column("text"))]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(learnt_from(F.col("doc_id"), 3, 1))
    weights = learn(docs, labels)
    return score(docs, weights).select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
    )
