"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Words are re-coded as 8-byte codes (their hashes) before compression: in raw letters a short
insult saves about one byte, less than the noise of a window, while a code that a dictionary
holds saves about six and one that it lacks saves none. The toxic dictionary is trained on the
segments of toxic rows that ordinary rows don't explain, the ordinary one the other way round;
both are raw-content dictionaries. Each window of ``WINDOW`` words is compressed with both;
the differences of the lengths give the mean per word and the largest of a text, whose
threshold is calibrated by logistic regression on labelled rows that trained no dictionary.

Defined results: empty and null texts get the calibrated score of a text without evidence;
null labels teach nothing; repeated rows get equal rows; without rows of both labels the
score is the share of toxic labels among those known (0 if none is).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import (
    blocks,
    flat,
    held_out,
    labelled_sample,
    learnt_from,
    read_table,
    ready,
    word_hashes,
    word_spans,
)

#: Words of a window.
WINDOW = 64
#: Labelled rows of each label that the fit takes: its bound, whatever the table's size.
SAMPLE_ROWS = 4000
#: Words of a dictionary at most; a word is a segment if so many rows of its label hold it, so many times as often.
DICTIONARY_WORDS, SEGMENT_ROWS, SEGMENT_ODDS = 2048, 6, 6.0
LEVEL = 1
PREDICT = 0.3

#: Letters, digits and bytes over 127 make words; the rest are gaps.
GAP = np.ones(256, bool)
GAP[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    GAP[_low:_high] = False


def word_codes(column: pa.Array) -> Iterator[np.ndarray]:
    """The words of each text as 64-bit codes."""
    buf, offs = flat(column)
    for first, last in blocks(offs):
        part, own = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        starts, ends, bounds = word_spans(part, own, GAP)
        codes = word_hashes(part, starts, ends)
        for k in range(last - first):
            yield codes[bounds[k] : bounds[k + 1]]


class _Distance:
    """Differences of window lengths under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.coders = []
        for content in (ordinary, toxic):
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.coders.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False)
            )

    def features(self, codes: np.ndarray) -> tuple[float, float, float]:
        """Sum of differences per word, the largest of a window, and the logarithm of the length."""
        if len(codes) == 0:
            return 0.0, 0.0, 0.0
        ordinary, toxic = self.coders
        total, largest = 0, -1000
        for i in range(0, len(codes), WINDOW):
            window = codes[i : i + WINDOW].tobytes()
            gain = len(ordinary.compress(window)) - len(toxic.compress(window))
            total += gain
            largest = max(largest, gain)
        return total / (len(codes) + 8.0), largest / 8.0, float(np.log1p(len(codes)))


def _rows_with(texts: list[np.ndarray]) -> dict[int, int]:
    if not texts:
        return {}
    words, n = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    return dict(zip(words.tolist(), n.tolist(), strict=True))


def _segments(own: dict[int, int], other: dict[int, int], n_own: int, n_other: int) -> bytes:
    """Codes of the words that rows of one label hold far more often; the most frequent last, where matches cost least."""
    scale = SEGMENT_ODDS * n_own / max(1, n_other)
    found = sorted((n, w) for w, n in own.items() if n >= SEGMENT_ROWS and n >= scale * (other.get(w, 0) + 0.5))
    return np.array([w for _, w in found[-DICTIONARY_WORDS:]], np.uint64).tobytes() or bytes(8)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; the intercept is last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The two dictionaries and the calibration from (doc_id, text) and (doc_id, toxic); ``SAMPLE_ROWS`` bounds the rows taken."""
    known = labels.where(F.col("toxic").isin(0, 1))
    sample = labelled_sample(docs, labels, "toxic", SAMPLE_ROWS)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(2)).alias("part")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.tobytes() for c in word_codes(batch.column("text"))]
            arrays = [batch.column("toxic"), batch.column("part"), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "part", "codes"])

    taken = sample.select("text", "toxic", part)
    got = taken.mapInArrow(codes, "toxic int, part long, codes binary").collect()
    got.sort(key=lambda r: bytes(r["codes"]))
    text = {(t, p): [np.frombuffer(r["codes"], np.uint64) for r in got if (r["toxic"], r["part"]) == (t, p)] for t in (0, 1) for p in (0, 1)}
    n_toxic = sum(r["toxic"] for r in got)
    share = n_toxic / len(got) if got else 0.0
    if not all(text.values()):
        return {"share": share}
    toxic, ordinary = _rows_with(text[1, 0]), _rows_with(text[0, 0])
    n1, n0 = len(text[1, 0]), len(text[0, 0])
    model = {"ordinary": _segments(ordinary, toxic, n0, n1), "toxic": _segments(toxic, ordinary, n1, n0)}
    distance = _Distance(model["ordinary"], model["toxic"])
    held = [(distance.features(t), y) for y in (0, 1) for t in text[y, 1]]
    model["weights"] = _logistic(np.array([f for f, _ in held]), np.array([y for _, y in held], float))
    # The sample may hold the labels in other shares than the table.
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = (counts.get(1, 1) / max(1, counts.get(0, 1))) / (max(1, len(text[1, 1])) / max(1, len(text[0, 1])))
    model["weights"][-1] += float(np.log(odds))
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) to (doc_id, score)."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_WORDS codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        distance = _Distance(fitted["ordinary"], fitted["toxic"]) if "weights" in fitted else None
        for batch in batches:
            if distance is None:
                p = np.full(batch.num_rows, fitted["share"])
            else:
                x = np.array([distance.features(c) for c in word_codes(batch.column("text"))]).reshape(-1, 3)
                z = np.column_stack([x, np.ones(len(x))]) @ fitted["weights"]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learnt_from(F.col("doc_id"), 4, 2))
    model = learn(docs, labels)
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
    )
