"""Shared by the operators: text columns as byte buffers, words as 64-bit hashes, bounded samples.

Every mapper works on Arrow batches of few rows, cut once more into blocks of about ``BLOCK``
bytes, so that its arrays stay small whatever the length of the texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import prepare

# Executors get the mappers by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules["cohortloom.llm"])

#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 20
#: Bytes whose words are hashed in one go: arrays of this length stay in the cache.
SPAN = 1 << 15
#: Rows in an Arrow batch: bounds what a worker holds when every text is long.
BATCH_ROWS = 128

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_INVERSE = _U(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
#: The bytes space and 9 to 13 end a word.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ready(spark: SparkSession) -> SparkSession:
    """The session with the library's runtime settings and small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has."""
    return base + "_" * max(map(len, df.columns), default=0)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, rest: int) -> Column:
    """Whether the id falls in the held-out bucket; false for a null id, which is not learnt from either."""
    return F.coalesce(bucket_of(doc_id, n) == rest, F.lit(False))


def learnt_from(doc_id: Column, n: int, rest: int) -> Column:
    return F.coalesce(bucket_of(doc_id, n) != rest, F.lit(False))


def sample_by_hash(df: DataFrame, key: str, per_key: int) -> DataFrame:
    """About ``per_key`` rows of each value of ``key``, chosen by a hash of ``doc_id``.

    The expected size is ``per_key`` times the number of values, however large the table is:
    one aggregation counts the values, then each row is kept with the fraction of its value.
    ``key`` has a bounded number of values (languages, labels).
    """
    counts = {r[key]: r["n"] for r in df.groupBy(key).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        share = F.when(F.col(key) == F.lit(value), min(1.0, per_key / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(place < share)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, per_key: int) -> DataFrame:
    """(doc_id, text, ``key``) of about ``per_key`` labelled rows of each label 0 and 1.

    The sample is drawn from the labels alone; its ids, about ``2 * per_key`` whatever the
    tables' size, are broadcast to the scan of the documents, so that no text is shuffled.
    """
    known = labels.where(F.col(key).isin(0, 1)).select("doc_id", F.col(key).cast("int").alias(key))
    return docs.select("doc_id", "text").join(F.broadcast(sample_by_hash(known, key, per_key)), "doc_id")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about ``size`` bytes together, one row at least."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (and one more)."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    gap = space[buf]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = True
    after = np.empty_like(gap)
    after[-1], after[:-1] = True, gap[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased on request; computed in spans of whole words."""
    out = np.empty(len(starts), _U)
    up, down = (_powers(min(SPAN, len(buf)), base) for base in (_BASE, _INVERSE))
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + SPAN, "right")))
        part = buf[low : int(ends[last - 1])]
        if len(part) > len(up):  # one long word
            up, down = _powers(len(part), _BASE), _powers(len(part), _INVERSE)
        part = (_LOWER[part] if lower else part).astype(_U)
        part += _U(1)
        part *= up[: len(part)]
        total = np.empty(len(part) + 1, _U)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((total[e] - total[s]) * down[s] + _U(0x51ED27) * (e - s).astype(_U))
        first = last
    return out


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of each row; a row with fewer words has its whole sequence as one run.

    Returns the hashes and for each row the index of its first one (and one more); a row without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    at = np.zeros(len(bounds), np.int64)
    np.cumsum(count, out=at[1:])
    first = np.repeat(bounds[:-1] - at[:-1], count) + np.arange(at[-1])
    row_end = np.repeat(bounds[1:], count)
    out = np.full(len(first), _U(size), _U)
    for k in range(size):
        there = first + k < row_end
        word = words[np.minimum(first + k, max(len(words) - 1, 0))] if len(words) else np.zeros(0, _U)
        out = np.where(there, mix(out * _BASE + word), out)
    return out, at


def signed(x: np.ndarray) -> pa.Array:
    """As Spark's long, bit by bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
