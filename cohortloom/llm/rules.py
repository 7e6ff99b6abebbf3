"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Only DataFrame expressions. Words and pairs of words are hashed to ``BUCKETS``; the target
multinomial counts those of documents labelled as good (a bounded sample of labelled rows), the
raw one those of every document, both with one added to each bucket. The mean over a
document's n-grams of log(target / raw) is compared with ``THRESHOLD``: the same text always
gets the same verdict.

Defined results: a null text has no words and fails the base rule, as does an empty one;
without a labelled row the ratio is 0 everywhere; null labels are not trusted; repeated rows
get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import read_table, ready, sample_by_hash

#: Cells of the two multinomials; their ratio is a literal in the plan.
BUCKETS = 4096
#: Labelled rows that the target is counted over: a bound of the fit; their ids are broadcast, 8 bytes each.
TARGET_ROWS = 20_000
#: Least mean log ratio of a kept document, in nats.
THRESHOLD = -0.08
#: Base rule: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
WINDOW = 3

_GAP = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _grams() -> Column:
    """Buckets of the words and of the pairs of neighbours in ``words``, whose number is ``n_words``."""
    words = F.col("words")
    single = F.transform(words, lambda w: _bucket(w))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 1), lambda i: _bucket(words[i - 1], words[i]))
    return F.when(F.col("n_words") > 1, F.concat(single, pairs)).otherwise(single)


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of each bucket, from (doc_id, text) and (doc_id, quality)."""
    ready(docs.sparkSession)
    trusted = sample_by_hash(labels.where(F.col("quality") == 1).select("doc_id", "quality"), "quality", TARGET_ROWS)
    ids = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_in")).distinct())
    counts = (
        docs.select("doc_id", _words(F.col("text")).alias("words"))
        .withColumn("n_words", F.size("words"))
        .join(ids, F.col("doc_id") == F.col("_id"), "left")
        .select("_in", F.explode(_grams()).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_in").alias("target"))
        .collect()  # BUCKETS rows at most
    )
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    scale = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + scale for t, r in zip(target, raw, strict=True)]


def profile(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """(doc_id, text) to the base counts, ``log_ratio`` and the verdict."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", text.alias("text"), _words(F.col("text")).alias("words")).withColumn(
        "n_words", F.size("words").cast("long")
    )
    # A key is the window's hash with its place in the lowest bits, so that sorting plain longs
    # brings equal windows together; the words themselves decide whether they are equal.
    keyed = counted.withColumn("bits", F.length(F.bin("n_words"))).withColumn(
        "keys",
        F.expr(
            f"""if(n_words >= {WINDOW},
                   sort_array(transform(sequence(0, cast(n_words as int) - {WINDOW}), i ->
                     shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | cast(i as bigint))),
                   cast(array() as array<bigint>))"""
        ),
    )
    same = """(shiftright(x, bits) = shiftright(keys[{k}], bits)
               and words[cast(x & (shiftleft(1L, bits) - 1) as int)] = words[cast(keys[{k}] & (shiftleft(1L, bits) - 1) as int)]
               and words[cast(x & (shiftleft(1L, bits) - 1) as int) + 1] = words[cast(keys[{k}] & (shiftleft(1L, bits) - 1) as int) + 1]
               and words[cast(x & (shiftleft(1L, bits) - 1) as int) + 2] = words[cast(keys[{k}] & (shiftleft(1L, bits) - 1) as int) + 2])"""
    placed = keyed.withColumn(
        "places",
        F.expr(
            f"""sort_array(transform(
                  filter(keys, (x, k) -> (k > 0 and {same.format(k="k - 1")})
                                      or (k < size(keys) - 1 and {same.format(k="k + 1")})),
                  x -> x & (shiftleft(1L, bits) - 1)))"""
        ),
    )
    covered = F.expr(
        f"""aggregate(places, named_struct('free', 0L, 'n', 0L),
              (a, p) -> named_struct('free', p + {WINDOW}, 'n', a.n + p + {WINDOW} - greatest(a.free, p)), a -> a.n)"""
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    ratio = F.expr("array(" + ",".join(f"{r!r}D" for r in ratios) + ")")
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + ratio[b])
    return (
        placed.select(
            "doc_id",
            "n_words",
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            covered.alias("n_repeat_words"),
            _grams().alias("grams"),
        )
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
            F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0).alias("log_ratio"),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= THRESHOLD))
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = log_ratios(docs, read_table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
    return profile(docs, ratios).select("doc_id", *columns)
