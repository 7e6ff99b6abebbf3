"""Token counts, centroid clustering and ranked search against brute force, with nulls, ties, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import centroids, lexical, token_counts
from cohortloom.llm.catalog import QUERIES, SQL
from tests.compare import connect, difference
from tests.conftest import FOLDER

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(SQL[name]).df()) is None


# Token counts

def _mixed(seed: int, n: int) -> str:
    """Letters, digits, white space of all kinds, signs, contractions, wide characters and special strings."""
    draw = random.Random(seed)
    parts = ["the", "Wort", " ", "  ", "\n", "\t ", " ", "　", "'ll", "'s", "''", "é", "字", "😀", "12", "3", ".", "...", "<|endoftext|>", "<|endof", "text|>", "\x1c"]
    return "".join(draw.choice(parts) for _ in range(n))


TEXTS = [
    (1, "a plain text"),
    (2, None),
    (3, ""),
    (4, " "),
    (5, "  two  and   three \n lines \n\n"),
    (6, "x" * 3000),
    (7, "word " * 900),
    (8, " " * 2500),
    (9, "<|endoftext|>" * 200),
    (10, "a" * 700 + " " + "b" * 900 + "<|endoftext|>" + "'ll" * 300),
    (10, "a" * 700 + " " + "b" * 900 + "<|endoftext|>" + "'ll" * 300),
    (None, "no id"),
    *[(100 + k, _mixed(k, 20 + 37 * k)) for k in range(60)],
]


def test_token_counts_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in TEXTS], "doc_id long, text string, n_tokens int, n_bytes string")
    # Small chunks, so that overlaps fail and are widened again and again.
    for chunk, overlap in ((64, 24), (200, 32), (16_384, 512)):
        rows = token_counts.token_counts(docs, TOKENIZER, 512, chunk, overlap).collect()
        assert len(rows) == len(TEXTS)
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows)
        expected = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in TEXTS)
        assert got == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


def test_splicing_on_random_texts(library):
    margin = token_counts._margin(token_counts.checked(open(TOKENIZER, encoding="utf-8").read()))
    for seed in range(150):
        text = _mixed(1000 + seed, 400)
        encode = lambda texts: library.encode_batch(texts, add_special_tokens=False)
        n = len(library.encode(text, add_special_tokens=False))
        assert token_counts.spliced_count(encode, text, margin, 50 + seed, 20) == n
        cut = token_counts.pieces(text)
        assert "".join(cut) == text
        assert sum(len(e) for e in encode(cut)) == n


def test_token_counts_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, TOKENIZER).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.checked(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


# Centroid clustering

def _lloyd(rows, k, rounds):
    """The contract, one vector at a time."""
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    cents = [q for _, q in named[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(cents)) for _, q in kept]
        if step < rounds:
            for n in range(len(cents)):
                own = [q for (_, q), (_, m) in zip(kept, near) if m == n]
                if own:
                    cents[n] = [sum(col) // len(own) for col in zip(*own)]
    return sorted((i if i is not None else -1, n, d) for (i, _), (d, n) in zip(kept, near)), cents


def _vectors():
    draw = random.Random(3)
    rows = [(k, [draw.choice([-1.0, -0.3, 0.0, 0.2, 0.9]) + draw.random() * 0.05 for _ in range(8)]) for k in range(300)]
    rows += [(400, rows[0][1]), (400, rows[0][1]), (401, rows[1][1]), (None, rows[2][1])]
    rows += [(500 + k, [0.5] * 8) for k in range(150)]  # a third of all are copies
    bad = [(600, None), (601, []), (602, [0.1] * 7), (603, [0.1] * 9), (604, [None] + [0.1] * 7), (605, [math.nan] * 8), (606, [math.inf] + [0.0] * 7)]
    return rows + bad


@pytest.mark.parametrize("block,group", [(3, 10), (8, 2048), (1, 64)])
def test_centroids_equal_the_plain_procedure(spark, block, group):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], "vec_id long, embedding array<double>, part int, block int")
    assigned, cents = centroids.lloyd(df, 8, 7, 3, "1", block, group)
    want, want_cents = _lloyd(rows, 7, 3)
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in assigned.collect()) == want
    assert cents.tolist() == want_cents


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [0.25, 0.5]), (2, [-0.25, 0.5])], schema)
    assigned, cents = centroids.lloyd(few, 2, 16, 3)
    assert len(cents) == 2 and [r["distance"] for r in assigned.collect()] == [0, 0]
    assigned, cents = centroids.lloyd(spark.createDataFrame([(1, None)], schema), 2)
    assert assigned.count() == 0 and len(cents) == 0


def test_components_beyond_64_bits_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.lloyd(rows, 2)


def test_shards_stay_where_they_are(spark):
    """Only the labels are moved for the update: the stored shards are read in their own buckets."""
    df = spark.createDataFrame(_vectors()[:300], "vec_id long, embedding array<double>")
    shards = centroids.Shards(centroids.whole_vectors(df, 8), 8, 4, 16)
    labels = centroids.nearest(shards.table, np.zeros((2, 8), np.int64), 4, False)
    from pyspark.sql import functions as F

    wide = labels.select("part", "labels", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("block"))
    joined = shards.table.select("part", "block", "slice").join(wide.hint("shuffle_hash"), ["block", "part"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    shards.drop()
    scan = plan[plan.index("ShuffledHashJoin") :].split("FileScan")[1]
    assert "Bucketed: true" in scan
    above = plan[plan.index("ShuffledHashJoin") : plan.index("FileScan")]
    assert "Exchange" not in above


# Ranked search

def _terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _ranked(docs, items):
    """The contract, every item with every document."""
    bags = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // n_terms if n_terms else 0
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in set(_terms(text))
                if bag[t]
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


DRAW = random.Random(11)
WORDS = [f"w{k}" for k in range(40)] + ["Öl", "öl", "ÖL", "naïve", "字", "A1", "a1"]
DOCS = [
    (1, None),
    (2, ""),
    (3, "!!! ... \n"),
    (None, "w1 w2 öl"),
    (4, "w1 W2 öl"),
    (4, "w1 W2 öl"),
    *[(100 + k, "w1 w2 w3, w9") for k in range(60)],  # one class of many members
    *[(300 - k, "w2 w1 w9 w3") for k in range(30)],
    *[(400 + k, " ".join(DRAW.choices(WORDS, k=1 + DRAW.randrange(60)))) for k in range(120)],
    (900, "w5 " * 30_000),
]
ITEMS = [(1, "w1 w2 w2 w9"), (2, "ÖL naïve"), (3, None), (4, ""), (5, "not there"), (6, "W5"), (6, "W5"), (None, "w7 a1 w8"), *[(20 + k, " ".join(DRAW.choices(WORDS, k=12))) for k in range(20)]]


@pytest.mark.parametrize("pairs", [1 << 19, 40])
def test_search_equals_every_pair_scored(spark, pairs):
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in DOCS], "doc_id long, text string, n int, m int")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, terms int")
    got = lexical.ranked_search(docs, items, pairs).collect()
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in got), key=str) == _ranked(DOCS, ITEMS)


def test_search_over_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(docs, some).count() == 0
    assert lexical.ranked_search(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0


def test_equal_hashes_are_told_apart_by_bytes():
    words = [b"alpha", b"beta", b"gamma"]
    state = lexical.Vocabulary(words).state
    buf = np.frombuffer(b"betaalphabetb", np.uint8)
    starts, ends = np.array([0, 4, 9]), np.array([4, 9, 13])
    assert lexical.term_numbers(state, buf, starts, ends).tolist() == [1, 0, -1]
    # A vocabulary that claims the hash of another word does not match it.
    forged = (state[0], state[1], state[2], np.sort(lexical.word_hashes(buf, starts, ends)), np.zeros(3, np.int64))
    assert (lexical.term_numbers(forged, buf, starts, ends) >= 0).tolist() == [False, True, False]
