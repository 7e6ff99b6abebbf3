"""The fitted operators by their accuracy on held-out rows, and their defined results for rows without evidence."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import language, quality, toxicity
from cohortloom.llm.catalog import QUERIES

LARGER = "/root/testdata/sf0.01"


def _auc(rows: list[tuple[float, int]]) -> float:
    """Share of the pairs of a positive and a negative row that are in order, ties as half."""
    positive, negative = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return wins / (len(positive) * len(negative))


@pytest.mark.parametrize(("name", "label"), [("op4_toxicity", "toxic"), ("op7_quality", "quality")])
def test_held_out_ranking(spark, name, label):
    rows = QUERIES[name](spark, LARGER)
    assert rows.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where(F.col(label).isin(0, 1)).select("doc_id", label)
    held = rows.where("held_out").join(labels, "doc_id").select("score", label).collect()
    assert all(0 <= s <= 1 for s, _ in held)
    assert _auc([(s, y) for s, y in held]) > 0.8


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = QUERIES["op6_language_id"](spark, LARGER)
    assert rows.count() == docs.count()
    held = rows.where("held_out").join(docs.where("lang is not null and text is not null").select("doc_id", "lang"), "doc_id")
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 0 and right > 0.9


def test_texts_without_evidence(spark):
    texts = [(1, "good words of the first kind"), (2, None), (3, ""), (3, ""), (4, "12 34 !?"), (None, "words"), (5, "long text " * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    # No label: the share of positive labels among none, and the intercept of a model without rows.
    model = toxicity.learn(docs, none)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, None, None), (2, 0, 0), (3, 1, 1), (5, 1, 1)], "doc_id long, toxic int, quality int")
    for module in (toxicity, quality):
        rows = module.score(docs, module.learn(docs, labels)).collect()
        assert len(rows) == len(texts)
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1


def test_quality_scores_follow_the_labels_shares_at_any_table_size(spark, monkeypatch):
    # Texts that tell nothing; 20 labels of one kind to one of the other.
    docs = spark.range(8400).selectExpr("id as doc_id", "concat('word', id % 7) as text")
    labels = spark.range(8400).selectExpr("id as doc_id", "cast(id % 21 > 0 as int) as quality")
    logits = []
    for rows in (10_000, 300):
        monkeypatch.setattr(quality, "SAMPLE_ROWS", rows)
        p = quality.score(docs, quality.learn(docs, labels)).agg(F.avg("score")).first()[0]
        logits.append(math.log(p / (1 - p)))
    assert logits == pytest.approx([math.log(20)] * 2, abs=0.6)


def test_languages_without_evidence(spark):
    rows = [
        (1, "the cat sat on the mat and looked at the dog in the house " * 5, "en"),
        (2, "der hund lief durch den wald und suchte nach seinem herrn im haus " * 5, "de"),
        (3, "the cat and the dog sat in the house", None),
        (4, "12 34 !?", "en"),
        (5, None, "de"),
        (6, "", None),
    ]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, lang_score double")
    got = {r.doc_id: r for r in language.identify(docs, language.learn(docs.select("doc_id", "text", "lang"))).collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["en", "de", "en", "und", "und", "und"]
    assert [got[k].lang_rejected for k in range(1, 7)] == [False, False, False, True, True, True]
    unknown = language.identify(docs, language.learn(docs.select("doc_id", "text", "lang").limit(0))).collect()
    assert {(r.lang_pred, r.lang_score, r.lang_rejected) for r in unknown} == {("und", 0.0, True)}
    assert [r.doc_id for r in language.language_stage(spark, docs, "").orderBy("doc_id").collect()] == [1, 2, 3]
    assert language.language_stage(spark, docs, "").columns == docs.columns
