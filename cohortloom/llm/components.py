"""Connected components of an edge table by hooking and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of ``edges`` (a, b: long): the label is the least id that is reachable.

    Each round hooks every label to its least neighbour, follows two pointers and contracts the
    edges. The tables of a round are stored, so that a lost executor repeats one round only.
    """
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = materialize(ends.withColumn("label", F.col("id")), "labels")
    left = materialize(_distinct(edges), "edges")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hook = materialize(hook, "hook")
        for _ in range(2):
            onward = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hook = hook.join(onward, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        hook = materialize(hook, "hook")
        labels = labels.join(hook.withColumnRenamed("a", "label"), "label", "left")
        labels = materialize(labels.select("id", F.coalesce("to", "label").alias("label")), "labels")
        left = left.join(hook.select("a", F.col("to").alias("x")), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = materialize(_distinct(left.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    return labels


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, its lesser end first, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
