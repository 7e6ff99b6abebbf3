"""Concept hierarchies given as (parent, child) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import fresh_path


def descendants(
    edges: DataFrame, roots: DataFrame, parent: str = "parent", child: str = "child", hops: int = 4
) -> DataFrame:
    """All concepts below the roots, the roots included, as a table ``id``.

    Each round follows ``hops`` levels of edges in one plan and writes what is
    new, as a further part of one table; it ends when nothing is. So what is written
    is as large as the result, however many rounds there are. Cycles and several
    parents are allowed, and neither depth nor size is limited.
    """
    links = edges.select(F.col(parent).alias("id"), F.col(child).alias("_to")).filter("id <> _to")
    spark = edges.sparkSession
    path, part = fresh_path(spark, "closure"), 0
    frontier = roots.select("id").distinct()
    schema = frontier.schema
    frontier.write.parquet(f"{path}/round=0")
    # A given schema: what a round finds out about the table does not grow with the rounds.
    parts = spark.read.schema(schema).option("recursiveFileLookup", True)
    frontier = found = parts.parquet(path)
    while True:
        level, levels = frontier, []
        for _ in range(hops):
            level = level.join(links, "id").select(F.col("_to").alias("id")).distinct()
            levels.append(level)
        reached = levels[0]
        for more in levels[1:]:
            reached = reached.union(more)
        part += 1
        reached.distinct().join(found, "id", "left_anti").select(F.col("id").cast(schema["id"].dataType)).write.parquet(f"{path}/round={part}")
        frontier, found = parts.parquet(f"{path}/round={part}"), parts.parquet(path)
        if frontier.isEmpty():
            return found


def flag_cohort(rows: DataFrame, ids: DataFrame, entity: str, code: str, name: str = "in_cohort") -> DataFrame:
    """Per entity: does any row carry one of the codes."""
    listed = ids.select(F.col("id").cast("string").alias(code)).distinct().withColumn("_hit", F.lit(1))
    return (
        rows.select(entity, F.col(code).cast("string").alias(code))
        .join(listed, code, "left")
        .groupBy(entity)
        .agg(F.coalesce(F.max("_hit"), F.lit(0)).alias(name))
    )
