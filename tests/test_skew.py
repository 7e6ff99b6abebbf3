"""Hot keys, ties and cycles: exact results where one key holds most rows."""

from __future__ import annotations

from random import Random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import hierarchy, joins, ordering, shape, splits
from cohortloom.session import materialize


@pytest.fixture(scope="module")
def hot(spark):
    """Key 0 holds two thirds of the rows; a third of all values are one number."""
    df = spark.range(60_000).select(
        "id",
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 7 < 3, 1.5).otherwise(F.rand(5)).alias("v"),
    )
    return materialize(df)


def test_medians(hot):
    got = ordering.group_medians(hot, ["k"], "v", "m")
    want = hot.groupBy("k").agg(F.median("v").alias("w"))
    joined = got.join(want, "k")
    assert joined.count() == want.count()
    assert joined.filter("m <> w").count() == 0


@pytest.mark.parametrize("bracket_rows", [1_000_000, 2000, 10])
def test_order_statistics_in_any_number_of_rounds(hot, bracket_rows):
    """No narrowing, one round, and rounds to the end; ranks at both ends, in a tie, and beyond the count."""
    ranks = {"a": lambda n: F.lit(1), "q": lambda n: F.floor(n * 0.25) + 1, "m": lambda n: F.floor(n * 0.7), "z": lambda n: n, "none": lambda n: n + 1}
    got = ordering.order_statistics(hot, ["k"], F.col("v"), ranks, accuracy=100, bracket_rows=bracket_rows)
    w = Window.partitionBy("k").orderBy("v")
    ranked = hot.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("k")))
    at = {"a": "1", "q": "floor(n * 0.25) + 1", "m": "floor(n * 0.7)", "z": "n"}
    want = ranked.groupBy("k").agg(*[F.expr(f"max(case when r = {e} then v end) as want_{c}") for c, e in at.items()])
    joined = got.join(want, "k")
    assert joined.count() == got.count() == want.count()
    assert joined.filter(" or ".join(f"not ({c} <=> want_{c})" for c in at)).count() == 0
    assert got.filter("none is not null").count() == 0


@pytest.mark.parametrize("bracket_rows", [1_000_000, 20])
def test_weights_count_as_copies(spark, bracket_rows):
    rows = materialize(
        spark.range(4000).selectExpr("id % 3 as k", "case when id % 11 < 4 then 0.5 else hash(id) % 1000 / 8 end as v", "pmod(hash(id, 7), 8) + 1 as w")
    )
    copies = rows.select("k", "v", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("copy"))
    ranks = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "late": lambda n: F.floor(n * 0.93)}
    got = ordering.order_statistics(rows, ["k"], F.col("v"), ranks, weight=F.col("w"), bracket_rows=bracket_rows)
    want = ordering.order_statistics(copies, ["k"], F.col("v"), ranks)
    assert sorted(got.collect()) == sorted(want.collect())
    medians = copies.groupBy("k").agg(F.median("v").alias("m"))
    assert sorted(ordering.group_medians(rows, ["k"], "v", "m", F.col("w")).collect()) == sorted(medians.collect())


def test_infinite_values_and_null_values(spark):
    rows = spark.range(3000).selectExpr(
        "1 as k", "case when id % 5 = 0 then null when id % 5 = 1 then double('-inf') when id % 5 = 2 then double('inf') else double(id) end as v"
    )
    ranks = {"first": lambda n: F.lit(1), "mid": lambda n: F.lit(601), "last": lambda n: n}
    row = ordering.order_statistics(rows, ["k"], F.col("v"), ranks, bracket_rows=5).first()
    assert (row["n"], row["first"], row["mid"], row["last"]) == (2400, float("-inf"), 3.0, float("inf"))


def test_row_numbers_and_running_sums(hot):
    got = ordering.running_totals(hot, ["k"], [F.col("v"), F.col("id")], {"rn": F.lit(1), "s": F.col("id")})
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select("id", F.row_number().over(w).alias("rn2"), F.sum("id").over(w).alias("s2"))
    joined = got.join(want, "id")
    assert joined.count() == 60_000
    assert joined.filter("rn <> rn2 or s <> s2").count() == 0


def test_global_row_numbers(hot):
    got = ordering.row_numbers(hot, [], [F.desc("id")], "rn")
    assert got.filter("rn <> 60000 - id").count() == 0


def test_folds_and_splits_are_exact(hot):
    df = hot.select("id", "k")
    folded = splits.kfold_stratified(df, "k", "id", 10)
    sizes = folded.groupBy("k", "fold").count().groupBy("k").agg(F.max("count").alias("a"), F.min("count").alias("b"), F.count("*").alias("f"))
    assert folded.count() == 60_000
    assert sizes.filter("a - b > 1 or f <> 10").count() == 0
    halves = splits.split_stratified(df, "k", "id", 0.2)
    wrong = (
        halves.groupBy("k")
        .agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("t"))
        .filter("t <> floor(n * 0.2 + 0.5)")
    )
    assert halves.count() == 60_000 and wrong.count() == 0


def test_tiny_labels(spark):
    df = spark.createDataFrame([(i, int(i > 5)) for i in range(9)], "id int, y int")
    assert splits.kfold_stratified(df, "y", "id", 10).groupBy("y", "fold").count().agg(F.max("count")).first()[0] == 1
    assert splits.split_stratified(df, "y", "id", 0.1).filter("split = 'test'").count() == 1


def test_closure_with_cycle_and_two_parents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3), (3, 5), (9, 1), (7, 7)] + [(i, i + 1) for i in range(100, 130)], "parent long, child long")
    roots = spark.createDataFrame([(1,), (100,)], "id long")
    got = sorted(r["id"] for r in hierarchy.descendants(edges, roots).collect())
    assert got == [1, 2, 3, 4, 5, *range(100, 131)]


def test_null_keys_are_one_group(spark):
    rows = spark.range(0, 30_000, 1, 8).selectExpr("cast(null as long) k", "id").union(spark.range(5).selectExpr("id % 2 k", "id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.running_totals(rows, ["k"], [F.col("id")], {"n": F.lit(1)})
        assert got.where("k is null").selectExpr("count(distinct n) d", "max(n) m").first() == (30_000, 30_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert shape.with_group_min(rows, "k", "id", "first").count() == 30_005


def test_null_labels_are_an_error(spark):
    df = spark.range(100).selectExpr("id", "case when id < 90 then id % 2 end as y")
    for split in (splits.split_stratified, splits.kfold_stratified):
        assert split(df.where("y is not null"), "y", "id").count() == 90
        with pytest.raises(Exception, match="null label"):
            split(df, "y", "id").collect()


def test_horizon_keeps_the_last_day_of_timestamps(spark):
    anchors = spark.sql("select 1 as e, timestamp'2016-03-01 10:00:00' as t0")
    events = spark.sql("select 1 as e, explode(array(timestamp'2020-03-01 08:00:00', timestamp'2020-03-01 10:00:01')) as t")
    got = joins.within_horizon(events, anchors, "e", "t", "t0", 4).collect()
    assert [r.t.hour * 100 + r.t.second for r in got] == [800]


def test_intervals_of_all_lengths_against_brute_force(spark):
    """Nested and overlapping blocks, one of a whole chromosome, one across every bin border, both ends, no block, nulls."""
    random = Random(11)
    blocks = [("1", 0, 10**9, 7), ("2", 99_999, 100_000, 3), ("1", 100_000 * 8**5 - 1, 100_000 * 8**5, 1)]
    for k in range(400):
        lo = random.randrange(0, 2_000_000)
        blocks.append((random.choice("12"), lo, lo + random.choice([0, 5, 90_000, 700_000]), k))
    places = [(random.choice("123"), random.randrange(0, 2_500_000)) for _ in range(500)]
    places += [(c, x + d) for c, lo, hi, _ in blocks[:40] for x in (lo, hi) for d in (-1, 0, 1)] + [("1", None), (None, 5), ("1", 10**10), ("2", 99_999), ("2", 99_999)]
    b = spark.createDataFrame(blocks, "chrom string, lo long, hi long, off long")
    p = spark.createDataFrame(places, "c string, pos long")
    hits = [(c, x, x + off) for c, x in places for k, lo, hi, off in blocks if c == k and x is not None and lo <= x <= hi]
    missed = [(c, x, None) for c, x in places if x is None or not any(c == k and lo <= x <= hi for k, lo, hi, _ in blocks)]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(joins.map_intervals(p, b, "c", "pos").collect()) == order(hits)
    assert order(joins.map_intervals(p, b, "c", "pos", keep_unmapped=True).collect()) == order(hits + missed)
    assert joins.map_intervals(p, b.limit(0), "c", "pos").count() == 0
    # One row for each block, whatever its length.
    own = b.select(joins._smallest_bin(F.col("lo"), F.col("hi"), 100).alias("at")).select("at.*")
    assert own.count() == len(blocks) and own.filter("_level is null or _bin is null").count() == 0
