"""Centroid clustering by dimension-sharded Lloyd rounds on whole numbers.

The vectors are stored once, cut twice: into groups of at most ``GROUP`` vectors, and each group into
blocks of ``BLOCK`` dimensions. The table of these shards is bucketed by (block, group). A round is

1. column-block tasks: each shard gives the exact partial squared distances of its vectors to the
   centroids' slices of the same dimensions;
2. a reduction by group: the blocks' partial distances are added and the nearest centroid is taken;
3. the labels, two bytes a vector and block, go back to the shards, which stay where they are: the join
   has the shards' own bucketing. Each shard adds up its slice of every cluster, and the sums of the
   slices, ``k`` times the number of dimensions, are all that the driver gets.

All sums are 64-bit integers, so the result does not depend on the order of tasks.

Defined results: a null vector, one of another length, or one with a null or non-finite component is
left out. A component is turned into ``floor(64 * x)``; one beyond ``LARGEST`` is an error, since squared
distances would leave 64 bits. With fewer vectors than ``k`` each is a centroid; without any the result is
empty. Repeated rows are vectors of their own; equal hashes are put in order by the vector itself. A
null id is hashed as no digits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import read_table, ready
from cohortloom.session import fresh_path, materialize

#: Dimensions of a shard, and vectors of a group.
BLOCK, GROUP = 16, 2048
#: Largest component: 64 dimensions, each at most twice as far apart, squared, stay below 2^63.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, size: int, scale: int = 64) -> DataFrame:
    """(vec_id, q) of the vectors with exactly ``size`` finite components, as whole numbers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == size)).where(F.coalesce(finite, F.lit(False)))
    too_far = F.raise_error(F.lit(f"a component is beyond {LARGEST}")).cast("long")
    # Compared as doubles: a larger number need not fit a long.
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) > float(LARGEST), too_far).otherwise(F.floor(v * scale)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of ``seed:<vec_id>``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("h", h).orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def _shards(vectors: DataFrame, size: int, block: int, group: int) -> DataFrame:
    """(part, block, n, slice, ids): groups of vectors cut into blocks of dimensions; the ids are with block 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId() << 32, [], 0

        def cut(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal part
            q = rows.column("q").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, size)
            blocks = list(range(0, size, block))
            none = pa.array([], pa.int64())
            ids = [rows.column("vec_id") if b == 0 else none for b in blocks]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            part += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part - 1] * len(blocks), pa.int64()),
                    pa.array([b // block for b in blocks], pa.int32()),
                    pa.array([len(q)] * len(blocks), pa.int32()),
                    pa.array([np.ascontiguousarray(q[:, b : b + block]).tobytes() for b in blocks], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids)),
                ],
                names=["part", "block", "n", "slice", "ids"],
            )

        def merged() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, group - n)
                held.append(some)
                n += some.num_rows
                batch = batch.slice(some.num_rows)
                if n == group:
                    yield cut(merged())
                    held, n = [], 0
        if n:
            yield cut(merged())

    return vectors.mapInArrow(run, "part long, block int, n int, slice binary, ids array<long>")


class Shards:
    """The stored shards: a table bucketed by (block, part), dropped from the catalog at the end."""

    def __init__(self, vectors: DataFrame, size: int, block: int, group: int):
        spark = vectors.sparkSession
        self.name = f"shards_{uuid.uuid4().hex}"
        self.blocks = -(-size // block)
        # As many buckets as shuffle partitions: the labels' side then takes the buckets' partitioning.
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cut = _shards(vectors, size, block, group).repartition(buckets, "block", "part")
        writer = cut.write.format("parquet").bucketBy(buckets, "block", "part")
        writer.option("path", fresh_path(spark, "shards")).saveAsTable(self.name)
        self.table = spark.table(self.name)

    def drop(self) -> None:
        self.table.sparkSession.sql(f"drop table if exists {self.name}")


def nearest(shards: DataFrame, centroids: np.ndarray, block: int, with_ids: bool) -> DataFrame:
    """(part, labels[, ids, distances]): partial distances of each shard, added by part, and their argmin.

    Labels are two bytes a vector. A tie goes to the centroid with the smaller number.
    """
    k = len(centroids)
    shared = shards.sparkSession.sparkContext.broadcast(centroids)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, n, held in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "slice")), strict=True):
                own = np.frombuffer(held, "<i8").reshape(n, -1)
                mine = shared.value[:, b * block : b * block + own.shape[1]]
                far = np.empty((n, k), "<i8")
                for c in range(k):
                    far[:, c] = ((own - mine[c]) ** 2).sum(axis=1)
                out.append(far.tobytes())
            arrays = [batch.column("part"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("ids")], names=["part", "far", "ids"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(f, "<i8") for f in table.column("far").to_pylist()).reshape(-1, k)
        labels = total.argmin(axis=1)
        part = table.column("part").slice(0, 1)
        if not with_ids:
            return pa.table({"part": part, "labels": [labels.astype("<u2").tobytes()]})
        ids = max(table.column("ids").to_pylist(), key=len)
        held = [pa.array([ids], pa.list_(pa.int64())), [labels.tolist()], [total.min(axis=1).tolist()]]
        return pa.table({"vec_ids": held[0], "labels": pa.array(held[1], pa.list_(pa.int32())), "distances": held[2]})

    partial = shards.select("part", "block", "n", "slice", "ids" if with_ids else F.array().cast("array<long>").alias("ids"))
    far = partial.mapInArrow(distances, "part long, far binary, ids array<long>")
    schema = "vec_ids array<long>, labels array<int>, distances array<long>" if with_ids else "part long, labels binary"
    return far.groupBy("part").applyInArrow(add, schema)


def moved(shards: Shards, labels: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """The centroids after each shard has updated its own slice; an empty cluster keeps its centroid."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "n", "slice", "labels"))
            for b, n, held, own in zip(*columns, strict=True):
                q, label = np.frombuffer(held, "<i8").reshape(n, -1), np.frombuffer(own, "<u2")
                mine = total.setdefault(b, np.zeros((k, q.shape[1] + 1), np.int64))
                np.add.at(mine, label, np.column_stack([q, np.ones(n, np.int64)]))
        for b, mine in total.items():
            at = np.indices(mine.shape).reshape(2, -1)
            names = ["block", "cluster", "place", "total"]
            whole = [np.full(mine.size, b), at[0], at[1], mine.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in whole], names=names)

    everywhere = labels.select("part", "labels", F.explode(F.sequence(F.lit(0), F.lit(shards.blocks - 1))).alias("block"))
    joined = shards.table.select("part", "block", "n", "slice").join(everywhere.hint("shuffle_hash"), ["block", "part"])
    added = joined.select("block", "n", "slice", "labels").mapInArrow(sums, "block long, cluster long, place long, total long")
    out = centroids.copy()
    rows = added.groupBy("block", "cluster", "place").agg(F.sum("total").alias("total")).collect()
    found = {(r["block"], r["cluster"], r["place"]): r["total"] for r in rows}
    for b in range(shards.blocks):
        own = out[:, b * block : (b + 1) * block]
        for c in range(k):
            if count := found.get((b, c, own.shape[1]), 0):
                own[c] = [found[b, c, d] // count for d in range(own.shape[1])]
    return out


def lloyd(
    vectors: DataFrame, size: int = 64, k: int = 16, rounds: int = 3, seed: str = "1", block: int = BLOCK, group: int = GROUP
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, stored, and the centroids.

    ``vectors`` has vec_id and embedding. ``k`` times ``size`` numbers are on the driver at a time.
    """
    spark = ready(vectors.sparkSession)
    kept = whole_vectors(vectors, size)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    shards = Shards(kept, size, block, group)
    for _ in range(rounds):
        centroids = moved(shards, materialize(nearest(shards.table, centroids, block, False), "labels"), centroids, block)
    last = nearest(shards.table, centroids, block, True)
    rows = last.select(F.explode(F.arrays_zip("vec_ids", "labels", "distances")).alias("r"))
    assigned = materialize(rows.select("r.vec_ids", "r.labels", "r.distances").toDF("vec_id", "cluster", "distance"), "assigned")
    shards.drop()
    return assigned, centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every kept vector of ``embeddings``, with inertia and the centroids' hashes."""
    assigned, centroids = lloyd(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, int(inertia.get(c, 0)), h) for c, h in enumerate(hashes)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256"
    )


def _sql(size: int = 64, k: int = 16, rounds: int = 3) -> str:
    """The same in DuckDB: one pair of tables a round, on (vector, dimension, value) rows."""
    near = (
        "near{r} as materialized (select v, min(struct_pack(d := d, c := c)) as best from (select x.v, y.c, "
        "cast(sum((x.q - y.q) * (x.q - y.q)) as bigint) as d from cells x join cent{r} y using (i) group by all) group by v)"
    )
    move = (
        "sums{r} as (select best.c as c, i, cast(sum(q) as bigint) as s, count(*) as n from cells join near{r} using (v) group by all), "
        "cent{n} as materialized (select o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.q) as q from cent{r} o left join sums{r} using (c, i))"
    )
    steps = [f"{near.format(r=r)}, {move.format(r=r, n=r + 1)}" for r in range(rounds)]
    good = f"len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}"
    return f"""
with kept as materialized (
  select row_number() over () as v, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings where {good}),
cells as materialized (select v, unnest(range(1, {size + 1})) as i, unnest(q) as q from kept),
first as (select v, row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), q) - 1 as c from kept),
cent0 as materialized (select c, i, q from cells join first using (v) where c < {k}),
{", ".join(steps)},
{near.format(r=rounds)},
hashes as (select c, sha256(string_agg(cast(q as varchar), ',' order by i)) as h from cent{rounds} group by c),
done as (select vec_id, best.c as c, best.d as d from kept join near{rounds} using (v))
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, h as centroid_sha256
from done join hashes using (c)
"""


SQL = _sql()
