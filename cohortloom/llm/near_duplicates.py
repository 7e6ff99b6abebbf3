"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A document is the set of its 4-word shingles; documents with the same set are one node. A node
has a signature of ``COORDINATES`` minima and is posted under its (coordinate, value) pairs.
Two nodes of similarity 0.8 agree in ``MATCHES`` of them but for a chance of about 1e-6 at the
very threshold (binomial) and far less above it. As in prefix filtering, a node's pairs are
ordered by rarity and only its first ``COORDINATES - MATCHES + 1`` are merged: two nodes with
enough matches meet in one of them. Pairs that no other node has come first and need no
posting; the long lists at the end are skipped, and their collisions are counted by comparing
the signatures of the candidates. Candidates with enough matches are confirmed on full sets.

A list can hold many copies. They aren't paired with each other: each member is compared with
the list's most central node (the one whose pairs most others share, as the original of edited
copies), components are formed, and only members of different components are compared then,
again with one node of each list first. What is still open, such as many documents about one
common passage, is not listed pair by pair either: the members of those lists are posted once
more, now under the rarest fifth of their shingles, which two sets of similarity 0.8 must share
and documents with only a passage in common do not. Every pair with enough matches is thus
confirmed, rejected, or inside one component.

Defined results: A-Z are lower-cased, words end at ASCII white space; with fewer than 4 words
the whole sequence is one shingle; null, empty and blank texts have the empty set and are alone.
``component_id`` is the least id of a component (null only if all its ids are null); rows with
the same id and set are alike. Extra columns are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import blocks, flat, mix, read_table, ready, shingle_hashes, word_hashes, word_spans
from cohortloom.llm.components import components
from cohortloom.session import materialize

#: Coordinates of a signature, and the matches that a pair needs.
COORDINATES, MATCHES = 64, 32
#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 4, 80
#: Words of a shingle in the pipeline, whose stages take five.
STAGE_SHINGLE = 5
#: Rounds that compare with one node of each list before the remaining pairs are listed.
STAR_ROUNDS = 2

_A = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of rows: the shingle hashes and the index of each row's first one (and one more)."""
    buf, offs = flat(column)
    for first, last in blocks(offs):
        part, own = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        starts, ends, bounds = word_spans(part, own)
        yield shingle_hashes(word_hashes(part, starts, ends), bounds, size)


def _print(members: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(members.tobytes())


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, node, signature); node and signature are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes, signatures = [], [], []
            for runs, at in shingle_sets(batch.column("text"), size):
                filled = np.flatnonzero(np.diff(at))
                minima = np.empty((COORDINATES, len(filled)), np.uint64)
                if len(filled):
                    for k in range(COORDINATES):
                        minima[k] = np.minimum.reduceat(runs * _A[k] + _B[k], at[filled])
                rows = iter(np.ascontiguousarray(minima.T))
                for k in range(len(at) - 1):
                    members = np.unique(runs[at[k] : at[k + 1]])
                    n.append(len(members))
                    nodes.append(_print(members) if len(members) else None)
                    signatures.append(next(rows).view(np.int64) if len(members) else None)
            arrays = [pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_shingles", "node", "signature"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, "doc_id long, n_shingles long, node binary, signature array<long>")


def _texts(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(id, text): one text of each of ``nodes`` (id, node, doc_id), found by id and confirmed by its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, good, k = batch.column("node").to_pylist(), [], 0
            for runs, at in shingle_sets(batch.column("text"), size):
                for j in range(len(at) - 1):
                    good.append(_print(np.unique(runs[at[j] : at[j + 1]])) == want[k])
                    k += 1
            chosen = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("id", "text")], names=["id", "text"])

    own = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    found = own.join(nodes, F.col("d").eqNullSafe(F.col("doc_id"))).select("id", "node", "text")
    return found.mapInArrow(run, "id long, text string").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            sets = []
            for runs, at in shingle_sets(batch.column("text_a"), size):
                sets += [np.unique(runs[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
            linked, ids = [], batch.column("b").to_pylist()
            for k, own in enumerate(sets):
                if seen[0] != ids[k]:
                    runs, _ = next(shingle_sets(batch.column("text_b").slice(k, 1), size))
                    seen = (ids[k], np.unique(runs))
                both = len(np.intersect1d(own, seen[1], assume_unique=True))
                linked.append(100 * both >= percent * (len(own) + len(seen[1]) - both))
            chosen = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(chosen) for c in ("a", "b")], names=["a", "b"])

    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _matching(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` with enough equal coordinates and sizes that allow the similarity."""
    first = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    second = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    equal = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda same: same))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(first, "a").join(second, "b").where(sizes & (equal >= MATCHES)).select("a", "b")


def _prefixes(every: DataFrame, needed: Column) -> DataFrame:
    """(key, id, central, n, at): the merged part of every posting list of ``every`` (id, n, key), the rarest keys first.

    Two members that share ``needed`` of their ``n`` keys meet in the first ``n - needed + 1``.
    Keys of one member only come first and are left out, as no pair can meet there; ``at`` is
    the place of a key among all of a member's.
    """
    shared = every.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    ranked = every.join(shared, "key").groupBy("id").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("often", "key"))).alias("own")
    )
    central = F.aggregate("own", F.lit(0.0), lambda total, pair: total + F.log(pair["often"])).alias("central")
    alone = F.col("n") - F.size("own")
    posted = F.slice("own", F.lit(1), F.size("own") - (needed - 1))
    return (
        ranked.where(F.size("own") >= needed)
        .select("id", central, "n", alone.alias("alone"), F.posexplode(posted).alias("place", "post"))
        .select(F.col("post.key").alias("key"), "id", "central", "n", (F.col("alone") + F.col("place")).alias("at"))
    )


def _signature_posts(nodes: DataFrame) -> DataFrame:
    pairs = nodes.select("id", F.posexplode("signature").alias("at", "value"))
    every = pairs.select("id", F.lit(COORDINATES).alias("n"), F.xxhash64("at", "value").alias("key"))
    return _prefixes(every, F.lit(MATCHES))


def _shingle_posts(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """As ``_signature_posts``, under the shingles of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[np.ndarray] = []
            for runs, at in shingle_sets(batch.column("text"), size):
                sets += [np.unique(runs[at[k] : at[k + 1]]).view(np.int64) for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "keys"])

    sets = texts.select("id", "text").mapInArrow(run, "id long, keys array<long>")
    every = sets.select("id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    return _prefixes(every, F.ceil(F.col("n") * percent / 100).cast("int"))


def _labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``posts`` with ``label``, of the lists that hold more than one component."""
    if labels is None:
        own = posts.withColumn("label", F.col("id"))
    else:
        own = posts.join(labels, "id", "left").select(*posts.columns, F.coalesce("label", "id").alias("label"))
    mixed = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return own.join(mixed, "key")


def _share(n: Column, percent: int) -> Column:
    """Common members that two sets of ``n`` members together need."""
    return F.ceil(percent * n / F.lit(100 + percent))


def _couples(shorter: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(key, label, other): components with a member in ``shorter`` and others of ``own`` that meet in a list.

    Two components are left out where the extremes of their members leave no pair open; those of a component
    of one member are its own, so that many single documents in one list are not paired with each other first.
    """

    def extremes(rows: DataFrame, label: str, x: str) -> DataFrame:
        bounds = {"low": F.min("n"), "high": F.max("n"), "rest": F.max(F.col("n") - F.col("at"))}
        return rows.groupBy("key", F.col("label").alias(label)).agg(*[value.alias(f"{name}_{x}") for name, value in bounds.items()])

    sizes = F.expr("low_a <= high_b") & (100 * F.col("high_a") >= percent * F.col("low_b"))
    rest = F.least("rest_a", "rest_b") >= _share(F.col("low_a") + F.col("low_b"), percent)
    met = extremes(shorter, "label", "a").join(extremes(own, "other", "b"), "key")
    return met.where(F.expr("label <> other") & sizes & rest).select("key", "label", "other")


def _open_pairs(own: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of different components that meet in a list of shingles and may be similar enough.

    The shorter of a pair is posted under a prefix that is shorter still, because sets of such
    sizes must share more; and what follows the meeting place must suffice for that share.
    Components that meet are found first, so that a list's members of one component never pair.
    """
    shorter = own.where(F.col("at") <= F.col("n") - _share(2 * F.col("n"), percent))
    first = shorter.select("key", "label", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    second = own.select("key", F.col("label").alias("other"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    sizes = F.expr("n_a < n_b or (n_a = n_b and a < b)") & (100 * F.col("n_a") >= percent * F.col("n_b"))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= _share(F.col("n_a") + F.col("n_b"), percent)
    pairs = _couples(shorter, own, percent).join(first, ["key", "label"]).join(second, ["key", "other"])
    return pairs.where(sizes & rest).select("a", "b")


def _hubs(own: DataFrame) -> DataFrame:
    """(key, hub, hub_label): the most central member of each list."""
    top = own.groupBy("key").agg(F.max_by("id", "central").alias("hub"))
    return own.join(top, "key").where("id = hub").select("key", "hub", F.col("label").alias("hub_label"))


def node_labels(nodes: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame | None:
    """(id, label) of the nodes (id, node, doc_id, n, signature) that are linked; None if none is."""
    posts = materialize(_signature_posts(nodes), "posts")
    members = _labelled(posts, None).select("id").distinct().join(nodes.select("id", "node", "doc_id"), "id")
    texts = materialize(_texts(docs, members, size), "texts")
    edges: DataFrame | None = None
    labels: DataFrame | None = None
    for step in range(STAR_ROUNDS + 1):
        own = materialize(_labelled(posts, labels), "lists")
        if own.isEmpty():
            break
        if step < STAR_ROUNDS:
            # One node of each list against the members of other components.
            hubs = _hubs(own)
            if step:
                first = hubs.select("key", F.col("hub_label").alias("first_label"))
                hubs = _hubs(own.join(first, "key").where("label <> first_label"))
            pairs = own.join(hubs, "key").where("label <> hub_label").select(F.col("id").alias("a"), F.col("hub").alias("b"))
        else:
            left = texts.join(own.select("id").distinct(), "id")
            own = materialize(_labelled(materialize(_shingle_posts(left, size, percent), "posts"), labels), "lists")
            pairs = _open_pairs(own, percent)
        pairs = materialize(_matching(pairs.distinct(), nodes, percent), "pairs")
        found = materialize(_confirmed(pairs, texts, size, percent), "links")
        if found.isEmpty():
            continue
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
    return labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, node, component_id, kept), a row for each row."""
    ready(docs.sparkSession)
    rows = materialize(sketches(docs, size), "sketches")
    nodes = (
        rows.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    )
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    labels = node_labels(nodes, docs, size, percent)
    named = nodes.select("node", "id", "doc_id")
    if labels is None:
        groups = named.select("node", F.col("doc_id").alias("component_id"))
    else:
        named = named.join(labels, "id", "left").select("node", "doc_id", F.coalesce("label", "id").alias("label"))
        least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        groups = named.join(least, "label").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "node", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the least id stays, with the columns of ``docs``.

    Repeated rows are a group; null ids come last in theirs; documents without a word are in none and stay.
    """
    row = "_row" + "_" * max(map(len, docs.columns))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), STAGE_SHINGLE)
    groups = found.select(F.col("doc_id").alias(row), "component_id").join(
        rows.select(row, F.col("doc_id").cast("long").alias("own_id")), row
    )
    place = F.struct(F.col("own_id").isNull().alias("last"), "own_id", row)
    first = groups.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
