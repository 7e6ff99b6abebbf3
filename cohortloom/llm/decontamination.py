"""Benchmark decontamination by greedy string tiling.

A seed is the Karp-Rabin fingerprint of ``SEED`` tokens in a row. Seeds of documents that hit a
fixed-size bitmap of the benchmark's seeds are joined with them. For each pair of document and
item that shares enough, the longest common run of unmarked tokens is marked again and again
(runs grow along the diagonals of shared seeds) until none has ``SEED`` tokens. A document is
contaminated if the tiles of one item cover ``COVERAGE`` of its tokens, in whatever order.

Defined results: tokens are runs of letters and digits, A-Z lower-cased. Null and empty texts
are clean; an item of fewer than ``SEED`` tokens is no evidence; an empty benchmark leaves all
clean; repeated items and repeated rows are judged alike, each row by its own text; null ids
are carried along. Extra columns are ignored by the operator and kept by the stage.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import blocks, flat, free_name, read_table, ready, shingle_hashes, signed, word_hashes, word_spans
from cohortloom.llm.toxicity import GAP
from cohortloom.session import materialize

#: Tokens of a seed, which is also the shortest tile.
SEED = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Cells of the bitmap of benchmark seeds: 1 MB in every task, whatever the benchmark's size. A full one only spares less.
CELLS = 1 << 20


def _seeds(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number of tokens and fingerprints of all runs of ``SEED`` tokens, for each text."""
    buf, offs = flat(column)
    for first, last in blocks(offs):
        part, own = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        starts, ends, bounds = word_spans(part, own, GAP)
        runs, at = shingle_hashes(word_hashes(part, starts, ends), bounds, SEED)
        for k in range(last - first):
            n = int(bounds[k + 1] - bounds[k])
            yield n, runs[at[k] : at[k + 1]] if n >= SEED else runs[:0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), signed(values.astype(np.uint64)))


def seed_table(texts: DataFrame) -> DataFrame:
    """(id, text) to (id, tokens, seeds) for the texts that have a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_seeds(batch.column("text")))
            keep = np.array([len(s) > 0 for _, s in found], bool)
            ids = batch.column("id").filter(pa.array(keep))
            kept = [f for f, k in zip(found, keep, strict=True) if k]
            counts = pa.array([n for n, _ in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, counts, _lists([s for _, s in kept])], names=["id", "tokens", "seeds"])

    return texts.mapInArrow(run, "id long, tokens long, seeds array<long>")


def _cell(seed: Column) -> Column:
    return seed.bitwiseAND(F.lit(CELLS - 1))


def seed_hits(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, text) to (doc_id, print, places, seeds): the seeds in the bitmap, of documents that have one.

    ``print`` is a hash of the text: with the id it names a row by its content.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows, places, seeds = [], [], []
            for k, (_, own) in enumerate(_seeds(batch.column("text"))):
                at = np.flatnonzero(there[(own & np.uint64(CELLS - 1)).astype(np.int64)])
                if len(at):
                    rows.append(k)
                    places.append(at.astype(np.uint64))
                    seeds.append(own[at])
            chosen = pa.array(rows, pa.int64())
            arrays = [batch.column("doc_id").take(chosen), batch.column("print").take(chosen), _lists(places), _lists(seeds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "print", "places", "seeds"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_print().alias("print"), "text")
    return named.mapInArrow(run, "doc_id long, print long, places array<long>, seeds array<long>")


def text_print() -> Column:
    return F.xxhash64("text")


def tiled(places: np.ndarray, seeds: np.ndarray, item: np.ndarray) -> int:
    """Tokens of the item that greedy string tiling marks.

    ``places`` and ``seeds`` are those of the document, ascending by place; ``item`` has the
    item's seeds in order. The work is in proportion to the pairs of equal seeds.
    """
    order = np.argsort(seeds, kind="stable")
    ranked = seeds[order]
    low, high = np.searchsorted(ranked, item), np.searchsorted(ranked, item, "right")
    at = [places[order[a:b]] for a, b in zip(low, high, strict=True)]
    heap: list[tuple[int, int, int]] = []
    nxt, run_nxt = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for j in range(len(item) - 1, -1, -1):
        run = np.full(len(at[j]), SEED, np.int64)
        if len(nxt) and len(run):
            k = np.minimum(np.searchsorted(nxt, at[j] + 1), len(nxt) - 1)
            more = nxt[k] == at[j] + 1
            run[more] = run_nxt[k[more]] + 1
        whole = ~np.isin(at[j] - 1, at[j - 1]) if j else np.ones(len(run), bool)
        heap += [(-int(n), int(p), j) for n, p in zip(run[whole], at[j][whole], strict=True)]
        nxt, run_nxt = at[j], run
    if not heap:
        return 0
    heapq.heapify(heap)
    first = int(places[0])
    in_doc, in_item = np.zeros(int(places[-1]) - first + SEED, bool), np.zeros(len(item) + SEED - 1, bool)
    while heap:
        n, p, j = heapq.heappop(heap)
        n, p = -n, p - first
        used = in_doc[p : p + n] | in_item[j : j + n]
        if not used.any():
            in_doc[p : p + n] = True
            in_item[j : j + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], used, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= SEED:
                heapq.heappush(heap, (-int(b - a), p + first + int(a), j + int(a)))
    return int(in_item.sum())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, print, items, best_item, coverage) of the contaminated rows of ``docs`` (doc_id, text); stored.

    ``benchmark`` has item_id and text. No side is broadcast by hint: Catalyst sees the stored
    benchmark's size and broadcasts it only if it is small.
    """
    ready(docs.sparkSession)
    items = materialize(seed_table(benchmark.select(F.col("item_id").cast("long").alias("id"), "text")), "items")
    bitmap = np.zeros(CELLS, bool)
    cells = items.select(F.explode("seeds").alias("seed")).select(_cell(F.col("seed")).alias("cell")).distinct()
    bitmap[[r["cell"] for r in cells.collect()]] = True  # CELLS numbers at most
    hits = materialize(seed_hits(docs, bitmap), "hits").where(F.size("seeds") > 0)
    # Items with the same text are told apart by their own key.
    numbered = materialize(items.withColumn("item", F.monotonically_increasing_id()), "numbered")
    windows = numbered.select("item", "tokens", F.explode("seeds").alias("seed")).distinct()
    named = hits.withColumn("row", F.xxhash64("doc_id", "print"))
    shared = (
        named.select("row", F.explode(F.array_distinct("seeds")).alias("seed"))
        .distinct()
        .join(windows, "seed")
        .groupBy("row", "item")
        .agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
        # A seed lies in one tile and a tile of n tokens has n - SEED + 1 seeds, repeated ones aside.
    )
    repeats = numbered.select("item", (F.size("seeds") - F.size(F.array_distinct("seeds"))).alias("again"))
    enough = F.lit(SEED) * (F.col("n") + F.col("again")) >= F.lit(COVERAGE) * F.col("tokens")
    pairs = shared.join(repeats, "item").where(enough).select("row", "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, own, item = (batch.column(c).to_pylist() for c in ("places", "seeds", "item_seeds"))
            n = [tiled(np.array(p, np.int64), np.array(s, np.int64), np.array(i, np.int64)) for p, s, i in zip(doc, own, item, strict=True)]
            covered = pa.array(np.array(n, float) / np.array(batch.column("tokens").to_pylist(), float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), batch.column("item_id"), covered],
                names=["doc_id", "print", "item_id", "coverage"],
            )

    sides = pairs.join(
        named.dropDuplicates(["row"]).select("row", "doc_id", "print", "places", "seeds"), "row"
    ).join(numbered.select("item", F.col("id").alias("item_id"), "tokens", F.col("seeds").alias("item_seeds")), "item")
    covered = sides.select("doc_id", "print", "item_id", "tokens", "places", "seeds", "item_seeds").mapInArrow(
        tile, "doc_id long, print long, item_id long, coverage double"
    )
    found = (
        covered.where(F.col("coverage") >= COVERAGE)
        .groupBy("doc_id", "print")
        .agg(
            F.count("*").alias("items"),
            F.max(F.struct(F.col("coverage"), (-F.col("item_id")).alias("item_id"))).alias("best"),
        )
        .select("doc_id", "print", "items", (-F.col("best.item_id")).alias("best_item"), F.col("best.coverage").alias("coverage"))
    )
    return materialize(found, "contaminated")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether it is contaminated, by how many items, and the most covered one."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contaminated(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    rows = docs.select("doc_id", text_print().alias("print")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.print") == F.col("f.print"))
    return rows.join(found.alias("f"), same, "left").select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"),
        "best_item",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that no benchmark item contaminates, with the columns of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contaminated(plain, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    own, text = free_name(docs, "id"), free_name(docs, "print")
    lost = found.select(F.col("doc_id").alias(own), F.col("print").alias(text))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (text_print() == F.col(text))
    return docs.join(lost, same, "left_anti")
