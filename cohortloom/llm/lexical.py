"""Ranked lexical search by bag deduplication.

Every document is restricted to the vocabulary of the search items: what is left is its bag, the ascending
term numbers with their frequencies, and its length class ``m``. Documents with the same bag and ``m`` have the
same score for every item. They are brought together by a hash and told apart by the bags themselves, each
class is scored once, and the ten best classes of an item are expanded into their members by ascending id.

A class with very many members is cut to its ten smallest ids inside each task, before the shuffle; no more can
be among an item's ten best. Tasks keep ten classes of each item for the same reason: each has a member at
least. Items are taken in blocks of about ``PAIRS`` (item, term) pairs, one pass over the documents each, so
that what is broadcast (vocabulary and postings of a block) is bounded whatever the number of items.

Defined results: a null text has no term and is no document; neither it nor a document without an item's term
is returned. Repeated rows are documents of their own, also with the same id; a null id comes after all
others with that score. An item without terms has no rows, a repeated item has its rows again. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import blocks, flat, read_table, ready, word_hashes, word_spans
from cohortloom.llm.toxicity import GAP
from cohortloom.session import materialize

#: Documents an item gets.
TOP = 10
#: (item, term) pairs of a block of items: bounds the broadcast vocabulary and postings.
PAIRS = 1 << 19
#: Cells of (class, item) that are scored at once.
CELLS = 1 << 21
_FAR = np.iinfo(np.int64).max


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last row, bytes with A-Z lower-cased, starts, ends and bounds of their terms."""
    buf, offs = flat(column)
    for first, last in blocks(offs):
        part, own = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        starts, ends, bounds = word_spans(part, own, GAP)
        capital = (part >= 65) & (part <= 90)
        yield first, last, np.where(capital, part + 32, part).astype(np.uint8), starts, ends, bounds


class Vocabulary:
    """Terms by hash; a word is a term only if all its bytes are the term's. Plain arrays, so that tasks need no package."""

    def __init__(self, terms: list[bytes]):
        buf = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = word_hashes(buf, starts, ends) if terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) < len(terms):
            raise ValueError("two terms of the items have the same hash")
        self.state = (buf, starts, ends, hashes[order], order)


def term_numbers(state: tuple, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary, -1 for others: found by hash, verified by its bytes."""
    own, first, last, hashes, order = state
    out = np.full(len(starts), -1, np.int64)
    if not len(hashes) or not len(starts):
        return out
    found = word_hashes(buf, starts, ends)
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    hit = np.flatnonzero(hashes[at] == found)
    term = order[at[hit]]
    size = ends[hit] - starts[hit]
    same = size == last[term] - first[term]
    hit, term, size = hit[same], term[same], size[same]
    if not len(hit):
        return out
    begin = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(begin, size)
    equal = buf[np.repeat(starts[hit], size) + step] == own[np.repeat(first[term], size) + step]
    good = np.logical_and.reduceat(equal, begin)
    out[hit[good]] = term[good]
    return out


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms counted, and the bag over the vocabulary, for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(len(shared.value[3]), 1)
        for batch in batches:
            for first, last, buf, starts, ends, bounds in _words(batch.column("text")):
                number = term_numbers(shared.value, buf, starts, ends)
                row = np.repeat(np.arange(last - first), np.diff(bounds))
                key, tf = np.unique((row * wide + number)[number >= 0], return_counts=True)
                at = np.searchsorted(key // wide, np.arange(last - first + 1)).astype(np.int32)
                terms, tfs = ((key % wide).astype(np.int32), tf.astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): distinct terms of every item; ``item`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, last, buf, starts, ends, bounds in _words(batch.column("text")):
                for k in range(last - first):
                    here = range(bounds[k], bounds[k + 1])
                    out.append(sorted({buf[starts[w] : ends[w]].tobytes().decode("utf-8") for w in here}))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(out, pa.list_(pa.string()))], names=["item", "item_id", "terms"])

    named = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return named.mapInArrow(run, "item long, item_id long, terms array<string>")


def length_class(n_docs: int, n_terms: int):
    """``m`` of a document by its number of terms, in 64-bit integers."""
    return F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {max(n_terms, 1)}L)")


def bag_classes(stored: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(terms, tfs, m, members): one row for documents of the same bag and length class, with their ``TOP`` smallest ids."""
    keyed = stored.where(F.size("terms") > 0).withColumn("m", length_class(n_docs, n_terms))
    keyed = keyed.withColumn("h", F.xxhash64("terms", "tfs", "m"))
    same = ("h", "terms", "tfs", "m")
    # The hash leads the sort; the bags after it make classes exact.
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))
    few = keyed.withColumn("place", place).where(F.col("place") <= TOP).groupBy(*same)
    known = F.array_sort(F.collect_list("doc_id"))
    rows = few.agg(known.alias("known"), F.count("*").cast("int").alias("n_members"))
    nulls = F.array_repeat(F.lit(None).cast("long"), F.col("n_members") - F.size("known"))
    return rows.select("terms", "tfs", "m", F.concat("known", nulls).alias("members"))


def best_classes(classes: DataFrame, postings: tuple) -> DataFrame:
    """(item, item_id, score, members): each task's ``TOP`` best classes of every item, each class scored once.

    ``postings`` are the items of each term (starts, items), the terms' weights and the item ids.
    """
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def scored(terms: list, tfs: list, ms: np.ndarray, n_items: int) -> np.ndarray:
        at, items, weight, _ = shared.value
        row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.int64)
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * ms[row]))
        count = at[term + 1] - at[term]
        begin = np.cumsum(count) - count
        posting = items[np.repeat(at[term] - begin, count) + np.arange(int(count.sum()))]
        total = np.zeros(len(terms) * n_items, np.int64)
        np.add.at(total, np.repeat(row, count) * n_items + posting, np.repeat(gain, count))
        return total.reshape(len(terms), n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids = shared.value[3]
        n_items = len(item_ids)
        item, score, first = (np.zeros(0, np.int64) for _ in range(3))
        held: list[list] = []
        floor = np.zeros(n_items, np.int64)
        step = max(CELLS // max(n_items, 1), 1)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                some = batch.slice(low, step)
                terms, tfs = ([np.array(x) for x in some.column(c).to_pylist()] for c in ("terms", "tfs"))
                members = some.column("members").to_pylist()
                total = scored(terms, tfs, some.column("m").to_numpy(), n_items)
                row, own = np.nonzero((total > 0) & (total >= floor))
                lead = np.array([_FAR if m[0] is None else m[0] for m in members], np.int64)
                item = np.concatenate([item, own])
                score = np.concatenate([score, total[row, own]])
                first = np.concatenate([first, lead[row]])
                held = [*held, *[members[r] for r in row]]
                order = np.lexsort([first, -score, item])
                start = np.searchsorted(item[order], np.arange(n_items))
                rank = np.arange(len(order)) - start[item[order]]
                full = order[rank == TOP - 1]
                floor[item[full]] = score[full]
                keep = order[rank < TOP]
                item, score, first, held = item[keep], score[keep], first[keep], [held[k] for k in keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array([item_ids[k] for k in item], pa.int64()), pa.array(score), pa.array(held, pa.list_(pa.int64()))],
            names=["item", "item_id", "score", "members"],
        )

    return classes.select("terms", "tfs", "m", "members").mapInArrow(run, "item long, item_id long, score long, members array<long>")


def _block(docs: DataFrame, rows: list, totals: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int]]:
    """The best documents of one block of items, and the number of documents and terms."""
    terms = sorted({t for r in rows for t in r["terms"]})
    number = {t: k for k, t in enumerate(terms)}
    stored = materialize(bags(docs, Vocabulary([t.encode("utf-8") for t in terms])), "bags")
    if totals is None:
        counted = stored.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        totals = counted["docs"], counted["terms"]
    df = np.zeros(len(terms), np.int64)
    for r in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a vocabulary at most
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    pairs = sorted((number[t], k) for k, r in enumerate(rows) for t in r["terms"])
    of, items = (np.array([p[c] for p in pairs], np.int64) for c in (0, 1))
    at = np.searchsorted(of, np.arange(len(terms) + 1)).astype(np.int64)
    found = best_classes(bag_classes(stored, *totals), (at, items, weight, [r["item_id"] for r in rows]))
    members = found.select("item", "item_id", "score", F.explode("members").alias("doc_id"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = members.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), totals


def ranked_search(docs: DataFrame, items: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = ready(docs.sparkSession)
    cut = materialize(item_terms(items), "items").where(F.size("terms") > 0)
    n_pairs = cut.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-n_pairs // pairs)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if not n_blocks else None
    totals = None
    for b in range(n_blocks):
        rows = cut.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).orderBy("item").collect()
        if rows:
            found, totals = _block(docs, rows, totals)
            # With several blocks each is stored, so that a lost executor repeats one of them at most.
            found = materialize(found, "ranked") if n_blocks > 1 else found
            out = found if out is None else out.unionByName(found)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""
with docs as materialized (select row_number() over () as d, doc_id, {_TERMS} as t from documents where text is not null),
items as materialized (select row_number() over () as i, item_id, unnest(list_distinct({_TERMS})) as term from benchmark where text is not null),
totals as materialized (select count(*) as n_docs, cast(sum(len(t)) as bigint) as n_terms from docs where len(t) > 0),
tfs as materialized (
  select d, term, count(*) as tf from (select d, unnest(t) as term from docs) where term in (select term from items) group by all),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * any_value(n_docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from tfs, totals group by term),
sizes as (select d, doc_id, 100 - 90 + ((90 * len(t) * n_docs) // n_terms) as m from docs, totals where len(t) > 0),
scores as (
  select i, item_id, d, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from items join weights using (term) join tfs using (term) join sizes using (d) group by all),
ranked as (
  select *, cast(row_number() over (partition by i order by score desc, doc_id asc nulls last) as integer) as rank
  from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}
"""
