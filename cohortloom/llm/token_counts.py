"""Token counts by overlap resynchronisation.

A document longer than one chunk is cut into chunks that overlap. Each is encoded by itself, with
offsets, and two neighbours are spliced at the first place of the overlap where both begin a
word. The proof that this gives the tokens of the whole text:

- The word pattern of a byte-level tokenizer is matched from left to right without look-behind,
  and tokens never cross words. So the tokens after a word's start depend on the text after it only.
- A match looks at most two characters beyond its end, and an added token is at most as long as the
  longest of them. So a word's start that is ``_margin`` before a chunk's end is a word's start
  of the whole text, if the chunk began with one or was spliced at one.

Where an overlap has no common start (one very long word), the left chunk is encoded again from
its last proven start, with an overlap twice as long, until there is one or the text ends.

Documents of one chunk are cut before single spaces that follow a character other than white
space, which begin a word for the same reason; a bounded memory holds the counts of such pieces.

Defined results: a null text is empty and has no bytes and no tokens; ids may be null or repeated
(each row is counted by itself); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import read_table, ready

#: Characters of a chunk, and how many more it shares with the next one.
CHUNK, OVERLAP = 32_768, 512
#: Chunks of a document that are encoded at a time: bounds the encodings in memory.
AT_ONCE = 16
#: Pieces of short texts whose counts a task remembers.
REMEMBERED = 300_000
#: Characters a match of the word pattern looks at beyond its end, and one.
LOOK_AHEAD = 3

_SPACES = re.compile(r"\s |^ ")


def checked(spec: str) -> str:
    """The tokenizer file's text, if the proof above holds for it."""
    parts = json.loads(spec)
    step = parts.get("pre_tokenizer") or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    bare = parts.get("normalizer") is None and parts.get("post_processor") is None
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in parts.get("added_tokens", []))
    uncut = parts.get("truncation") is None and parts.get("padding") is None
    if not (plain and bare and added and uncut):
        raise ValueError("chunks can be spliced for plain byte-level tokenizers only")
    return spec


def _margin(spec: str) -> int:
    longest = max((len(t["content"]) for t in json.loads(spec).get("added_tokens", [])), default=0)
    return longest + LOOK_AHEAD


class Chunk:
    """An encoded chunk: where its words start in the text, and how many of its tokens come before each."""

    def __init__(self, encoding, start: int, end: int):
        words = np.array(encoding.word_ids, np.int64)
        places = encoding.offsets
        self.before = np.flatnonzero(np.diff(words, prepend=-1) != 0)
        self.starts = np.array([places[k][0] for k in self.before.tolist()], np.int64) + start
        self.tokens, self.end = len(words), end

    def upto(self, place: int) -> int:
        """Tokens before a word's start."""
        return int(self.before[np.searchsorted(self.starts, place)])


def _chunks(encode, text: str, chunk: int, overlap: int) -> Iterator[Chunk]:
    cuts = range(0, max(len(text) - overlap, 1), chunk)
    spans = [(c, min(c + chunk + overlap, len(text))) for c in cuts]
    for k in range(0, len(spans), AT_ONCE):
        some = spans[k : k + AT_ONCE]
        for (a, b), encoding in zip(some, encode([text[a:b] for a, b in some]), strict=True):
            yield Chunk(encoding, a, b)


def spliced_count(encode, text: str, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode`` gives the encodings of a list of texts."""
    following = _chunks(encode, text, chunk, overlap)
    left, entry, total = next(following), 0, 0
    for right in following:
        wider = overlap
        while left.end < right.end:
            proven = left.starts[(left.starts > entry) & (left.starts <= left.end - margin)]
            common = np.intersect1d(proven, right.starts)
            if len(common):
                place = int(common[0])
                total += left.upto(place) - left.upto(entry)
                left, entry = right, place
                break
            wider *= 2
            end = min(left.end + wider, len(text))
            left = Chunk(encode([text[entry:end]])[0], entry, end)
            # What is left holds the right chunk now, or the search goes on in the longer overlap.
    return total + left.tokens - (left.upto(entry) if left.tokens else 0)


def pieces(text: str) -> list[str]:
    """The text cut before single spaces where a word surely starts."""
    parts = text.split(" ")
    if not _SPACES.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else []
    out, piece = [], [parts[0]]
    solid = bool(parts[0]) and not parts[0][-1].isspace()
    for part in parts[1:]:
        if solid:
            out.append(" ".join(piece))
            piece = ["", part]
        else:
            piece.append(part)
        solid = bool(part) and not part[-1].isspace()
    return [*out, " ".join(piece)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a byte-level tokenizer file. The driver reads it, and the tasks get
    its text; that is the tokenizer's own size, whatever the documents. Nothing is shuffled.
    """
    spark = ready(docs.sparkSession)
    spec = checked(Path(tokenizer).read_text(encoding="utf-8"))
    shared, margin = spark.sparkContext.broadcast(spec), _margin(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(shared.value)
        known: dict[str, int] = {}

        def encode(texts: list[str]) -> list:
            return library.encode_batch(texts, add_special_tokens=False)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            cut = [pieces(t) if len(t) <= chunk + overlap else None for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            fresh = list({p for own in cut if own for p in own} - known.keys())
            counted = library.encode_batch_fast(fresh, add_special_tokens=False)
            known.update(zip(fresh, map(len, counted), strict=True))
            tokens = [
                spliced_count(encode, t, margin, chunk, overlap) if own is None else sum(map(known.__getitem__, own))
                for t, own in zip(texts, cut, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    counts = measured.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
