"""Encoding into the pieces of a given SentencePiece vocabulary, and decoding, with the N best segmentations.

The pieces that fit a text make a lattice; a segmentation is a path and its score the sum of
its pieces' log-probabilities. Forward Viterbi gives the best score of every prefix. A
backward A* search from the end uses them as its heuristic, which is exact, so that paths
come out best first. No piece of the vocabulary has a blank behind another character; a
text is therefore a row of independent lattices, one for each word with the blanks before it,
and the N best of the text are the N best sums of theirs. A word's second best score follows
from its forward and backward scores alone (the best path over an edge off the best path), so
the search is run for the few words of each text whose other paths can be among its N best.
The forward pass goes over all new words of about ``GROUP`` characters of text side by side.

The vocabulary is one of merges in order of frequency; its piece of rank r gets Zipf's
probability 1 / ((r + 1) H). A character without a piece is spelled in byte pieces, as is the
blank sign itself where a text holds it, so that decoding gives back every text. Log-probabilities
are whole multiples of ``2 ** -32``: sums are exact, whatever their order, and so are ties.

Defined results: null and empty texts have no piece, score 0 and one segmentation; among equal
scores of a word, the path whose last piece begins first comes first, then that of the piece before it, and so
on, for the best path as for all others; repeated rows get equal rows. Extra columns are ignored. The search goes
on where it is nearest to the start of the word, so a run of any length without blanks takes time in proportion.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import read_table, ready

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of each text.
N_BEST = 3
#: Words whose best segmentations a task remembers at once, and the longest that it remembers, in characters.
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64
#: Characters of text whose new words are segmented side by side.
GROUP = 1 << 20
#: Log-probabilities are counted in parts of this size.
PARTS = 1 << 32
_NEVER, _NEVER_64 = -(1 << 200), -(1 << 61)
#: Bits of a code point.
_CODE = 21

BLANK = "▁"
SIGN = "sign"
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with id and log-probability (in ``PARTS``), and the ids of the 256 byte pieces."""

    #: Every piece, and every beginning of one with the id -1: a walk from a place ends where no piece goes on.
    pieces: dict[str, tuple[int, int]]
    byte_ids: list[int]
    byte_score: int

    def text_of(self) -> dict[int, bytes]:
        out = {i: piece.replace(BLANK, " ").encode() for piece, (i, _) in self.pieces.items() if i >= 0}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    def spelled(self, character: str) -> tuple[tuple[int, ...], int]:
        """Ids and log-probability of a character in byte pieces."""
        own = character.encode()
        return tuple(self.byte_ids[b] for b in own), len(own) * self.byte_score


def vocabulary_of(ranks: dict[str, tuple[int, float]], byte_ids: list[int]) -> Vocabulary:
    """From (id, rank) of each piece: Zipf's probabilities of the ranks."""
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in ranks):
        raise ValueError("a piece has a blank behind another character")
    total = sum(1 / (r + 1) for _, r in ranks.values())
    score = lambda r: round(-math.log((r + 1) * total) * PARTS)
    pieces = {p[:k]: (-1, 0) for p in ranks for k in range(1, len(p))}
    pieces |= {p: (i, score(r)) for p, (i, r) in ranks.items()}
    return Vocabulary(pieces, byte_ids, score(len(ranks)))


def load(path: str = VOCABULARY) -> Vocabulary:
    """Read on the driver; the 32,000 pieces are broadcast to the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    byte_ids = [0] * 256
    ranks: dict[str, tuple[int, float]] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ranks[model.id_to_piece(i)] = (i, -model.get_score(i))
    return vocabulary_of(ranks, byte_ids)


class Lattice:
    """All pieces that fit one string: for each end the (start, ids, score) of its edges."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        known, n = vocabulary.pieces.get, len(text)
        self.edges: list[list[tuple[int, tuple[int, ...], int]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            for end in range(start + 1, n + 1):
                i, score = known(text[start:end], (None, 0))
                if end == start + 1 and (i is None or i < 0):
                    self.edges[end].append((start, *vocabulary.spelled(text[start])))
                elif i is not None and i >= 0:
                    self.edges[end].append((start, (i,), score))
                if i is None:
                    break
        #: Viterbi: the best score of each prefix.
        self.best = [0] * (n + 1)
        for end in range(1, n + 1):
            self.best[end] = max(self.best[start] + score for start, _, score in self.edges[end])

    def paths(self, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best (score, ids), best first; fewer if there are no more."""
        last = len(self.best) - 1
        agenda = [(-self.best[last], last, 0, 0, ())]
        found: list[tuple[int, tuple[int, ...]]] = []
        pushed = 0
        while agenda and len(found) < n:
            # Among equals the one nearest to the start: the first of tied paths is walked to its end at once.
            _, at, _, behind, ids = heapq.heappop(agenda)
            if at == 0:
                found.append((behind, _unlinked(ids)))
                continue
            for start, own, score in self.edges[at]:
                pushed += 1
                # What lies behind is exact, and so is the best of what lies before.
                heapq.heappush(agenda, (-(behind + score + self.best[start]), start, pushed, behind + score, (own, ids)))
        return found


def _unlinked(ids: tuple) -> tuple[int, ...]:
    out: list[int] = []
    while ids:
        own, ids = ids
        out += own
    return tuple(out)


def best_and_gap(vocabulary: Vocabulary, text: str) -> tuple[int, list[int], float]:
    """Score and ids of the best path, and by how much the second best is worse (infinite if there is none).

    Forward Viterbi with the two best scores of every prefix.
    """
    known, n = vocabulary.pieces.get, len(text)
    first, second = [_NEVER] * (n + 1), [_NEVER] * (n + 1)
    came: list[tuple[int, tuple[int, ...] | int]] = [(0, ())] * (n + 1)
    first[0] = 0
    for start in range(n):
        here, other, end = first[start], second[start], start + 1
        found = known(text[start:end])
        if found is None or found[0] < 0:
            own, score = vocabulary.spelled(text[start])
        else:
            own, score = found
        while True:
            if own != -1:
                total, most = here + score, first[end]
                if total > most:
                    also = other + score
                    second[end] = also if also > most else most
                    first[end] = total
                    came[end] = (start, own)
                elif total > second[end]:
                    second[end] = total
            if found is None or end == n:
                break
            end += 1
            found = known(text[start:end])
            if found is None:
                break
            own, score = found
    ids, at = [], n
    while at:
        at, own = came[at]
        if isinstance(own, int):
            ids.append(own)
        else:
            ids += own[::-1]
    return first[n], ids[::-1], first[n] - second[n] if second[n] > _NEVER // 2 else math.inf


class Tree:
    """The pieces as a tree of characters, in arrays, for ``best_and_gap`` of many strings at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.bytes_of = vocabulary, vocabulary.text_of()
        node = {"": 0} | {p: k for k, p in enumerate(vocabulary.pieces, 1)}
        keys = np.array([node[p[:-1]] << _CODE | ord(p[-1]) for p in vocabulary.pieces], np.int64)
        self.child = np.argsort(keys) + 1
        #: Sorted (node, character) of every step down, and a last key that no string has.
        self.keys = np.append(keys[self.child - 1], np.iinfo(np.int64).max)
        self.ids, self.scores = (np.array([0, *column], np.int64) for column in zip(*vocabulary.pieces.values(), strict=True))
        self.lengths = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.lengths[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, length, id, score) of all pieces; a character without one has the id -1. ``left``: characters to the string's end."""
        at, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for k in range(int(left.max(initial=0))):
            if not len(at):
                break
            key = node[at] << _CODE | codes[at + k]
            step = np.searchsorted(self.keys, key)
            there = self.keys[step] == key
            node[at[there]] = self.child[step[there]]
            if k == 0:
                alone = np.ones(len(codes), bool)
                alone[there] = self.ids[node[there]] < 0
                bare = np.flatnonzero(alone)
                n_bytes = 1 + sum((codes[bare] > most).astype(np.int64) for most in (0x7F, 0x7FF, 0xFFFF))
                found.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1), n_bytes * self.vocabulary.byte_score))
            at = at[there]
            own = at[self.ids[node[at]] >= 0]
            found.append((own, np.full(len(own), k + 1), self.ids[node[own]], self.scores[node[own]]))
            at = at[left[at] > k + 1]
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def best(self, strings: list[str]) -> Iterator[tuple[int, bytes, bytes, float]]:
        """(score, ids as bytes, decoded bytes, gap) of strings of 1 to ``REMEMBERED_LENGTH`` characters, as ``best_and_gap`` has them."""
        codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(n)
        word = np.repeat(np.arange(len(n)), n)
        place, length, ids, scores = self._edges(codes, ends[word] - np.arange(len(codes)))
        # Pieces that begin at the same distance from the start of their strings end at different places: one step for all.
        offset = place - (ends - n)[word[place]]
        order = np.argsort(offset.astype(np.uint8), kind="stable")
        place, length, ids, scores = (column[order] for column in (place, length, ids, scores))
        start = place + word[place]
        end = start + length
        first, second = np.full((2, len(codes) + len(n)), _NEVER_64)
        came = np.zeros(len(first), np.int64)
        first[ends - n + np.arange(len(n))] = 0
        bounds = np.concatenate([[0], np.cumsum(np.bincount(offset))])
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            a, b, score = start[low:high], end[low:high], scores[low:high]
            total, most = first[a] + score, first[b]
            better = total > most
            second[b] = np.maximum(np.where(better, most, total), np.where(better, second[a] + score, second[b]))
            first[b] = np.where(better, total, most)
            came[b[better]] = np.flatnonzero(better) + low
        # Back along the best paths, all strings side by side.
        last = ends + np.arange(len(n))
        here, which, walked = last, np.arange(len(n)), []
        while len(which):
            edge = came[here]
            walked.append((which, edge))
            on = offset[order[edge]] > 0
            here, which = start[edge][on], which[on]
        of, edge = (np.concatenate(column[::-1]) for column in zip(*walked, strict=True))
        order = np.argsort(of, kind="stable")
        of, edge = of[order], edge[order]
        # A spelled character is as many ids as it has bytes.
        bare = np.flatnonzero(ids[edge] < 0)
        spelled = [self.vocabulary.spelled(chr(c))[0] for c in codes[place[edge[bare]]].tolist()]
        many = np.ones(len(edge), np.int64)
        many[bare] = [len(own) for own in spelled]
        path, of = np.repeat(ids[edge], many), np.repeat(of, many)
        path[path < 0] = [i for own in spelled for i in own]
        data, text = path.astype(np.int32).tobytes(), b"".join(map(self.bytes_of.__getitem__, path.tolist()))
        cut = np.searchsorted(of, np.arange(len(n) + 1))
        cut_text = np.concatenate([[0], np.cumsum(self.lengths[path])])[cut].tolist()
        cut = (4 * cut).tolist()
        more = second[last] > _NEVER_64 // 2
        gaps = [gap if there else math.inf for gap, there in zip((first[last] - second[last]).tolist(), more.tolist(), strict=True)]
        for k, (score, gap) in enumerate(zip(first[last].tolist(), gaps, strict=True)):
            yield score, data[cut[k] : cut[k + 1]], text[cut_text[k] : cut_text[k + 1]], gap


class Coder:
    """Segmentations of whole texts from those of their units."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.vocabulary, self.n = vocabulary, n
        self.tree = Tree(vocabulary)
        self.bytes_of = self.tree.bytes_of
        self.known: dict[str, tuple] = {}
        self.searched: dict[str, list] = {}
        self.literal = [vocabulary.byte_ids[b] for b in BLANK.encode()]

    def unit(self, name: str) -> tuple:
        """(score in parts, ids as bytes, decoded bytes, gap of the second best, name) of a unit."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if name == SIGN:
            score, ids, gap = 3 * self.vocabulary.byte_score, self.literal, math.inf
        else:
            score, ids, gap = best_and_gap(self.vocabulary, name[1:])
        made = (score, array("i", ids).tobytes(), b"".join(map(self.bytes_of.__getitem__, ids)), gap, name)
        if len(name) <= REMEMBERED_LENGTH:
            self.known[name] = made
        return made

    def paths(self, name: str) -> list[tuple[int, tuple[int, ...]]]:
        """The N best paths of a unit that has more than one."""
        if name in self.searched:
            return self.searched[name]
        if len(self.searched) >= REMEMBERED // 10:
            self.searched.clear()
        found = Lattice(self.vocabulary, name[1:]).paths(self.n)
        if len(name) <= REMEMBERED_LENGTH:
            self.searched[name] = found
        return found

    def names(self, text: str) -> list[str]:
        """Names of a text's units: ``w`` and its string, or ``SIGN`` for the blank sign itself."""
        if not text:
            return []
        names: list[str] = []
        for k, part in enumerate(text.split(BLANK)):
            if k:
                names.append(SIGN)
            part = part.replace(" ", BLANK) if k else BLANK + part.replace(" ", BLANK)
            names += ["w" + u for u in _UNIT.findall(part)]
        return names

    def units(self, text: str) -> list[tuple]:
        """Units of a text."""
        known, unit = self.known, self.unit
        return [known.get(name) or unit(name) for name in self.names(text)]

    def units_of(self, texts: Iterable[str]) -> Iterator[list[tuple]]:
        """Units of each of ``texts``; the new ones of about ``GROUP`` characters are segmented at once."""
        held, size = [], 0
        for text in texts:
            held.append(self.names(text))
            size += len(text)
            if size >= GROUP:
                yield from self._looked_up(held)
                held, size = [], 0
        yield from self._looked_up(held)

    def _looked_up(self, held: list[list[str]]) -> Iterator[list[tuple]]:
        every = set().union(*held)
        if len(self.known) + len(every) > REMEMBERED:
            self.known.clear()
        new = [name for name in every if name not in self.known and name != SIGN and len(name) <= REMEMBERED_LENGTH]
        if new:
            self.known |= {name: (*made, name) for name, made in zip(new, self.tree.best([name[1:] for name in new]), strict=True)}
        known, unit = self.known, self.unit
        for names in held:
            yield [known.get(name) or unit(name) for name in names]

    def pieces(self, units: list[tuple], other: dict[int, int]) -> list[int]:
        """Ids of all units, with other paths than the best at the places in ``other``."""
        parts = [np.array(self.paths(u[4])[other[k]][1], np.int32).tobytes() if k in other else u[1] for k, u in enumerate(units)]
        return np.frombuffer(b"".join(parts), np.int32).tolist()

    def decode(self, units: list[tuple]) -> str:
        """Text of the best segmentation, from the pieces' bytes."""
        return self.text(b"".join(u[2] for u in units))

    def text(self, data: bytes) -> str:
        """Bytes of all pieces, without the blank that encoding puts first."""
        return data[1:].decode() if data else ""

    def best(self, units: list[tuple]) -> list[tuple[float, dict[int, int]]]:
        """The N best as (score, {place of a unit: which of its paths} where not the first), best first."""
        total = sum(u[0] for u in units)
        # Only the units with the smallest gaps can differ: changing another one costs more than each of theirs alone.
        free = heapq.nsmallest(self.n - 1, ((u[3], k) for k, u in enumerate(units) if u[3] < math.inf))
        sums: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
        for _, k in free:
            paths = self.paths(units[k][4])
            first = paths[0][0]
            longer = [(cost + first - paths[j][0], [*own, (k, j)] if j else own) for cost, own in sums for j in range(len(paths))]
            sums = heapq.nsmallest(self.n, longer, key=lambda s: s[0])
        return [((total - cost) / PARTS, dict(own)) for cost, own in sums]


_PATHS = "array<struct<score:double,pieces:array<int>>>"


def _shared(df: DataFrame, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary with its class, so that executors need not have the package installed."""
    return ready(df.sparkSession).sparkContext.broadcast(cloudpickle.dumps(vocabulary))


def encode(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST) -> DataFrame:
    """(doc_id, text) to (doc_id, segmentations): the ``n`` best as score and piece ids, best first."""
    shared = _shared(docs, vocabulary)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("pieces", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pickle.loads(shared.value), n)
        for batch in batches:
            rows = []
            for units in coder.units_of(text or "" for text in batch.column("text").to_pylist()):
                rows.append(
                    [
                        {"score": score, "pieces": coder.pieces(units, other)}
                        for score, other in coder.best(units)
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "segmentations"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, segmentations {_PATHS}")


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, pieces) to (doc_id, text)."""
    shared = _shared(coded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pickle.loads(shared.value))
        for batch in batches:
            texts = [coder.text(b"".join(coder.bytes_of[i] for i in ids or ())) for ids in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "pieces").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST) -> DataFrame:
    """(doc_id, text) to (doc_id, n_pieces, score, pieces_sha256, n_best, last_score, round_trip), from the segmentations.

    ``pieces_sha256`` is over the ids of the best one as little-endian 32-bit numbers;
    ``round_trip`` is whether decoding them gives the text.
    """
    shared = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pickle.loads(shared.value), n)
        for batch in batches:
            rows, texts = [], [text or "" for text in batch.column("text").to_pylist()]
            for text, units in zip(texts, coder.units_of(texts), strict=True):
                ids = b"".join(u[1] for u in units)
                best = coder.best(units)
                same = coder.decode(units) == text
                rows.append((len(ids) // 4, best[0][0], sha256(ids).hexdigest(), len(best), best[-1][0], same))
            kinds = (pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays],
                names=["doc_id", "n_pieces", "score", "pieces_sha256", "n_best", "last_score", "round_trip"],
            )

    schema = "doc_id long, n_pieces long, score double, pieces_sha256 string, n_best long, last_score double, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), load())


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every document that is left with the digest of its segmentations."""
    return digests(docs, load())
