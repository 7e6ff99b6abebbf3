"""Language-model scores of a Brown class-based bigram model.

Every word of the learning texts belongs to one of ``CLASSES`` classes. Exchange clustering moves
words to the class that gains most log-likelihood of the class bigrams. It runs in rounds over
all words seen ``CORE`` times or more; the texts are stored once as the words' numbers, which each round reads; the
words of one half are moved at a time, against the counts of the round before, and words seen
once, which stand for new ones, are one class meanwhile. Then each of these is moved from there to
its best class, from its neighbours' classes. A text is scored by transitions between classes and emissions of words:

    P(w | v) = P(class w | class v) P(w | class w)
    P(d | c) = (N(c, d) + PRIOR p(d)) / (sum over d of N(c, d) + PRIOR)
    p(d) = (N(d) + 0.1 m(d)) / (the sum of this over d),  P(w | d) = (n(w) + 0.1) / (N(d) + 0.1 m(d))

m(d) is the number of different words in d. All words that were never seen are one more word, in
a class of its own; a word seen once stood in for it when it was new, so N(c, new) and N(new, d)
are the bigrams with words seen once, in addition to those of their own classes. The end of a
text is a class of its own as well, and precedes each text. Both factors sum to one.

Words are 64-bit hashes. The ``FREQUENT`` most frequent ones are broadcast with count and class;
what a text has of other words is joined with the whole lexicon.

Defined results: null, empty and blank texts are one end; rows with a null id are scored but not
learnt from; repeated rows get equal scores and each counts; without a learning text every token
is the unseen word, of probability 1 in both models. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import blocks, flat, held_out, learnt_from, mix, read_table, ready, signed, word_hashes, word_spans
from cohortloom.session import materialize

#: Classes that words are exchanged between.
CLASSES = 64
#: The classes of the end of a text and of unseen words.
END_CLASS, NEW_CLASS = CLASSES, CLASSES + 1
#: Rounds of exchange; each moves the words of one half.
ROUNDS = 6
#: Strength of the class frequencies in a transition, in tokens.
PRIOR = 100.0
#: Added to each count.
ADDED = 0.1
#: Times that a word is seen that takes part in every round. Hash and class of each are broadcast, 16 bytes.
CORE = 2
#: Words that are broadcast for scoring: 18 bytes each.
FREQUENT = 1 << 18
#: Counts that a task adds up before it sends them on.
HELD = 1 << 20
#: Words of a part, whose neighbours' classes are added up in one place, and words that are exchanged at once.
WORDS, TOGETHER = 1024, 256
#: Counts below this have their entropies looked up; rows of a batch of numbers, which are small.
SMALL, NUMBERS = 32, 4096

#: Stands for the end of a text among the word hashes.
END = np.uint64(0xE4D0F7E87)
_END = int(END)


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of rows: the word hashes with an end behind each row, and the index of each row's first (and one more)."""
    buf, offs = flat(column)
    for first, last in blocks(offs):
        part, own = buf[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        starts, ends, bounds = word_spans(part, own)
        yield np.insert(word_hashes(part, starts, ends), bounds[1:], END), bounds + np.arange(len(bounds))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows that are equal but for the last column, a count, added up."""
    *keys, n = (np.concatenate(column) for column in zip(*parts, strict=True))
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
    keys, n = [k[order] for k in keys], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return (*(k[new] for k in keys), np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n)


def _counted(table: DataFrame, keys: str, parts_of, rows) -> DataFrame:
    """Counts of ``keys`` over all of ``table``, added up in each task only; ``rows`` gives the keys of each of ``parts_of`` a batch."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        held = 0
        for batch in batches:
            for part in parts_of(batch):
                found = rows(*part)
                parts.append(_summed([(*found, np.ones(len(found[0]), np.int64))]))
                held += len(parts[-1][0])
                if held >= HELD:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held >= HELD // 2:
                        yield _batch(parts[0])
                        parts, held = [], 0
        if parts:
            yield _batch(_summed(parts))

    def _batch(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        arrays = [signed(c) if c.dtype == np.uint64 else pa.array(c) for c in part]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "n"])

    return table.mapInArrow(run, f"{keys}, n long")


def _behind(words: np.ndarray, last: object) -> np.ndarray:
    """What follows each token: the next one, ``last`` after the last."""
    return np.append(words[1:], np.array([last], words.dtype))


def _before(words: np.ndarray, first: object) -> np.ndarray:
    """What each token follows: the one before, ``first`` at the beginning."""
    return np.append(np.array([first], words.dtype), words[:-1])


class _Places:
    """Places of words in an ascending array of hashes: the leading bits, which are spread evenly, give a place close by."""

    def __init__(self, names: np.ndarray):
        bits = len(names).bit_length() + 1
        self.shift, self.size = np.uint64(64 - bits), len(names)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((names >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])
        self.names = np.append(names, np.uint64(2**64 - 1))

    def of(self, words: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it has none."""
        at = self.first[words >> self.shift]
        behind = np.flatnonzero(self.names[at] < words)
        while len(behind):
            at[behind] += 1
            behind = behind[self.names[at[behind]] < words[behind]]
        return np.where((self.names[at] == words) & (at < self.size), at, np.int32(-1))


def _numbers(words: np.ndarray, core: _Places) -> np.ndarray:
    """Place of each word in the core, the one behind it for END, one more for all others."""
    at = core.of(words)
    at[at < 0] = core.size + 1
    at[words == END] = core.size
    return at


def _numbered(docs: DataFrame, core: np.ndarray) -> DataFrame:
    """(numbers, others), a row for each block of whole texts: the number of every token as 32 bits, and the words outside the core, in order.

    Each text ends with an end, and so does each row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(shared.value)
        for batch in batches:
            for words, _ in tokens(batch.column("text")):
                own = _numbers(words, places)
                columns = [own.tobytes(), words[own == places.size + 1].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["numbers", "others"])

    return docs.select("text").mapInArrow(run, "numbers binary, others binary")


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers and the other words of each row of ``_numbered``."""
    for numbers, others in zip(batch.column("numbers"), batch.column("others"), strict=True):
        yield np.frombuffer(numbers.as_py(), np.int32), np.frombuffer(others.as_py(), np.uint64)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


WIDTH = CLASSES + 2
#: Slots of a word: the class behind it, ``WIDTH`` plus the class before it, ``2 * WIDTH`` for the word itself behind it.
SLOTS = 2 * WIDTH + 1


def _steps(cells: np.ndarray) -> np.ndarray:
    """What the entropies of ``cells`` gain from each count below ``SMALL``."""
    return _entropy(cells + np.arange(SMALL).reshape(-1, *[1] * cells.ndim)) - _entropy(cells)


def steps(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gains that words share, as most of their counts are small: of the cells of each column and row, and of the sums."""
    return _steps(counts.T), _steps(counts), _steps(counts.sum(1)), _steps(counts.sum(0))


def _gained(cells: np.ndarray, known: np.ndarray, n: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Rows of what ``cells`` (those at ``at``, if given) gain from the counts ``n``, looked up in ``known`` where ``n`` is small."""
    size = np.minimum(n, SMALL - 1).astype(np.int64)
    gain = known[size] if at is None else known[size, at]
    large = np.flatnonzero(n >= SMALL)
    if len(large):
        own = np.broadcast_to(cells, (len(large), cells.shape[-1])) if at is None else cells[at[large]]
        gain[large] = _entropy(own + n[large, None]) - _entropy(own)
    return gain


def exchange(
    counts: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, loops: np.ndarray, known: tuple[np.ndarray, ...] | None = None
) -> np.ndarray:
    """The classes to which words of classes ``own`` move, each as if alone.

    ``counts`` is the matrix of class bigrams and ``known`` its ``steps``, a row of ``right`` and ``left`` a word's counts
    with the class behind and before it, in which the ``loops`` of the word with itself are left out.
    """
    k = np.arange(len(own))
    n = right.sum(1) + loops
    columns, rows, behind, before = known or steps(counts)

    def gains(cells: np.ndarray, known: np.ndarray, with_: np.ndarray, across: np.ndarray) -> np.ndarray:
        """What the cells of a word's neighbours gain in each class, all but the crossing."""
        word, j = np.nonzero(with_)
        each = np.arange(len(word))
        x, kind = with_[word, j], own[word]
        gain = _gained(cells, known, x, j)
        # The word's own class has its cells without the word.
        less = cells[j, kind] - x
        gain[each, kind] = _entropy(less + x) - _entropy(less)
        inner = np.flatnonzero(j == kind)
        if len(inner):
            rest = cells[j[inner]]
            rest[np.arange(len(inner)), kind[inner]] -= x[inner]
            rest -= across[word[inner]]
            rest[np.arange(len(inner)), j[inner]] -= loops[word[inner]]
            gain[inner] = _entropy(rest + x[inner, None]) - _entropy(rest)
        gain[each, j] = 0
        total = np.zeros(with_.shape)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            total[word[first]] = np.add.reduceat(gain, first)
        return total

    # The word in class c: row c gets ``right``, column c gets ``left``, and their crossing gets both and the loops.
    gain = gains(counts.T, columns, right, left) + gains(counts, rows, left, right)
    crossing = np.repeat(np.diag(counts)[None], len(own), 0)
    crossing[k, own] -= right[k, own] + left[k, own] + loops
    both = right + left + loops[:, None]
    at = np.nonzero(both)
    gain[at] += _entropy(crossing[at] + both[at]) - _entropy(crossing[at])
    # Words that are beside it keep their own sums, whichever class it takes.
    for sums, shared, add in ((counts.sum(1), behind, n), (counts.sum(0), before, left.sum(1) + loops)):
        more = _gained(sums, shared, add)
        less = sums[own] - add
        more[k, own] = _entropy(less + add) - _entropy(less)
        gain -= more
    best = np.argmax(gain[:, :CLASSES], 1)
    better = (own >= CLASSES) | (gain[k, best] > gain[k, own] + 1e-9 * np.abs(gain[k, own]))
    return np.where((n > 0) & better, best, own)


def _matrix(numbered: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Class bigrams of ``numbered`` texts, whose words have ``classes``."""
    shared = numbered.sparkSession.sparkContext.broadcast(classes.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = shared.value, np.zeros(WIDTH * WIDTH, np.int64)
        for batch in batches:
            for numbers, _ in _sequences(batch):
                kinds = classes[numbers]
                total += np.bincount(_before(kinds, END_CLASS) * np.int16(WIDTH) + kinds, minlength=WIDTH * WIDTH)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    out = np.zeros(WIDTH * WIDTH)
    sums = numbered.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most WIDTH^2 rows
        out[r["cell"]] = r["n"]
    return out.reshape(WIDTH, WIDTH)


def _exchanged(vectors: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, slots, ns) to (word, class): the best class of each word, whose own is that of all others.

    ``slots`` are those of ``SLOTS``. Words seen once between the same two classes get the same one.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        known, alike = steps(counts), np.full(SLOTS * SLOTS, -1, np.int64)

        def best(slots: np.ndarray, ns: np.ndarray, many: np.ndarray) -> np.ndarray:
            cells = np.repeat(np.arange(len(many)), many) * SLOTS + slots
            dense = np.bincount(cells, ns, len(many) * SLOTS).reshape(len(many), -1)
            own = np.full(len(many), NEW_CLASS)
            return exchange(counts, own, dense[:, :WIDTH], dense[:, WIDTH : 2 * WIDTH], dense[:, -1], known)

        for batch in batches:
            new = []
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                many = part.column("slots").value_lengths().to_numpy()
                slots, ns = (part.column(c).flatten().to_numpy() for c in ("slots", "ns"))
                first = np.cumsum(many) - many
                last = first + many - 1
                once = (many == 2) & (ns[first] == 1) & (ns[last] == 1)
                keys = slots[first].astype(np.int64) * SLOTS + slots[last]
                open_ = np.unique(keys[once])
                open_ = open_[alike[open_] < 0]
                if len(open_):
                    pairs = np.column_stack([open_ // SLOTS, open_ % SLOTS]).ravel()
                    alike[open_] = best(pairs, np.ones(len(pairs)), np.full(len(open_), 2))
                found = alike[keys]
                if not once.all():
                    rest = np.repeat(~once, many)
                    found[~once] = best(slots[rest], ns[rest], many[~once])
                new.append(found)
            moved = np.concatenate(new) if new else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(moved, pa.int32())], names=["word", "class"])

    # By number: the rows are few bytes and much work, which adaptive execution would put into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return vectors.select("word", "slots", "ns").repartition(tasks, "word").mapInArrow(run, "word long, class int")


def _slots(numbered: DataFrame, classes: np.ndarray, moving: np.ndarray) -> DataFrame:
    """(part, cells, ns): what the words that are ``moving`` have around them, ``WORDS`` words in a part.

    A cell is a word's place in its part times ``SLOTS``, plus the slot; cells and counts are packed as 32-bit
    numbers. A task adds up to ``HELD`` * 4 neighbours before it sends them on, so a part has a few rows of each task.
    """
    shared = numbered.sparkSession.sparkContext.broadcast((classes.astype(np.int16), moving))

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(keys))
        firsts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        cells, ns = every[firsts], np.diff(np.append(firsts, len(every))).astype(np.int32)
        parts = cells // (WORDS * SLOTS)
        at = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
        own = (cells - parts * (WORDS * SLOTS)).astype(np.int32)
        rows = [(int(parts[a]), own[a:b].tobytes(), ns[a:b].tobytes()) for a, b in zip(at, np.append(at[1:], len(cells)), strict=True)]
        columns = zip(*rows, strict=True)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "cells", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, moving = shared.value
        held: list[np.ndarray] = []
        for batch in batches:
            for b, _ in _sequences(batch):
                kinds = classes[b].astype(np.int64)
                a, behind, before = _before(b, len(moving) - 2), kinds, _before(kinds, END_CLASS)
                same, moves = a == b, moving[b]
                after, back = np.flatnonzero(_before(moves, False)), np.flatnonzero(moves & ~same)
                slots = np.where(same[after], 2 * WIDTH, behind[after])
                held += [a[after].astype(np.int64) * SLOTS + slots, b[back].astype(np.int64) * SLOTS + WIDTH + before[back]]
                if sum(map(len, held)) >= 4 * HELD:
                    yield packed(held)
                    held = []
        if sum(map(len, held)):
            yield packed(held)

    return numbered.mapInArrow(run, "part int, cells binary, ns binary")


def _round(numbered: DataFrame, classes: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """``classes`` of the core after the words that are ``moving`` were exchanged."""
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast((_matrix(numbered, classes), classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, classes = shared.value
        known = steps(counts)

        def moved(part: int, total: np.ndarray) -> pa.RecordBatch:
            dense = total.reshape(WORDS, SLOTS)
            own = np.flatnonzero(dense.any(1))
            new = []
            for at in range(0, len(own), TOGETHER):
                k = own[at : at + TOGETHER]
                new.append(exchange(counts, classes[part * WORDS + k], dense[k, :WIDTH], dense[k, WIDTH : 2 * WIDTH], dense[k, -1], known))
            arrays = [pa.array(part * WORDS + own, pa.int64()), pa.array(np.concatenate(new), pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "class"])

        last, total = -1, np.zeros(WORDS * SLOTS)
        for batch in batches:
            for part, cells, ns in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "ns")), strict=True):
                if part != last:
                    if last >= 0:
                        yield moved(last, total)
                    last, total = part, np.zeros(WORDS * SLOTS)
                total[np.frombuffer(cells, np.int32)] += np.frombuffer(ns, np.int32)
        if last >= 0:
            yield moved(last, total)

    # By number: the rows are few bytes and much work, which adaptive execution would put into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = _slots(numbered, classes, moving).repartition(tasks, "part").sortWithinPartitions("part")
    out = classes.copy()
    found = parts.mapInArrow(run, "word long, class int").toArrow()  # a number and a class for each moving word
    out[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return out


def _core_classes(numbered: DataFrame, core: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core, of the end and of all others, and the class bigrams under them."""
    spread = mix(core)
    classes = np.append((spread % np.uint64(CLASSES)).astype(np.int64), [END_CLASS, NEW_CLASS])
    for k in range(rounds):
        half = (mix(spread + np.uint64(k // 2)) & np.uint64(1)) == np.uint64(k % 2)
        classes = _round(numbered, classes, np.append(half, [False, False]))
    return classes, _matrix(numbered, classes)


@dataclass(frozen=True)
class Model:
    """The stored lexicon (word, n, class) and what is small of the model."""

    lexicon: DataFrame
    total: int
    different: int
    #: log10 of the transitions between all CLASSES + 2 classes.
    transitions: np.ndarray
    #: For each class N(d) + 0.1 m(d).
    mass: np.ndarray


def learn(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """From ``docs`` (text): all of them, all their words."""
    context = ready(docs.sparkSession).sparkContext
    texts = docs.select("text")
    counted = _counted(texts, "word long", lambda batch: tokens(batch.column("text")), lambda words, bounds: (words,))
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Words seen once are never in the core: they stand for new ones below.
    often = words.where((F.col("n") >= CORE) & (F.col("word") != _END)).select("word").toArrow()
    core = np.sort(often.column("word").to_numpy().view(np.uint64))
    numbered = materialize(_numbered(texts, core), "numbered")
    classes, counts = _core_classes(numbered, core, rounds)
    shared = context.broadcast((core, classes))
    rest = len(core) + 1

    def contexts(numbers: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        own, other = shared.value[1][numbers].astype(np.int16), numbers == rest
        return others, _before(own, END_CLASS)[other], _behind(own, END_CLASS)[other]

    # One shuffle by word serves both aggregations; a word has WIDTH^2 rows at most after the first.
    around = _counted(numbered, "word long, before short, behind short", _sequences, contexts).repartition("word")
    around = materialize(around.groupBy("word", "before", "behind").agg(F.sum("n").alias("n")).groupBy("word").agg(
        F.collect_list("before").alias("before"), F.collect_list("behind").alias("behind"), F.collect_list("n").alias("n")
    ), "contexts")
    slots = F.concat(F.transform("behind", lambda c: c.cast("int")), F.transform("before", lambda c: c.cast("int") + WIDTH))
    vectors = around.select("word", slots.alias("slots"), F.concat("n", "n").alias("ns"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NUMBERS))
    others = materialize(_exchanged(vectors, counts), "others")
    rare = materialize(others.join(words, "word").select("word", "n", "class"), "rare")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, classes = shared.value
        places = _Places(core)
        for batch in batches:
            own = pa.array(classes[_numbers(batch.column("word").to_numpy().view(np.uint64), places)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), own], names=["word", "n", "class"])

    kept = words.select("word", "n").mapInArrow(labelled, "word long, n long, class int").where(F.col("class") != NEW_CLASS)
    lexicon = materialize(kept.unionByName(rare), "lexicon")
    ready(docs.sparkSession)

    # Class bigrams: of two core words by number, of a core word and another from its contexts, of two others by joins.
    size = WIDTH
    counts[NEW_CLASS] = counts[:, NEW_CLASS] = 0
    flagged = rare.select("word", "class", (F.col("n") == 1).alias("once"))
    each = around.select("word", F.explode(F.arrays_zip("before", "behind", "n")).alias("c")).select("word", "c.*").join(flagged, "word")
    for r in each.groupBy("class", "once", "before", "behind").agg(F.sum("n").alias("n")).collect():  # at most 2 WIDTH^3 rows
        for own in {r["class"], NEW_CLASS if r["once"] else r["class"]}:
            if r["before"] != NEW_CLASS:
                counts[r["before"], own] += r["n"]
            if r["behind"] != NEW_CLASS:
                counts[own, r["behind"]] += r["n"]

    def other_pairs(numbers: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        # Two others in a row are neighbours among the others as well.
        both = (numbers == rest)[1:][(numbers == rest)[:-1]]
        first = np.flatnonzero(both)
        return others[first], others[first + 1]

    pairs = _counted(numbered, "a long, b long", _sequences, other_pairs)
    first, second = flagged.toDF("a", "class_a", "new_a"), flagged.toDF("b", "class_b", "new_b")
    marked = pairs.join(first, "a").join(second, "b")
    kinds = ["class_a", "class_b", "new_a", "new_b"]
    for r in marked.groupBy(kinds).agg(F.sum("n").alias("n")).collect():  # at most 4 CLASSES^2 rows
        for c in {r["class_a"], NEW_CLASS if r["new_a"] else r["class_a"]}:
            for d in {r["class_b"], NEW_CLASS if r["new_b"] else r["class_b"]}:
                counts[c, d] += r["n"]
    own, different = np.zeros(size), np.zeros(size)
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():
        own[r["class"]], different[r["class"]] = r["n"], r["m"]
    different[NEW_CLASS] = 1
    mass = own + ADDED * different
    smooth = mass.copy()
    smooth[NEW_CLASS] += counts[: CLASSES + 1, NEW_CLASS].sum()
    smooth /= smooth.sum()
    with np.errstate(divide="ignore"):
        transitions = np.log10((counts + PRIOR * smooth) / (counts.sum(1, keepdims=True) + PRIOR))
    return Model(lexicon, int(own.sum()), int(different.sum()) - 1, transitions, mass)


class _Scorer:
    """Sums over the tokens of a text whose counts and classes are given."""

    def __init__(self, model: tuple):
        self.total, self.different, self.transitions, self.mass = model

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + ADDED) / (self.total + ADDED * (self.different + 1)))

    def emission(self, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.log10((n + ADDED) / self.mass[kind])


_FOUND = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _first_pass(docs: DataFrame, model: Model) -> DataFrame:
    """Sums over the frequent tokens of each text, and its other tokens with the classes beside them (-1: another such token)."""
    spark = docs.sparkSession
    top = model.lexicon.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    names = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(names)
    names = names[order]
    counts, kinds = top.column("n").to_numpy()[order], top.column("class").to_numpy().astype(np.int16)[order]
    shared = spark.sparkContext.broadcast((names, counts, kinds, (model.total, model.different, model.transitions, model.mass)))
    rest_kind = pa.list_(pa.struct([("place", pa.int64()), ("word", pa.int64()), ("before", pa.int32()), ("behind", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, kinds, small = shared.value
        scorer, places = _Scorer(small), _Places(names)
        # The last of each stands for the words that aren't there.
        base_of, emission_of = np.append(scorer.base(counts), 0.0), np.append(scorer.emission(counts, kinds), 0.0)
        kinds = np.append(kinds, np.int16(-1))
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            rest: list = []
            for words, bounds in tokens(batch.column("text")):
                at = places.of(words)
                kind, there, firsts, ends = kinds[at], at >= 0, bounds[:-1], bounds[1:] - 1
                before = _before(kind, END_CLASS)
                before[firsts] = END_CLASS
                score = emission_of[at]
                score += np.where(there & (before >= 0), scorer.transitions[before, kind], 0.0)
                columns[0].append(np.diff(bounds))
                columns[1].append(np.add.reduceat(there.astype(np.int64), firsts))
                columns[2].append(np.add.reduceat(base_of[at], firsts))
                columns[3].append(np.add.reduceat(score, firsts))
                # The last token is an end, which only an empty lexicon lacks.
                behind = _behind(kind, END_CLASS)
                behind[ends] = END_CLASS
                own = np.flatnonzero(~there)
                row = np.searchsorted(bounds, own, "right") - 1
                rest.append((np.bincount(row, minlength=len(firsts)), own - bounds[row], words[own].view(np.int64), before[own], behind[own]))
            many, *fields = (np.concatenate(c) for c in zip(*rest, strict=True)) if rest else (np.zeros(0, np.int64),) * 5
            fields = [pa.array(f, kind.type) for f, kind in zip(fields, rest_kind.value_type, strict=True)]
            offsets = pa.array(np.append(0, np.cumsum(many)), pa.int32())
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(rest_kind.value_type)))
            sums = [np.concatenate(c) if c else np.zeros(0) for c in columns]
            kinds_of = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.array(s, kind) for s, kind in zip(sums, kinds_of, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays, rest],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rest"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, f"{_FOUND}, rest array<struct<place:long,word:long,before:int,behind:int>>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, n_known, base_score, score), a row for each row."""
    if model.total == 0:
        alone = tokens_only(docs)
        return alone.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("n_known"), *[F.lit(0.0).alias(c) for c in ("base_score", "score")])
    first = materialize(_first_pass(docs, model).withColumn("row", F.monotonically_increasing_id()), "scores")
    rest = first.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.*")
    found = rest.join(model.lexicon, "word", "left").select(
        "row",
        F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(NEW_CLASS)).alias("kind"), "before", "behind").alias("t"),
    )
    # A text's own rare tokens: as bounded as the text.
    gathered = found.groupBy("row").agg(F.sort_array(F.collect_list("t")).alias("rare"))
    shared = docs.sparkSession.sparkContext.broadcast((model.total, model.different, model.transitions, model.mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            rare = batch.column("rare")
            t = rare.flatten()
            place, n, kind, before, behind = (t.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "kind", "before", "behind"))
            many = rare.value_lengths().to_numpy()  # one at least
            firsts = np.cumsum(many) - many
            follows = np.append(False, place[1:] == place[:-1] + 1)
            follows[firsts] = False
            before = np.where(follows, np.roll(kind, 1), before)
            own = scorer.emission(n, kind) + scorer.transitions[before, kind]
            own = own + np.where(behind >= 0, scorer.transitions[kind, behind], 0.0)
            known = np.add.reduceat((n > 0).astype(np.int64), firsts)
            each = list(zip(firsts.tolist(), (firsts + many).tolist(), strict=True))
            base, score = ([float(x[a:b].sum()) for a, b in each] for x in (scorer.base(n), own))
            arrays = [pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", "known", "base", "more"])

    more = gathered.mapInArrow(run, "row long, known long, base double, more double")
    return first.select("row", "doc_id", "n_tokens", "n_known", "base_score", "score").join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def tokens_only(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(bounds) for _, bounds in tokens(batch.column("text"))]
            own = pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs.where(learnt_from(F.col("doc_id"), 10, 0)))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 10, 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
