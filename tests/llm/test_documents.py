"""The document operators against brute force on a small table with nulls, ties, copies, empty and long texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cohortloom.llm import language_model, near_duplicates, pieces, pii, rules
from cohortloom.llm.catalog import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


def _words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


LONG = " ".join(f"word{i % 97}x{i % 31}" for i in range(4000))
BASE = " ".join(f"tok{i}" for i in range(120))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river"),
    (2, "The quick brown fox jumps over the lazy dog near the river"),
    (2, "The quick brown fox jumps over the lazy dog near the river"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one two"),
    (7, "ONE\ttwo"),
    (8, BASE),
    (9, BASE.replace("tok60", "changed")),
    (10, BASE + " and two more"),
    (11, LONG),
    (12, "naïve café ▁ sign  two blanks 😀"),
    (None, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def _shingles(text: str | None, size: int) -> frozenset:
    words = _words(text)
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, size):
    sets = [_shingles(t, size) for _, t in TEXTS]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    want = []
    for k, (doc_id, _) in enumerate(TEXTS):
        ids = [TEXTS[j][0] for j in range(len(sets)) if group[j] == group[k] and TEXTS[j][0] is not None]
        want.append((doc_id, len(sets[k]), min(ids)))
    got = near_duplicates.near_duplicates(docs.select("doc_id", "text"), size)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(want)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    got = near_duplicates.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5, 6, 8, 11, 12]


def test_language_model_base_and_counts(docs):
    train = [(i, t) for i, t in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for _, t in train for w in [*_words(t), "\0end"])
    total = sum(counts.values())
    learnt = docs.where(language_model.learnt_from(docs["doc_id"], 10, 0))
    model = language_model.learn(learnt, rounds=2)
    got = language_model.score(docs, model).collect()
    want = []
    for i, t in TEXTS:
        own = [*_words(t), "\0end"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        want.append((i, len(own), sum(counts[w] > 0 for w in own), round(base, 6)))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == Counter(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    rows = (10.0**model.transitions)[: language_model.END_CLASS + 1].sum(1)
    assert abs(rows - 1).max() < 1e-9
    # The same scores when hardly any word is in the core or broadcast.
    before = language_model.CORE, language_model.FREQUENT
    try:
        language_model.FREQUENT = 3
        again = language_model.score(docs, model).collect()
    finally:
        language_model.CORE, language_model.FREQUENT = before
    key = lambda rows: sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert key(again) == key(got)


def test_exchange_takes_the_most_likely_class():
    classes, width = language_model.CLASSES, language_model.WIDTH
    draw = np.random.default_rng(3)
    # Words 0 to 89 in a few classes, one of them that of all others.
    text = np.append(draw.integers(0, 90, 3000) ** 2 // 90, [7, 7, 7])
    own = np.append(draw.integers(0, 5, 88), [language_model.NEW_CLASS] * 2)

    def likelihood(kinds):
        counts = np.zeros((width, width))
        np.add.at(counts, (kinds[text[:-1]], kinds[text[1:]]), 1)
        parts = [counts, counts.sum(1), counts.sum(0)]
        cells, behind, before = (float((x[x > 0] * np.log(x[x > 0])).sum()) for x in parts)
        return counts, cells - behind - before

    counts, _ = likelihood(own)
    a, b = text[:-1], text[1:]
    right, left, loops = np.zeros((90, width)), np.zeros((90, width)), np.zeros(90)
    np.add.at(loops, a[a == b], 1)
    np.add.at(right, (a[a != b], own[b[a != b]]), 1)
    np.add.at(left, (b[a != b], own[a[a != b]]), 1)
    got = language_model.exchange(counts, own, right, left, loops)
    # The first and the last word of the text lack a neighbour; words not seen stay.
    for w in set(np.unique(text)) - {text[0], text[-1]}:
        every = [likelihood(np.where(np.arange(90) == w, c, own))[1] for c in range(classes)]
        assert every[got[w]] == pytest.approx(max(every), abs=1e-6)
    assert all(got[w] == own[w] for w in set(range(90)) - set(text.tolist()))


def test_every_word_seen_twice_takes_part_in_the_rounds(spark, monkeypatch):
    seen = []
    inner = language_model._core_classes
    monkeypatch.setattr(language_model, "_core_classes", lambda docs, core, rounds: seen.append(len(core)) or inner(docs, core, rounds))
    # More words than the 32,768 that once were the limit, each twice.
    rows = [(k, " ".join(f"v{w}" for w in range(k % 20, 40_000, 20)) + f" once{k}") for k in range(40)]
    model = language_model.learn(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1)
    assert seen == [40_000]
    assert model.lexicon.count() == 40_000 + 40 + 1


def test_neighbours_are_added_up_in_a_row_for_each_part_of_the_words(spark):
    """A round over 80,000 tokens sends a few packed rows on, not one for each pair of words."""
    draw = np.random.default_rng(5)
    lists = [[f"w{w}" for w in draw.integers(0, 3000, 2000) ** 2 // 3000] for _ in range(40)]
    table = spark.createDataFrame([(" ".join(words),) for words in lists], "text string")
    seen = Counter(w for words in lists for w in words)
    hashed = np.concatenate([words for words, _ in language_model.tokens(pa.array([" ".join(seen)]))])[:-1]
    names = dict(zip(hashed.tolist(), seen, strict=True))
    core = np.sort(hashed[[n > 5 for n in seen.values()]])
    place = {names[h]: k for k, h in enumerate(core.tolist())}
    end, rest, width, slots = len(core), len(core) + 1, language_model.WIDTH, language_model.SLOTS
    classes = np.append(np.arange(end) % language_model.CLASSES, [language_model.END_CLASS, language_model.NEW_CLASS])
    moving = np.append(np.arange(end) % 3 > 0, [False, False])
    want, cells = Counter(), Counter()
    for words in lists:
        own = [end, *(place.get(w, rest) for w in words), end]
        for a, b in zip(own, own[1:]):
            cells[classes[a], classes[b]] += 1
            want[a, 2 * width if a == b else classes[b]] += moving[a]
            want[b, width + classes[a]] += moving[b] and a != b
    numbered = language_model._numbered(table, core).cache()
    matrix = language_model._matrix(numbered, classes)
    assert {k: matrix[k] for k in cells} == cells and matrix.sum() == sum(cells.values())
    rows = language_model._slots(numbered, classes, moving).collect()
    got = Counter()
    for r in rows:
        for cell, n in zip(np.frombuffer(r["cells"], np.int32).tolist(), np.frombuffer(r["ns"], np.int32).tolist()):
            got[r["part"] * language_model.WORDS + cell // slots, cell % slots] += n
    assert got == +want
    assert len(rows) <= numbered.rdd.getNumPartitions() * (end // language_model.WORDS + 1) < 100


def test_pieces_come_back_and_best_paths_are_right(docs):
    vocabulary = pieces.load()
    assert all(r.round_trip for r in pieces.digests(docs, vocabulary).collect())
    for word in ("▁the", "▁rivers", "naïve"):
        every = []

        def walk(at: int, score: int, lattice) -> None:
            if at == 0:
                every.append(score)
            for start, _, own in lattice.edges[at]:
                walk(start, score + own, lattice)

        lattice = pieces.Lattice(vocabulary, word)
        walk(len(word), 0, lattice)
        assert [s for s, _ in lattice.paths(5)] == sorted(every, reverse=True)[:5]


def _every_segmentation(coder: pieces.Coder, text: str) -> list[tuple[int, tuple[int, ...]]]:
    """All (score, ids) of a whole text: each unit's by plain recursion, then all their combinations."""
    v = coder.vocabulary

    def split(rest: str) -> list[tuple[int, tuple[int, ...]]]:
        if not rest:
            return [(0, ())]
        out = []
        for k in range(1, len(rest) + 1):
            i, score = v.pieces.get(rest[:k], (-1, 0))
            if i >= 0:
                own = ((i,), score)
            elif k == 1:
                own = v.spelled(rest[0])
            else:
                continue
            out += [(own[1] + s, own[0] + ids) for s, ids in split(rest[k:])]
        return out

    whole = [(0, ())]
    for unit in coder.units(text):
        own = [(unit[0], tuple(coder.literal))] if unit[4] == pieces.SIGN else split(unit[4][1:])
        whole = [(a + s, x + y) for a, x in whole for s, y in own]
    return whole


def test_best_segmentations_of_whole_texts_against_brute_force():
    """Scores, order and pieces of the N best; ties and repeated characters; no segmentation comes twice."""
    coder = pieces.Coder(pieces.load(), 4)
    random = np.random.default_rng(7)
    texts = ["", " ", "a", "the", "hhhhhh", "====", "▁x", "x ▁ y", "é\n", "  ab  "]
    texts += ["".join(random.choice(list("abh=é▁ "), size=random.integers(1, 8))) for _ in range(300)]
    for text in texts:
        units = coder.units(text)
        best = coder.best(units)
        made = [tuple(coder.pieces(units, other)) for _, other in best]
        every = dict((ids, score) for score, ids in _every_segmentation(coder, text))
        assert len(set(made)) == len(made) == min(4, len(every))
        assert [every[ids] for ids in made] == sorted(every.values(), reverse=True)[: len(made)]
        assert [score for score, _ in best] == [every[ids] / pieces.PARTS for ids in made]
        assert {coder.text(b"".join(map(coder.bytes_of.__getitem__, ids))) for ids in made} == {text}
        assert coder.decode(units) == text


def test_a_very_long_word_is_segmented_in_time():
    coder = pieces.Coder(pieces.load())
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh"), size=100_000)) + " " + "=" * 50_000
    units = coder.units(text)
    best = coder.best(units)
    assert len({tuple(coder.pieces(units, other)) for _, other in best}) == 3
    assert coder.decode(units) == text and not coder.known


def test_encode_and_decode_with_extra_columns_and_repeats(spark):
    vocabulary = pieces.load()
    texts = ["a cat", "a cat", "", None, "naïve ▁ tab\tend\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, segmentations string")
    coded = pieces.encode(docs, vocabulary, 2)
    rows = {r.doc_id: r.segmentations for r in coded.collect()}
    assert rows[0] == rows[1] and len(rows[0]) == 2 and [len(rows[k]) for k in (2, 3)] == [1, 1]
    for k in (0, -1):
        place = "segmentations[size(segmentations) - 1].pieces" if k else "segmentations[0].pieces"
        back = pieces.decode(coded.selectExpr("doc_id", f"{place} as pieces"), vocabulary)
        assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_personal_data_with_disguises(spark):
    rows = [(1, "mail a.b@c.org or call +1 (555) 123-4567 now"), (2, "write to jane at example dot com"), (3, None), (4, "ip 10.0.0.1")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = {i: [span.kind for span in r.base] for i, r in got.items()}
    assert kinds == {1: ["email", "phone"], 2: [], 3: [], 4: ["ip"]}
    assert [span.kind for span in got[2].added] == ["email"]
    assert rows[1][1][got[2].added[0].start : got[2].added[0].end] == "jane at example dot com"


def test_rule_counts(spark):
    text = "a b c a b c\nx y\nx y\n#$"
    row = rules.profile(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), [0.0] * rules.BUCKETS).collect()
    one, none = sorted(row, key=lambda r: r.doc_id)
    assert (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (11, 12, 2, 1, 6)
    assert (none.n_words, none.base_failed, none.kept) == (0, True, False)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert near_duplicates.near_duplicates(none.select("doc_id", "text")).count() == 0
    assert pieces.digests(none, pieces.load()).count() == 0
    model = language_model.learn(none, rounds=1)
    assert [r.base_score for r in language_model.score(docs.limit(1), model).collect()] == [0.0]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.round_trip for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_new_words_are_segmented_side_by_side(monkeypatch):
    """As one by one, ties, spelled characters, blanks and the blank sign included; only long words go one by one."""
    ranks = {p: (k + 300, float(k)) for k, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "é", "▁▁", "abab", "c"])}
    vocabulary = pieces.vocabulary_of(ranks, list(range(256)))
    texts = ["", "a", "abababa ab", " ", "  ab  ", "é\U0001f600z中 ▁ a▁b", "a\nb", "zz " * 3, "ab" * 40 + " ba", "ba ab " * 9]
    one, many = pieces.Coder(vocabulary), pieces.Coder(vocabulary)
    expected = [one.units(text) for text in texts]
    single, seen = pieces.best_and_gap, []
    monkeypatch.setattr(pieces, "best_and_gap", lambda v, text: (seen.append(text), single(v, text))[1])
    monkeypatch.setattr(pieces, "GROUP", 20)
    assert list(many.units_of(texts)) == expected
    assert seen == ["▁" + "ab" * 40]


def test_single_documents_of_one_list_are_not_paired_where_their_places_rule_it_out(spark):
    """60 documents of 100 shingles meet late in their prefixes; two of them early enough to be similar."""
    rows = [(1, k, 100, 11 if k in (7, 9) else 12 + k % 8, k) for k in range(60)] + [(1, 90, 100, 30, 7), (1, 91, 100, 31, 9)]
    own = spark.createDataFrame(rows, "key long, id long, n int, at int, label long")
    shorter = own.where("n = 100 and at <= 11")
    couples = near_duplicates._couples(shorter, own, 80)
    assert sorted(tuple(r) for r in couples.collect()) == [(1, 7, 9), (1, 9, 7)]
    assert [tuple(r) for r in near_duplicates._open_pairs(own, 80).collect()] == [(7, 9)]
