"""Line de-duplication and decontamination against brute force, with nulls, ties, empty texts and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from cohortloom.llm import decontamination, lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, removed string"


def _sentence(seed: int, n: int = 24) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(4000)}" for _ in range(n))


def _changed(line: str, at: int) -> str:
    words = line.split(" ")
    words[at] = "other"
    return " ".join(words)


A, B, C = _sentence(1), _sentence(2, 40), _sentence(3, 60)
TEXTS = [
    (1, f"{A}\nshort line\n{B}"),
    (2, f"{A.upper()}\nshort line\n{_changed(B, 39)}\n{_sentence(4)}"),
    (3, None),
    (4, ""),
    (5, "\n\n \t\n"),
    (6, f"{B}\n{B}\n{_sentence(5)}"),
    (7, f"{C}\n" + "\n".join(_sentence(100 + k, 12) for k in range(300))),
    (8, f"{_changed(C, 0)}\n{_changed(C, 59)}\n{_changed(_changed(C, 0), 59)}"),
    (8, f"{_changed(C, 0)}\n{_changed(C, 59)}\n{_changed(_changed(C, 0), 59)}"),
    (9, A),
    (None, f"{A}\n{_sentence(6)}"),
    *[(20 + k, f"{_sentence(7)}\n{_sentence(200 + k)}") for k in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def _line_sets(text: str | None) -> list[frozenset]:
    out = []
    for line in (text or "").split("\n"):
        words = [w.lower() for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
        runs = range(len(words) - lines.SHINGLE + 1)
        out.append(frozenset(tuple(words[k : k + lines.SHINGLE]) for k in runs))
    return out


def _removed() -> dict[tuple, list[int]]:
    """Numbers of the lines that go, by (id, text), from a comparison of all lines with all earlier ones."""
    found: dict[tuple, list[int]] = {}
    # Repeated rows are one row; null ids come last.
    rows = sorted(set(TEXTS), key=lambda row: (row[0] is None, row[0] or 0))
    before: list[frozenset] = []
    for key in rows:
        for number, own in enumerate(_line_sets(key[1])):
            if own and any(100 * len(own & other) >= lines.PERCENT * len(own | other) for other in before):
                found.setdefault(key, []).append(number)
            if own:
                before.append(own)
    return found


def test_removed_lines(docs):
    got = lines.removed_lines(docs.select("doc_id", "text")).collect()
    assert Counter((r.doc_id, tuple(r.removed)) for r in got) == Counter((i, tuple(n)) for (i, _), n in _removed().items())


def test_lines_are_sets_of_words(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [
        (1, f"All rights reserved.\n{long}\nyes"),
        # A copy of few words, nine of ten words in another order, a word said twice, four words of five.
        (2, f"ALL rights  reserved.\n{long.replace('one ', '')} other\n{' '.join(reversed(long.split()[1:]))}\nyes yes\nno\na b c d e"),
        (3, "a b c d\nyes no\nrights\n \nall rights reserved. now"),
    ]
    got = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets, want = [], {}
    for i, text in rows:
        for number, line in enumerate(text.split("\n")):
            own = set(line.lower().split())
            if own and any(len(own & other) >= 0.8 * len(own | other) for other in sets):
                want.setdefault(i, []).append(number)
            sets += [own] if own else []
    assert want == {2: [0, 1, 2, 3], 3: [0]}
    assert {r.doc_id: list(r.removed) for r in got} == want


def test_line_stage(spark, docs):
    got = lines.line_stage(spark, docs, "")
    assert got.columns == docs.columns
    gone, want = _removed(), []
    for i, text in TEXTS:
        left = None if text is None else [s for k, s in enumerate(text.split("\n")) if k not in gone.get((i, text), [])]
        if (i, text) in gone and not "".join(left).strip():
            continue
        want.append((i, None if left is None else "\n".join(left)))
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.removed == "extra" for r in rows)


def test_lines_of_empty_tables(spark, docs):
    assert lines.removed_lines(docs.limit(0)).count() == 0
    assert lines.line_stage(spark, docs.where("text is null or text = ''"), "").count() == 2


ITEM = [f"t{k}" for k in range(40)]
ITEMS = [(1, " ".join(ITEM)), (2, "too short an item"), (3, None), (4, " ".join(ITEM)), (5, _sentence(8, 30))]
LEAKS = {
    1: "before " + " ".join(ITEM) + " after",
    # In another order: the tiles still cover the item.
    2: " ".join([*ITEM[20:], "between", *ITEM[:20]]),
    3: "x " + " ".join(ITEM[:19]) + " y",
    4: "x " + " ".join(ITEM[:20]) + " y",
    # One passage twice counts once.
    5: " ".join([*ITEM[:15], "z", *ITEM[:15]]),
    6: None,
    7: "",
    8: " ".join(w for k in range(10) for w in [*ITEM[4 * k : 4 * k + 4], "cut"]),
    9: (_sentence(9, 20_000) + " " + _sentence(8, 30).upper().replace(" ", ", ")),
    10: _sentence(10, 300),
}


def _tiled(doc: list[str], item: list[str]) -> int:
    """Greedy string tiling as published: mark the longest unmarked common run until none is long enough."""
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while (
                    j + n < len(item)
                    and p + n < len(doc)
                    and doc[p + n] == item[j + n]
                    and not in_doc[p + n]
                    and not in_item[j + n]
                ):
                    n += 1
                best = max(best, (n, -p, -j))
        n, p, j = best[0], -best[1], -best[2]
        if n < decontamination.SEED:
            return sum(in_item)
        in_doc[p : p + n] = [True] * n
        in_item[j : j + n] = [True] * n


def _tokens(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_contaminated(spark):
    docs = spark.createDataFrame([*LEAKS.items(), (1, LEAKS[1]), (None, LEAKS[1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = set()
    for i, text in [*LEAKS.items(), (None, LEAKS[1])]:
        # The long text has one passage of the benchmark, at its end.
        doc = _tokens(text)[-200:]
        covered = {k: _tiled(doc, _tokens(t)) / len(_tokens(t)) for k, t in ITEMS if len(_tokens(t)) >= decontamination.SEED}
        hit = {k: c for k, c in covered.items() if c >= decontamination.COVERAGE}
        if hit:
            best = min(hit, key=lambda k: (-hit[k], k))
            want.add((i, len(hit), best, round(hit[best], 9)))
    got = {(r.doc_id, r["items"], r.best_item, round(r.coverage, 9)) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == want
    assert {i for i, *_ in got} == {1, 2, 4, 9, None}


def test_tiles_are_those_of_the_published_procedure():
    draw = random.Random(5)
    for _ in range(60):
        doc = [draw.choice("abc") for _ in range(draw.randrange(5, 40))]
        item = [draw.choice("abc") for _ in range(draw.randrange(5, 30))]
        rows, want = [], _tiled(doc, item)
        import pyarrow as pa

        for words in (doc, item):
            rows.append(next(decontamination._seeds(pa.array([" ".join(words)])))[1].view("int64"))
        shared = [k for k, s in enumerate(rows[0]) if s in set(rows[1])]
        if not shared:
            assert want == 0
            continue
        import numpy as np

        got = decontamination.tiled(np.array(shared, np.int64), rows[0][shared], rows[1])
        # Equal lengths may be marked in another order, which can move a tile by a few tokens.
        assert abs(got - want) <= 2 * decontamination.SEED
        assert got >= decontamination.SEED


def test_decontamination_stage_keeps_clean_documents(spark, tmp_path):
    rows = [(i, t, "en", "s", 0 if t is None else len(t), "extra") for i, t in LEAKS.items()]
    docs = spark.createDataFrame(rows, SCHEMA.replace("removed", "item_id"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontamination.decontamination_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [3, 5, 6, 7, 8, 10]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs.select("doc_id", "text"), none).count() == 0
    assert decontamination.contaminated(docs.select("doc_id", "text").limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_removed_lines_do_not_depend_on_slices_or_hot_cells(spark, monkeypatch):
    docs = spark.range(60).selectExpr(
        "id as doc_id",
        "concat('the common words of a line that many share ', id % 7, '\\n', 'page ', id, ' of nine views in a row', '\\n', 'own ', id * 977) as text",
    )
    found = []
    # All cells hot, none hot; one slice, several.
    for hot, parts, slices in ((1 << 20, 3, 1), (0, 64, 3)):
        monkeypatch.setattr(lines, "HOT", hot)
        monkeypatch.setattr(lines, "PARTS", parts)
        monkeypatch.setattr(lines, "SLICES", slices)
        found.append(sorted((r.doc_id, tuple(r.removed)) for r in lines.removed_lines(docs).collect()))
    assert found[0] == found[1] != []


def test_long_lines_of_a_common_vocabulary_make_no_pairs(spark, monkeypatch):
    """Lines of 200 of 400 words differ in about 200: 64 bits leave every pair open, the bits at the meeting do not."""
    draw, words = random.Random(3), [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(draw.sample(words, 200))) for k in range(60)]
    rows.append((60, rows[7][1] + " another"))  # similar to an earlier one
    written: dict[str, int] = {}
    stored = lines.materialize

    def counted(df, name):
        out = stored(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    removed = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.removed) for r in removed.collect()] == [(60, [0])]
    assert written["slice"] <= 10
