"""Personal data with offset-preserving deobfuscation.

Base detection works on the text as it is. Then a chain of transducers rewrites a copy:
look-alike characters to ASCII, spelled digits to digits, at and dot disguises to ``@`` and
``.``. Each keeps a tape of (normalised span, source span), so that what the same detectors
find in the rewritten copy is mapped back through the chain to code points of the source. A
mapped span counts if a rewriting took part in it and no base span of its kind overlaps it.

Defined results: a null text is an empty one and has no spans; repeated rows get equal rows;
extra columns are ignored. All patterns are linear in the text: no repetition can restart
inside a run that it has already read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import read_table, ready

KINDS = ("email", "ip", "card", "phone")

# ---- detectors on one text -------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match of these can't begin inside a run of digits, so looking behind spares the attempts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each ``@`` with a domain, from the last match on."""
    free = 0
    for at in _DOMAIN.finditer(text):
        p = at.start()
        low = max(free, text.rfind("@", free, p) + 1)
        run = p - low - len(text[low:p].rstrip(_LOCAL))
        if run:
            free = at.end()
            yield p - run, free


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans, by start and then kind."""
    found = [Span(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append(Span(m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append(Span(m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(Span(m.start(), 3, m.end()))
    return sorted(found)


# ---- transducers -----------------------------------------------------------------------------


class Tape:
    """A rewritten text and, piece by piece, where it comes from."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.src, self.copied = [], [], [], []
        done = here = 0
        for start, end, new in [*edits, (len(source), len(source), "")]:
            for a, b, piece, copied in ((done, start, source[done:start], True), (start, end, new, False)):
                if piece:
                    self.at.append(here)
                    self.src.append((a, b))
                    self.copied.append(copied)
                    parts.append(piece)
                    here += len(piece)
            done = end
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the rewritten text, and whether a rewriting took part in it."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        low = self.src[i][0] + (start - self.at[i] if self.copied[i] else 0)
        high = self.src[j][0] + (end - self.at[j]) if self.copied[j] else self.src[j][1]
        # Between two copied pieces something was rewritten or left out.
        return low, high, j > i or not self.copied[i]


# Letters of other scripts that look like ASCII ones, and marks that look like ASCII marks.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "﹘": "-", "․": ".", "。": ".", "｡": ".", "﹒": ".", "•": ".", "·": ".", "﹫": "@", "﹢": "+", "⁺": "+",
}
#: Scripts and forms where such characters are found, and the marks without width.
_STRANGE = re.compile(
    "[­ ·²³¹ıɑɡͰ-ԯ٠-٩۰-۹०-९"
    " -‏‐-―•-․‪-  -⁤⁰-₎Ⅰ-ⅿ−①-⓿"
    "❶-➓　。︀-️﹒-﹫﻿！-｡\U0001d400-\U0001d7ff\U0001f100-\U0001f10a]"
)


def _plain(c: str) -> str:
    """The ASCII form of one character; nothing for one without width; itself if it has none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) in ("Cf", "Mn"):
        return ""
    if unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() else c


def _homoglyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _STRANGE.finditer(text) if (new := _plain(m[0])) != m[0]]


# The digits as words.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
}
_SPELLED = re.compile(rf"(?<!\w)(?:{'|'.join(SPELLED)})(?!\w)", re.IGNORECASE)
_PLUS = re.compile(r"(?<!\w)plus ?(?=[0-9(])", re.IGNORECASE)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI](?=[0-9])")


def _spelled_digits(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in SPELLED):
        return []
    return [(m.start(), m.end(), str(SPELLED[m[0].lower()])) for m in _SPELLED.finditer(text) if m[0].lower() in SPELLED]


def _signs_and_letters(text: str) -> list[tuple[int, int, str]]:
    """``plus`` before a digit, and O, o, l, I between digits."""
    if not _DIGIT.search(text):
        return []
    edits = [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    edits += [(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGIT.finditer(text)]
    return sorted(edits)


_BRACKETED = re.compile(r"[\[({<]\s{0,3}(at|dot|@|\.)\s{0,3}[\])}>]", re.IGNORECASE)
_BARE_AT = re.compile(
    r"(?<=[A-Za-z0-9._%+-])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]++(?:\s{1,3}dot\s{1,3}[A-Za-z0-9-]++)+|[A-Za-z0-9-]++\s{0,3}[\[({<]\s{0,3}(?:dot|\.)\s{0,3}[\])}>])",
    re.IGNORECASE,
)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.IGNORECASE)


def _at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """``[at]``, ``(dot)`` with the blanks about them; bare ``at`` where a disguised domain follows; bare ``dot``."""
    edits = []
    for m in _BRACKETED.finditer(text):
        start, end = m.start(), m.end()
        while start > 0 and m.start() - start < 3 and text[start - 1].isspace():
            start -= 1
        while end < len(text) and end - m.end() < 3 and text[end].isspace():
            end += 1
        edits.append((start, end, "@" if m[1].lower() in ("at", "@") else "."))
    low = text.lower()
    if "dot" in low:
        edits += [(m.start(), m.end(), ".") for m in _BARE_DOT.finditer(text)]
        edits += [(m.start(), m.end(), "@") for m in _BARE_AT.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


CHAIN: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (_homoglyphs, _spelled_digits, _signs_and_letters, _at_and_dot)


def normalise(text: str) -> list[Tape]:
    """The tapes of the transducers that change something, in order."""
    tapes: list[Tape] = []
    for step in CHAIN:
        if edits := step(tapes[-1].text if tapes else text):
            tapes.append(Tape(tapes[-1].text if tapes else text, edits))
    return tapes


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only deobfuscation shows."""
    base = detect(text)
    tapes = normalise(text)
    added = []
    if tapes:
        taken = [[s for s in base if s.kind == k] for k in range(len(KINDS))]
        for start, kind, end in detect(tapes[-1].text):
            rewritten = False
            for tape in reversed(tapes):
                start, end, changed = tape.back(start, end)
                rewritten |= changed
            own = taken[kind]
            i = bisect_right(own, Span(end - 1, len(KINDS), 0))
            if rewritten and not (i and own[i - 1].end > start):
                added.append(Span(start, kind, end))
    return base, sorted(added)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


# ---- on a table ------------------------------------------------------------------------------

_SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, base, added): spans in code points, ends exclusive, by start and then kind."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in spans]

        for batch in batches:
            found = [find(t or "") for t in batch.column("text").to_pylist()]
            base, added = (pa.array([rows(f[k]) for f in found], _SPANS) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), base, added], names=["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    placed = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")),
    )

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.array_sort(placed)).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
