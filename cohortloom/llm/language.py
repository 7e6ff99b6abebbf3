"""Language identification by compression with per-language zstandard raw-content dictionaries.

Every language known from the learning rows gets a dictionary of raw text. A text is cut into
windows of ``WINDOW`` bytes, each is compressed with every dictionary, and the language with
the smallest sum wins. Windows keep a dictionary relevant in a long text, whose own beginning
would else serve all languages alike. A narrow margin between best and second is a rejection.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected;
repeated rows get equal rows; ties go to the language that sorts first, with margin 0 (rejected);
without any learning row every text is ``und``. Extra columns pass through ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import free_name, held_out, learnt_from, read_table, ready, sample_by_hash

#: Bytes of text compressed at once.
WINDOW = 2048
#: Learning rows of each language, and characters taken of each: a bound of the fit, not of the scoring.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 800
#: Bytes of a dictionary.
DICTIONARY = 1 << 14
#: Below this share of the best size, and below so many bytes, the margin is narrow.
MARGIN, MARGIN_BYTES = 0.004, 2
#: Matches from four bytes on, looked for lazily: short words count, at a third of the cost of optimal parsing.
PARAMETERS = {
    "window_log": 17,
    "chain_log": 15,
    "hash_log": 15,
    "search_log": 2,
    "min_match": 4,
    "target_length": 16,
    "strategy": zstandard.STRATEGY_LAZY,
    "write_content_size": 0,
    "write_checksum": 0,
    "write_dict_id": 0,
}
#: Only letters and bytes over 127 are evidence; the rest becomes a blank.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def learn(rows: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary for each non-null ``lang`` of ``rows`` (doc_id, text, lang); of bounded size."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = sample_by_hash(known.select("doc_id", "text", "lang"), "lang", SAMPLE_ROWS)
    # A slice of each row at a hashed place, and the rows in hashed order: no beginnings, no run of ids.
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    cut = F.substr(F.col("text"), (place + 1).cast("int"), F.lit(SAMPLE_CHARS))
    order = F.xxhash64("doc_id", F.lit("order"))
    texts: dict[str, list[tuple]] = {}
    for r in sample.select("lang", order.alias("order"), cut.alias("text")).collect():
        texts.setdefault(r["lang"], []).append((r["order"], r["text"]))
    return {
        lang: b" ".join(_letters(t) for _, t in sorted(own))[-DICTIONARY:] for lang, own in sorted(texts.items())
    }


def _letters(text: str) -> bytes:
    """The lower-cased words, one blank between them."""
    return b" ".join(text.lower().encode().translate(LETTERS).split())


class _Coder:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=parameters))

    def sizes(self, text: str) -> list[int]:
        data = _letters(text)
        windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
        return [sum(len(c.compress(w)) for w in windows) for c in self.coders]

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether it is rejected."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        if len(order) == 1:
            return self.langs[0], 1.0, False
        lead = sizes[order[1]] - best
        narrow = lead < MARGIN_BYTES or lead < MARGIN * best
        score = 1.0 / sum(2.0 ** -min(60, s - best) for s in sizes)
        return self.langs[order[0]], score, narrow


#: Columns of a decision.
DECISION = ("lang_pred", "lang_score", "lang_rejected")


def identify(docs: DataFrame, dictionaries: dict[str, bytes], names: tuple[str, str, str] = DECISION) -> DataFrame:
    """``docs`` with the decision in columns ``names``, which replace columns of these names; the others pass through."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(dictionaries)  # DICTIONARY bytes for each language
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(shared.value)
        for batch in batches:
            found = [coder.decide(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    kinds = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "boolean"), strict=True))
    return kept.mapInArrow(decide, f"{fields}, {kinds}")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = learn(docs.where(learnt_from(F.col("doc_id"), 5, 0)))
    return identify(docs.select("doc_id", "text"), dictionaries).select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is not rejected, with the columns of ``docs``."""
    dictionaries = learn(docs.select("doc_id", "text", "lang"))
    names = tuple(free_name(docs, n) for n in DECISION)
    return identify(docs, dictionaries, names).where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
