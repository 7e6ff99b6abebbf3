"""Text column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as true.
TRUE_WORDS = ("true", "1", "t", "yes")
# Suffixes of the summary statistics of a feature.
STAT_SUFFIX = r"_(sd|min|max|median)$"


def clean(x: Column) -> Column:
    """Trimmed lower-case text."""
    return F.lower(F.trim(x))


def title_case(x: Column) -> Column:
    """First letter of each word in upper case; space and hyphen start a word."""
    return F.array_join(F.transform(F.split(x, r"(?<=[\s-])"), F.initcap), "")


def name_token(name: Column, position: int, sep: str = "_") -> Column:
    """Token of a delimited name, counted from 0; null when there are fewer."""
    return F.get(F.split(name, sep), F.lit(position))


def strip_stat_suffix(name: Column) -> Column:
    """Feature name without its statistic."""
    return F.regexp_replace(name, STAT_SUFFIX, "")


def parse_bool(x: Column) -> Column:
    """True for one of ``TRUE_WORDS``; anything else, null included, is false."""
    return F.coalesce(F.lower(x.cast("string")).isin(*TRUE_WORDS), F.lit(False))


def observed_allele(allele: Column) -> Column:
    """Right side of an ``A>C`` call, else the trimmed text itself."""
    changed = F.regexp_extract(allele, r">([A-Za-z])$", 1)
    return F.coalesce(F.nullif(changed, F.lit("")), F.trim(allele))


def site_key(*parts: Column) -> Column:
    """Key of a site from its parts, joined by ``_``; null when a part is null."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit("_"))
        pieces.append(part.cast("string"))
    return F.concat(*pieces)


def fixed(x: Column, digits: int = 2) -> Column:
    """Number as text with a fixed count of decimals."""
    return F.format_string(f"%.{digits}f", x)


def map_values(x: Column, mapping: Mapping[str, object]) -> Column:
    """Dictionary lookup; a value that is not listed becomes null."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), x)
