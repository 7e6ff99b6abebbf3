"""Compare a Spark result with a DuckDB result: names, row count and values regardless of order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(x: object) -> object:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_cell(x) for x in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((x is None, str(x)) for x in row))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)[:20]} != {sorted(want.columns)[:20]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for c in got.columns:
        a, b = got[c].dtype.kind, want[c].dtype.kind
        if a != b and {a, b} != {"i", "u"}:
            return f"column {c}: {got[c].dtype} != {want[c].dtype}"
    wrong = [(g, w) for g, w in zip(_rows(got), _rows(want)) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0][0][:12]} != {wrong[0][1][:12]}" if wrong else None
