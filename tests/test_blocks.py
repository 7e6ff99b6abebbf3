"""Packed blocks are read and handed over a few at a time, whatever the table's size."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortloom.operators import many_logistic
from cohortloom.session import materialize


def test_a_group_of_rows_holds_few_blocks(spark, monkeypatch):
    """Before, Parquet cut a file after 100 blocks at the earliest, which a task's reader and writer held at once."""
    monkeypatch.setattr(many_logistic, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(many_logistic, "FEW_BLOCKS", {**many_logistic.FEW_BLOCKS, "parquet.block.size": 2 << 16}, raising=False)
    x = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda k: F.xxhash64(F.col("id"), k).cast("double"))
    rows = spark.range(4096, numPartitions=1).select((F.col("id") % 2).cast("double").alias("label"), x.alias("features"), (F.col("id") % 3).cast("int").alias("fold"))
    blocks = many_logistic.pack(materialize(rows.coalesce(1)), 3)
    files = [Path(f.removeprefix("file:")) for f in blocks.table.inputFiles()]
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in files for k in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 4096 * 64 * 8 // (1 << 16)
    assert max(g.num_rows for g in groups) <= 3
    assert blocks.rows.tolist() == [1366, 1365, 1365]


def test_totals_over_packed_rows(spark):
    """The sums are those of the rows themselves, and the session's setting is as before."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(500, 7)), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(float(b), a.tolist(), int(k % 2)) for k, (a, b) in enumerate(zip(x, y))], "label double, features array<double>, fold int")
    before = spark.conf.get(many_logistic.HANDED_SETTING, None)
    blocks = many_logistic.pack(rows.repartition(3), 2)

    def add(total, fold, a, b):
        if fold == 1:
            total += (a * b[:, None]).sum(axis=0)

    want = np.append((x * y[:, None])[1::2].sum(axis=0), y[1::2].sum())
    assert np.allclose(many_logistic._summed(blocks, (8,), add), want)
    assert spark.conf.get(many_logistic.HANDED_SETTING, None) == before
