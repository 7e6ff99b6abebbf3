"""Many penalised logistic models over one table, all fitted at once.

A search over penalties in k folds needs one model for each candidate and fold. They read the same rows, so
all their coefficients are the columns of one matrix here: a pass over the rows gives the losses and gradients
of all models, as two matrix products a block of rows. The partial sums of the tasks are added in two levels, so
the driver gets about the square root of the number of tasks, each models x features numbers.

Rows are packed once into blocks of one fold, as dense matrices in Parquet. They are compressed column by column, since
a pass costs less to unpack a block than to hand it over whole. A model leaves out its own fold by leaving out blocks.
The driver keeps a limited-memory quasi-Newton state for each model. It starts from the upper bound of the curvature, a
quarter of the second moments plus the penalty, which all models share but for the penalty: one eigendecomposition
serves all, and badly scaled features cost no more passes than good ones.
Models that have converged leave the passes. Those still open after ``REFRESH`` passes (weak penalties on rows that a
plane separates, where the bound is far too high) start anew from their own curvature, taken in one more pass, as many
at a time as ``CURVATURE`` numbers hold.
"""

from __future__ import annotations

import math
import sys
import warnings
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import materialize

# Executors get the mappers by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a block's matrix: bounds what a task holds at a time.
BLOCK_BYTES = 4 << 20
#: A Parquet file of blocks is cut after each few of them. Spark reads a group of rows at a time, and Parquet looks at a
#: group's and a page's size after 100 rows if not told otherwise: that is 400 MB of blocks.
FEW_BLOCKS = {
    "parquet.block.size": 2 * BLOCK_BYTES,
    "parquet.block.size.row.check.min": 1,
    "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
    "parquet.enable.dictionary": "false",
}
#: Bytes that a task's JVM and its Python worker hand over at once, and the setting for it.
HANDED, HANDED_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
CODEC = "lz4_raw"
#: Bytes of matrices a task passes over at least, where there are as many.
TASK_BYTES = 16 << 20
#: Numbers of a piece of a task's totals, 1 MB, which are summed piece by piece.
PIECE = 1 << 17
#: Steps the quasi-Newton state remembers.
MEMORY = 12
#: Models that are multiplied at once: bounds a block's scores in a task.
WIDE = 512
#: Passes between looks at the curvature of open models, and the numbers that such a look may hold (64 MB).
REFRESH, CURVATURE = 10, 1 << 23
NO_FOLD = -1


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside hand over ``HANDED`` bytes at a time, or one row."""
    before = spark.conf.get(HANDED_SETTING, None)
    spark.conf.set(HANDED_SETTING, HANDED)
    try:
        yield
    finally:
        spark.conf.unset(HANDED_SETTING) if before is None else spark.conf.set(HANDED_SETTING, before)


@dataclass
class Blocks:
    """Packed rows: (fold, n, x, y) with the constant 1 as the last feature; ``x`` is column by column under a ``codec``, else row by row."""

    table: DataFrame
    size: int
    folds: int
    rows: np.ndarray  # rows of each fold
    parts: int
    codec: str | None = None


def pack(df: DataFrame, folds: int = 0, fold: str = "fold", features: str = "features", label: str = "label") -> Blocks:
    """Pack (label, features[, fold]) once; ``features`` is a vector or an array without nulls.

    With ``folds`` = 0 all rows are of no fold and no model leaves any out. A missing or infinite feature and a
    label other than 0 and 1 are errors.
    """
    kind = df.schema[features].dataType.typeName()
    x = F.col(features).cast("array<double>") if kind == "array" else vector_to_array(F.col(features))
    number = F.col(fold).cast("int") if folds else F.lit(NO_FOLD)
    rows = df.select(number.alias("fold"), F.col(label).cast("double").alias("y"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def out(k: int) -> pa.RecordBatch:
            xs, ys = (np.concatenate(p) for p in zip(*held.pop(k), strict=True))
            n = count.pop(k)
            columns = [pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([xs.shape[1]], pa.int32())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([pa.compress(xs.tobytes("F"), CODEC, asbytes=True)], pa.binary()), pa.array([ys.tobytes()], pa.binary())],
                names=["fold", "n", "size", "x", "y"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            y, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "fold"))
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
            if len(flat) % len(y):
                raise ValueError("a feature is missing or infinite, or rows have different numbers of features")
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("a label is neither 0 nor 1")
            rows = flat.reshape(len(y), -1)
            most = max(BLOCK_BYTES // (8 * (rows.shape[1] + 1)), 1)
            # Rows are copied a block at a time, never the whole batch.
            for k in np.unique(own).astype(int).tolist():
                mine = np.flatnonzero(own == k)
                for low in range(0, len(mine), most):
                    some = mine[low : low + most]
                    x = np.hstack([rows[some], np.ones((len(some), 1))])
                    if not np.isfinite(x).all():
                        raise ValueError("a feature is missing or infinite, or rows have different numbers of features")
                    held.setdefault(k, []).append((x, y[some]))
                    count[k] = count.get(k, 0) + len(some)
                    if count[k] >= most:
                        yield out(k)
        for k in list(held):
            yield out(k)

    with _small_batches(df.sparkSession):
        table = materialize(rows.mapInArrow(run, "fold int, n long, size int, x binary, y binary"), "blocks", **FEW_BLOCKS)
    found = table.groupBy("fold", "size").agg(F.sum("n").alias("n")).collect()
    sizes = {r["size"] for r in found}
    if len(sizes) > 1:
        raise ValueError("rows have different numbers of features")
    per_fold = np.zeros(max(folds, 1), np.int64)
    for r in found:
        per_fold[max(r["fold"], 0)] = r["n"]
    size = sizes.pop() if sizes else 1
    # A task for every TASK_BYTES: a small table needs no second level of sums.
    parts = min(max(table.rdd.getNumPartitions(), 1), int(per_fold.sum()) * size * 8 // TASK_BYTES + 1)
    return Blocks(table.coalesce(parts), size, folds, per_fold, parts, CODEC)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, codec: str | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for fold, n, x, y in zip(*(batch.column(c) for c in ("fold", "n", "x", "y")), strict=True):
            # One block is unpacked at a time.
            shape, matrix = (n.as_py(), size), x.as_buffer()
            if codec:
                matrix = pa.decompress(matrix, 8 * math.prod(shape), codec)
            yield fold.as_py(), np.frombuffer(matrix).reshape(shape, order="F" if codec else "C"), np.frombuffer(y.as_buffer())


def _summed(blocks: Blocks, shape: tuple[int, ...], add: Callable[[np.ndarray, int, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """``add(total, fold, x, y)`` over all blocks: a sum in each task, then over groups of tasks, then on the driver.

    Totals travel in pieces of ``PIECE`` numbers, each summed by itself, so that no task holds several tasks' whole totals;
    those of several pieces are summed over the groups as well, so that the driver gets each piece once.
    """
    groups, size = math.isqrt(blocks.parts - 1) + 1, math.prod(shape)
    width, codec = blocks.size, blocks.codec

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for fold, x, y in _blocks(batches, width, codec):
            add(total, fold, x, y)
        total, group = total.ravel(), TaskContext.get().partitionId() % groups
        for at in range(0, size, PIECE):
            arrays = [pa.array([group], pa.int32()), pa.array([at // PIECE], pa.int32()), pa.array([total[at : at + PIECE].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "piece", "total"])

    def join(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t) for t in table.column("total").to_pylist())
        return table.select(["part", "piece"]).slice(0, 1).append_column("total", pa.array([total.tobytes()], pa.binary()))

    schema = "part int, piece int, total binary"
    sums = blocks.table.select("fold", "n", "x", "y").mapInArrow(partial, schema)
    if blocks.parts > 1:
        sums = sums.groupBy("part", "piece").applyInArrow(join, schema)
        if size > PIECE:
            sums = sums.groupBy("piece").applyInArrow(join, schema)
    out = np.zeros(size)
    with _small_batches(blocks.table.sparkSession):
        found = sums.collect()
    for r in found:
        at = r["piece"] * PIECE
        out[at : at + PIECE] += np.frombuffer(r["total"])
    return out.reshape(shape)


@dataclass
class Fits:
    """Coefficients (models x features, the constant last) with the strength and left-out fold of each model."""

    weights: np.ndarray
    c: np.ndarray
    left_out: np.ndarray
    converged: np.ndarray
    gradient: np.ndarray  # largest component at the end
    passes: int


def fit_many(
    blocks: Blocks,
    c: Sequence[float],
    left_out: Sequence[int],
    penalised_intercept: bool = False,
    tol: float = 1e-9,
    max_passes: int = 300,
) -> Fits:
    """Model m minimises ``|w|^2 / (2 c[m])`` plus the summed losses of all rows outside fold ``left_out[m]``.

    ``NO_FOLD`` leaves nothing out. The constant's weight is penalised only with ``penalised_intercept``.
    """
    c, left_out = np.array(c, float), np.array(left_out, np.int64)
    m, d = len(c), blocks.size
    penalty = np.repeat(1.0 / c[:, None], d, axis=1)
    if not penalised_intercept:
        penalty[:, -1] = 0.0

    def squares(total: np.ndarray, fold: int, x: np.ndarray, y: np.ndarray) -> None:
        total += x.T @ x

    values, basis = np.linalg.eigh(_summed(blocks, (d, d), squares))
    n = max(int(blocks.rows.sum()), 1)
    share = 1.0 - np.array([blocks.rows[k] if k != NO_FOLD else 0 for k in left_out], float) / n
    curve = 0.25 * share[:, None] * np.maximum(values, 0.0)[None, :] + 1.0 / c[:, None]

    def losses(weights: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = left_out[which]

        def add(total: np.ndarray, fold: int, x: np.ndarray, y: np.ndarray) -> None:
            sign = 2.0 * y - 1.0
            use = np.flatnonzero((out != fold) | (out == NO_FOLD))
            for low in range(0, len(use), WIDE):
                some = use[low : low + WIDE]
                margin = sign[:, None] * (x @ weights[some].T)
                total[some, 0] += np.logaddexp(0.0, -margin).sum(axis=0)
                pull = -sign[:, None] * np.exp(-np.logaddexp(0.0, margin))
                total[some, 1:] += pull.T @ x

        total = _summed(blocks, (len(which), d + 1), add)
        f = total[:, 0] + 0.5 * (penalty[which] * weights**2).sum(axis=1)
        return f, total[:, 1:] + penalty[which] * weights

    own: dict[int, np.ndarray] = {}  # inverse curvature of models that needed it

    def bounded(r: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = ((r @ basis) / curve[which]) @ basis.T
        for k, model in enumerate(which.tolist()):
            if model in own:
                out[k] = own[model] @ r[k]
        return out

    def curvatures(which: np.ndarray) -> np.ndarray:
        out = left_out[which]

        def add(total: np.ndarray, fold: int, x: np.ndarray, y: np.ndarray) -> None:
            for k in np.flatnonzero((out != fold) | (out == NO_FOLD)):
                half = np.exp(-np.abs(x @ weights[which[k]]) / 2)
                # A matrix by itself: half the work of two different ones.
                scaled = x * (half / (1.0 + half * half))[:, None]
                total[k] += scaled.T @ scaled

        return _summed(blocks, (len(which), d, d), add)

    weights, f, g = np.zeros((m, d)), np.full(m, np.inf), np.zeros((m, d))
    step, move = np.ones(m), np.zeros((m, d))
    s, y = np.zeros((m, MEMORY, d)), np.zeros((m, MEMORY, d))
    known = np.zeros(m, np.int64)
    done, last_look = np.zeros(m, bool), np.zeros(m, np.int64)
    passes, looked = 0, 0
    while not done.all() and passes < max_passes:
        if passes - looked >= REFRESH:
            # Those that were looked at longest ago come first.
            still = sorted(np.flatnonzero(~done).tolist(), key=lambda k: last_look[k])[: max(CURVATURE // (d * d), 1)]
            now = np.array(still)
            for model, seen in zip(still, curvatures(now), strict=True):
                seen[np.diag_indices(d)] += penalty[model] + 1e-10 * np.trace(seen) / d + 1e-12
                own[model] = np.linalg.inv(seen)
            while len(own) * d * d > max(CURVATURE, d * d):
                del own[next(k for k in own if k not in still)]
            known[now], last_look[now], looked, step[now] = 0, passes, passes, 1.0
            passes += 1
            move[now] = -bounded(g[now], now)
        which = np.flatnonzero(~done)
        trial = weights[which] + step[which, None] * move[which]
        f_new, g_new = losses(trial, which)
        passes += 1
        slope = (g[which] * move[which]).sum(axis=1)
        first = np.isinf(f[which])
        slack = 1e-13 * (np.abs(np.where(first, 0.0, f[which])) + 1.0)
        good = first | (f_new <= np.where(first, 0.0, f[which]) + 1e-4 * step[which] * slope + slack)
        step[which[~good]] *= 0.5
        # Steps too short to change anything: what is there is the optimum within rounding.
        done[which[~good]] = step[which[~good]] < 1e-12
        taken, at = which[good], np.flatnonzero(good)
        change, turn = trial[at] - weights[taken], g_new[at] - g[taken]
        keep = ~first[at] & ((change * turn).sum(axis=1) > 1e-300)
        for k, model in zip(np.flatnonzero(keep), taken[keep], strict=True):
            s[model] = np.roll(s[model], -1, axis=0)
            y[model] = np.roll(y[model], -1, axis=0)
            s[model, -1], y[model, -1] = change[k], turn[k]
            known[model] = min(known[model] + 1, MEMORY)
        weights[taken], f[taken], g[taken] = trial[at], f_new[at], g_new[at]
        near = np.abs(bounded(g[taken], taken)).max(axis=1) <= tol * (1.0 + np.abs(weights[taken]).max(axis=1))
        done[taken] = near
        move[taken] = -_direction(g[taken], s[taken], y[taken], known[taken], lambda r: bounded(r, taken))
        step[taken] = 1.0
    if not done.all():
        warnings.warn(f"{int((~done).sum())} of {m} models have not converged in {passes} passes", stacklevel=2)
    return Fits(weights, c, left_out, done, np.abs(g).max(axis=1, initial=0.0), passes)


def _direction(g, s, y, known, start):
    """Two-loop product of the inverse curvature with ``g``, for all models side by side."""
    q = g.copy()
    alpha = np.zeros((MEMORY, len(g)))
    inner = (s * y).sum(axis=2)
    for k in range(MEMORY - 1, -1, -1):
        use = known >= MEMORY - k
        rho = np.where(use, 1.0 / np.where(use, inner[:, k], 1.0), 0.0)
        alpha[k] = rho * (s[:, k] * q).sum(axis=1)
        q -= alpha[k][:, None] * y[:, k]
    r = start(q)
    for k in range(MEMORY):
        use = known >= MEMORY - k
        rho = np.where(use, 1.0 / np.where(use, inner[:, k], 1.0), 0.0)
        beta = rho * (y[:, k] * r).sum(axis=1)
        r += np.where(use, alpha[k] - beta, 0.0)[:, None] * s[:, k]
    return r


def held_out_counts(blocks: Blocks, fits: Fits) -> np.ndarray:
    """(models, 4): true positives, false positives, false negatives and true negatives on each model's own fold."""
    weights, out = fits.weights, fits.left_out

    def add(total: np.ndarray, fold: int, x: np.ndarray, y: np.ndarray) -> None:
        mine = np.flatnonzero(out == fold)
        for low in range(0, len(mine), WIDE):
            some = mine[low : low + WIDE]
            yes, true = x @ weights[some].T >= 0.0, (y == 1.0)[:, None]
            for k, cell in enumerate((yes & true, yes & ~true, ~yes & true, ~yes & ~true)):
                total[some, k] += cell.sum(axis=0)

    return _summed(blocks, (len(weights), 4), add)


def cross_validated_f1(blocks: Blocks, c: Sequence[float], penalised_intercept: bool = False, tol: float = 1e-4) -> list[float]:
    """Mean F1 over the folds of each strength: all strengths and folds are fitted at once.

    A fold without a positive row and without a positive decision counts zero. ``tol`` is that of a
    search; a smaller one gives the same decisions but for rows at 0.5.
    """
    grid = [(x, k) for x in c for k in range(blocks.folds)]
    fits = fit_many(blocks, [x for x, _ in grid], [k for _, k in grid], penalised_intercept, tol)
    tp, fp, fn, _ = held_out_counts(blocks, fits).T
    f1 = np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)
    return f1.reshape(len(c), blocks.folds).mean(axis=1).tolist()


def score_column(weights: Sequence[float], features: str = "features", array: bool = False):
    """Probability of class 1 of one fitted model, as an expression."""
    x = F.col(features).cast("array<double>") if array else vector_to_array(F.col(features))
    w = F.array(*[F.lit(float(v)) for v in weights[:-1]])
    z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(weights[-1])), lambda total, v: total + v)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
