"""Whitening of embeddings by refined eigenvectors.

Each entry c becomes the whole number floor(``SCALE`` * c) + ``SHIFT``. One pass gives exact
sums for each dimension, a second the covariance of the centred vectors; both leave a table
of a fixed number of rows for each task. On the driver, which holds a few matrices of
dimension by dimension, float32 eigenvectors are the start, and Ogita-Aishima steps (matrix
products only) in extended precision square the error each time. Eigenvalues closer than a
step can tell apart form clusters: inside one, the shifted matrix projected on the cluster is
solved anew, and steps go on. Each component's largest entry is positive.

Vectors that are null, empty, or hold null or non-finite entries are dropped, and so are
those whose length is not that of most vectors (of equally many: the longest). Entries beyond
2**52 after scaling count as that. Repeated rows and ids all stay. An empty table gives no
rows. A component without variance (fewer vectors than dimensions, constant dimensions) has a
null ``whitened`` and is left out of ``identity_error``. A ``deviation`` that does not fit a
long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalis.llm.frames import arrow_of, batch_of, id_type

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EDGE = float(1 << 52)
LOW_BITS = 26
STEPS = 40
ROWS_AT_ONCE = 4096
LONG = (1 << 63) - 1


def valid(vector: str) -> Column:
    """Vectors of finite entries."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their whole-number vectors; the vector column is last."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(k, ROWS_AT_ONCE)
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                yield batch, np.clip(np.floor(SCALE * flat), -EDGE, EDGE).astype(np.int64).reshape(batch.num_rows, -1) + SHIFT


def _sums(schema: pa.Schema):
    """Sums of each dimension, high and low bits apart, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for _, x in _blocks(batches):
            n, high, low = n + len(x), high + (x >> LOW_BITS).sum(axis=0), low + (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        if n:
            yield batch_of(schema, np.arange(len(high)), np.full(len(high), n), high, low)

    return run


def _products(held: Broadcast, schema: pa.Schema):
    """Upper triangle of the sum of outer products of the vectors that ``held`` makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, change = 0, held.value
        for _, x in _blocks(batches):
            y = change(x)
            total = total + y.T @ y
        if not isinstance(total, int):
            a, b = np.triu_indices(len(total))
            yield batch_of(schema, a, b, total[a, b])

    return run


@dataclass(frozen=True)
class Centred:
    """x - S / n, where whole parts of the mean are taken off before the rest."""

    whole: np.ndarray
    rest: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


@dataclass(frozen=True)
class Projected:
    """Centred vectors on components, each over the root of its eigenvalue."""

    centred: Centred
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.append(self.centred(x) @ self.axes, np.ones((len(x), 1)), axis=1)


def _total(rows: DataFrame, change, size: int) -> np.ndarray:
    ddl = "a int, b int, v double"
    held = rows.sparkSession.sparkContext.broadcast(change)  # a few vectors or one thin matrix
    found = rows.mapInArrow(_products(held, arrow_of(ddl)), ddl).groupBy("a", "b").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    a, b, v = (found.column(c).to_numpy() for c in "abv")
    out[a, b] = out[b, a] = v
    return out


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two and more sorted values, each within ``gap`` of the next."""
    order = np.argsort(-values, kind="stable")
    cut = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to the precision of a double.

    Starts from float32 eigenvectors. A step adds X E, where E comes from the error of
    orthogonality and the off-diagonal part of X' A X.
    """
    d = len(matrix)
    scale = np.abs(matrix).max() if d else 0
    if not scale:
        return np.zeros(d), np.eye(d)
    a = matrix.astype(np.longdouble) / np.longdouble(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    one, last, solved = np.eye(d, dtype=np.longdouble), np.inf, False
    norm = float(np.abs(a).sum(axis=0).max())
    least = 4 * np.finfo(float).eps * norm  # a matrix of doubles does not tell closer values apart
    for _ in range(STEPS):
        loose = one - x.T @ x
        near = x.T @ a @ x
        near = (near + near.T) / 2  # what rounding adds must not differ between the two halves
        value = np.diag(near) / (1 - np.diag(loose))
        off = near - np.diag(value)
        size = float(np.abs(off).sum(axis=0).max())
        gap = max(2 * (size + norm * float(np.abs(loose).sum(axis=0).max())), least)
        distance = value[None, :] - value[:, None]
        far = np.abs(distance) > gap
        step = np.where(far, (near + value[None, :] * loose) / np.where(far, distance, 1), loose / 2)
        x = x + x @ step
        error = float(np.abs(step).max())
        if error > last / 4 or error < 1e-18:
            close = _clusters(value, gap)
            if solved or not close:
                break
            for c in close:
                part = x[:, c].T @ ((a - value[c].mean() * one) @ x[:, c])
                x[:, c] = x[:, c] @ np.linalg.eigh((part / (np.abs(part).max() or 1)).astype(np.float64))[1].astype(np.longdouble)
            solved, last = True, np.inf
            continue
        last = error
    x = x + x @ (one - x.T @ x) / 2
    value = np.diag(x.T @ a @ x) / (x * x).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    x = (x / np.sqrt((x * x).sum(axis=0)))[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return (value[order] * np.longdouble(scale)).astype(np.float64), x.astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """What whitening rows needs: count, exact sums, centre, components with their variances and shares."""

    n: int
    sums: list[int]
    centred: Centred
    axes: np.ndarray
    value: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their variances; nan without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.value > 0, self.axes / np.sqrt(self.value), np.nan)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(i, v): rows whose vector is valid and as long as most."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).where(valid("v"))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return rows.where(F.size("v") == F.lit(length["d"] if length else 0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all of ``usable``'s rows; None without any."""
    vectors = rows.select("v")
    ddl = "d int, n long, high long, low long"
    sums = vectors.mapInArrow(_sums(arrow_of(ddl)), ddl).groupBy("d")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low")).collect()  # one row a dimension
    if not sums:
        return None
    n = sums[0]["n"]
    total = [(int(r["high"]) << LOW_BITS) + r["low"] for r in sorted(sums, key=lambda r: r["d"])]
    centred = Centred(np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total]))
    covariance = _total(vectors, centred, len(total)) / n
    value, axes = refined_eigen(covariance)
    value = np.where(value > len(total) * np.finfo(float).eps * max(value[0], 0), value, 0)[:components]
    axes, live = axes[:, :components], int((value > 0).sum())
    trace = np.trace(covariance)
    explained = value / trace if trace else np.zeros(len(value))
    error = 0.0
    if live:
        # the column of ones gives the sums, whose rounding is taken off
        seen = _total(vectors, Projected(centred, axes[:, :live] / np.sqrt(value[:live])), live + 1) / n
        error = float(np.abs(seen[:live, :live] - np.outer(seen[:live, live], seen[:live, live]) - np.eye(live)).max())
    return Whitening(n, total, centred, axes, value, explained, error)


def _exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 of each row, in whole numbers."""
    off = max((abs(s - n * k) for s, k in zip(sums, (s // n for s in sums), strict=True)), default=0)
    gap = x - np.array([s // n for s in sums])
    if len(gap) and (int(np.abs(gap).max()) * n + off) ** 2 * len(sums) <= LONG:
        far = gap * n - np.array([s % n for s in sums])
        return (far * far).sum(axis=1).tolist()
    found = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [f if f <= LONG else None for f in found]


def _whiten(held: Broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = held.value
        scaled, k = w.scaled, len(w.value)
        for batch, x in _blocks(batches):
            out = (w.centred(x) @ scaled).ravel()
            each, again = np.repeat(np.arange(len(x)), k), len(x)
            ids = batch.column(0).take(pa.array(each))
            far = pa.array(_exact_deviation(x, w.n, w.sums), pa.int64()).take(pa.array(each))
            number = np.tile(np.arange(1, k + 1), again)
            yield batch_of(schema, ids, number, np.full(len(each), w.n), far, pa.array(out, mask=np.isnan(out)), np.tile(w.explained, again), np.full(len(each), w.identity_error))

    return run


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows, components)
    ddl = f"i {id_type(rows, 'i')}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    held = rows.sparkSession.sparkContext.broadcast(model)
    out = rows.limit(0) if model is None else rows
    return out.mapInArrow(_whiten(held, arrow_of(ddl)), ddl).withColumnRenamed("i", id_col)
