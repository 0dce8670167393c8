"""Whitening of embeddings by a tall-skinny QR factorisation (TSQR).

Components become whole numbers, so sums are exact. Over each distinct vector once:

1. count and sums per dimension (exact; one row for each partition);
2. each partition centres its rows (n x - S, exact, then divided by n) and folds them, batch by batch, into one R factor;
3. R factors are merged in a tree, ``FAN`` at a time, until one is left: a square of the dimension, whatever the number of rows;
4. its singular values and right vectors are those of the centred table. Rows projected on right vectors, over the square root of
   the eigenvalue s ** 2 / n, are white. No covariance is formed on the way; only the error of the result is measured with one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
FAN = 8
LIMIT = 1 << 62
BATCH = 4096


@dataclass
class Whitening:
    """``components`` (dimension x kept) of unit length by falling eigenvalue, with what centres a row exactly."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) with floor(256 c), padded with 0 to the longest vector's dimension, and that dimension.

    Rows whose vector is null or holds a null or non-finite entry are left out.
    """
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(fine).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE))
    padded = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return rows.select("vec_id", F.when(F.size("v") == width, x).otherwise(padded).alias("x")), width


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S as exact 64-bit integers; too large values raise."""
    if n * largest(x) + largest(sums) >= LIMIT:
        raise OverflowError("components are too large to centre exactly in 64 bits")
    return n * x - sums


def _moments(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums per dimension."""

    def run(batches):
        n, total = 0, [0] * width
        for _, x in _matrices(batches, width):
            if largest(x) >= LIMIT // BATCH:
                raise OverflowError("components are too large to be summed exactly")
            n, total = n + len(x), [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "total"])

    parts = fit.mapInArrow(run, "n long, total array<string>")
    place = parts.select("n", F.posexplode("total").alias("place", "t")).groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    rows = sorted(place.collect())
    if any(abs(int(r["t"])) >= LIMIT for r in rows):
        raise OverflowError("sums are too large for 64 bits")
    return (rows[0]["n"] if rows else 0), np.array([int(r["t"]) for r in rows], np.int64)


def fold(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The R factor of what ``r`` stands for, with ``block`` below."""
    return np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")


def tsqr(fit: DataFrame, width: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows of ``fit`` (a checkpoint or files), merged in a tree; all that reaches the driver is R."""

    def leaf(batches):
        r = None
        for _, x in _matrices(batches, width):
            r = fold(r, centred(x, n, sums) / n)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for b in table.sort_by("child")["r"].to_pylist():
            r = fold(r, np.frombuffer(b).reshape(-1, width))
        return pa.table({"node": table["node"][:1], "r": pa.array([r.tobytes()], pa.binary())})

    parts, tree = fit.rdd.getNumPartitions(), fit.select("x").mapInArrow(leaf, "node long, r binary")
    while parts > 1:
        parts = math.ceil(parts / FAN)
        tree = tree.select(F.col("node").alias("child"), F.floor(F.col("node") / FAN).alias("node"), "r").groupBy("node").applyInArrow(merge, "node long, r binary")
    return np.frombuffer(tree.first()["r"]).reshape(-1, width)


def project(x: np.ndarray, w: Whitening) -> np.ndarray:
    return (centred(x, w.n, w.sums) / w.n) @ (w.components / np.sqrt(w.eigenvalues))


def fit_whitening(rows: DataFrame, width: int, components: int = 4) -> Whitening | None:
    """Fit over the distinct vectors of ``rows``; None if there is none or they don't vary.

    Directions without variance (a singular value of 0 to rounding) are no components, so there may be fewer than asked for.
    """
    if not width:
        return None
    fit = materialize(rows.select("x").distinct())
    n, sums = _moments(fit, width)
    if not n:
        return None
    _, s, vt = np.linalg.svd(tsqr(fit, width, n, sums), full_matrices=False)
    kept = min(components, int((s > max(s[0], 1e-300) * 16 * width * np.finfo(float).eps).sum()))
    if not kept:
        return None
    w = Whitening(n, sums, vt[:kept].T.copy(), s[:kept] ** 2 / n, float((s**2).sum() / n))

    def run(batches):
        for _, x in _matrices(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in project(x, w).T], names=[f"c{i}" for i in range(kept)])

    white = fit.mapInArrow(run, ", ".join(f"c{i} double" for i in range(kept)))
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    got = white.agg(*(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
    w.identity_error = max(abs(got[f"v{i}_{j}"] - (i == j)) for i, j in pairs)
    return w


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row with a whole vector and each component.

    Shorter vectors count as padded with 0, empty ones as 0. Rows that repeat an id or a vector are rows of their own; a null id stays
    null. Without rows, or where all vectors are equal, there is no component and so no row. Components too
    large to be centred exactly in 64 bits raise an error; a deviation beyond 64 bits (from some 10 ** 7 rows on) is null.
    """
    rows, width = integers(vectors, id_col, vec_col)
    schema = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit_whitening(rows, width, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    kept, share = len(w.eigenvalues), w.eigenvalues / w.trace

    def run(batches):
        for b, x in _matrices(batches, width):
            away = centred(x, w.n, w.sums)
            m, beyond = len(x), (away.astype(float) ** 2).sum(axis=1) >= LIMIT
            deviation = pa.array(np.repeat((away * away).sum(axis=1), kept), mask=np.repeat(beyond, kept))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, w.n)),
                deviation, pa.array(project(x, w).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * kept, w.identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
