"""Whitening of embeddings: pivoted Cholesky of the covariance, then one-sided Jacobi on the triangular factor.

Entries are whole numbers, so the sums and the scatter are counted exactly: each partition adds up its rows centred at
the rounded mean, Spark adds the partitions, and the rest of the centring is a correction in whole numbers. Only sums by
dimension and by pair of dimensions reach the driver. There V = T T' is factored with pivots (T triangular), and columns
of T are rotated in pairs until all are orthogonal: the squares of their norms are the eigenvalues, the columns over
their norms the components. Neither V is diagonalised itself nor T T' formed again, so small eigenvalues keep their
digits.

Cases: rows with a null vector or null or non-finite entries are left out; repeated vectors count once in the fit and
each row has its results; a null id stays null; shorter vectors have zeros at their end; where the covariance has a rank
under the number of components, there are only as many as its rank (none for an empty table, one vector, or vectors of
no entries); equal eigenvalues come in either order; texts of any length and other columns, clashing names too, are not
read. A deviation that doesn't fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.vectors import integer_vectors, matrix
from foliant.session import materialize

EXACT = 1 << 53  # whole numbers below are exact as doubles
LONG = 1 << 62
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    n: int
    centre: np.ndarray  # whole numbers next to the mean
    rest: list[int]  # sums less n times the centre
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # a column each
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A row for each vector, a column for each component."""
        off = np.array([r / self.n for r in self.rest])
        return ((x - self.centre) - off) @ self.components / np.sqrt(self.values)


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            total += matrix(batch.column(0), size).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([n, *total], pa.int64())], names=["at", "total"])

    found = fit.select("x").mapInArrow(run, "at int, total bigint").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by = {r["at"]: int(r["total"]) for r in found.collect()}
    return by.get(-1, 0), [by.get(i, 0) for i in range(size)]


def scatter(fit: DataFrame, centre: list[int], largest: int) -> np.ndarray:
    """Sums of products of the vectors less ``centre``, as Python's whole numbers."""
    size = len(centre)
    upper = np.triu_indices(size)
    step = max(1, EXACT // max(1, (2 * largest) ** 2) - 1)  # rows whose products add up exactly as doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound, at = np.zeros((size, size), dtype=np.int64), 0, np.array(centre, dtype=np.int64)

        def sent() -> pa.RecordBatch:
            columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["i", "j", "total"])

        for batch in batches:
            rows = matrix(batch.column(0), size) - at
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                more = len(part) * int(np.abs(part).max(initial=0)) ** 2
                if bound + more >= LONG:
                    yield sent()
                    total, bound = np.zeros_like(total), 0
                if more < EXACT:
                    wide = part.astype(np.float64)
                    total += (wide.T @ wide).astype(np.int64)
                elif more < LONG:
                    total += part.T @ part
                else:
                    raise ValueError("products of entries must stay below 2^62")
                bound += more
        if bound:
            yield sent()

    parts = fit.select("x").mapInArrow(run, "i int, j int, total bigint")
    found = np.zeros((size, size), dtype=object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found[r["i"], r["j"]] = found[r["j"], r["i"]] = int(r["total"])
    return found


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order, t: v[order][:, order] = t t' with t lower triangular, as many columns as v has rank."""
    a, size = v.copy(), len(v)
    order, t = np.arange(size), np.zeros((size, size))
    least = size * np.finfo(float).eps * a.diagonal().max(initial=0.0)
    for k in range(size):
        best = k + int(np.argmax(a.diagonal()[k:]))
        if a[best, best] <= least:
            return order, t[:, :k]
        for rows in (a, a.T, t):
            rows[[k, best]] = rows[[best, k]]
        order[[k, best]] = order[[best, k]]
        t[k, k] = np.sqrt(a[k, k])
        t[k + 1 :, k] = a[k + 1 :, k] / t[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(t[k + 1 :, k], t[k + 1 :, k])
    return order, t


def rounds(columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of pairs that share no column."""
    ring = list(range(columns)) + [-1] * (columns % 2)
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1:-1]) if a >= 0 and b >= 0]
        yield np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(t: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the norms, falling, and directions of the columns of t when rotated to be orthogonal."""
    g = t.copy()
    for _ in range(most_sweeps):
        worst = 0.0
        for p, q in rounds(g.shape[1]):
            if not len(p):
                continue
            one, two = g[:, p], g[:, q]
            a, b, c = (one * one).sum(axis=0), (two * two).sum(axis=0), (one * two).sum(axis=0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, float(off.max()))
            turn = off > 1e-17
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            tan = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, tan)
            sin = cos * tan
            g[:, p], g[:, q] = cos * one - sin * two, sin * one + cos * two
        if worst <= 1e-12:  # convergence is quadratic: this sweep has taken off what was left
            break
    else:
        raise RuntimeError(f"columns not orthogonal after {most_sweeps} sweeps")
    values = (g * g).sum(axis=0)
    falling = np.argsort(-values, kind="stable")
    return values[falling], g[:, falling] / np.sqrt(values[falling])


def fit_whitening(fit: DataFrame, size: int, largest: int, most: int) -> Fit | None:
    """The first components of different vectors (column x); None without any."""
    n, total = sums(fit, size)
    if not n or not size:
        return None
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    exact = n * scatter(fit, centre, largest) - np.outer(np.array(rest, dtype=object), np.array(rest, dtype=object))
    v = np.array([[entry / (n * n) for entry in row] for row in exact])
    order, t = pivoted_cholesky(v)
    if not t.shape[1]:
        return None
    values, turned = one_sided_jacobi(t)
    components = np.zeros((size, min(most, len(values))))
    components[order] = turned[:, :most]
    peaks = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return Fit(n, np.array(centre), rest, values[:most], components * np.sign(peaks), sum(exact[i, i] for i in range(size)) / (n * n))


def identity_error(fit: DataFrame, found: Fit, size: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    names = [f"w{i}" for i in range(len(found.values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(w) for w in found.whiten(matrix(batch.column(0), size)).T], names=names)

    rows = fit.select("x").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for a in names for b in names if a <= b]
    covariances = rows.agg(*[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    return max(abs(covariances[a + b] - (a == b)) for a, b in pairs)


def whiten_embeddings(embeddings: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit list is each distinct vector once, n of them. ``deviation`` is the exact sum of squares of n times a row's
    vector minus the sums; ``explained`` is a component's share of the variance.
    """
    spark = embeddings.sparkSession
    rows, size, largest = integer_vectors(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding")
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    found = fit_whitening(fit, size, largest, most)
    if found is None:
        return spark.createDataFrame([], WHITENED)
    error = identity_error(fit, found, size)
    count, n = len(found.values), found.n
    squares = sum(r * r for r in found.rest)

    def deviations(x: np.ndarray) -> list[int | None]:
        y, rest = x - found.centre, np.array(found.rest)
        if len(y) and size * max(int(np.abs(y).max()), 1) * max(int(np.abs(y).max()), int(np.abs(rest).max())) >= LONG:
            y, rest = y.astype(object), rest.astype(object)
        own, cross = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
        exact = (n * n * int(a) - 2 * n * int(b) + squares for a, b in zip(own, cross))
        return [d if d < 1 << 63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), size)
            each = np.repeat(np.arange(len(x)), count)
            columns = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n, dtype=np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                pa.array(found.whiten(x).ravel()), pa.array(np.tile(found.values / found.trace, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)
