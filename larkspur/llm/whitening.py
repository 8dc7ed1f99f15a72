"""Operator 13, embedding whitening by pivoted Cholesky and one-sided Jacobi.

The distinct vectors, as integers, are found by one shuffle; their sums are exact, and the scatter around the
mean is added up from a small matrix of each task. The driver factors that matrix (its size is the number of
dimensions, not of rows), and a last pass without a shuffle projects every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import new_name, saved, ship
from .vectors import as_matrix, row_bytes, scaled, totals, whole_vectors


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with a[order][:, order] = factor @ factor.T; the factor is lower triangular with a column per rank."""
    n = len(a)
    order, left = np.arange(n), np.diag(a).astype(float).copy()
    factor = np.zeros((n, n))
    floor = n * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(n):
        p = k + int(left[k:].argmax())
        if left[p] <= floor:
            return factor[:, :k], order
        for rows in (order, left, factor):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def jacobi_columns(g: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """g with its columns rotated among each other until all are orthogonal.

    A sweep meets each pair of columns once, in rounds of disjoint pairs that rotate together.
    """
    g = g.copy()
    n = g.shape[1]
    seats = np.arange(n + n % 2)
    for _ in range(most_sweeps if n > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            there = (p < n) & (q < n)
            p, q = p[there], q[there]
            a, b = g[:, p], g[:, q]
            pp, qq, pq = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(pq) > 1e-15 * np.sqrt(pp * qq)
            if turn.any():
                turned = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    z = (qq - pp) / (2 * pq)
                    t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
                t = np.where(turn, t, 0.0)
                c = 1 / np.sqrt(1 + t * t)
                g[:, p], g[:, q] = c * (a - t * b), c * (b + t * a)
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]
        if not turned:
            break
    return g


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance in falling order, without those that are zero, and its unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(cov)
    rotated = jacobi_columns(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(rotated)
    vectors[order] = rotated
    return norms[by] ** 2, vectors[:, by] / norms[by]


@dataclass(frozen=True)
class Whitening:
    #: Distinct vectors, their sums, and what is needed to project; components are columns.
    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    dims: int
    scale: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.components / np.sqrt(self.values)


def _dims(rows: DataFrame) -> int:
    found = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return found.dims if found else 0


def fit_whitening(vectors: DataFrame, vector_col: str, most_components: int, scale: float = 256.0, dims: int | None = None) -> Whitening:
    """The whitening of the distinct vectors floor(scale * entry).

    Left out are null vectors, those with a null or not finite entry, and those that don't have dims entries (by
    default the length that most rows have, of several the greatest). Components whose variance is zero don't
    exist; with one distinct vector or an empty table there are none.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    width = _dims(rows) if dims is None else dims
    if not width:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0, scale)

    def integers(batches):
        for b in batches:
            x = scaled(whole_vectors(b.column("v"), width)[1], scale)
            yield pa.RecordBatch.from_arrays([pa.array(row_bytes(x) if len(x) else [], pa.binary())], names=["x"])

    distinct = saved(rows.mapInArrow(integers, "x binary").distinct())

    def count(batches):
        n, sums = 0, np.zeros(width, np.int64)
        for b in batches:
            x = as_matrix(b.column("x"), width)
            n, sums = n + len(x), sums + x.sum(0, dtype=np.int64)
        return {0: np.array([n]), 1: sums}

    t = totals(distinct, count)
    n, sums = (int(t[0][0]), t[1]) if t else (0, np.zeros(width, np.int64))
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0, width, scale)
    mean = sums / n

    def scatter(batches):
        s = np.zeros((width, width))
        for b in batches:
            y = as_matrix(b.column("x"), width) - mean
            s += y.T @ y
        return dict(enumerate(s))

    t = totals(distinct, scatter, "double")
    cov = np.stack([t[i] for i in range(width)]) / n
    cov = (cov + cov.T) / 2
    values, components = principal(cov)
    keep = min(most_components, len(values))
    fit = Whitening(n, sums, values[:keep], components[:, :keep], float(np.trace(cov)), 0.0, width, scale)
    if not keep:
        return fit

    def check(batches):
        s, first = np.zeros((keep, keep)), np.zeros(keep)
        for b in batches:
            y = fit.project(as_matrix(b.column("x"), width))
            s, first = s + y.T @ y, first + y.sum(0)
        return {**dict(enumerate(s)), keep: first}

    t = totals(distinct, check, "double")
    off = t[keep] / n  # the mean left by rounding
    white = np.stack([t[i] for i in range(keep)]) / n - np.outer(off, off)
    return Whitening(n, sums, fit.values, fit.components, fit.trace, float(np.abs(white - np.eye(keep)).max()), width, scale)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums of (n * x - sums)^2 of each row, in longs where they fit; a sum beyond a long raises an error when it is stored."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if len(sums) * most * most < 2**63:
        d = n * x.astype(np.int64) - sums
        return (d * d).sum(1).tolist()
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]


def whiten(vectors: DataFrame, vector_col: str, fit: Whitening, keep: list[str]) -> DataFrame:
    """A row for each remaining vector and component: the columns keep, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows that fit_whitening leaves out are left out here. Repeated rows are rows of their own; null ids stay.
    Columns of keep that are named like a new column are replaced.
    """
    ship(vectors.sparkSession)
    new = T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double")
    taken = {f.name for f in new}
    carried = [c for c in keep if c.lower() not in taken]
    vector = new_name(vectors, "whole_vector")
    rows = vectors.select(*carried, F.col(vector_col).cast("array<double>").alias(vector))
    schema = T.StructType([*(rows.schema[c] for c in carried), *new])
    k = len(fit.values)
    explained = fit.values / fit.trace if k else fit.values

    def run(batches):
        for b in batches:
            at, values = whole_vectors(b.column(vector), fit.dims)
            if not k or not len(at):
                continue
            x = scaled(values, fit.scale)
            rows_of = pa.array(np.repeat(at, k))
            columns = [b.column(c).take(rows_of) for c in carried]
            columns.append(pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))))
            columns.append(pa.array(np.full(len(x) * k, fit.n, np.int64)))
            columns.append(pa.array([d for d in _deviation(x, fit.n, fit.sums) for _ in range(k)], pa.int64()))
            columns.append(pa.array(fit.project(x).reshape(-1)))
            columns.append(pa.array(np.tile(explained, len(x))))
            columns.append(pa.array(np.full(len(x) * k, fit.identity_error)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
