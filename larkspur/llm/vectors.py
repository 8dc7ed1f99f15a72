"""Vectors of a table as integer matrices in Arrow batches, and exact sums over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers are below this, so squared distances over up to 64 dimensions fit a long.
MOST = 2**27


def whole_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors with dims entries, none of them null or not finite."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
    if not dims or not len(rows):
        return rows[:0], np.empty((0, dims))
    flat = column.take(pa.array(rows)).flatten()
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(values).all(1)
    return rows[good], values[good]


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * value) as int32; entries of 2^27 or more are refused, since their squares don't fit."""
    x = np.floor(values * scale)
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"a vector has an entry of {MOST / scale:g} or more")
    return x.astype(np.int32)


def as_matrix(column: pa.Array, dims: int, kind=np.int32) -> np.ndarray:
    """The matrices of a binary column, one below the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims)


def row_bytes(x: np.ndarray) -> list[bytes]:
    """Each row's bytes."""
    size = x.shape[1] * x.itemsize
    raw = np.ascontiguousarray(x).tobytes()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def partials(slots: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    """A task's sums, an array for each slot, for totals."""
    return pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int32()), pa.array([v.tolist() for v in slots.values()], pa.list_(kind))], names=["slot", "sums"])


def totals(df: DataFrame, work, kind: str = "long") -> dict[int, np.ndarray]:
    """Sums over all tasks by slot: work makes from a task's batches a dict of arrays (few and short), Spark adds them up."""
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]):
        yield partials(work(batches), arrow)

    parts = df.mapInArrow(run, f"slot int, sums array<{kind}>").select("slot", F.posexplode("sums").alias("place", "part"))
    out: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("slot", "place").agg(F.sum("part").alias("total")).collect():
        out.setdefault(r.slot, {})[r.place] = r.total
    return {s: np.array([v[i] for i in range(len(v))], np.int64 if kind == "long" else np.float64) for s, v in out.items()}
