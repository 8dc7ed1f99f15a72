"""Operator 12, centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are sorted along a Hilbert curve through all their dimensions and cut into blocks, each with the
least and greatest value of every dimension (its box). In a round a block compares its vectors with its
candidate centroids only: those that distance bounds from its box don't rule out. What is left is compared
exactly, in integers. Blocks are written once; a round reads them and sends a sum for each centroid.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .cluster import saved, ship
from .vectors import as_matrix, row_bytes, scaled, totals, whole_vectors

#: Vectors of a block.
BLOCK = 128
#: Bits of a dimension in the Hilbert key: four zones, with borders at the mean and one deviation beside it.
BITS = 2


def hilbert_keys(zones: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of zones (numbers below 2^bits) on the Hilbert curve, as big-endian bytes.

    The curve's reflections and exchanges are undone from the top bit down for all rows at once, then the
    axes are Gray-decoded and their bits interleaved (Skilling's transposed form).
    """
    x = zones.astype(np.uint8).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        top, low = np.uint8(1 << b), np.uint8((1 << b) - 1)
        for d in range(dims):
            upper = (x[:, d] & top) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, d]) & low).astype(np.uint8)
            x[:, 0] ^= np.where(upper, low, swap).astype(np.uint8)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.uint8)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & np.uint8(1 << b), np.uint8((1 << b) - 1), np.uint8(0))
    x ^= turn[:, None]
    planes = np.stack([(x >> np.uint8(b)) & np.uint8(1) for b in range(bits - 1, -1, -1)], 1)
    return np.packbits(planes.reshape(n, -1), axis=1)


def _fits(*sizes: int) -> bool:
    """Whether squared distances between numbers of these magnitudes are exact in doubles."""
    return 4 * 64 * max(sizes) ** 2 < 2**53


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centre, by matrix products of doubles where these are exact."""
    kind = np.float64 if x.shape[1] <= 64 and _fits(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0))) else np.int64
    a, c = x.astype(kind), centres.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centres (columns) can be the nearest of a vector in each box (rows).

    One drops out if its least distance to the box is above another's greatest, or if the centre with the least
    greatest distance is nearer at every corner. Both are strict, so centres that tie stay.
    """
    lo, hi, c = low[:, None].astype(np.int64), high[:, None].astype(np.int64), centres[None].astype(np.int64)
    outside = np.maximum(np.maximum(lo - c, c - hi), 0)
    least = (outside * outside).sum(2)
    across = np.maximum(np.abs(c - lo), np.abs(c - hi))
    most = (across * across).sum(2)
    fit = least <= most.min(1)[:, None]
    lead = centres[most.argmin(1)].astype(np.int64)
    # the greatest value of |x - lead|^2 - |x - c|^2 = 2x(c - lead) + |lead|^2 - |c|^2 in the box
    away = c - lead[:, None]
    gain = 2 * np.where(away > 0, hi * away, lo * away).sum(2) + (lead * lead).sum(1)[:, None] - (c * c).sum(2)
    return fit & (gain >= 0)


def nearest(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vectors, nearest centre, squared distance) of a batch of blocks, and how many pairs were compared."""
    dims = centres.shape[1]
    x = as_matrix(batch.column("vectors"), dims)
    sizes = batch.column("rows").to_numpy()
    fit = candidates(as_matrix(batch.column("low"), dims), as_matrix(batch.column("high"), dims), centres)
    near, far, at, pairs = np.empty(len(x), np.int32), np.empty(len(x), np.int64), 0, 0
    for n, can in zip(sizes.tolist(), fit):
        numbers = np.flatnonzero(can)
        d = distances(x[at : at + n], centres[numbers])
        best = d.argmin(1)
        near[at : at + n], far[at : at + n] = numbers[best], d[np.arange(n), best]
        at, pairs = at + n, pairs + n * len(numbers)
    return x, near, far, pairs


@dataclass(frozen=True)
class Clustering:
    #: The vectors in blocks, centroids (a row each), and sums of squared distances.
    blocks: DataFrame
    centroids: np.ndarray
    inertia: dict[int, int]


def hilbert_blocks(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """The kept vectors as integers in written blocks along the Hilbert curve: ids, vectors, low, high, rows.

    Vectors are dealt by ranges of the curve's key and, within equal keys, by a hash of the id, so that many
    copies of one vector are several ranges.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type = rows.schema["id"].dataType

    def moments(batches):
        n, sums, squares = 0, np.zeros(dims, np.int64), np.zeros(dims)
        for b in batches:
            x = scaled(whole_vectors(b.column("v"), dims)[1], scale)
            n, sums, squares = n + len(x), sums + x.sum(0, dtype=np.int64), squares + (x.astype(float) ** 2).sum(0)
        return {0: np.array([n], float), 1: sums.astype(float), 2: squares}

    m = totals(rows.select("v"), moments, "double")
    n = max(m[0][0], 1.0) if m else 1.0
    mean = m[1] / n if m else np.zeros(dims)
    spread = np.sqrt(np.maximum(m[2] / n - mean**2, 0)) if m else np.zeros(dims)
    first = np.argsort(-spread, kind="stable")  # dimensions that vary most decide first
    borders = np.stack([mean - spread, mean, mean + spread])

    keyed_type = T.StructType([T.StructField("id", id_type), T.StructField("x", T.BinaryType()), T.StructField("key", T.BinaryType())])

    def keyed(batches):
        for b in batches:
            at, values = whole_vectors(b.column("v"), dims)
            x = scaled(values, scale)
            zones = (x[:, first] > borders[:, None, first]).sum(0)
            keys = [] if not len(x) else row_bytes(hilbert_keys(zones, BITS))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(row_bytes(x) if len(x) else [], pa.binary()), pa.array(keys, pa.binary())], names=["id", "x", "key"])

    ordered = rows.mapInArrow(keyed, keyed_type).repartitionByRange("key", F.xxhash64("id", "x")).sortWithinPartitions("key")
    block_type = T.StructType(
        [T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("vectors", "low", "high")), T.StructField("rows", T.IntegerType())]
    )
    arrow_id = to_arrow_type(id_type)

    def cut(batches):
        left_ids, left = [], np.empty((0, dims), np.int32)

        def blocks(ids, x, end):
            starts = [s for s in range(0, len(x), BLOCK) if s + BLOCK <= len(x) or end]
            parts = [x[s : s + BLOCK] for s in starts]
            columns = [pa.array([ids[s : s + BLOCK] for s in starts], pa.list_(arrow_id))]
            columns += [pa.array([f(p).tobytes() for p in parts], pa.binary()) for f in (lambda p: p, lambda p: p.min(0), lambda p: p.max(0))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([len(p) for p in parts], pa.int32())], names=block_type.names)

        for b in batches:
            left_ids += b.column("id").to_pylist()
            left = np.concatenate([left, as_matrix(b.column("x"), dims)])
            full = len(left) // BLOCK * BLOCK
            if full:
                yield blocks(left_ids[:full], left[:full], False)
                left_ids, left = left_ids[full:], left[full:]
        if len(left):
            yield blocks(left_ids, left, True)

    return saved(ordered.mapInArrow(cut, block_type))


def _starts(vectors: DataFrame, id_col: str, vector_col: str, k: int, salt: str, dims: int, scale: float) -> np.ndarray:
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where((F.size(v) == dims) & ~bad).select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("h"), v.alias("v"))
    picked = rows.orderBy("h", "v").limit(k).collect()
    return scaled(np.array([r.v for r in picked], float).reshape(-1, dims), scale).astype(np.int64)


def cluster_vectors(vectors: DataFrame, id_col: str, vector_col: str, k: int, rounds: int, salt: str = "3", dims: int = 64, scale: float = 1024.0) -> Clustering:
    """Lloyd's rounds over integer vectors floor(scale * entry), exact at every step.

    Kept: vectors with exactly dims entries, none null or not finite. The first centroids are the k kept vectors
    with the smallest sha256 of "salt:id" (fewer where fewer are kept; ties by vector; a null id is empty). A
    vector goes to its nearest centroid, of several to the one with the smaller number; a centroid then becomes the
    floor of its vectors' mean, and stays if it has none. Repeated ids and vectors are rows of their own.
    Entries of 2^27 / scale or more raise an error. An empty table has no centroids.
    """
    centres = _starts(vectors, id_col, vector_col, k, salt, dims, scale)
    blocks = hilbert_blocks(vectors, id_col, vector_col, dims, scale)
    if not len(centres):
        return Clustering(blocks, centres, {})

    def sums_by(now: np.ndarray):
        def work(batches):
            out = np.zeros((len(now), dims + 2), np.int64)  # sums of the entries, vectors, distances
            for b in batches:
                x, near, far, _ = nearest(b, now)
                for c in range(len(now)):
                    mine = near == c
                    out[c, :dims] += x[mine].sum(0, dtype=np.int64)
                    out[c, dims] += mine.sum()
                    out[c, dims + 1] += far[mine].sum()
            return dict(enumerate(out))

        return totals(blocks, work)

    for _ in range(rounds):
        found = sums_by(centres)
        centres = np.stack([s[:dims] // s[dims] if s[dims] else c for s, c in ((found[i], c) for i, c in enumerate(centres))])
    return Clustering(blocks, centres, {i: int(s[dims + 1]) for i, s in sums_by(centres).items()})


def assigned(found: Clustering, id_name: str) -> DataFrame:
    """One row per kept vector: its id, cluster, squared distance, the sums of its cluster and of all, and its centroid's digest."""
    centres, dims = found.centroids, found.centroids.shape[1]
    id_type = found.blocks.schema["ids"].dataType.elementType
    names = [id_name, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kinds = [id_type, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres], object)
    each = np.array([found.inertia.get(i, 0) for i in range(len(centres))], np.int64)
    whole = sum(found.inertia.values())

    def run(batches):
        for b in batches:
            if not len(centres):
                continue
            _, near, far, _ = nearest(b, centres)
            arrays = [b.column("ids").flatten(), pa.array(near), pa.array(far), pa.array(each[near]), pa.array(np.full(len(near), whole, np.int64)), pa.array(digests[near], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return found.blocks.mapInArrow(run, T.StructType([T.StructField(a, t) for a, t in zip(names, kinds)]))
