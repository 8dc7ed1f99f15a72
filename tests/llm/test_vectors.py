"""Centroid clustering and whitening against brute force."""

import hashlib
import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from larkspur.llm import centroids, queries, vectors, whitening  # noqa: E402

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}")


def lloyd(rows, dims, k, rounds):
    """The contract, written out row by row."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted([(i, near(v), far(v, centres[near(v)])) for i, v in kept], key=repr)


def test_hilbert_order_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk.astype(int), axis=0)).sum(1) == 1).all()


def test_boxes_keep_the_nearest_and_drop_the_far():
    r = np.random.default_rng(1)
    dropped = 0
    for dims in (2, 5, 64):
        for _ in range(60):
            x = (r.integers(-900, 900, dims) + r.integers(-60, 60, (20, dims))).astype(np.int32)
            c = np.unique(r.integers(-900, 900, (8, dims)), axis=0)
            fit = centroids.candidates(x.min(0)[None], x.max(0)[None], c)[0]
            d = ((x[:, None].astype(int) - c) ** 2).sum(2)
            assert fit[d.argmin(1)].all() and (centroids.distances(x, c) == d).all()
            assert fit[np.unique(np.nonzero(d == d.min(1)[:, None])[1])].all()
            dropped += (~fit).sum()
    assert dropped > 700
    big = np.array([[2**27 - 1] * 64, [-(2**27) + 1] * 64], np.int32)
    assert centroids.distances(big, big.astype(np.int64)).tolist() == [[0, 64 * (2**28 - 2) ** 2], [64 * (2**28 - 2) ** 2, 0]]


def test_rounds_as_written_out(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    r = np.random.default_rng(2)
    groups = r.normal(size=(5, 4)) * 2
    rows = [(i, (groups[i % 5] + r.normal(size=4) * 0.3).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5, 0.25, -1.0, 0.0]) for i in range(40)] + rows[:3]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 0.0, 0.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0])]
    df = table(spark, [(*x, "a", 1) for x in rows], ", cluster string, distance int")
    found = centroids.cluster_vectors(df, "vec_id", "embedding", 6, 4, dims=4)
    got = centroids.assigned(found, "vec_id").collect()
    assert sorted(((g.vec_id, g.cluster, g.distance) for g in got), key=repr) == lloyd(rows, 4, 6, 4)
    for c in {g.cluster for g in got}:
        assert {g.cluster_inertia for g in got if g.cluster == c} == {sum(g.distance for g in got if g.cluster == c)}
    assert {g.inertia for g in got} == {sum(g.distance for g in got)}


def test_few_and_no_vectors(spark):
    two = centroids.cluster_vectors(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]), "vec_id", "embedding", 8, 2, dims=2)
    assert [(r.cluster, r.distance) for r in centroids.assigned(two, "vec_id").collect()] == [(0, 0), (0, 0)]
    none = centroids.cluster_vectors(table(spark, [(1, None)]), "vec_id", "embedding", 8, 2)
    assert centroids.assigned(none, "vec_id").count() == 0
    with pytest.raises(ValueError):
        vectors.scaled(np.array([[2.0**20]]), 1024)


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    got = queries.op12_centroids(spark, DIR)
    want = c.execute(queries.SQL["op12_centroids"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_factor_and_rotations():
    r = np.random.default_rng(3)
    for n, rank in ((1, 1), (2, 2), (7, 7), (9, 4), (64, 64)):
        a = r.normal(size=(n, rank)) * (10.0 ** r.integers(-3, 3, rank))
        a = a @ a.T
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor, np.tril(factor)) and np.allclose(factor @ factor.T, a[order][:, order], rtol=1e-10, atol=1e-12 * np.abs(a).max())
        values, parts = whitening.principal(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-9, atol=1e-13 * values[0])
        assert np.abs(parts.T @ parts - np.eye(rank)).max() < 1e-12 and np.allclose((parts * values) @ parts.T, a, atol=1e-11 * np.abs(a).max())


def whitened(x, k):
    u = np.unique(x, axis=0)
    values, parts = np.linalg.eigh(np.cov(u.T, bias=True))
    return u, values[::-1], ((x - u.mean(0)) @ parts[:, ::-1][:, :k]) / np.sqrt(values[::-1][:k])


def test_whitening_query(spark):
    got = queries.op13_whitening(spark, DIR).orderBy("vec_id", "component").toPandas()
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(int)
    u, values, want = whitened(x, 4)
    have = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-9
    assert (got.n == len(u)).all() and got.identity_error.max() < 1e-10
    assert np.allclose(got.explained.to_numpy()[:4], values[:4] / values.sum(), rtol=1e-12)
    assert got.deviation.tolist() == np.repeat(((len(u) * x - u.sum(0)) ** 2).sum(1), 4).tolist()


def test_whitening_of_odd_rows(spark):
    rows = [(1, [0.0, 1.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "b"), (None, [1.0, 1.0, 0.0], "c"), (3, [2.0, 1.0, 3.0], "d"), (4, None, "e"), (5, [1.0, None, 0.0], "f"), (6, [1.0, float("nan"), 0.0], "g"), (7, [1.0], "h"), (8, [], "i")]
    df = table(spark, rows, ", component string").withColumn("whole_vector", df_lit(5))
    fit = whitening.fit_whitening(df, "embedding", most_components=4)
    got = whitening.whiten(df, "embedding", fit, keep=["vec_id", "component", "whole_vector"]).collect()
    assert (fit.n, len(fit.values), fit.dims) == (3, 2, 3) and fit.identity_error < 1e-10
    assert len(got) == 8 and got[0].whole_vector == 5 and sorted({r.vec_id for r in got}, key=repr) == [1, 3, None]
    assert whitening.whiten(df, "embedding", whitening.fit_whitening(df.limit(1), "embedding", 4), ["vec_id"]).count() == 0
    empty = whitening.fit_whitening(df.where("vec_id > 99"), "embedding", 4)
    assert empty.n == 0 and whitening.whiten(df, "embedding", empty, ["vec_id"]).count() == 0
    big = np.array([[2**26, -(2**26)]])
    assert whitening._deviation(big, 1000, np.array([5, 5])) == [(1000 * 2**26 - 5) ** 2 + (1000 * 2**26 + 5) ** 2]


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)
