"""Block form and bucket form of the neighbour join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.operators import knn as K
from sparkmend.sources import io


def brute(a, b, k):
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
    return [sorted((float(d[i, j]), j) for j in range(len(b)))[:k] for i in range(len(a))]


def frame(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, v array<double>").repartition(3)


def as_lists(df):
    out = {}
    for r in df.orderBy("lk", "rank").collect():
        out.setdefault(r["lk"], []).append((r["dist"], r["rk"]))
    return out


@pytest.mark.parametrize("block", [12, 100, 1 << 20])
def test_blocks_of_any_size_give_the_same(spark, block, monkeypatch):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=(40, 3)), 1) + 1e6  # ties and cancellation
    b = np.vstack([np.round(rng.normal(size=(90, 3)), 1) + 1e6, a[:9], a[:9]])
    monkeypatch.setattr(K, "BLOCK", block)
    seen = []
    real = K._parts
    monkeypatch.setattr(K, "_parts", lambda n, d, t: seen.append((n * d, real(n, d, t))) or seen[-1][1])
    got = as_lists(K.knn_join(frame(spark, a, "lk"), frame(spark, b, "rk"), "lk", "rk", k=6, vec="v"))
    for i, want in enumerate(brute(a, b, 6)):
        assert [j for _, j in got[i]] == [j for _, j in want]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want], rtol=1e-12, atol=1e-15)
    assert all(numbers / parts <= block for numbers, parts in seen)


def test_kernel_holds_a_strip_of_distances(monkeypatch):
    monkeypatch.setattr(K._Kernel, "STRIP", 1000)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 8)), rng.normal(size=(200, 8))
    kernel, sizes = K._Kernel(3, "euclidean", 2.0, False), []
    real = kernel.whole
    kernel.whole = lambda x, y: sizes.append(len(x) * len(y)) or real(x, y)
    found = list(kernel.nearest(a, b, np.arange(200)))
    assert max(sizes) <= 1000 and sum(len(i) for i, _, _ in found) == 900


def test_odd_rows(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [1.0, 1.0])], "lk long, v array<double>")
    right = spark.createDataFrame([(1, [0.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "rk long, v array<double>")
    got = K.knn_join(left, right, "lk", "rk", k=5, vec="v", exclude_self=True).collect()
    assert sorted((r["lk"] or 0, r["rk"], r["rank"]) for r in got) == [(0, 1, 2), (0, 3, 1), (1, 3, 1)]
    assert K.knn_join(left, right.limit(0), "lk", "rk", vec="v").collect() == []
    assert K.knn_join(left.limit(0), right, "lk", "rk", vec="v", mode="approx").collect() == []


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_approximate_mode_recall(spark, block, monkeypatch):
    """At least 0.9 of the exact neighbours on the embeddings; buckets cut into
    blocks give the same rows as whole ones, and every row has its k."""
    d = io.table(spark, "/root/testdata/sf0.01", "embeddings")
    left = d.where("vec_id % 20 = 0").select(F.col("vec_id").alias("lk"), "embedding")
    right = d.select(F.col("vec_id").alias("rk"), "embedding")
    args = dict(k=10, vec="embedding", exclude_self=True)
    exact = {(r["lk"], r["rk"]) for r in K.knn_join(left, right, "lk", "rk", **args).collect()}
    monkeypatch.setattr(K, "BLOCK", block * 64 if block < 1000 else block)
    near = {(r["lk"], r["rk"]) for r in K.knn_join(left, right, "lk", "rk", mode="approx", **args).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


def test_hot_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    rng = np.random.default_rng(2)
    same = np.zeros((120, 2))
    a, b = np.vstack([same[:10], rng.normal(size=(10, 2)) * 50]), np.vstack([same, rng.normal(size=(60, 2)) * 50])
    sizes = []
    real = K._Kernel.cells
    monkeypatch.setattr(K._Kernel, "cells", lambda self, x, y, keys: sizes.append(y.groupBy(*keys).count().agg(F.max("count")).first()[0]) or real(self, x, y, keys))
    got = as_lists(K.knn_join(frame(spark, a, "lk"), frame(spark, b, "rk"), "lk", "rk", k=4, vec="v", mode="approx", tables=4, bucket_length=5.0))
    assert [len(v) for v in got.values()] == [4] * 20 and all(got[i] == [(0.0, j) for j in range(4)] for i in range(10))
    assert max(sizes) <= 2 * 32


@pytest.mark.parametrize("metric, p", [("manhattan", 2), ("chebyshev", 2), ("minkowski", 1), ("minkowski", 3), ("minkowski", 4), ("minkowski", 2.5)])
def test_tiles_of_any_size_give_the_same(monkeypatch, metric, p):
    rng = np.random.default_rng(9)
    a, b = np.round(rng.normal(size=(23, 5)), 1), np.round(rng.normal(size=(37, 5)), 1)
    b[20:30] = b[:10]  # ties
    kernel = K._Kernel(6, metric, p, False)
    d = np.abs(a[:, None, :] - b[None, :, :])
    p = {"manhattan": 1, "chebyshev": np.inf}.get(metric, p)
    want = d.max(2) if p == np.inf else (d**p).sum(2)
    for size in (1, 7, 64):
        monkeypatch.setattr(K._Kernel, "ROWS", size)
        monkeypatch.setattr(K._Kernel, "COLS", 2 * size)
        assert np.allclose(kernel.whole(a, b), want, rtol=1e-13)
        got = [np.concatenate(x) for x in zip(*kernel.nearest(a, b, np.arange(37)), strict=True)]
        flat = [(i, j) for i in range(23) for _d, j in sorted((kernel.exact(a[i : i + 1], b[j : j + 1])[0], j) for j in range(37))[:6]]
        assert [*zip(got[0].tolist(), got[1].tolist(), strict=True)] == flat
