"""The neighbour join of the tuning sends the right side once per left block, for
all metrics of a scaler at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.operators import knn as K
from sparkmend.operators import tune as TU


def distance(a, b, metric, p):
    d = np.abs(np.array(a) - np.array(b))
    return {"manhattan": d.sum(), "chebyshev": d.max(), "euclidean": np.sqrt((d * d).sum())}.get(metric, (d**p).sum() ** (1 / p))


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("block", [40, 1 << 21])
def test_metrics_of_one_pass(spark, monkeypatch, twice, block):
    """Groups, ties, null keys and keys that come twice, in blocks of any size."""
    rng = np.random.default_rng(4)
    left = [(g, i, [float(x) for x in np.round(rng.normal(size=3), 1)]) for g in (0, 1) for i in range(30)]
    if twice:
        left += [(0, 5, [0.0, 0.1, 0.2]), (0, None, [0.5, 0.0, 0.0]), (0, None, [0.0, 0.5, 0.0])]
    right = [(g, i, f"n{i % 3}", [float(x) for x in np.round(rng.normal(size=3), 1)]) for g in (0, 1, 2) for i in range(40)]
    right += [(1, 100 + i, "same", right[0][3]) for i in range(5)]
    L = spark.createDataFrame(left, "g int, a long, v array<double>").repartition(3)
    R = spark.createDataFrame(right, "g int, b long, l string, v array<double>").repartition(4)
    spaces = [(4, "manhattan", 2.0), (2, "chebyshev", 2.0), (5, "euclidean", 2.0), (3, "minkowski", 3.0)]
    monkeypatch.setattr(K, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = K.knn_joins(L, R, "a", "b", spaces, vec="v", carry="l", by="g").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault((r["space"], r["g"], r["a"]), []).append((r["b"], r["l"], r["dist"]))
    names = {(g, b): n for g, b, n, _v in right}
    assert len(got) == len(spaces) * len({(g, a) for g, a, _v in left})
    for (s, g, a), found in got.items():
        k, metric, p = spaces[s]
        want = []
        for x in (v for h, i, v in left if (h, i) == (g, a)):
            want += sorted((distance(x, y, metric, p), b) for h, b, _n, y in right if h == g)[:k]
        want = sorted(want)[:k]
        assert np.allclose([d for *_x, d in found], [d for d, _b in want], rtol=1e-12)
        if not twice:
            assert [b for b, *_x in found] == [b for _d, b in want] and all(n == names[g, b] for b, n, _d in found)


def test_trials_of_a_scaler_share_a_join(spark, monkeypatch):
    df = spark.range(240).select("id", *[(F.xxhash64("id", F.lit(i)) % 100 / 10.0).alias(f"f{i}") for i in range(4)], (F.col("id") % 3).cast("int").alias("y"))
    sent, real = [], K._passes

    def grid(left, right, *more):
        sent.append((left.count(), right.count()))
        return real(left, right, *more)

    monkeypatch.setattr(K, "_passes", grid)
    kinds = [("standard", "manhattan", 3), ("standard", "chebyshev", 5), ("standard", "euclidean", 4), ("minmax", "euclidean", 2)]
    trials = [{"scaler": s, "metric": m, "n_neighbors": n, "weights": w} for s, m, n in kinds for w in ("uniform", "distance")]
    out, summary = TU.tune(df, "y", "id", cv_folds=3, preset="scaled_knn", trials=trials)
    assert sent == [(240, 480)] * 2  # a join per scaler
    assert out.count() == 8 and 0 <= summary["best"] <= 1


def test_exact_hits_win_alone(spark):
    rows = [(1, "a", 0.0), (1, "b", 0.001), (1, "b", 0.001), (2, "a", 4.0), (2, "b", 1.0), (2, "a", 4.0), (3, "b", 0.0), (3, "a", 0.0), (3, "b", 2.0), (4, "b", 2.0), (4, "a", 2.0)]
    nb = spark.createDataFrame(rows, "k int, __nl string, dist double")
    assert {r["k"]: r["prediction"] for r in K.vote(nb, "k", "distance").collect()} == {1: "a", 2: "b", 3: "a", 4: "a"}
    assert {r["k"]: r["prediction"] for r in K.vote(nb, "k").collect()} == {1: "b", 2: "a", 3: "b", 4: "a"}
