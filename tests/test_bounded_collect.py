"""What reaches the driver does not grow with the rows."""

import numpy as np
from pyspark.sql import functions as F

from sparkmend.config import ProfileConfig
from sparkmend.operators.gram import moments
from sparkmend.operators.quantiles import exact_quantiles, resolve


def _collected(monkeypatch, fn):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, real = [], DataFrame.collect

    def counting(self):
        rows = real(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counting)
    out = fn()
    monkeypatch.undo()
    return out, max(seen, default=0)


def test_quantiles_collect_one_row_per_pair(spark, monkeypatch):
    probs = [0.1, 0.25, 0.5, 0.9]
    for n in (1_000, 40_000):
        df = spark.range(n, numPartitions=4).select((F.xxhash64("id") % 100003).cast("double").alias("x"), (F.col("id") % 7).alias("t"))
        got, most = _collected(monkeypatch, lambda: exact_quantiles(df, ["x", "t"], probs))
        pdf = df.toPandas()
        for c in ("x", "t"):
            assert np.allclose(got[c], np.quantile(pdf[c], probs))
        assert most <= 2 * len(probs)


def test_unsettled_bracket_is_still_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 9, 4, 4, 4, 2]], "x double")
    got = resolve(df, ["x"], [0.5], [8], {(0, 0): (100.0, 200.0)}, ProfileConfig())
    assert got[(0, 0)] == 4.0


def test_correlations_go_by_tiles(spark, monkeypatch):
    """200 columns in tiles of 16: a row per tile and task, a pass per 20 tiles,
    the driver sees a number per column and the strong pairs."""
    from sparkmend.operators import correlate as C

    monkeypatch.setattr(C, "TILE", 16)
    monkeypatch.setattr(C, "HELD", 20 * 6 * 256)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 200)) + 1000
    x[:, 150] = x[:, 3] + rng.normal(size=400) * 0.01
    x[:, 7] = 5.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    df = df.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)]).repartition(5)
    sent = []
    real = C._tile_sums
    monkeypatch.setattr(C, "_tile_sums", lambda d, c, tiles, s: sent.append(len(tiles)) or real(d, c, tiles, s))
    got = np.zeros((200, 200))
    for r in C.corr_frame(df, names).collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["r"]
    assert sent == [20, 20, 20, 20, 11]  # 13 * 14 / 2 tiles
    for i, j in [(0, 1), (3, 150), (150, 199), (7, 9), (17, 16), (12, 12)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        want = 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
        assert abs(got[i, j] - want) < 1e-9
    (out, report, _, heat), most = _collected(monkeypatch, lambda: C.filter_features(df.withColumn("t", F.col("c3") * 2), "t"))
    assert most <= 201 and report["n_features_before"] == 200
    assert "c150" in report["dropped_redundant"] + report["kept_features"] and heat.count() == (len(report["kept_features"]) + 1) ** 2


def test_heavy_ties_and_unsettled_columns_run_in_many_tasks(spark, monkeypatch):
    from sparkmend.operators import quantiles as Q

    ranges = []
    real = Q._by_range

    def watched(counts, wanted):
        cut = Q.cut_lineage
        monkeypatch.setattr(Q, "cut_lineage", lambda df: ranges.append(cut(df)) or ranges[-1])
        return real(counts, wanted)

    monkeypatch.setattr(Q, "_by_range", watched)
    df = spark.range(60_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 0.1).when(F.col("id") % 3 == 1, 0.2).otherwise(0.7).alias("few"), (F.xxhash64("id") % 100003).cast("double").alias("x")
    )
    few = ProfileConfig(quantile_max_bracket=100, quantile_accuracy=4)
    got = exact_quantiles(df, ["few", "x"], [0.2, 0.5, 0.9], few)
    pdf = df.toPandas()
    for c in ("few", "x"):
        assert np.allclose(got[c], np.quantile(pdf[c], [0.2, 0.5, 0.9]))
    # never settled: the whole column, dealt over the ranges
    xs, key = {0: F.col("x")}, "k"
    monkeypatch.setattr(Q, "ROUNDS", 0)
    ((lo, hi),) = Q.order_statistics(df, xs, {key: (0, 29_999, 30_000)}, {key: [0.0, 1.0]}).values()
    monkeypatch.undo()
    assert (lo, hi) == tuple(np.sort(pdf["x"])[29_999:30_001])
    rows = [r["n"] for r in ranges[-1].groupBy("range").agg(F.count("*").alias("n")).collect()]
    assert len(rows) >= 6 and max(rows) < 0.5 * sum(rows)


def test_moments_collect_one_row_per_matrix_row(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)) + np.arange(6) * 100
    df = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(x)], "g int, " + ", ".join(f"c{i} double" for i in range(6)))
    cols = [f"c{i}" for i in range(6)]
    (res, shift), most = _collected(monkeypatch, lambda: moments(df.repartition(5), cols, by="g"))
    assert most <= 3 * 7
    for g in range(3):
        z = x[np.arange(500) % 3 == g] - shift
        n, s, m = res[g]
        assert n == len(z) and np.allclose(s, z.sum(0)) and np.allclose(m, z.T @ z)
    (n, s, m), _ = moments(df.limit(0), cols)
    assert n == 0 and not s.any() and m.shape == (6, 6)
