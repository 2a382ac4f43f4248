"""Text columns in the ridge equal their 0/1 columns, however many levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.operators import levels as L

RNG = np.random.default_rng(3)


def planted(spark, n=3000, wide=300, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, wide, n)
    a[: n // 3] = 7  # a level with a third of the rows
    b = rng.integers(0, 5, n)
    c = (a * 3 + rng.integers(0, 2, n)) % 40
    x = rng.normal(size=(n, 2)) + 100
    y = x @ [2.0, -1.0] + np.sin(a) * 30 + b * 4 + rng.normal(size=n)
    test = rng.random(n) < 0.25
    rows = [
        (i, bool(test[i]), f"a{a[i]:05d}" if a[i] % 11 else None, f"b{b[i]}" if test[i] or b[i] < 4 else f"b{b[i]}", f"c{c[i]}", float(x[i, 0]), float(x[i, 1]), float(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, is_test boolean, ta string, tb string, tc string, x0 double, x1 double, y double")


def dense(df, levels, alpha=1.0):
    """Test RMSE and predictions with one 0/1 column per level."""
    pdf = df.toPandas()
    tr = ~pdf["is_test"].to_numpy()
    cols = [pdf["x0"].to_numpy(), pdf["x1"].to_numpy()]
    for c in levels:
        known = sorted(pdf.loc[tr, c].dropna().unique())
        cols += [(pdf[c] == v).to_numpy(float) for v in known[1:]]
    x, y = np.stack(cols, 1), pdf["y"].to_numpy()
    mx, my = x[tr].mean(0), y[tr].mean()
    xc = x[tr] - mx
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y[tr] - my))
    pred = (x - mx) @ w + my
    return float(np.sqrt(np.mean((pred - y)[~tr] ** 2))), dict(zip(pdf["id"], pred, strict=True)), x.shape[1] - 2


@pytest.mark.parametrize("levels, there", [(["ta"], False), (["ta", "tb"], False), (["ta", "tb", "tc"], False), (["ta", "tb"], True)])
def test_equals_dummy_columns(spark, levels, there, monkeypatch):
    if there:
        monkeypatch.setattr(L, "ON_DRIVER", 10)
    df = planted(spark, n=600 if there else 3000, wide=40 if there else 1500)
    want, pred, slots = dense(df, levels)
    mo = L.level_moments(df, ["x0", "x1"], "y", levels)
    w, b = L.ridge(mo.train)
    assert mo.slots == slots and abs(L.test_rmse(mo.test, w, b) - want) < 1e-7
    got = {r["id"]: r["prediction"] for r in mo.predict(df, ["x0", "x1"], w, b).collect()}
    assert max(abs(got[i] - v) for i, v in pred.items()) < 1e-6


def test_wide_join_and_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(L, "SMALL", 0)
    df = planted(spark, n=800, wide=60).withColumn("none", F.lit(None).cast("string")).withColumn("one", F.lit("same"))
    want, pred, _ = dense(df, ["ta"])
    mo = L.level_moments(df, ["x0", "x1"], "y", ["none", "ta", "one"])
    w, b = L.ridge(mo.train)
    assert abs(L.test_rmse(mo.test, w, b) - want) < 1e-7
    got = {r["id"]: r["prediction"] for r in mo.predict(df, ["x0", "x1"], w, b).collect()}
    assert len(got) == 800 and max(abs(got[i] - v) for i, v in pred.items()) < 1e-6
    none = L.level_moments(df, ["x0", "x1"], "y", ["none", "one"])
    assert none.slots == 0 and none.effects is None
    only = L.level_moments(df, [], "y", ["ta"])
    assert L.ridge(only.train)[0].shape == (0,) and L.test_rmse(only.test, np.zeros(0), L.ridge(only.train)[1]) > 0


def test_rows_without_a_level_are_spread(spark):
    df = spark.range(8000).withColumn("t", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")))
    table = df.where("t is not null").select(F.col("t").alias("__l"), F.lit(1.0).alias("__w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = L.join_levels(df, table, "t", small=False)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 8000 and max(sizes) < 2000 and out.where("__w = 1").count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
