"""Tree fits on weighted cells against the rows they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.operators import cells as C
from sparkmend.operators import models as M
from sparkmend.operators import split as S
from sparkmend.operators import tune as TU


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(3)
    n = 3000
    x, z = rng.normal(size=n), rng.randint(0, 5, size=n)
    y = np.where(x > 0.3, 10.0, 0.0) + z + rng.normal(size=n) * 0.1
    data = [(i, float(x[i]) if i % 50 else None, float(z[i]), float(y[i]), "b" if y[i] > 7 else "a") for i in range(n)]
    return spark.createDataFrame(data, "k long, x double, z double, y double, c string").repartition(4).persist()


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(C, "ROWS", 100)


def test_cells_hold_every_row_and_sum(rows, small):
    got = C.collapse(rows, ["x", "z"], ["c"], sums=[F.sum("y").alias("s")])
    row = got.frame.agg(F.sum("__n"), F.sum("s"), F.count_distinct("x"), F.count_if(F.col("x").isNull())).first()
    assert row[0] == got.n == 3000 and row[1] == pytest.approx(rows.agg(F.sum("y")).first()[0])
    assert row[2] == C.BINS and row[3] > 0  # 32 quantile bins, and the missing ones apart
    assert got.bins.cuts["z"] is None and got.frame.count() <= 33 * 5 * 2
    # the bins hold about as many rows each
    share = got.frame.where("x IS NOT NULL").groupBy("x").agg(F.sum("__n").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert share[0] > 70 and share[1] < 115


def test_units_keep_rows_and_minimum(rows, small, monkeypatch):
    got = C.collapse(rows, ["z"], ["c"])
    for args, most in (((), 1), ((7,), 7)):
        u = got.units(*args)
        assert u.agg(F.sum("__w")).first()[0] == pytest.approx(3000)
        per = u.groupBy("z", "c").agg(F.count(F.lit(1)).alias("u"), F.sum("__w").alias("w")).collect()
        assert all(r["u"] == min(most, round(r["w"])) for r in per)
    assert got.units(draws=True).count() == 3000  # few rows: a draw is a row
    monkeypatch.setattr(C, "UNITS", 1000)
    assert 1000 <= got.units(draws=True).count() <= 1010


def test_cuts_at_the_ends_of_the_doubles(spark, small):
    v = [float("-inf"), -1.7976931348623157e308, 1.7976931348623157e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v[i % 5] if i % 2 else float(i),) for i in range(400)], "x double")
    got = C.collapse(df, ["x"])
    assert got.frame.agg(F.sum("__n")).first()[0] == 400
    assert got.frame.where("x IS NULL").first()["__n"] == 40


def test_boosted_regressor_on_cells_equals_rows(rows, monkeypatch):
    p = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3}
    d = rows.withColumn("x", F.round("x", 0)).na.fill({"x": 0.0})  # few values: the same cuts
    by_row = M.predict_regressor(M.fit_gbt_regressor(d, ["x", "z"], "y", p), d, ["x", "z"], "a")
    monkeypatch.setattr(C, "ROWS", 100)
    fit = M.fit_gbt_regressor(d, ["x", "z"], "y", p)
    assert isinstance(fit, M.BinnedRegressor)
    both = M.predict_regressor(fit, by_row, ["x", "z"], "b")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-6


@pytest.mark.parametrize("model", ["gbt", "rf"])
def test_classifiers_on_cells_predict_rows(rows, small, model):
    d = rows.where("x IS NOT NULL")
    fit = M.fit_classifier(d, ["x", "z"], "c", model, {"n_estimators": 10, "max_depth": 4, "max_features": "all", "min_samples_leaf": 2})
    assert fit.bins is not None
    assert M.metric_value(fit.predict(d), "c", "pred_label", "accuracy") > 0.97


def test_fold_scores_on_cells_are_those_of_rows(rows, small):
    """A tree's score from the held-out cells is the score over held-out rows."""
    d = S.kfold(rows.na.fill({"x": 0.0}), "k", 3).withColumn("__ylog", F.log1p("y")).persist()
    p = {"model": "gbt_r", "n_estimators": 3, "max_depth": 2, "learning_rate": 0.5}
    for log in (False, True):
        cells = TU._fold_cells(d, "fold", 1, ["x", "z"], "y", "regression", log, None)
        got = TU._cell_score(cells, ["x", "z"], "y", p, "regression", log, None)
        mdl = M.fit_gbt_regressor(d, ["x", "z"], "__ylog" if log else "y", p, cells=cells[0])
        pr = M.predict_regressor(mdl, d.where("fold = 1"), ["x", "z"], "p")
        pr = pr.withColumn("p", F.expm1("p")) if log else pr
        assert got == pytest.approx(M.metric_value(pr, "y", "p", "rmse"), rel=1e-9)
    cells = TU._fold_cells(d, "fold", 1, ["x", "z"], "c", "classification", False, None)
    q = {"model": "gbt", "n_estimators": 3, "max_depth": 2}
    fit = M.fit_classifier(d, ["x", "z"], "c", "gbt", q, cells=cells[0])
    assert TU._cell_score(cells, ["x", "z"], "c", q, "classification", False, None) == pytest.approx(M.metric_value(fit.predict(d.where("fold = 1")), "c", "pred_label", "accuracy"))


def test_forests_keep_the_node_of_each_row(rows, small, monkeypatch):
    monkeypatch.setattr(C, "PER_TASK", 1000)
    d = C.collapse(rows, ["x", "z"], ["c"]).units(draws=True)
    assert d.rdd.getNumPartitions() == 3  # a task per thousand units
    few = rows.where("k < 80 AND x IS NOT NULL").coalesce(1)
    fit = M.fit_classifier(few, ["x", "z"], "c", "rf", {"n_estimators": 5})
    assert fit.model.getCacheNodeIds()
    from pyspark.ml.classification import RandomForestClassifier

    est = RandomForestClassifier(featuresCol="features", labelCol="__label", numTrees=5, maxDepth=30, seed=42)
    plain = est.fit(M._assemble(fit.indexer.transform(few), ["x", "z"]))
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(fit.model) == trees(plain)


def test_a_task_fits_few_thousand_rows():
    assert C.PER_TASK <= C.ROWS  # a forest's rows meet every tree: 65,536 units keep eight tasks busy


def test_counting_values_reads_the_rows_once(spark, small):
    """One pass tells features of many values from those of few (two scans in Python before)."""
    acc = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        acc.add(1)
        return float(x)

    for k in (31, 32, 33, 40):
        df = spark.range(2000).select((F.col("id") % k * 1.7 - 3.4).alias("a"), F.when(F.col("id") > 9, F.col("id") % 7 + 0.5).alias("b"), F.lit(float("nan")).alias("c"))
        assert C._few_values(df, ["a", "b", "c"]) == (2000, [k <= C.BINS, True, True])
    df = spark.range(2000).select(seen("id").alias("a"))
    assert C._few_values(df, ["a"]) == (2000, [False])
    assert acc.value == 2000
    zeros = spark.range(2000).select(F.expr("if(id % 2 = 0, -0.0D, 0.0D) + id % 32").alias("a"), F.lit(None).cast("double").alias("b"))
    assert C._few_values(zeros, ["a", "b"]) == (2000, [True, True])


def test_rows_of_one_task_are_spread(spark, monkeypatch):
    from sparkmend.sources import io

    one = spark.range(0, 4000, 1, 1).withColumn("k", F.lit(1))
    assert io.spread(one).rdd.getNumPartitions() == 1  # too few rows for a shuffle
    monkeypatch.setattr(io, "SPREAD_ROWS", 100)
    got = io.spread(one)
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 4000 and max(per) <= 2000 and got.columns == ["id", "k"]
    assert got.agg(F.sum("id")).first()[0] == 3999 * 2000
    even = spark.range(0, 4000, 1, 64)
    assert io.spread(even) is even and io.spread(one.where("false")).count() == 0


def test_training_rows_are_released(spark):
    from sparkmend.plans import catalog_models as CM

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    d = spark.range(100).withColumn("x", F.col("id") * 2)
    with CM._kept(d, "x") as kept:
        assert kept.columns == ["x"] and kept.storageLevel.useMemory and kept.storageLevel.useDisk
        kept.count()
    assert not kept.storageLevel.useMemory
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_texts_are_measured_once(spark):
    from sparkmend.plans.catalog_profile import documents_faulted

    plan = documents_faulted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "parquet" not in plan


def test_small_lookups_are_broadcast(spark):
    from sparkmend.plans import catalog_models as CM
    from sparkmend.session import cut_lineage

    best = cut_lineage(spark.range(50).withColumnRenamed("id", "k"))
    rows = spark.range(1000).select((F.col("id") % 60).alias("k"))
    for most, hinted in ((50, True), (49, False)):
        joined = rows.join(CM._joinable(best, most), "k", "left")
        assert ("strategy=broadcast" in joined._jdf.queryExecution().optimizedPlan().toString()) is hinted and joined.count() == 1000
