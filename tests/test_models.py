"""Moments, CV and search helpers against direct computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.operators import features as FE
from sparkmend.operators import gram
from sparkmend.operators import levels as L
from sparkmend.operators import models as M
from sparkmend.operators import split as S
from sparkmend.operators import tune as TU


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(5)
    X = rng.normal(size=(600, 3)) * [1.0, 100.0, 0.01]
    y = X @ [1.5, 0.02, 300.0] + rng.normal(size=600)
    rows = [(i, *map(float, x), float(t)) for i, (x, t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y double"), X, y


def test_gram_moments_match_numpy(data):
    df, X, y = data
    (n, S_, G), shift = gram.moments(df, ["a", "b", "c", "y"])
    Z = np.column_stack([X, y]) - shift
    assert n == 600
    assert np.allclose(S_, Z.sum(0)) and np.allclose(G, Z.T @ Z)


def test_linear_stats_of_few_and_many_columns_agree(data):
    df, X, y = data
    small = M.linear_stats(df, ["a", "b", "c"], "y")
    wide = df.withColumn("d", F.col("a") * 0 + 1.0).withColumn("e", F.col("b") * 2)
    big = M.linear_stats(wide, ["a", "b", "c", "d", "e"], "y")
    assert np.allclose(small.cov_xx, big.cov_xx[:3, :3]) and np.allclose(small.cov_xy, big.cov_xy[:3])
    assert small.mean_y == pytest.approx(big.mean_y)


def test_fold_moment_ridge_equals_direct_fit(data):
    df, X, y = data
    d = S.kfold(df, "k", 3)
    mom = TU.fold_moments(d, ["a", "b", "c"], "y", "fold", 3)
    fast = TU.cv_score(d, "fold", 3, ["a", "b", "c"], "y", {"model": "ridge", "alpha": 2.0}, "regression", moments=mom)
    slow = TU.cv_score(d, "fold", 3, ["a", "b", "c"], "y", {"model": "ridge", "alpha": 2.0}, "regression", moments=None)
    assert np.allclose(fast, slow, rtol=1e-9)


def test_greedy_test_rmse_from_moments_equals_pass(data):
    df, X, y = data
    d = S.train_test_split(df, "k")
    mo = L.level_moments(d, ["a", "b", "c"], "y")
    w, b = L.ridge(mo.train, cols=[0, 2])
    fast = L.test_rmse(mo.test, w, b)
    assert FE.BorderedRidge(mo, [0]).score(2) == pytest.approx(fast, rel=1e-9)
    m = M.fit_linear(d.where(~F.col("is_test")), ["a", "c"], "y", "ridge", alpha=1.0)
    slow = M.metric_value(d.where(F.col("is_test")).withColumn("p", m.predict_col()), "y", "p", "rmse")
    assert fast == pytest.approx(slow, rel=1e-9)


def test_draws_are_seeded_and_in_range():
    a = TU.draw_trials("log_target", 30, 7)
    assert a == TU.draw_trials("log_target", 30, 7)
    for t in a:
        if t["model"] == "ridge":
            assert 1e-4 <= t["alpha"] <= 1e3
        if t["model"] == "gbt_r":
            assert 50 <= t["n_estimators"] <= 400 and t["n_estimators"] % 50 == 0 and 2 <= t["max_depth"] <= 8
    for t in TU.draw_trials("scaled_knn", 30, 1):
        assert 1 <= t["n_neighbors"] <= 30 and (t["metric"] != "minkowski" or 1 <= t["p"] <= 4)


def test_best_trial_ties_lowest(spark):
    rows = [(0, "m", "{}", "rmse", 2.0, "[]"), (1, "m", "{}", "rmse", 1.0, "[]"), (2, "m", "{}", "rmse", 1.0, "[]")]
    trials = spark.createDataFrame(rows, TU.TRIAL_SCHEMA)
    assert TU.best_trial(trials, "rmse").first()["trial"] == 1
    assert TU.best_trial(trials, "accuracy").first()["trial"] == 0
    assert json.loads(trials.first()["params"]) == {}
