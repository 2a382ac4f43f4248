"""Invariants of the operators on planted-fault fixtures (our own values)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmend.functions import exprs as X
from sparkmend.operators import correlate as C
from sparkmend.operators import fixes as FX
from sparkmend.operators import knn as K
from sparkmend.operators import models as M
from sparkmend.operators import profile as P
from sparkmend.operators import split as S
from sparkmend.operators.quantiles import exact_quantiles
from sparkmend.operators.rank import hash_rank
from sparkmend.sources import io

SF = "/root/testdata/sf0.001"


def _lin(vals, p):
    v = sorted(vals)
    h = (len(v) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


def test_exact_quantiles_match_linear_rule_with_ties(spark):
    rng = np.random.RandomState(1)
    vals = list(rng.randint(0, 7, 3000).astype(float)) + list(rng.normal(size=2000))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(df, ["x"], probs)["x"]
    for p, g in zip(probs, got):
        assert g == pytest.approx(_lin(vals, p), abs=1e-12)


def test_exact_quantiles_narrowing_path(spark):
    from sparkmend.config import ProfileConfig

    cfg = ProfileConfig(quantile_accuracy=50, quantile_max_bracket=40)
    vals = [float(i % 997) * 1.5 for i in range(20000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.9], cfg)["x"]
    for p, g in zip([0.25, 0.5, 0.9], got):
        assert g == pytest.approx(_lin(vals, p))


def test_hash_rank_equals_global_row_number(spark):
    ev = io.table(spark, SF, "events")
    got = hash_rank(ev, ["event_id"], 42, by=["event_type"], bits=4).select("event_id", "_rank")
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(X.row_hash(["event_id"], 42), "event_id")
    ref = ev.select("event_id", F.row_number().over(w).alias("_rank"))
    assert sorted(got.collect()) == sorted(ref.collect())


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_row_choice_does_not_depend_on_partitioning(spark, parts):
    ev = io.table(spark, SF, "events").repartition(parts)
    nul = io.inject_nulls(ev, {"value": 0.1}, "event_id")
    assert nul.where(F.col("value").isNull()).count() == int(ev.count() * 0.1)
    chosen = sorted(r[0] for r in nul.where(F.col("value").isNull()).select("event_id").collect())
    base = io.inject_nulls(io.table(spark, SF, "events"), {"value": 0.1}, "event_id")
    assert chosen == sorted(r[0] for r in base.where(F.col("value").isNull()).select("event_id").collect())
    s1 = S.train_test_split(ev, "event_id").where("is_test").select("event_id").collect()
    s2 = S.train_test_split(io.table(spark, SF, "events"), "event_id").where("is_test").select("event_id").collect()
    assert sorted(s1) == sorted(s2)


def test_folds_disjoint_complete_and_stratified(spark):
    lab = io.table(spark, "/root/testdata/sf0.01", "labels")
    f = S.stratified_kfold(lab, "doc_id", "toxic", 5).cache()
    assert f.count() == lab.count()
    assert f.select("doc_id").distinct().count() == lab.count()
    shares = f.groupBy("toxic", "fold").count().collect()
    by = {}
    for r in shares:
        by.setdefault(r["toxic"], []).append(r["count"])
    for counts in by.values():
        assert max(counts) - min(counts) <= 1
    k = S.kfold(lab, "doc_id", 5, exact=True).groupBy("fold").count().collect()
    assert max(r["count"] for r in k) - min(r["count"] for r in k) <= 1


def test_impute_and_scale_properties(spark):
    ev = io.inject_nulls(io.table(spark, SF, "events"), {"value": 0.2}, "event_id")
    for strat in ("mean", "median"):
        out = FX.impute(ev, ["value"], strat)
        assert out.where(F.col("value").isNull()).count() == 0
    sc = FX.scale(FX.impute(ev, ["value", "user_id"], "mean"), ["value", "user_id"], "standard")
    row = sc.agg(F.avg("value"), F.stddev_pop("value")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9
    mm = FX.scale(ev, ["value"], "minmax").agg(F.min("value"), F.max("value")).first()
    assert mm[0] == pytest.approx(0.0) and mm[1] == pytest.approx(1.0)


def test_constant_and_zero_variance_edges(spark):
    df = spark.createDataFrame([(float(i), 42.0, float(i % 3)) for i in range(100)], "a double, const double, t double")
    assert FX.scale(df, ["const"], "standard").agg(F.max(F.abs("const"))).first()[0] == 0.0
    assert FX.scale(df, ["const"], "minmax").agg(F.max("const")).first()[0] == 0.0
    names = ["a", "const", "t"]
    vals = {(names[r["i"]], names[r["j"]]): r["r"] for r in C.corr_frame(df, names).collect()}
    assert vals[("a", "const")] == 0.0
    out, report, _d, _h = C.filter_features(df, "t")
    assert "const" in report["dropped_low_target_corr"]
    sm = P.scale_mismatch(df.select("const")).first()
    assert sm["mismatch"] is False


def test_log1p_expm1_roundtrip(spark):
    df = spark.createDataFrame([(float(x),) for x in [0.0, 1.0, 10.0, 1234.5]], "x double")
    back = df.select(X.expm1_clip(F.log1p("x")).alias("y"), "x").collect()
    for r in back:
        assert r["y"] == pytest.approx(r["x"], rel=1e-12)


def test_coerce_numeric_rules(spark):
    vals = ["1e5", " 3 ", "abc", "NaN", "inf", "1d", "", "-2.5", ".5", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(X.coerce_numeric(F.col("s"))).collect()]
    assert got[0] == 1e5 and got[1] == 3.0 and got[2] is None and got[3] is None
    assert got[4] == float("inf") and got[5] is None and got[6] is None and got[7] == -2.5 and got[8] == 0.5 and got[9] is None
    wd = P.wrong_dtypes(spark.createDataFrame([(" 3 ",), ("1e5",), (None,)], "s string")).collect()
    assert [r["col_name"] for r in wd] == ["s"]
    empty = P.wrong_dtypes(spark.createDataFrame([(None,)], "s string")).collect()
    assert empty == []


def test_skew_g1_small_n_and_flags(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert P.skewness_report(df).count() == 0
    docs = io.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["col_name"]: r["skew"] for r in P.skewness_report(docs).collect()}
    assert "n_chars" in rows and rows["n_chars"] > 3


def test_class_imbalance_edges(spark):
    single = spark.createDataFrame([(1,)] * 10, "y int")
    r = P.class_imbalance(single, "y").first()
    assert r["ratio"] == 1.0 and r["imbalanced"] is False
    tie = spark.createDataFrame([(1,)] * 10 + [(2,)] + [(3,)], "y int")
    r = P.class_imbalance(tie, "y").first()
    assert r["minority"] == "2" and r["imbalanced"] is True
    reg = spark.createDataFrame([(i,) for i in range(11)], "y int")
    assert P.class_imbalance(reg, "y").count() == 0
    assert P.class_imbalance(reg.limit(10), "y").count() == 1


def test_ridge_matches_closed_form_and_lasso_kkt(spark):
    rng = np.random.RandomState(0)
    X_ = rng.normal(size=(400, 3))
    y = X_ @ np.array([2.0, -1.0, 0.0]) + rng.normal(scale=0.5, size=400) + 3
    df = spark.createDataFrame([tuple(map(float, row)) + (float(t),) for row, t in zip(X_, y)], "a double, b double, c double, y double")
    m = M.fit_linear(df, ["a", "b", "c"], "y", "ridge", alpha=1.0)
    Xc = X_ - X_.mean(0)
    w = np.linalg.solve(Xc.T @ Xc + np.eye(3), Xc.T @ (y - y.mean()))
    assert np.allclose(m.coef, w, atol=1e-8)
    assert m.intercept == pytest.approx(y.mean() - X_.mean(0) @ w)
    alpha = 0.3
    la = M.fit_linear(df, ["a", "b", "c"], "y", "lasso", alpha=alpha)
    grad = Xc.T @ (y - y.mean() - Xc @ la.coef) / len(y)
    for g, wj in zip(grad, la.coef):
        if wj != 0:
            assert g == pytest.approx(alpha * np.sign(wj), abs=1e-6)
        else:
            assert abs(g) <= alpha + 1e-6


@pytest.mark.parametrize("metric,p", [("euclidean", 2), ("manhattan", 1), ("chebyshev", 2), ("minkowski", 3)])
def test_knn_join_equals_brute_force(spark, metric, p):
    rng = np.random.RandomState(3)
    L = rng.normal(size=(60, 4))
    R = np.vstack([rng.normal(size=(150, 4)), rng.normal(size=(50, 4)) + 5, L[:5]])  # clusters and exact hits
    ldf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(L)], "lk long, v array<double>")
    rdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(R)], "rk long, v array<double>")
    got = K.knn_join(ldf, rdf, "lk", "rk", k=7, vec="v", metric=metric, p=p).collect()
    d = np.abs(L[:, None, :] - R[None, :, :])
    D = {"euclidean": np.sqrt((d * d).sum(2)), "manhattan": d.sum(2), "chebyshev": d.max(2), "minkowski": (d**p).sum(2) ** (1 / p)}[metric]
    for r in got:
        order = sorted(range(len(R)), key=lambda j: (D[r["lk"], j], j))
        assert order[r["rank"] - 1] == r["rk"]
        assert r["dist"] == pytest.approx(D[r["lk"], r["rk"]], rel=1e-9, abs=1e-12)
    assert len(got) == 60 * 7


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    oh = FX.one_hot(df, ["s"]).collect()
    assert [list(r.asDict()) for r in oh][0] == ["s_b", "s_c"]
    assert [tuple(r) for r in oh] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    codes = [r[0] for r in FX.category_codes(df, ["s"]).collect()]
    assert codes == [1, 0, -1, 2]
    joined = sorted(r[0] for r in FX.category_codes_join(df, "s").collect())
    assert joined == [-1, 0, 1, 2]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    out = [r[0] for r in FX.clip_outliers(df, ["x"]).collect()]
    assert out[-1] is None and max(v for v in out if v is not None) < 1000


def test_wrong_dtypes_sample_by_key(spark):
    rows = [(i, str(i * 1.5) if i < 60 else "text") for i in range(100)]
    df = spark.createDataFrame(rows, "k long, s string")
    assert [r["col_name"] for r in P.wrong_dtypes(df, sample=50, key="k").collect()] == ["s"]
    assert P.wrong_dtypes(df).count() == 0


def test_histogram_density_integrates_to_one(spark):
    docs = io.table(spark, SF, "documents")
    h = P.histogram(docs, "n_chars", 40).collect()
    assert len(h) == 40
    total = sum(r["density"] * (r["hi"] - r["lo"]) for r in h)
    assert total == pytest.approx(1.0)
    assert sum(r["count"] for r in h) == docs.count()


def test_extract_code_and_metric(spark):
    texts = ["```python\nx = 1\n```", "pre ```Python\r\ny = 2\n``` post", "```\nz = 3\n```", "plain ```js text", "no fence"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.extract_code(F.col("t"))).collect()]
    assert got == ["x = 1", "y = 2", "z = 3", "plain  text", "no fence"]
    m = spark.createDataFrame([("step 3 New RMSLE: 0.4312",), ("nothing",)], "t string")
    assert [r[0] for r in m.select(X.extract_metric(F.col("t"))).collect()] == [0.4312, None]


def test_category_codes_join_equals_sorted_rank(spark):
    vals = [f"lv{(i * 7919) % 1000:04d}" for i in range(3000)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, s string").repartition(5)
    got = {r["k"]: r["s"] for r in FX.category_codes_join(df, "s", n_ranges=7).collect()}
    order = {v: i for i, v in enumerate(sorted({v for v in vals if v is not None}))}
    for k, v in enumerate(vals):
        assert got[k] == (order[v] if v is not None else -1)


def test_one_hot_vector_matches_columns(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    vec = [list(r[0].toArray()) for r in FX.one_hot_vector(df, "s").collect()]
    cols = [list(map(float, r)) for r in FX.one_hot(df, ["s"]).collect()]
    assert vec == cols
