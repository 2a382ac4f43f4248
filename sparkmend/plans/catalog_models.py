"""Registered queries: models, metrics, KNN, evaluation, features, tuning,
user steps and the whole pipeline (SURVEY 2.3, 2.4 metrics, 2.9-2.11,
2.13, 2.14)."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import row_hash_sql
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import fixes as FX
from ..operators import knn as K
from ..operators import models as M
from ..operators import profile as P
from ..operators import split as S
from ..operators import tune as TU
from ..session import cut_lineage
from ..sources import io
from . import catalog_fixes as FXQ
from .catalog_profile import EVENT_COLS, documents_faulted, documents_health
from .common import faulted_events, faulted_events_sql, memo, rounded
from .pipeline import run_pipeline
from .registry import query
from .sqlgen import gram_sql, guarded_corr_sql, health_sql, level_ridge_ctes, means_sql, missing_sql, residual_sql, ridge_sql, union

T = io.table
FE_SQL = faulted_events_sql()
LI_SPLIT = f"(SELECT *, ({row_hash_sql(['l_orderkey'], 42)} % 100) < 20 AS is_test FROM lineitem)"
EMB_SPLIT = f"(SELECT *, ({row_hash_sql(['vec_id'], 42)} % 100) < 20 AS is_test FROM embeddings)"
CLS_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "ship_day"]


def lineitem_split(spark, sf):
    d = T(spark, sf, "lineitem").withColumn("ship_day", F.datediff(F.col("l_shipdate"), F.lit("1992-01-01")).cast("double"))
    return S.train_test_split(d, "l_orderkey")


# ── linear family ───────────────────────────────────────────────────────────


@query(
    "fit_linear",
    f"""SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 6) AS coef FROM {LI_SPLIT} WHERE NOT is_test
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 6) FROM {LI_SPLIT} WHERE NOT is_test""",
)
def q_fit_linear(spark, sf):
    d = lineitem_split(spark, sf)
    return rounded(M.fit_linear(d.where(~F.col("is_test")), ["l_quantity"], "l_extendedprice", "linear").coef_frame(spark))


def _ridge2_sql(alpha: float = 1.0) -> str:
    s = f"""(SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
        covar_pop(l_quantity, l_quantity) * count(*) + {alpha} AS a11, covar_pop(l_quantity, l_discount) * count(*) AS a12,
        covar_pop(l_discount, l_discount) * count(*) + {alpha} AS a22,
        covar_pop(l_quantity, l_extendedprice) * count(*) AS b1, covar_pop(l_discount, l_extendedprice) * count(*) AS b2
     FROM {LI_SPLIT} WHERE NOT is_test)"""
    w = f"(SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM {s})"
    return f"""SELECT 'intercept' AS term, round(my - w1 * m1 - w2 * m2, 6) AS coef FROM {w}
UNION ALL SELECT 'l_quantity', round(w1, 6) FROM {w}
UNION ALL SELECT 'l_discount', round(w2, 6) FROM {w}"""


@query("fit_ridge", _ridge2_sql(1.0))
def q_fit_ridge(spark, sf):
    d = lineitem_split(spark, sf)
    return rounded(M.fit_linear(d.where(~F.col("is_test")), ["l_quantity", "l_discount"], "l_extendedprice", "ridge", alpha=1.0).coef_frame(spark))


def _cd_sql(l1: float, l2: float, sweeps: int = 300) -> str:
    """Coordinate descent for 1/2 w'Gw - c'w + l1|w|_1 + l2/2|w|^2 on the
    covariance of three features, written as a recursive CTE (an independent
    solver for the oracle)."""
    x = ["l_quantity", "l_discount", "l_tax"]
    g = ", ".join(f"covar_pop({a}, {b}) AS g{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x) if i <= j)
    c = ", ".join(f"covar_pop({a}, l_extendedprice) AS c{i}" for i, a in enumerate(x))
    m = ", ".join(f"avg({a}) AS m{i}" for i, a in enumerate(x))

    def soft(z):
        return f"(sign({z}) * greatest(abs({z}) - {l1}, 0.0))"

    return f"""WITH RECURSIVE st AS (SELECT {g}, {c}, {m}, avg(l_extendedprice) AS my FROM {LI_SPLIT} WHERE NOT is_test),
cd(it, w0, w1, w2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT it + 1, n0, n1, n2 FROM (
    SELECT it, {soft('c0 - g01 * w1 - g02 * w2')} / (g00 + {l2}) AS n0,
           {soft('c1 - g01 * n0 - g12 * w2')} / (g11 + {l2}) AS n1,
           {soft('c2 - g02 * n0 - g12 * n1')} / (g22 + {l2}) AS n2
    FROM cd, st WHERE it < {sweeps}))
SELECT 'intercept' AS term, round(my - m0 * w0 - m1 * w1 - m2 * w2, 4) AS coef FROM cd, st WHERE it = {sweeps}
UNION ALL SELECT 'l_quantity', round(w0, 4) FROM cd WHERE it = {sweeps}
UNION ALL SELECT 'l_discount', round(w1, 4) FROM cd WHERE it = {sweeps}
UNION ALL SELECT 'l_tax', round(w2, 4) FROM cd WHERE it = {sweeps}"""


@query("fit_lasso", _cd_sql(10.0, 0.0))
def q_fit_lasso(spark, sf):
    d = lineitem_split(spark, sf)
    m = M.fit_linear(d.where(~F.col("is_test")), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lasso", alpha=10.0)
    return rounded(m.coef_frame(spark), 4)


@query("fit_elasticnet", _cd_sql(1.0 * 0.5, 1.0 * 0.5))
def q_fit_elasticnet(spark, sf):
    d = lineitem_split(spark, sf)
    m = M.fit_linear(d.where(~F.col("is_test")), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "elasticnet", alpha=1.0, l1_ratio=0.5)
    return rounded(m.coef_frame(spark), 4)


# ── classifiers and regressors (Spark ML) ───────────────────────────────────

# a target that the features explain up to noise: l_qty_noisy (quantity plus a
# hashed 0-10), as number, as two classes and as three
_NOISY = FXQ._LCF
_BAND = "CASE WHEN l_qty_noisy < 18 THEN 'low' WHEN l_qty_noisy < 38 THEN 'mid' ELSE 'high' END"
_HALF = "CASE WHEN l_qty_noisy > 30 THEN 'b' ELSE 'a' END"
TREE_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def noisy_split(spark, sf):
    d = FXQ.lineitem_corr_frame(spark, sf, ["l_orderkey", "l_linenumber", "l_partkey", *TREE_FEATS])
    return S.train_test_split(d.withColumn("band", F.expr(_BAND)).withColumn("half", F.expr(_HALF)), "l_orderkey")


_NOISY_SPLIT = f"(SELECT *, {_BAND} AS band, {_HALF} AS half, ({row_hash_sql(['l_orderkey'], 42)} % 100) < 20 AS is_test FROM {_NOISY})"


def _newton_sql(steps: int = 12) -> str:
    """L2 logistic regression of ``half`` on two scaled features by Newton
    steps: (1/n) sum logloss + |w|^2 / (2n), intercept free."""
    return f"""WITH RECURSIVE raw AS MATERIALIZED (SELECT l_quantity AS a, l_discount AS b, CAST(half = 'b' AS DOUBLE) AS y FROM {_NOISY_SPLIT} WHERE NOT is_test),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM raw),
d AS MATERIALIZED (SELECT (a - ma) / sa AS x1, (b - mb) / sb AS x2, y FROM raw, st),
it(k, b0, b1, b2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1,
    b0 - (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / det,
    b1 - (g0 * (h02 * h12 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / det,
    b2 - (g0 * (h01 * h12 - h02 * h11) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
    SELECT k, b0, b1, b2, sum(p - y) AS g0, sum((p - y) * x1) + b1 AS g1, sum((p - y) * x2) + b2 AS g2,
           sum(v) AS h00, sum(v * x1) AS h01, sum(v * x2) AS h02, sum(v * x1 * x1) + 1 AS h11, sum(v * x1 * x2) AS h12, sum(v * x2 * x2) + 1 AS h22
    FROM (SELECT *, p * (1 - p) AS v FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it, d WHERE k < {steps}))
    GROUP BY k, b0, b1, b2)))
SELECT 'intercept' AS term, round(b0, 3) AS coef, 2 AS n_classes FROM it WHERE k = {steps}
UNION ALL SELECT 'l_quantity', round(b1, 3), 2 FROM it WHERE k = {steps}
UNION ALL SELECT 'l_discount', round(b2, 3), 2 FROM it WHERE k = {steps}"""


@query("fit_logistic", _newton_sql())
def q_fit_logistic(spark, sf):
    feats = ["l_quantity", "l_discount"]
    d = noisy_split(spark, sf)
    train = d.where(~F.col("is_test"))
    train = FX.apply_scale(train, FX.scale_params(train, feats, "standard"))
    fit = M.fit_classifier(train, feats, "half", "logistic", {"C": 1.0, "tol": 1e-12})
    coefs = [("intercept", float(fit.model.intercept))] + list(zip(feats, map(float, fit.model.coefficients)))
    rows = [(t, round(c, 3), int(fit.model.numClasses)) for t, c in coefs]
    return spark.createDataFrame(rows, "term string, coef double, n_classes int")


@query("fit_logistic_classes")
def q_fit_logistic_classes(spark, sf):
    d = lineitem_split(spark, sf)
    # the scale mismatch is repaired first (standard scaler fitted on the
    # training rows), as the repair plan would; the L2 objective is
    # ill-conditioned on raw prices and day numbers
    d = FX.apply_scale(d, FX.scale_params(d.where(~F.col("is_test")), CLS_FEATS, "standard"))
    fit = M.fit_classifier(d.where(~F.col("is_test")), CLS_FEATS, "l_returnflag", "logistic", {"C": 1.0})
    return fit.predict(d.where(F.col("is_test"))).select("l_orderkey", "l_linenumber", "l_returnflag", F.col("pred_label").alias("prediction"))


# What trees grown by another engine must share: one row per test row, labels
# seen in training, and a score as good as looking the row's quantity up in the
# training rows (most frequent class, mean) up to SLACK.  100 boosted trees fit
# the noise of a few thousand rows, so the regressor's bound is the wider one.
SLACK, SLACK_RMSE = 0.02, 0.1


def _lookup_sql(label: str) -> str:
    return f"""WITH s AS MATERIALIZED (SELECT * FROM {_NOISY_SPLIT}),
best AS (SELECT l_quantity, {label} AS guess FROM (SELECT l_quantity, {label}, count(*) AS n FROM s WHERE NOT is_test GROUP BY ALL)
         QUALIFY row_number() OVER (PARTITION BY l_quantity ORDER BY n DESC, {label}) = 1)
SELECT l_orderkey, l_linenumber, s.{label} AS label, true AS seen_label,
       round((SELECT avg(CAST(t.{label} = guess AS DOUBLE)) FROM s t JOIN best USING (l_quantity) WHERE t.is_test), 6) AS lookup_accuracy,
       true AS as_good FROM s WHERE is_test"""


@contextmanager
def _kept(train, *cols):
    """These columns of the training rows, hashed and split once for all passes of
    a fit: in memory, on disk where that lacks, released at the end."""
    narrow = train.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield narrow
    finally:
        narrow.unpersist()


def _joinable(guesses, most=100_000):
    """A stored look-up table, broadcast up to so many rows: the test rows stay where they are."""
    return F.broadcast(guesses) if guesses.limit(most + 1).count() <= most else guesses


def _classify(spark, sf, label, model, params):
    d = noisy_split(spark, sf)
    test = d.where(F.col("is_test"))
    w = Window.partitionBy("l_quantity").orderBy(F.col("n").desc(), F.col(label))
    with _kept(d.where(~F.col("is_test")), *TREE_FEATS, label) as train:
        fit = M.fit_classifier(train, TREE_FEATS, label, model, params)
        best = cut_lineage(train.groupBy("l_quantity", label).agg(F.count("*").alias("n")))
    out = fit.predict(test)
    best = best.withColumn("r", F.row_number().over(w)).where("r = 1").select("l_quantity", F.col(label).alias("guess"))
    both = out.join(_joinable(best), "l_quantity", "left")
    got, lookup = both.agg(M.accuracy_expr(label, "pred_label"), F.avg((F.col(label) == F.col("guess")).cast("double"))).first()
    return out.select(
        "l_orderkey", "l_linenumber", F.col(label).alias("label"), F.col("pred_label").isin(fit.indexer.labels).alias("seen_label"),
        F.lit(round(lookup, 6)).alias("lookup_accuracy"), F.lit(got >= lookup - SLACK).alias("as_good"),
    )


@query("fit_random_forest", _lookup_sql("band"))
def q_fit_random_forest(spark, sf):
    return _classify(spark, sf, "band", "rf", {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 1, "max_features": "sqrt"})


@query("fit_gbt_classifier", _lookup_sql("half"))
def q_fit_gbt_classifier(spark, sf):
    return _classify(spark, sf, "half", "gbt", {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1})


@query(
    "fit_gbt_regressor",
    f"""WITH s AS MATERIALIZED (SELECT * FROM {_NOISY_SPLIT}),
best AS (SELECT l_quantity, avg(l_qty_noisy) AS guess FROM s WHERE NOT is_test GROUP BY l_quantity)
SELECT l_orderkey, l_linenumber, round(l_qty_noisy, 6) AS l_qty_noisy, true AS in_range,
       round((SELECT sqrt(avg(power(t.l_qty_noisy - guess, 2))) FROM s t JOIN best USING (l_quantity) WHERE t.is_test), 6) AS lookup_rmse,
       true AS as_good FROM s WHERE is_test""",
)
def q_fit_gbt_regressor(spark, sf):
    d = noisy_split(spark, sf)
    test, y = d.where(F.col("is_test")), F.col("l_qty_noisy")
    with _kept(d.where(~F.col("is_test")), *TREE_FEATS, "l_qty_noisy") as train:
        mdl = M.fit_gbt_regressor(train, TREE_FEATS, "l_qty_noisy", {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.1})
        best = cut_lineage(train.groupBy("l_quantity").agg(F.avg(y).alias("guess"), F.min(y).alias("lo"), F.max(y).alias("hi")))
    out = M.predict_regressor(mdl, test, TREE_FEATS, "prediction")
    lo, hi = best.agg(F.min("lo"), F.max("hi")).first()
    both = out.join(_joinable(best), "l_quantity", "left")
    got, lookup = both.agg(M.rmse_expr("l_qty_noisy", "prediction"), M.rmse_expr("l_qty_noisy", "guess")).first()
    pad = (hi - lo) / 10  # boosted sums may step a little outside
    return rounded(
        out.select(
            "l_orderkey", "l_linenumber", "l_qty_noisy", F.col("prediction").between(lo - pad, hi + pad).alias("in_range"),
            F.lit(round(lookup, 6)).alias("lookup_rmse"), F.lit(got <= lookup * (1 + SLACK_RMSE)).alias("as_good"),
        )
    )


# targets that the features settle: any tree learner finds the cuts, so the
# predictions themselves are compared, row by row
_CUT_FEATS = ["l_linenumber", "disc", "tax"]
_ZONE = "CASE WHEN l_linenumber <= 2 THEN 'front' WHEN disc >= 6 THEN 'deep' ELSE 'rest' END"
_PAIR = "CASE WHEN l_linenumber <= 3 AND disc < 5 THEN 'in' ELSE 'out' END"
_STEP = "CASE WHEN l_linenumber <= 3 THEN 100.0 ELSE 0.0 END + CASE WHEN disc >= 5 THEN 10.0 ELSE 0.0 END"
_CUT_SRC = f"""(SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS INTEGER) AS disc, ({row_hash_sql(['l_orderkey'], 42)} % 100) < 20 AS is_test FROM lineitem)"""


def _cut_split(spark, sf):
    d = io.spread(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"))
    d = d.withColumn("disc", F.round(F.col("l_discount") * 100).cast("int")).withColumn("tax", F.round(F.col("l_tax") * 100).cast("int"))
    d = d.withColumn("zone", F.expr(_ZONE)).withColumn("pair", F.expr(_PAIR)).withColumn("step", F.expr(_STEP).cast("double"))
    d = S.train_test_split(d, "l_orderkey")
    return d.where(~F.col("is_test")), d.where(F.col("is_test"))


def _cut_classes(spark, sf, label, model, params):
    train, test = _cut_split(spark, sf)
    with _kept(train, *_CUT_FEATS, label) as rows:
        fit = M.fit_classifier(rows, _CUT_FEATS, label, model, params)
    return fit.predict(test).select("l_orderkey", "l_linenumber", F.col(label).alias("label"), F.col("pred_label").alias("prediction"))


@query("fit_random_forest_cuts", f"SELECT l_orderkey, l_linenumber, {_ZONE} AS label, {_ZONE} AS prediction FROM {_CUT_SRC} WHERE is_test")
def q_fit_random_forest_cuts(spark, sf):
    return _cut_classes(spark, sf, "zone", "rf", {"n_estimators": 100, "max_depth": 8})


@query("fit_gbt_classifier_cuts", f"SELECT l_orderkey, l_linenumber, {_PAIR} AS label, {_PAIR} AS prediction FROM {_CUT_SRC} WHERE is_test")
def q_fit_gbt_classifier_cuts(spark, sf):
    return _cut_classes(spark, sf, "pair", "gbt", {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.1})


@query("fit_gbt_regressor_cuts", f"SELECT l_orderkey, l_linenumber, CAST({_STEP} AS DOUBLE) AS y, CAST({_STEP} AS DOUBLE) AS prediction FROM {_CUT_SRC} WHERE is_test")
def q_fit_gbt_regressor_cuts(spark, sf):
    train, test = _cut_split(spark, sf)
    with _kept(train, *_CUT_FEATS, "step") as rows:
        mdl = M.fit_gbt_regressor(rows, _CUT_FEATS, "step", {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.1})
    out = M.predict_regressor(mdl, test, _CUT_FEATS, "prediction")
    return out.select("l_orderkey", "l_linenumber", F.col("step").alias("y"), F.round("prediction", 3).alias("prediction"))


@query(
    "log_target_regression",
    f"""WITH fit AS (SELECT regr_slope(ln(1 + l_extendedprice), l_quantity) AS b, regr_intercept(ln(1 + l_extendedprice), l_quantity) AS a
                FROM {LI_SPLIT} WHERE NOT is_test),
pr AS (SELECT l_extendedprice AS y, exp(least(greatest(a + b * l_quantity, -10.0), 20.0)) - 1 AS p FROM {LI_SPLIT}, fit WHERE is_test)
SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(sqrt(avg(power(ln(1 + y) - ln(1 + greatest(p, 0)), 2))), 6) AS rmsle FROM pr""",
)
def q_log_target_regression(spark, sf):
    d = lineitem_split(spark, sf)
    predict = M.fit_log_target(d.where(~F.col("is_test")), ["l_quantity"], "l_extendedprice", "linear")
    pr = predict(d.where(F.col("is_test")))
    return rounded(pr.agg(M.rmse_expr("l_extendedprice", "prediction").alias("rmse"), M.rmsle_expr("l_extendedprice", "prediction").alias("rmsle")))


# ── metrics ─────────────────────────────────────────────────────────────────

_RULE = "CASE WHEN l_shipdate > TIMESTAMP '1995-06-17 00:00:00' THEN 'N' ELSE 'R' END"


@query("metric_accuracy", f"SELECT round(avg(CAST(l_returnflag = {_RULE} AS DOUBLE)), 6) AS accuracy FROM lineitem")
def q_metric_accuracy(spark, sf):
    d = T(spark, sf, "lineitem").withColumn("pred", F.when(F.col("l_shipdate") > F.lit("1995-06-17 00:00:00").cast("timestamp_ntz"), "N").otherwise("R"))
    return rounded(M.metric(d, "l_returnflag", "pred", "accuracy"))


@query("metric_rmse", "SELECT round(sqrt(avg(power(l_extendedprice - (l_quantity * 1000.0 + 20000.0), 2))), 6) AS rmse FROM lineitem")
def q_metric_rmse(spark, sf):
    d = T(spark, sf, "lineitem").withColumn("pred", F.col("l_quantity") * 1000.0 + 20000.0)
    return rounded(M.metric(d, "l_extendedprice", "pred", "rmse"))


@query("metric_rmsle", "SELECT round(sqrt(avg(power(ln(1 + l_extendedprice) - ln(1 + greatest(l_quantity * 1000.0 - 5000.0, 0)), 2))), 6) AS rmsle FROM lineitem")
def q_metric_rmsle(spark, sf):
    d = T(spark, sf, "lineitem").withColumn("pred", F.col("l_quantity") * 1000.0 - 5000.0)
    return rounded(M.metric(d, "l_extendedprice", "pred", "rmsle"))


@query("target_std", "SELECT round(coalesce(stddev_samp(l_extendedprice), 0.0), 6) AS score FROM lineitem WHERE l_extendedprice IS NOT NULL")
def q_target_std(spark, sf):
    return rounded(P.target_std(T(spark, sf, "lineitem"), "l_extendedprice", "regression"))


# ── KNN ─────────────────────────────────────────────────────────────────────

_DIST = "sqrt(list_sum(list_transform(list_zip(l.embedding, r.embedding), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)))))"
_PAIRS = f"""(SELECT l.vec_id, r.vec_id AS nb_id, r.label AS nb_label, {_DIST} AS dist
   FROM (SELECT * FROM {EMB_SPLIT} WHERE is_test) l, (SELECT * FROM {EMB_SPLIT} WHERE NOT is_test) r)"""
_TOP5 = f"(SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nb_id) AS rank FROM {_PAIRS} QUALIFY rank <= 5)"


def emb_split(spark, sf):
    return S.train_test_split(T(spark, sf, "embeddings"), "vec_id")


@query("knn_join", f"SELECT vec_id, nb_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM {_TOP5}")
def q_knn_join(spark, sf):
    d = emb_split(spark, sf)
    right = d.where(~F.col("is_test")).select(F.col("vec_id").alias("nb_id"), "embedding")
    return rounded(K.knn_join(d.where(F.col("is_test")), right, "vec_id", "nb_id", k=5, vec="embedding"))


@query("knn_join_approx")
def q_knn_join_approx(spark, sf):
    """Every row whose id is divisible by 20 against all rows."""
    d = T(spark, sf, "embeddings")
    right = d.select(F.col("vec_id").alias("nb_id"), "embedding")
    return rounded(K.knn_join(d.where("vec_id % 20 = 0"), right, "vec_id", "nb_id", k=10, vec="embedding", exclude_self=True, mode="approx"))


@query(
    "knn_classify",
    f"""SELECT t.vec_id, t.label, v.prediction FROM (SELECT * FROM {EMB_SPLIT} WHERE is_test) t LEFT JOIN
(SELECT vec_id, nb_label AS prediction FROM (SELECT vec_id, nb_label, count(*) AS votes FROM {_TOP5} GROUP BY vec_id, nb_label)
 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, nb_label) = 1) v ON t.vec_id = v.vec_id""",
)
def q_knn_classify(spark, sf):
    d = emb_split(spark, sf)
    return K.knn_classify(d.where(~F.col("is_test")), d.where(F.col("is_test")), "vec_id", "label", k=5, vec="embedding")


# ── evaluation ──────────────────────────────────────────────────────────────


_BASE_SQL = f"""WITH d AS (SELECT event_id, user_id, value, ({row_hash_sql(['event_id'], 42)} % 100) < 20 AS is_test FROM {FE_SQL} WHERE value IS NOT NULL),
mu AS (SELECT avg(user_id) AS mu FROM d WHERE NOT is_test),
di AS (SELECT CAST(event_id AS DOUBLE) AS x1, coalesce(CAST(user_id AS DOUBLE), (SELECT mu FROM mu)) AS x2, value AS y, is_test FROM d),
s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
             covar_pop(x1, x1) * count(*) + 1.0 AS a11, covar_pop(x1, x2) * count(*) AS a12, covar_pop(x2, x2) * count(*) + 1.0 AS a22,
             covar_pop(x1, y) * count(*) AS b1, covar_pop(x2, y) * count(*) AS b2 FROM di WHERE NOT is_test),
w AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM s)
SELECT 'regression' AS task_type, 'rmse' AS metric,
       round(sqrt(avg(power(y - (my - w1 * m1 - w2 * m2 + w1 * x1 + w2 * x2), 2))), 6) AS score, 2 AS n_features
FROM di, w WHERE is_test"""


@query("baseline_score", _BASE_SQL)
def q_baseline_score(spark, sf):
    s = EV.baseline_score(faulted_events(spark, sf), "value", "event_id", task="regression")
    return spark.createDataFrame([(s.task, s.metric, round(s.value, 6), s.n_features)], "task_type string, metric string, score double, n_features int")


@memo
def _events_eval(spark, sf):
    df = faulted_events(spark, sf)
    plan = FX.recommend_fixes(P.health_report(df, target="value", task="regression"), "value")
    return EV.evaluate_fix(df, plan, "value", "event_id", task="regression")


# fixed values: the plan that the events table gets (missing user ids filled
# with the training median, both text columns encoded)
_EV_SPLIT = f"(SELECT *, ({row_hash_sql(['event_id'], 42)} % 100) < 20 AS is_test FROM {FE_SQL})"
_EV_MEAN = f"(SELECT * REPLACE (coalesce(CAST(user_id AS DOUBLE), (SELECT avg(user_id) FROM {_EV_SPLIT} WHERE NOT is_test AND value IS NOT NULL)) AS user_id) FROM {_EV_SPLIT})"
_EV_MEDIAN = f"(SELECT * REPLACE (coalesce(CAST(user_id AS DOUBLE), (SELECT quantile_cont(user_id, 0.5) FROM {_EV_SPLIT} WHERE NOT is_test)) AS user_id) FROM {_EV_SPLIT})"
_EV_NUMS = {"event_id": "event_id", "user_id": "user_id"}
_EV_CATS = ["event_type", "props"]


def _ev_scores() -> str:
    return f"""{level_ridge_ctes('b', _EV_MEAN, 'value', _EV_NUMS, [])},
{level_ridge_ctes('f', _EV_MEDIAN, 'value', _EV_NUMS, _EV_CATS)},
ev AS (SELECT b.rmse AS rb, f.rmse AS ra, greatest((b.rmse - f.rmse) / b.rmse, 0.0) AS rw, (SELECT count(*) FROM f_lv) AS nl FROM b_rmse b, f_rmse f)"""


@query(
    "evaluate_fix",
    f"""WITH {_ev_scores()}
SELECT 'regression' AS task_type, 'rmse' AS metric, round(rb, 4) AS before, round(ra, 4) AS after, round(rw, 4) AS reward, rw > 0 AS improved,
       2 AS n_features_before, CAST(2 + nl AS INTEGER) AS n_features_after, CAST(NULL AS VARCHAR) AS exec_error FROM ev""",
)
def q_evaluate_fix(spark, sf):
    return _events_eval(spark, sf)[0]


@query(
    "compare_scores",
    f"""WITH {_ev_scores()}
SELECT 'before' AS stage, 'rmse' AS metric, round(rb, 4) AS value FROM ev UNION ALL SELECT 'after', 'rmse', round(ra, 4) FROM ev""",
)
def q_compare_scores(spark, sf):
    return EV.compare_scores(_events_eval(spark, sf)[0])


# a target that follows a text column of some thousand levels
WIDE_LEVELS = 1100


def _wide_sql() -> str:
    src = f"""(SELECT *, ({row_hash_sql(['l_rid'], 42)} % 100) < 20 AS is_test FROM (
  SELECT l_orderkey * 10 + l_linenumber AS l_rid, l_quantity, 's' || (l_partkey * 7 + l_suppkey) % {WIDE_LEVELS} AS tag,
         CAST((l_partkey * 7 + l_suppkey) % {WIDE_LEVELS} * 131 % 977 AS DOUBLE) + l_quantity + l_tax * 100 AS y FROM lineitem))"""
    nums = {"l_rid": "l_rid", "l_quantity": "l_quantity"}
    return f"""WITH {level_ridge_ctes('b', src, 'y', nums, [])},
t AS MATERIALIZED (SELECT * FROM {src}),
lv AS MATERIALIZED (SELECT tag, count(*) AS n FROM t WHERE NOT is_test GROUP BY tag),
one AS (SELECT min(tag) AS f FROM lv),
{_one_text_ridge('t', ['l_rid', 'l_quantity'], 'tag', 'y')},
ev AS (SELECT b.rmse AS rb, f.rmse AS ra, greatest((b.rmse - f.rmse) / b.rmse, 0.0) AS rw FROM b_rmse b, f_rmse f)
SELECT 'regression' AS task_type, 'rmse' AS metric, round(rb, 4) AS before, round(ra, 4) AS after, round(rw, 4) AS reward, rw > 0 AS improved,
       2 AS n_features_before, CAST(1 + (SELECT count(*) FROM lv) AS INTEGER) AS n_features_after, CAST(NULL AS VARCHAR) AS exec_error FROM ev"""


def _one_text_ridge(src: str, nums: list[str], cat: str, y: str) -> str:
    """CTE ``f_rmse`` of a ridge (alpha 1) on two numeric columns and one text
    column of any width, by block elimination: the level block is diagonal."""
    z = ["1.0", *[f"({c} - m{j})" for j, c in enumerate(nums)], f"({y} - my)"]
    m = len(z)
    r = [f"sum({x})" for x in z]
    g = ", ".join(f"sum({z[i]} * {z[j]}) AS g{i}{j}" for i in range(m) for j in range(i, m))
    a = ", ".join(f"{r[i]} / (count(*) + 1.0) AS a{i}" for i in range(m))
    rr = ", ".join(f"{r[i]} AS r{i}" for i in range(m))
    e = ", ".join(f"sum(r{i} * a{j}) AS e{i}{j}" for i in range(m) for j in range(i, m))
    s = ", ".join(f"g{i}{j} - e{i}{j} AS s{i}{j}" for i in range(m) for j in range(i, m))
    c = lambda i, j: f"(s{min(i, j)}{max(i, j)} - s0{i} * s0{j} / s00 + {1.0 if i == j and i < 3 else 0.0})"
    det = f"({c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(1, 2)})"
    pred = "w0 + w1 * z1 + w2 * z2 + coalesce(a3 - w0 * a0 - w1 * a1 - w2 * a2, 0.0)"
    return f"""f_mu AS MATERIALIZED (SELECT {', '.join(f'avg({c}) AS m{j}' for j, c in enumerate(nums))}, avg({y}) AS my FROM {src} WHERE NOT is_test),
f_g AS (SELECT {g} FROM {src}, f_mu WHERE NOT is_test),
f_a AS MATERIALIZED (SELECT {cat} AS lvl, {rr}, {a} FROM {src}, f_mu, one WHERE NOT is_test AND {cat} > f GROUP BY {cat}),
f_e AS (SELECT {e} FROM f_a),
f_s AS (SELECT {s} FROM f_g, f_e),
f_w AS (SELECT ({c(1, 3)} * {c(2, 2)} - {c(2, 3)} * {c(1, 2)}) / {det} AS w1, ({c(2, 3)} * {c(1, 1)} - {c(1, 3)} * {c(1, 2)}) / {det} AS w2, s03 / s00 AS b, s01 / s00 AS b1, s02 / s00 AS b2 FROM f_s),
f_k AS (SELECT w1, w2, b - w1 * b1 - w2 * b2 AS w0 FROM f_w),
f_rmse AS (SELECT sqrt(avg((t - p) * (t - p))) AS rmse FROM (
  SELECT {z[3]} AS t, {pred} AS p FROM (SELECT x.*, {z[1]} AS z1, {z[2]} AS z2, m0, m1, my FROM {src} x, f_mu WHERE is_test) x
  LEFT JOIN f_a ON f_a.lvl = x.{cat}, f_k))"""


@query("evaluate_fix_wide", _wide_sql())
def q_evaluate_fix_wide(spark, sf):
    tag = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % WIDE_LEVELS
    d = T(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_rid"), "l_quantity", F.concat(F.lit("s"), tag).alias("tag"),
        ((tag * 131 % 977).cast("double") + F.col("l_quantity") + F.col("l_tax") * 100).alias("y"),
    )
    plan = [{"seq": 1, "issue": "dtype", "col_name": "tag", "action": "one_hot", "params": '{"drop_first": true}'}]
    return EV.evaluate_fix(d, plan, "y", "l_rid", task="regression", expand=False)[0]


@query("check_nulls_cleared", missing_sql(FE_SQL, ["value", "user_id", "event_type"]))
def q_check_nulls_cleared(spark, sf):
    return EV.check_nulls_cleared(faulted_events(spark, sf), ["value", "user_id", "event_type"])


@query(
    "check_encoded",
    "SELECT column_name AS col_name, 'text_feature' AS problem FROM information_schema.columns "
    "WHERE table_name = 'orders' AND data_type = 'VARCHAR' AND column_name <> 'o_orderstatus'",
)
def q_check_encoded(spark, sf):
    return EV.check_encoded(T(spark, sf, "orders"), "o_orderstatus")


def emb_wide(spark, sf, dims: int | None = None):
    """embeddings with one double column per dimension (all dimensions)."""
    d = T(spark, sf, "embeddings")
    dims = dims or int(d.agg(F.max(F.size("embedding"))).first()[0])
    return d.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)])


@memo
def _scaling_checks(spark, sf):
    """The scaling task on real rows: embeddings with one dimension blown up
    by 1500; the fix is a standard scaler fitted on training rows."""
    d = S.train_test_split(io.inject_scale(emb_wide(spark, sf), "f0", 1500.0), "vec_id")
    feats = [c for c in d.columns if c.startswith("f") and c[1:].isdigit()]
    tr, te = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    acc_b = M.metric_value(K.knn_classify(tr, te, "vec_id", "label", 5, feats=feats), "label", "prediction", "accuracy")
    prm = FX.scale_params(tr, feats, "standard")
    tr_s, te_s = FX.apply_scale(tr, prm), FX.apply_scale(te, prm)
    acc_a = M.metric_value(K.knn_classify(tr_s, te_s, "vec_id", "label", 5, feats=feats), "label", "prediction", "accuracy")
    mism_before = P.scale_mismatch(d.select(*feats)).first()["mismatch"]
    mism_after = P.scale_mismatch(FX.apply_scale(d, prm).select(*feats)).first()["mismatch"]
    return acc_b, acc_a, mism_before, mism_after


@query("check_improvement")
def q_check_improvement(spark, sf):
    acc_b, acc_a, _mb, _ma = _scaling_checks(spark, sf)
    ok, detail = EV.check_improvement(acc_b, acc_a, "accuracy_gain")
    return spark.createDataFrame([("accuracy_gain", round(acc_b, 6), round(acc_a, 6), ok, detail)], "rule string, before double, after double, passed boolean, detail string")


@query("scorecard")
def q_scorecard(spark, sf):
    acc_b, acc_a, mb, ma = _scaling_checks(spark, sf)
    checks = {
        # the scaled frame was scored: a failed fit, apply or prediction leaves NaN
        "runs": (acc_a == acc_a, "scaler fitted and applied"),
        "scale_fixed": (bool(mb) and not ma, f"mismatch before={mb} after={ma}"),
        "accuracy_gain": EV.check_improvement(acc_b, acc_a, "accuracy_gain"),
    }
    return EV.scorecard("scaling", checks)


@query("scorecard_missing")
def q_scorecard_missing(spark, sf):
    plan = FX.recommend_fixes(documents_health(spark, sf), "toxic")
    return EV.grade_missing(documents_faulted(spark, sf), plan, "toxic", "doc_id", ["quality", "words_txt", "n_chars", "n_bytes"])


# a price that grows exponentially with the quantity
_SKEW_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _skewed_lines(spark, sf):
    d = T(spark, sf, "lineitem")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    return d.select(line, *_SKEW_FEATS, (F.exp(F.col("l_quantity") * 0.3) * (1 + F.col("l_discount"))).alias("y"))


def _skew_sql() -> str:
    src = f"""(SELECT *, ln(1 + y) AS ylog, ({row_hash_sql(['line'], 42)} % 100) < 20 AS is_test FROM (
  SELECT l_orderkey * 10 + l_linenumber AS line, {', '.join(_SKEW_FEATS)}, exp(l_quantity * 0.3) * (1 + l_discount) AS y FROM lineitem))"""
    nums = {c: c for c in _SKEW_FEATS}
    pred = "(SELECT rid, sum(z * w) + (SELECT my FROM {0}_mu) AS p FROM {0}_ent JOIN {0}_w USING (i) WHERE is_test GROUP BY rid)"
    err = "sqrt(avg(pow(ln(1 + {0}) - ln(1 + greatest({1}, 0.0)), 2)))"
    return f"""WITH t AS MATERIALIZED (SELECT * FROM {src} ORDER BY line),
{level_ridge_ctes('b', 't', 'y', nums, [])},
{level_ridge_ctes('g', 't', 'ylog', nums, [])},
sc AS (SELECT (SELECT {err.format('s.y', 'p')} FROM b_src s JOIN {pred.format('b')} USING (rid)) AS rb,
  (SELECT {err.format('exp(s.y) - 1', 'exp(least(greatest(p, -10.0), 20.0)) - 1')} FROM g_src s JOIN {pred.format('g')} USING (rid)) AS ra,
  (SELECT {err.format('exp(s.y) - 1', 'p')} FROM g_src s JOIN {pred.format('g')} USING (rid)) AS rl),
sk AS (SELECT skewness(y) AS s0, skewness(ylog) AS s1 FROM t)"""


@query(
    "check_improvement_rmsle",
    _skew_sql() + """
SELECT 'rmsle_half' AS rule, round(rb, 6) AS before, round(ra, 6) AS after, ra < rb * 0.5 AS passed,
       printf('RMSLE %.4f vs threshold %.4f', ra, rb * 0.5) AS detail FROM sc""",
)
def q_check_improvement_rmsle(spark, sf):
    got = EV.rmsle_scores(_skewed_lines(spark, sf), _SKEW_FEATS, "y", "line")
    ok, detail = EV.check_improvement(got["before"], got["after"], "rmsle_half")
    return spark.createDataFrame(
        [("rmsle_half", round(got["before"], 6), round(got["after"], 6), ok, detail)], "rule string, before double, after double, passed boolean, detail string"
    )


@query(
    "scorecard_skew",
    _skew_sql() + """,
c AS (SELECT 'log_target' AS "check", CASE WHEN abs(s0) > 3.0 AND abs(s1) <= 3.0 THEN 0.4 ELSE 0.0 END::DOUBLE AS points, abs(s0) > 3.0 AND abs(s1) <= 3.0 AS passed,
             printf('skew %.4f -> %.4f', s0, s1) AS detail FROM sk
      UNION ALL SELECT 'inverse', CASE WHEN ra < rl THEN 0.3 ELSE 0.0 END::DOUBLE, ra < rl, printf('RMSLE %.4f, on the log scale %.4f', ra, rl) FROM sc
      UNION ALL SELECT 'rmsle', CASE WHEN ra < rb * 0.5 THEN 0.3 ELSE 0.0 END::DOUBLE, ra < rb * 0.5, printf('RMSLE %.4f vs threshold %.4f', ra, rb * 0.5) FROM sc)
SELECT * FROM c
UNION ALL SELECT 'total', round(least(sum(points), 1.0), 2), round(least(sum(points), 1.0), 2) >= 1.0,
                 CASE WHEN round(least(sum(points), 1.0), 2) >= 1.0 THEN 'done' ELSE 'not done' END FROM c""",
)
def q_scorecard_skew(spark, sf):
    return EV.grade_skew(_skewed_lines(spark, sf), _SKEW_FEATS, "y", "line")


# ── features ────────────────────────────────────────────────────────────────

_PART_FEATS = ["p_partkey", "p_size", "p_retailprice"]


def _candidate_sql(cols) -> str:
    parts = [f"CASE WHEN {c} > -1 THEN ln(1 + {c}) END AS fe_log1p_{c}" for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            parts.append(f"CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / {b} END AS fe_ratio_{a}_{b}")
            parts.append(f"CAST({a} AS DOUBLE) * {b} AS fe_prod_{a}_{b}")
    body = ", ".join(parts)
    names = [p.rsplit(" AS ", 1)[1] for p in parts]
    return "SELECT p_partkey, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f" FROM (SELECT p_partkey, {body} FROM part)"


@query("candidate_features", _candidate_sql(_PART_FEATS))
def q_candidate_features(spark, sf):
    d = T(spark, sf, "part")
    cands = FE.candidate_features(d, "p_retailprice_target", cols=_PART_FEATS)
    return rounded(d.select("p_partkey", *[c.alias(n) for n, (c, _s) in cands.items()]))


@query(
    "candidate_features_limit",
    """SELECT p_partkey, round(CAST(p_retailprice AS DOUBLE) / (1 + p_size), 6) AS fe_price_per_size,
  round(CASE WHEN p_partkey > -1 THEN ln(1 + p_partkey) END, 6) AS fe_log1p_p_partkey, round(CASE WHEN p_size > -1 THEN ln(1 + p_size) END, 6) AS fe_log1p_p_size FROM part""",
)
def q_candidate_features_limit(spark, sf):
    """Own SQL first, then the rules' candidates up to the limit."""
    d = T(spark, sf, "part")
    own = {"fe_price_per_size": "CAST(p_retailprice AS DOUBLE) / (1 + p_size)"}
    cands = FE.candidate_features(d, "p_retailprice", cols=["p_partkey", "p_size"], limit=3, extra=own)
    return rounded(d.select("p_partkey", *[c.alias(n) for n, (c, _s) in cands.items()]))


_VALIDATE_SQL = """SELECT 'fe_price_per_size' AS attempt, count(CASE WHEN p_size = 0 THEN NULL ELSE p_retailprice / p_size END) > 0 AS ok,
       CASE WHEN count(CASE WHEN p_size = 0 THEN NULL ELSE p_retailprice / p_size END) > 0 THEN 'fe_price_per_size'
            ELSE 'New column ''fe_price_per_size'' is entirely NaN' END AS detail FROM part
UNION ALL SELECT 'bad_feature', false, 'New column ''bad_feature'' does not start with ''fe_'''
UNION ALL SELECT 'fe_empty', count(CASE WHEN p_size < 0 THEN 1.0 END) > 0,
       CASE WHEN count(CASE WHEN p_size < 0 THEN 1.0 END) > 0 THEN 'fe_empty' ELSE 'New column ''fe_empty'' is entirely NaN' END FROM part
UNION ALL SELECT 'two_new', false, 'Expected 1 new column, got 2: [''fe_a'', ''fe_b'']'
UNION ALL SELECT 'none_new', false, 'No new column was added'
UNION ALL SELECT 'fe_touched', false, 'Columns changed or lost: [''p_size'']'"""


@query("validate_feature", _VALIDATE_SQL)
def q_validate_feature(spark, sf):
    d = T(spark, sf, "part")
    before = d
    trials = {
        "fe_price_per_size": d.withColumn("fe_price_per_size", F.try_divide(F.col("p_retailprice"), F.col("p_size"))),
        "bad_feature": d.withColumn("bad_feature", F.col("p_size") * 10),
        "fe_empty": d.withColumn("fe_empty", F.when(F.col("p_size") < 0, F.lit(1.0))),
        "two_new": d.withColumn("fe_a", F.col("p_size")).withColumn("fe_b", F.col("p_size")),
        "none_new": d,
        "fe_touched": d.withColumn("p_size", F.col("p_size") + 1).withColumn("fe_touched", F.col("p_size")),
    }
    rows = [(name,) + FE.validate_feature(before, after) for name, after in trials.items()]
    return spark.createDataFrame(rows, "attempt string, ok boolean, detail string")


@memo
def _greedy(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag")
    cands = FE.candidate_features(d, "l_extendedprice", cols=["l_quantity", "l_discount", "l_tax"])
    return FE.greedy_features(d, "l_extendedprice", cands, "l_orderkey", task="regression")


_GREEDY_COLS = ["l_quantity", "l_discount", "l_tax"]


def _greedy_sql() -> str:
    """The keep-if-better walk over ridge scores from one train and one test
    Gram matrix (recursive CTE; a feature that is not in the model is masked)."""
    base = ["l_orderkey", *_GREEDY_COLS]
    cands = [(f"fe_log1p_{c}", f"CASE WHEN {c} > -1 THEN ln(1 + {c}) END") for c in _GREEDY_COLS]
    for i, a in enumerate(_GREEDY_COLS):
        for b in _GREEDY_COLS[i + 1 :]:
            cands.append((f"fe_ratio_{a}_{b}", f"CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / {b} END"))
            cands.append((f"fe_prod_{a}_{b}", f"CAST({a} AS DOUBLE) * {b}"))
    names, y = [n for n, _ in cands], "l_extendedprice"
    feats = base + names
    p, nb, nc = len(feats), len(base), len(cands)
    table = ", ".join(f"({i + 1}, '{n}', '{sql}')" for i, (n, sql) in enumerate(cands))
    made = ", ".join(f"{sql} AS {n}" for n, sql in cands)
    keys = ", ".join(["l_orderkey", *_GREEDY_COLS, y, "l_returnflag"])
    return f"""WITH RECURSIVE wide AS MATERIALIZED (SELECT {keys}, is_test, {made} FROM {LI_SPLIT}),
mu AS MATERIALIZED ({means_sql('wide', feats, y, 'NOT is_test')}),
tr AS MATERIALIZED ({gram_sql('wide', feats, y, 'NOT is_test', 'mu')}),
te AS MATERIALIZED ({gram_sql('wide', feats, y, 'is_test', 'mu')}),
cand(i, name, code) AS (VALUES {table}),
first AS (SELECT list_transform(range(1, {p + 1}), lambda i: CASE WHEN i <= {nb} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS mask),
walk(it, mask, cur, before, after, kept, room, misses) AS (
  SELECT 0, mask, s, s, s, false, greatest(1, CAST(floor(0.5 * {nb + 1}) AS INTEGER)), 0
  FROM (SELECT mask, {residual_sql('w', 'te.g', 'te.n', p)} AS s FROM (SELECT mask, {ridge_sql('tr.g', 'mask', p)} AS w FROM first, tr), te)
  UNION ALL
  SELECT it + 1, CASE WHEN new < cur THEN trial ELSE mask END, least(new, cur), cur, new, new < cur,
         room - CAST(new < cur AS INTEGER), CASE WHEN new < cur THEN 0 ELSE misses + 1 END
  FROM (SELECT it, mask, trial, cur, room, misses, {residual_sql('w', 'te.g', 'te.n', p)} AS new
        FROM (SELECT *, {ridge_sql('tr.g', 'trial', p)} AS w
              FROM (SELECT *, list_transform(mask, lambda x, i: CASE WHEN i = {nb} + it + 1 THEN 1.0::DOUBLE ELSE x END) AS trial
                    FROM walk WHERE it < {nc} AND room > 0 AND misses < 5), tr), te)),
last AS (SELECT mask FROM walk ORDER BY it DESC LIMIT 1)"""


_GREEDY_NAMES = [f"fe_log1p_{c}" for c in _GREEDY_COLS] + [
    f"fe_{kind}_{a}_{b}" for i, a in enumerate(_GREEDY_COLS) for b in _GREEDY_COLS[i + 1 :] for kind in ("ratio", "prod")
]


# every candidate is a column of the result, null where it was not kept
@query(
    "greedy_features",
    _greedy_sql()
    + f"\nSELECT {', '.join(['l_orderkey', *_GREEDY_COLS, 'l_extendedprice', 'l_returnflag'])}, "
    + ", ".join(f"CASE WHEN mask[{5 + i}] = 1 THEN round({n}, 6) END AS {n}" for i, n in enumerate(_GREEDY_NAMES))
    + " FROM wide, last",
)
def q_greedy_features(spark, sf):
    out = _greedy(spark, sf)[0]
    return rounded(out.withColumns({n: F.lit(None).cast("double") for n in _GREEDY_NAMES if n not in out.columns}))


@query(
    "feature_log",
    _greedy_sql()
    + """
SELECT it AS iteration, name AS feature_name, code, round(before, 4) AS metric_before, round(after, 4) AS metric_after,
       round(before - after, 4) AS delta, kept, CASE WHEN kept THEN 'Improved metric' ELSE 'No improvement' END AS reason
FROM walk JOIN cand ON cand.i = walk.it""",
)
def q_feature_log(spark, sf):
    return _greedy(spark, sf)[1]


# ── tuning ──────────────────────────────────────────────────────────────────


@memo
def _tune_generic(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")
    return TU.tune(d, "l_extendedprice", "l_orderkey", n_trials=6, cv_folds=3, preset="generic")


@memo
def _tune_log(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return TU.tune(d, "l_extendedprice", "l_orderkey", n_trials=4, cv_folds=3, preset="log_target")


_CV_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _cv_ridge_sql(k: int = 5) -> str:
    """Closed-form ridge per fold."""
    src = f"(SELECT *, {row_hash_sql(['l_orderkey'], 42, 'fold')} % {k} AS fold FROM lineitem)"
    ctes, rows = [], []
    p, y = len(_CV_FEATS), "l_extendedprice"
    for f in range(k):
        ctes += [
            f"m{f} AS ({means_sql(src, _CV_FEATS, y, f'fold <> {f}')})",
            f"a{f} AS ({gram_sql(src, _CV_FEATS, y, f'fold <> {f}', f'm{f}')})",
            f"b{f} AS ({gram_sql(src, _CV_FEATS, y, f'fold = {f}', f'm{f}')})",
        ]
        w = f"(SELECT {ridge_sql('g', '[1.0, 1.0, 1.0]', p)} AS w FROM a{f})"
        rows.append(f"SELECT 0 AS trial, {f} AS fold, round({residual_sql('w', 'g', 'n', p)}, 6) AS score FROM {w}, b{f}")
    return "WITH " + ",\n".join(ctes) + "\n" + union(rows)


@query("cv_score", _cv_ridge_sql())
def q_cv_score(spark, sf):
    d = T(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    d = S.kfold(d, "l_orderkey", 5)
    feats = ["l_quantity", "l_discount", "l_tax"]
    mom = TU.fold_moments(d, feats, "l_extendedprice", "fold", 5)
    sc = TU.cv_score(d, "fold", 5, feats, "l_extendedprice", {"model": "ridge", "alpha": 1.0}, "regression", moments=mom)
    return spark.createDataFrame([(0, f, round(s, 6)) for f, s in enumerate(sc)], "trial int, fold int, score double")


# ten ridge penalties of the search space
_RIDGES = [t for t in TU.draw_trials("regression", 60, 7) if t["model"] == "ridge"][:10]
_TUNE_FEATS = ["l_quantity", "l_discount", "l_tax", "l_line"]


def _tune_ridge_input(spark, sf):
    d = T(spark, sf, "lineitem")
    return d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").alias("l_line"), "l_extendedprice")


def _tune_ridge_sql(log: bool, k: int = 3) -> str:
    """(trial, fold, score) of every penalty: closed-form ridge per fold, on the
    price or on log1p of it with the error measured on the price."""
    y = "ylog" if log else "l_extendedprice"
    src = f"""(SELECT *, ln(1 + l_extendedprice) AS ylog, {row_hash_sql(['line'], 42, 'fold')} % {k} AS fold FROM (
  SELECT l_orderkey * 10 + l_linenumber AS line, l_quantity, l_discount, l_tax, l_linenumber AS l_line, l_extendedprice FROM lineitem))"""
    ctes, rows, p = [f"src AS MATERIALIZED (SELECT * FROM {src})"], [], len(_TUNE_FEATS)
    for f in range(k):
        ctes += [
            f"m{f} AS MATERIALIZED ({means_sql('src', _TUNE_FEATS, y, f'fold <> {f}')})",
            f"a{f} AS MATERIALIZED ({gram_sql('src', _TUNE_FEATS, y, f'fold <> {f}', f'm{f}')})",
            f"b{f} AS MATERIALIZED ({gram_sql('src', _TUNE_FEATS, y, f'fold = {f}', f'm{f}')})",
        ]
        for t, trial in enumerate(_RIDGES):
            w = f"(SELECT {ridge_sql('g', '[1.0, 1.0, 1.0, 1.0]', p, trial['alpha'])} AS w FROM a{f})"
            if log:
                pred = " + ".join(f"w[{i + 1}] * ({c} - m{i})" for i, c in enumerate(_TUNE_FEATS)) + f" + m{p}"
                score = f"(SELECT sqrt(avg(pow(l_extendedprice - (exp(least(greatest({pred}, -10.0), 20.0)) - 1), 2))) FROM src, m{f}, {w} WHERE fold = {f})"
                rows.append(f"SELECT {t} AS trial, {f} AS fold, {score} AS score")
            else:
                rows.append(f"SELECT {t} AS trial, {f} AS fold, {residual_sql('w', 'g', 'n', p)} AS score FROM {w}, b{f}")
    return "WITH " + ",\n".join(ctes) + ",\nsc AS MATERIALIZED (" + union(rows) + ")"


_TRIAL_TABLE = ", ".join(f"({i}, '{json.dumps(t, sort_keys=True)}')" for i, t in enumerate(_RIDGES))
_TRIALS_SQL = f"""(SELECT CAST(trial AS INTEGER) AS trial, 'ridge' AS model, params, 'rmse' AS metric, round(avg(score), 6) AS score FROM sc
  JOIN (VALUES {_TRIAL_TABLE}) t(i, params) ON i = trial GROUP BY trial, params)"""


@memo
def _tune_ridge(spark, sf):
    return TU.tune(_tune_ridge_input(spark, sf), "l_extendedprice", "line", cv_folds=3, preset="generic", trials=_RIDGES)


@memo
def _tune_ridge_log(spark, sf):
    return TU.tune(_tune_ridge_input(spark, sf), "l_extendedprice", "line", cv_folds=3, preset="log_target", trials=_RIDGES)


@query("tune_ridge_trials", f"{_tune_ridge_sql(False)}\nSELECT * FROM {_TRIALS_SQL}")
def q_tune_ridge_trials(spark, sf):
    return rounded(_tune_ridge(spark, sf)[0].drop("fold_scores"))


@query("tune_ridge_log_trials", f"{_tune_ridge_sql(True)}\nSELECT * FROM {_TRIALS_SQL}")
def q_tune_ridge_log_trials(spark, sf):
    return rounded(_tune_ridge_log(spark, sf)[0].drop("fold_scores"))


@query("best_trial_ridge", f"{_tune_ridge_sql(True)}\nSELECT * FROM {_TRIALS_SQL} ORDER BY score, trial LIMIT 1")
def q_best_trial_ridge(spark, sf):
    trials, summary = _tune_ridge_log(spark, sf)
    return rounded(TU.best_trial(trials, summary["metric"]).drop("fold_scores"))


@query("tune")
def q_tune(spark, sf):
    return rounded(_tune_generic(spark, sf)[0])


@query("best_trial")
def q_best_trial(spark, sf):
    trials, summary = _tune_generic(spark, sf)
    return rounded(TU.best_trial(trials, summary["metric"]))


@query("tune_log_target")
def q_tune_log_target(spark, sf):
    return rounded(_tune_log(spark, sf)[0])


@memo
def _tune_knn(spark, sf):
    return TU.tune(emb_wide(spark, sf), "label", "vec_id", n_trials=10, cv_folds=3, preset="scaled_knn")


@memo
def _tune_rf(spark, sf):
    docs = T(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    d = io.inject_nulls(lab.join(docs, "doc_id", "inner"), {"n_chars": 0.1}, "doc_id")
    return TU.tune(d, "quality", "doc_id", n_trials=3, cv_folds=3, preset="imputed_rf")


@query("tune_scaled_knn")
def q_tune_scaled_knn(spark, sf):
    return rounded(_tune_knn(spark, sf)[0])


@query("tune_imputed_rf")
def q_tune_imputed_rf(spark, sf):
    return rounded(_tune_rf(spark, sf)[0])


@query("compare_tuning")
def q_compare_tuning(spark, sf):
    """All four presets."""
    return rounded(TU.compare_tuning(spark, [run(spark, sf)[1] for run in (_tune_generic, _tune_log, _tune_knn, _tune_rf)]))


# ── user steps and the pipeline ─────────────────────────────────────────────


def _batch_fn(batches):
    for pdf in batches:
        pdf = pdf.copy()
        pdf["fe_value_abs"] = pdf["value"].abs()
        yield pdf


@query(
    "user_transform",
    "SELECT event_id, round(value, 6) AS value, round(value * value, 6) AS fe_value_sq, round(abs(value), 6) AS fe_value_abs FROM events",
)
def q_user_transform(spark, sf):
    from ..operators.udf import user_transform

    d = T(spark, sf, "events").select("event_id", "value")
    out, err = user_transform(d, lambda df: df.withColumn("fe_value_sq", F.col("value") * F.col("value")))
    out, err2 = user_transform(out, _batch_fn, batch_schema="event_id long, value double, fe_value_sq double, fe_value_abs double")
    if err or err2:
        raise RuntimeError(err or err2)
    return rounded(out)


def pipeline_input(spark, sf):
    return faulted_events(spark, sf)


def _pipeline_sql() -> str:
    """The summary: findings counted, the plan they ask for, ridge before and
    after (levels as features), the one candidate tried, and the filter, whose
    redundancy walk has nothing to do on these tables."""
    health = health_sql(FE_SQL, ["event_id", "user_id", "value"], ["event_type", "props"], EVENT_COLS[:-1], None)
    kinds = sorted(P.ISSUE_KINDS)
    js = " || ', ' || ".join(f"'\"{k}\": ' || count(*) FILTER (issue = '{k}')" for k in kinds)
    cand = f"(SELECT *, CASE WHEN u0 > -1 THEN ln(1 + u0) END AS fe FROM (SELECT *, user_id AS u0 FROM {_EV_MEDIAN}))"
    cand = f"(SELECT * REPLACE (coalesce(fe, (SELECT avg(fe) FROM {cand} WHERE NOT is_test AND value IS NOT NULL)) AS fe) FROM {cand})"
    return f"""WITH {_ev_scores()},
{level_ridge_ctes('k', cand, 'value', {**_EV_NUMS, 'fe': 'fe'}, _EV_CATS)},
rep AS MATERIALIZED ({health}),
plan AS (SELECT string_agg(action || ':' || col_name, ',' ORDER BY step, col_name) AS steps, count(*) AS n FROM (
  SELECT 2 AS step, 'impute_median' AS action, col_name FROM rep WHERE issue = 'missing_values' AND col_name NOT IN ('value', 'event_type', 'props')
  UNION ALL SELECT 3, 'one_hot', col_name FROM rep WHERE issue = 'dtype' AND detail = 'string'
  UNION ALL SELECT 4, 'clip_iqr', col_name FROM rep WHERE issue = 'outliers' AND col_name <> 'value')),
kept AS (SELECT k.rmse < f.rmse AS yes FROM k_rmse k, f_rmse f),
full_t AS MATERIALIZED (SELECT *, CASE WHEN user_id > -1 THEN ln(1 + user_id) END AS fe FROM {_EV_MEDIAN}),
lv AS (SELECT c, level FROM f_lv),
dums AS MATERIALIZED (SELECT c, level, (CASE WHEN c = 0 THEN 'event_type_' ELSE 'props_' END) || level AS name FROM lv),
cors AS (SELECT 0 AS o, 0 AS c, '' AS level, 'event_id' AS name, {guarded_corr_sql('event_id', 'value')} AS r FROM full_t
  UNION ALL SELECT 1, 0, '', 'user_id', {guarded_corr_sql('user_id', 'value')} FROM full_t
  UNION ALL SELECT 2, 0, '', 'fe_log1p_user_id', {guarded_corr_sql('fe', 'value')} FROM full_t, kept WHERE yes HAVING count(*) > 0
  UNION ALL SELECT 3, d.c, d.level, d.name, {guarded_corr_sql("(CASE WHEN coalesce(CASE WHEN d.c = 0 THEN t.event_type ELSE t.props END, '') = d.level THEN 1.0 ELSE 0.0 END)", 't.value')}
    FROM dums d, full_t t GROUP BY d.c, d.level, d.name),
low AS (SELECT coalesce(string_agg(chr(39) || name || chr(39), ', ' ORDER BY o, c, level), '') AS names, (SELECT count(*) FROM cors WHERE abs(r) >= 0.1) AS after FROM cors WHERE abs(r) < 0.1)
SELECT 1 AS step, 'task' AS stage, 'ok' AS status, 'n_classes_max' AS metric, 10.0::DOUBLE AS value, 'regression' AS detail
UNION ALL SELECT 2, 'profile', 'ok', 'issues', count(*) FILTER (issue <> 'dtype'), '{{' || {js} || '}}' FROM rep
UNION ALL SELECT 3, 'plan', 'ok', 'steps', n, steps FROM plan
UNION ALL SELECT 4, 'repair', 'ok', 'rmse', round(ra, 4), 'before=' || round(rb, 4) || ' reward=' || round(rw, 4) FROM ev
UNION ALL SELECT 5, 'features', 'ok', 'kept', CAST(yes AS INTEGER), CASE WHEN yes THEN 'fe_log1p_user_id' ELSE '' END FROM kept
UNION ALL SELECT 6, 'filter', 'ok', 'features_after', after, 'low=[' || names || '] redundant=[]' FROM low"""


@query("run_pipeline", _pipeline_sql())
def q_run_pipeline(spark, sf):
    return run_pipeline(pipeline_input(spark, sf), "value", "event_id")["summary"]



# ── SQL oracle for the scaling check (KNN accuracy before / after) ──────────


def _scaling_sql() -> str:
    h = row_hash_sql(["vec_id"], 42)
    base = f"""base AS (SELECT vec_id, label, ({h} % 100) < 20 AS is_test,
      list_transform(embedding, lambda x, i: CASE WHEN i = 1 THEN CAST(x AS DOUBLE) * 1500.0 ELSE CAST(x AS DOUBLE) END) AS v
    FROM embeddings),
dims AS (SELECT d, avg(x) AS mu, coalesce(nullif(stddev_pop(x), 0), 1.0) AS sd
         FROM (SELECT unnest(generate_series(1, len(v))) AS d, unnest(v) AS x FROM base WHERE NOT is_test) GROUP BY d),
st AS (SELECT list(mu ORDER BY d) AS mus, list(sd ORDER BY d) AS sds FROM dims),
sc AS (SELECT vec_id, label, is_test, list_transform(v, lambda x, i: (x - st.mus[i]) / st.sds[i]) AS v FROM base, st)"""

    def acc(src: str) -> str:
        dist = "sqrt(list_sum(list_transform(list_zip(l.v, r.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))))"
        return f"""(SELECT avg(CAST(CAST(t.label AS VARCHAR) = CAST(p.pred AS VARCHAR) AS DOUBLE)) FROM (SELECT * FROM {src} WHERE is_test) t LEFT JOIN
  (SELECT vec_id, nb_label AS pred FROM (
     SELECT vec_id, nb_label, count(*) AS votes FROM (
       SELECT l.vec_id, r.label AS nb_label, row_number() OVER (PARTITION BY l.vec_id ORDER BY {dist}, r.vec_id) AS rk
       FROM (SELECT * FROM {src} WHERE is_test) l, (SELECT * FROM {src} WHERE NOT is_test) r) WHERE rk <= 5
     GROUP BY vec_id, nb_label)
   QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, nb_label) = 1) p ON t.vec_id = p.vec_id)"""

    return f"""WITH {base},
a AS (SELECT {acc('base')} AS b, {acc('sc')} AS af)
SELECT 'accuracy_gain' AS rule, round(b, 6) AS before, round(af, 6) AS after, (af - b) >= 0.15 AS passed,
       printf('gain %+.4f (threshold 0.15)', af - b) AS detail FROM a"""


from .registry import ORACLES as _OR  # noqa: E402

_OR["check_improvement"] = _scaling_sql()


def _scorecard_sql() -> str:
    body = _scaling_sql()
    head, tail = body.split("\na AS (", 1)
    ratio = """(SELECT CASE WHEN count(*) >= 2 AND max(s) / min(s) > 1000.0 THEN 'True' ELSE 'False' END FROM
      (SELECT d, stddev_samp(x) AS s FROM (SELECT unnest(generate_series(1, len(v))) AS d, unnest(v) AS x FROM {src}) GROUP BY d) WHERE s > 0)"""
    return f"""{head}
a AS ({tail.split(chr(10) + "SELECT")[0]},
m AS (SELECT {ratio.format(src='base')} AS mb, {ratio.format(src='sc')} AS ma),
c AS (
  SELECT 'runs' AS "check", 0.2::DOUBLE AS points, true AS passed, 'scaler fitted and applied' AS detail
  UNION ALL SELECT 'scale_fixed', CASE WHEN mb = 'True' AND ma = 'False' THEN 0.4 ELSE 0.0 END::DOUBLE, mb = 'True' AND ma = 'False',
                   'mismatch before=' || mb || ' after=' || ma FROM m
  UNION ALL SELECT 'accuracy_gain', CASE WHEN af - b >= 0.15 THEN 0.4 ELSE 0.0 END::DOUBLE, af - b >= 0.15,
                   printf('gain %+.4f (threshold 0.15)', af - b) FROM a)
SELECT * FROM c
UNION ALL SELECT 'total', round(least(sum(points), 1.0), 2), round(least(sum(points), 1.0), 2) >= 1.0,
                 CASE WHEN round(least(sum(points), 1.0), 2) >= 1.0 THEN 'done' ELSE 'not done' END FROM c"""


_OR["scorecard"] = _scorecard_sql()
