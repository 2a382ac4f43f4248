"""Models and metrics.

Linear family (OLS, ridge, lasso, elastic net): one aggregate pass gives
means and the covariance (centred Gram) matrix of features and target;
the fit is a p x p solve on the driver, so any alpha / l1 ratio / feature
subset of the same rows costs no further pass.  Objectives follow
sklearn: ridge ||y - Xw - b||^2 + a||w||^2; lasso / elastic net
(1/2n)||y - Xw - b||^2 + a r |w|_1 + a (1-r)/2 ||w||^2.  Predictions are
column expressions (whole-stage codegen).

Logistic regression, random forests and boosted trees use Spark ML
(distributed L-BFGS / tree learners) with the parameter mapping noted on
each function.  Trees on more than a few thousand rows are fitted on the
weighted cells of their bins (``cells.py``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q
from .cells import Bins, Cells, collapse


# ── linear family from one Gram pass ────────────────────────────────────────


@dataclass
class LinearStats:
    feats: list[str]
    n: int
    mean_x: np.ndarray
    mean_y: float
    cov_xx: np.ndarray
    cov_xy: np.ndarray
    var_y: float


def linear_stats(df: DataFrame, feats: Sequence[str], y: str) -> LinearStats:
    """n, means, population covariances of features and target (rows with
    any missing value in feats / y are skipped), from Gram partials."""
    from .gram import moments

    feats = list(feats)
    p = len(feats)
    (n, S, G), shift = moments(df, feats + [y])
    n = max(n, 1.0)
    mz = S / n
    C = G / n - np.outer(mz, mz)
    return LinearStats(feats, int(n), shift[:p] + mz[:p], float(shift[p] + mz[p]), C[:p, :p], C[:p, p], float(C[p, p]))


@dataclass
class LinearModel:
    feats: list[str]
    coef: np.ndarray
    intercept: float
    kind: str = "linear"
    params: dict = field(default_factory=dict)

    def predict_col(self) -> Column:
        e = F.lit(float(self.intercept))
        for c, w in zip(self.feats, self.coef):
            e = e + F.col(q(c)).cast("double") * F.lit(float(w))
        return e

    def coef_frame(self, spark) -> DataFrame:
        rows = [("intercept", float(self.intercept))] + [(c, float(w)) for c, w in zip(self.feats, self.coef)]
        return spark.createDataFrame(rows, "term string, coef double")


def _coordinate_descent(G: np.ndarray, c: np.ndarray, l1: float, l2: float, tol: float = 1e-12, max_iter: int = 100000) -> np.ndarray:
    """argmin 1/2 w'Gw - c'w + l1 |w|_1 + l2/2 |w|^2 by cyclic coordinate
    descent (covariance updates)."""
    p = len(c)
    w = np.zeros(p)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            denom = G[j, j] + l2
            if denom <= 0:
                continue
            rho = c[j] - G[j] @ w + G[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / denom
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol * max(1.0, float(np.max(np.abs(w))) if p else 1.0):
            break
    return w


def fit_linear_from_stats(st: LinearStats, kind: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5, subset: Sequence[int] | None = None) -> LinearModel:
    idx = list(range(len(st.feats))) if subset is None else list(subset)
    feats = [st.feats[i] for i in idx]
    if not idx:
        return LinearModel(feats, np.zeros(0), st.mean_y, kind)
    G = st.cov_xx[np.ix_(idx, idx)]
    c = st.cov_xy[idx]
    n = st.n
    if kind == "linear":
        w = np.linalg.lstsq(G, c, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.solve(n * G + alpha * np.eye(len(idx)), n * c)
    elif kind == "lasso":
        w = _coordinate_descent(G, c, alpha, 0.0)
    elif kind == "elasticnet":
        w = _coordinate_descent(G, c, alpha * l1_ratio, alpha * (1.0 - l1_ratio))
    else:
        raise ValueError(kind)
    b = st.mean_y - float(st.mean_x[idx] @ w)
    return LinearModel(feats, w, b, kind, {"alpha": alpha, "l1_ratio": l1_ratio})


def fit_linear(train: DataFrame, feats: Sequence[str], y: str, kind: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5) -> LinearModel:
    return fit_linear_from_stats(linear_stats(train, feats, y), kind, alpha, l1_ratio)


# ── Spark ML wrappers ───────────────────────────────────────────────────────


def _assemble(df: DataFrame, feats: Sequence[str], out: str = "features", vectors: Sequence[str] = (), bins: Bins | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    # under names of their own: the caller's columns keep their types
    names = {f"__f{i}": F.col(q(c)).cast("double") for i, c in enumerate(feats)}
    df = df.withColumns(names)
    if bins is not None:
        df = Bins({f"__f{i}": bins.cuts[c] for i, c in enumerate(feats)}).apply(df)
    return VectorAssembler(inputCols=[*names, *vectors], outputCol=out, handleInvalid="keep").transform(df).drop(*names)


def _label_index(train: DataFrame, y: str):
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol=y, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="error").fit(train.select(F.col(q(y)).cast("string").alias(y)))


@dataclass
class ClassifierFit:
    model: object
    indexer: object
    feats: list[str]
    y: str
    vectors: list[str] = field(default_factory=list)
    bins: Bins | None = None

    def predict(self, df: DataFrame, binned: bool = False) -> DataFrame:
        """Adds ``pred_label`` (the predicted label as text); ``binned``: the
        features of ``df`` are in the model's bins already."""
        out = self.model.transform(_assemble(df, self.feats, vectors=self.vectors, bins=None if binned else self.bins))
        labels = self.indexer.labels
        m = F.create_map(*[x for i, lv in enumerate(labels) for x in (F.lit(float(i)), F.lit(lv))])
        out = out.withColumn("pred_label", m[F.col("prediction")])
        return out.drop(*[c for c in ("features", "rawPrediction", "probability", "prediction") if c in out.columns])


def fit_classifier(train: DataFrame, feats: Sequence[str], y: str, model: str = "logistic", params: dict | None = None, weight_col: str | None = None, seed: int = 42, vectors: Sequence[str] = (), cells: Cells | None = None) -> ClassifierFit:
    """model: logistic (sklearn C -> regParam 1/(C n), no standardisation),
    rf (RandomForestClassifier), gbt (GBTClassifier; more than two classes
    through OneVsRest).  ``vectors``: vector columns that are features too.  The input is not cached here: Spark ML caches its
    own (blocked) training instances for the iterations."""
    from pyspark.ml.classification import (
        GBTClassifier,
        LogisticRegression,
        OneVsRest,
        RandomForestClassifier,
    )

    params = dict(params or {})
    tr = train.withColumn(y, F.col(q(y)).cast("string")).where(F.col(q(y)).isNotNull())
    # vectors of one-hot levels are few; dense ones would make a cell of each row
    if cells is None and model in ("rf", "gbt"):
        cells = collapse(tr, feats, [y], vectors, weight_col)
    least = 1
    if model == "rf":
        least = int(max(params.get("min_samples_leaf", 1), math.ceil(params.get("min_samples_split", 2) / 2)))
    if cells is not None:
        draws = model == "rf" or float(params.get("subsample", 1.0)) < 1.0
        tr = cells.units(least, draws, weighted=weight_col is not None)
        weight_col = "__w"
        idx = _label_index(cells.frame, y)
    else:
        idx = _label_index(tr, y)
    d = _assemble(idx.transform(tr), feats, vectors=vectors)
    cols = ["features", "__label"] + ([weight_col] if weight_col else [])
    # not persisted here: Spark ML caches its own blocked instances when the
    # input is not cached (a cached DataFrame makes every iteration convert
    # rows again)
    d = d.select(*cols)
    n_classes = len(idx.labels)
    if model == "logistic":
        n = d.count()
        C = float(params.get("C", 1.0))
        est = LogisticRegression(
            featuresCol="features",
            labelCol="__label",
            regParam=1.0 / (C * max(n, 1)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=int(params.get("max_iter", 1000)),
            tol=float(params.get("tol", 1e-6)),
        )
        if weight_col:
            est.setWeightCol(weight_col)
    elif model == "rf":
        depth = params.get("max_depth")
        est = RandomForestClassifier(
            featuresCol="features",
            labelCol="__label",
            numTrees=int(params.get("n_estimators", 100)),
            maxDepth=int(depth) if depth is not None else 30,
            minInstancesPerNode=least,
            featureSubsetStrategy=str(params.get("max_features", "sqrt")),
            # a row's node is kept, not sought from the root of every tree at each level
            cacheNodeIds=True,
            seed=seed,
        )
        if weight_col:
            est.setWeightCol(weight_col)
    elif model == "gbt":
        base = GBTClassifier(
            featuresCol="features",
            labelCol="__label",
            maxIter=int(params.get("n_estimators", 100)),
            stepSize=float(params.get("learning_rate", 0.1)),
            maxDepth=int(params.get("max_depth", 3)),
            subsamplingRate=float(params.get("subsample", 1.0)),
            seed=seed,
        )
        est = base if n_classes <= 2 else OneVsRest(classifier=base, featuresCol="features", labelCol="__label")
        if cells is not None:
            est.setWeightCol(weight_col)
    else:
        raise ValueError(model)
    fitted = est.fit(d)
    return ClassifierFit(fitted, idx, list(feats), y, list(vectors), cells.bins if cells is not None else None)


@dataclass
class BinnedRegressor:
    """A Spark ML model of binned features."""

    model: object
    bins: Bins


def fit_gbt_regressor(train: DataFrame, feats: Sequence[str], y: str, params: dict | None = None, seed: int = 42, cells: Cells | None = None):
    """GBTRegressor on the rows, or on ``cells`` with the mean target __y of each
    (squared error: the same trees)."""
    from pyspark.ml.regression import GBTRegressor

    params = dict(params or {})
    least = int(params.get("min_samples_leaf", 1))
    target = F.col(q(y)).cast("double")
    if cells is None:
        train = train.where(F.col(q(y)).isNotNull())
        cells = collapse(train, feats, sums=[F.avg(target).alias("__y")])
    est = GBTRegressor(
        featuresCol="features",
        labelCol="__y",
        maxIter=int(params.get("n_estimators", 100)),
        stepSize=float(params.get("learning_rate", 0.1)),
        maxDepth=int(params.get("max_depth", 3)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        minInstancesPerNode=least,
        seed=seed,
    )
    if cells is None:
        return est.fit(_assemble(train, feats).select("features", target.alias("__y")))
    d = cells.units(least, draws=float(params.get("subsample", 1.0)) < 1.0)
    return BinnedRegressor(est.setWeightCol("__w").fit(_assemble(d, feats).select("features", "__y", "__w")), cells.bins)


def predict_regressor(model, df: DataFrame, feats: Sequence[str], out: str = "prediction", binned: bool = False) -> DataFrame:
    if isinstance(model, LinearModel):
        return df.withColumn(out, model.predict_col())
    bins = None
    if isinstance(model, BinnedRegressor):
        model, bins = model.model, None if binned else model.bins
    d = _assemble(df, feats, bins=bins)
    res = model.transform(d.drop("prediction") if "prediction" in d.columns else d).drop("features")
    return res if out == "prediction" else res.withColumnRenamed("prediction", out)


# ── metrics ─────────────────────────────────────────────────────────────────


def accuracy_expr(y: str, p: str) -> Column:
    return F.avg((F.col(q(y)).cast("string") == F.col(q(p)).cast("string")).cast("double"))


def rmse_expr(y: str, p: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(q(y)).cast("double") - F.col(q(p)).cast("double"), 2)))


def rmsle_expr(y: str, p: str) -> Column:
    yy = F.log1p(F.col(q(y)).cast("double"))
    pp = F.log1p(F.greatest(F.col(q(p)).cast("double"), F.lit(0.0)))
    return F.sqrt(F.avg(F.pow(yy - pp, 2)))


def metric(df: DataFrame, y: str, p: str, kind: str) -> DataFrame:
    e = {"accuracy": accuracy_expr, "rmse": rmse_expr, "rmsle": rmsle_expr}[kind](y, p)
    return df.agg(e.alias(kind))


def metric_value(df: DataFrame, y: str, p: str, kind: str) -> float:
    v = metric(df, y, p, kind).first()[0]
    return float("nan") if v is None else float(v)


def fit_log_target(train: DataFrame, feats: Sequence[str], y: str, kind: str = "linear", params: dict | None = None):
    """Log-target regression: fit on log1p(y), predict expm1 of the
    prediction clipped to [-10, 20] (back on the original scale).  Returns a
    function DataFrame -> DataFrame adding ``prediction``."""
    from ..functions.exprs import expm1_clip

    params = dict(params or {})
    tr = train.withColumn("__ylog", F.log1p(F.col(q(y)).cast("double")))
    if kind == "gbt_r":
        mdl = fit_gbt_regressor(tr, feats, "__ylog", params)

        def predict(df: DataFrame) -> DataFrame:
            return predict_regressor(mdl, df, feats, "__plog").withColumn("prediction", expm1_clip(F.col("__plog"))).drop("__plog")

        return predict
    lm = fit_linear(tr, feats, "__ylog", kind, params.get("alpha", 1.0), params.get("l1_ratio", 0.5))

    def predict(df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", expm1_clip(lm.predict_col()))

    return predict
