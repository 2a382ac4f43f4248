"""Hyper-parameter search: seeded random trials scored by k-fold CV.

Trials are drawn on the driver from declared spaces (a few hundred
parameter sets at most).  Scoring runs on Spark: folds come from the key
hash (stratified for classification); the linear family for every trial
and fold is solved from one per-fold moments pass; trees are Spark ML
fits, on larger tables to the weighted cells of each fold's bins; KNN neighbours are computed once per (scaler, metric) and fold
with the largest k, and every smaller k reuses them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_PROFILE, ProfileConfig
from ..functions.exprs import categorical_cols, numeric_cols, q
from . import models as M
from .cells import Cells, collapse
from .fixes import apply_scale, category_codes, impute, one_hot, scale_params
from .knn import knn_classify, knn_joins, vote
from .profile import detect_task
from .split import kfold, stratified_kfold

# fixed values: search spaces
#   knn: k 1-30, weights uniform / distance, metric euclidean / manhattan /
#        chebyshev / minkowski (p 1-4), scaler standard / minmax / robust
#   rf: trees 50-500 step 50, depth 3-25 or none, split 2-20, leaf 1-10,
#       features sqrt / log2 / 0.3 / 0.5 / 0.7 / 0.9, weight none / balanced
#       (generic search: depth 3-20, no 0.9, no weight)
#   ridge alpha 1e-4..1e3 log; lasso alpha 1e-4..1e2 log; elastic net alpha
#   1e-4..1e2 log and l1_ratio 0-1
#   gbt regressor: trees 50-400 step 50, learning rate 0.01-0.3 log, depth
#       2-8, subsample 0.5-1, leaf 1-20 (generic: trees 50-300, no leaf)
#   generic classification: rf / gbt / knn (k 1-30, uniform / distance,
#       euclidean / manhattan)


def _draw(space: str, rng: np.random.RandomState) -> dict:
    if space == "scaled_knn":
        p = {"scaler": rng.choice(["standard", "minmax", "robust"]), "n_neighbors": int(rng.randint(1, 31)), "weights": rng.choice(["uniform", "distance"]), "metric": rng.choice(["euclidean", "manhattan", "chebyshev", "minkowski"])}
        if p["metric"] == "minkowski":
            p["p"] = int(rng.randint(1, 5))
        return {k: (v.item() if hasattr(v, "item") else v) for k, v in p.items()}
    if space in ("imputed_rf", "rf_generic"):
        generic = space == "rf_generic"
        use_depth = bool(rng.randint(0, 2))
        p = {
            "model": "rf",
            "n_estimators": int(rng.randint(1, 11 if not generic else 11) * 50),
            "max_depth": int(rng.randint(3, (21 if generic else 26))) if use_depth else None,
            "min_samples_split": int(rng.randint(2, 21)),
            "min_samples_leaf": int(rng.randint(1, 11)),
            "max_features": str(rng.choice(["sqrt", "log2", "0.3", "0.5", "0.7"] + ([] if generic else ["0.9"]))),
        }
        if not generic:
            p["class_weight"] = str(rng.choice(["none", "balanced"]))
        return p
    if space in ("log_target", "regression"):
        m = str(rng.choice(["ridge", "lasso", "elasticnet", "gbt_r"]))
        if m == "ridge":
            return {"model": m, "alpha": float(10 ** rng.uniform(-4, 3))}
        if m == "lasso":
            return {"model": m, "alpha": float(10 ** rng.uniform(-4, 2))}
        if m == "elasticnet":
            return {"model": m, "alpha": float(10 ** rng.uniform(-4, 2)), "l1_ratio": float(rng.uniform(0, 1))}
        p = {"model": m, "n_estimators": int(rng.randint(1, (9 if space == "log_target" else 7)) * 50), "learning_rate": float(10 ** rng.uniform(-2, math.log10(0.3))), "max_depth": int(rng.randint(2, 9)), "subsample": float(rng.uniform(0.5, 1.0))}
        if space == "log_target":
            p["min_samples_leaf"] = int(rng.randint(1, 21))
        return p
    if space == "classification":
        m = str(rng.choice(["rf", "gbt", "knn"]))
        if m == "rf":
            return _draw("rf_generic", rng)
        if m == "gbt":
            return {"model": "gbt", "n_estimators": int(rng.randint(1, 7) * 50), "learning_rate": float(10 ** rng.uniform(-2, math.log10(0.3))), "max_depth": int(rng.randint(2, 9)), "subsample": float(rng.uniform(0.5, 1.0))}
        return {"model": "knn", "n_neighbors": int(rng.randint(1, 31)), "weights": str(rng.choice(["uniform", "distance"])), "metric": str(rng.choice(["euclidean", "manhattan"]))}
    raise ValueError(space)


def draw_trials(space: str, n: int, seed: int = 42) -> list[dict]:
    rng = np.random.RandomState(seed)
    return [_draw(space, rng) for _ in range(n)]


def search_space(spark, space: str, n: int, seed: int = 42) -> DataFrame:
    rows = [(i, t.get("model", "knn"), json.dumps(t, sort_keys=True)) for i, t in enumerate(draw_trials(space, n, seed))]
    return spark.createDataFrame(rows, "trial int, model string, params string")


# ── per-fold moments for the linear family ──────────────────────────────────


def fold_moments(df: DataFrame, feats: Sequence[str], y: str, fold_col: str, k: int):
    """{fold: (n, S, G)} sums of z = [x, y] - shift per fold, one pass."""
    from .gram import moments

    res, _shift = moments(df, list(feats) + [y], by=fold_col)
    m = len(feats) + 1
    return {f: res.get(f, (0.0, np.zeros(m), np.zeros((m, m)))) for f in range(k)}


def _linear_from_moments(n, S, G, kind, params):
    p = len(S) - 1
    mx, my = S[:p] / n, S[p] / n
    C = G[:p, :p] / n - np.outer(mx, mx)
    c = G[:p, p] / n - mx * my
    st = M.LinearStats(feats=[str(i) for i in range(p)], n=round(n), mean_x=mx, mean_y=my, cov_xx=C, cov_xy=c, var_y=0.0)
    mdl = M.fit_linear_from_stats(st, kind if kind != "ols" else "linear", params.get("alpha", 1.0), params.get("l1_ratio", 0.5))
    return mdl.coef, mdl.intercept


def _rmse_from_moments(w, b, n, S, G):
    p = len(S) - 1
    a = np.append(-w, 1.0)
    srr = a @ G @ a - 2 * b * (a @ S) + n * b * b
    return float(np.sqrt(max(srr / n, 0.0))) if n > 0 else float("nan")


# ── CV scoring ──────────────────────────────────────────────────────────────


def _acc(pred: DataFrame, label: str, p: str) -> float:
    return M.metric_value(pred, label, p, "accuracy")


TREES = ("rf", "gbt", "gbt_r")


def _fold_cells(df: DataFrame, fold_col: str, f: int, feats, label: str, task: str, log_target: bool, weight_col: str | None) -> tuple[Cells, DataFrame] | None:
    """Cells of the rows outside fold ``f``, and those of fold ``f`` in the same
    bins (fitted on the former), in one pass for all trials; None for few rows."""
    held = F.coalesce(F.col(q(fold_col)) == f, F.lit(False))
    y = F.col(q("__ylog" if log_target else label)).cast("double")
    d = df.withColumn("__held", held).where(held | y.isNotNull()) if task == "regression" else df.withColumn("__held", held).withColumn(label, F.col(q(label)).cast("string"))
    sums, by = [], ["__held", label]
    if task == "regression":
        score = F.col(q(label)).cast("double")
        sums, by = [F.avg(y).alias("__y"), F.avg(score).alias("__mean"), (F.var_pop(score) * F.count(score)).alias("__ss")], ["__held"]
    both = collapse(d, feats, by, weight_col=weight_col, sums=sums, fit_on=F.col(q(fold_col)) != f)
    if both is None:
        return None
    return Cells(both.bins, both.frame.where(~F.col("__held")), both.n), both.frame.where("__held")


def _cell_score(cells: tuple[Cells, DataFrame], feats, label: str, params: dict, task: str, log_target: bool, weight_col: str | None) -> float:
    """``_fold_score`` of a tree model on cells."""
    train, held = cells
    if task == "classification":
        wc = weight_col if params.get("class_weight") == "balanced" else None
        pred = M.fit_classifier(train.frame, feats, label, params["model"], params, weight_col=wc, cells=train).predict(held, binned=True)
        row = pred.agg(F.sum(F.when(F.col(q(label)) == F.col("pred_label"), F.col("__n"))), F.sum("__n")).first()
        return float("nan") if not row[1] else float(row[0] or 0) / row[1]
    pr = M.predict_regressor(M.fit_gbt_regressor(train.frame, feats, label, params, cells=train), held, feats, "__p", binned=True)
    p = F.expm1(F.least(F.greatest(F.col("__p"), F.lit(-10.0)), F.lit(20.0))) if log_target else F.col("__p")
    v = pr.agg(F.sqrt(F.sum(F.col("__ss") + F.col("__n") * F.pow(F.col("__mean") - p, 2)) / F.sum("__n"))).first()[0]
    return float("nan") if v is None else float(v)


def _fold_score(df: DataFrame, fold_col: str, f: int, feats, label: str, params: dict, task: str, log_target: bool, weight_col: str | None, cells=None) -> float:
    model = params.get("model", "knn")
    if cells is not None and model in TREES:
        return _cell_score(cells, feats, label, params, task, log_target, weight_col)
    tr = df.where(F.col(q(fold_col)) != f)
    va = df.where(F.col(q(fold_col)) == f)
    if task == "classification":
        if model == "knn":
            pred = knn_classify(tr, va, "__key", label, k=params["n_neighbors"], weights=params.get("weights", "uniform"), feats=feats, metric=params.get("metric", "euclidean"), p=float(params.get("p", 2)))
            return _acc(pred, label, "prediction")
        wc = weight_col if params.get("class_weight") == "balanced" else None
        fit = M.fit_classifier(tr, feats, label, "rf" if model == "rf" else "gbt", params, weight_col=wc)
        return _acc(fit.predict(va), label, "pred_label")
    ycol = "__ylog" if log_target else label
    if model == "gbt_r":
        mdl = M.fit_gbt_regressor(tr, feats, ycol, params)
        pr = M.predict_regressor(mdl, va, feats, "__p")
    else:
        lm = M.fit_linear(tr, feats, ycol, model if model != "ols" else "linear", params.get("alpha", 1.0), params.get("l1_ratio", 0.5))
        pr = va.withColumn("__p", lm.predict_col())
    if log_target:
        pr = pr.withColumn("__p", F.expm1(F.least(F.greatest(F.col("__p"), F.lit(-10.0)), F.lit(20.0))))
    return M.metric_value(pr, label, "__p", "rmse")


LINEAR = ("ridge", "lasso", "elasticnet", "ols")


def _log_linear_scores(df: DataFrame, fold_col: str, k: int, feats, label: str, trials: list[dict]) -> list[list[float]]:
    """Fold scores of linear fits to __ylog, every trial at once: the fits come
    from one pass of fold moments, the errors of their predictions (taken back by
    expm1) from one more, a product of each Arrow batch with the matrix of all
    trials' weights; a row's errors count in its own fold."""
    from .gram import moments

    feats = list(feats)
    p = len(feats)
    per_fold, shift = moments(df, [*feats, "__ylog"], by=fold_col)
    none = (0.0, np.zeros(p + 1), np.zeros((p + 1, p + 1)))
    per_fold = {f: per_fold.get(f, none) for f in range(k)}
    all_n, all_s, all_g = (sum(v[i] for v in per_fold.values()) for i in range(3))
    weights, base = np.zeros((k, p, len(trials))), np.zeros((k, len(trials)))
    for f, (n, s, g) in per_fold.items():
        for t, params in enumerate(trials):
            w, b = _linear_from_moments(all_n - n, all_s - s, all_g - g, params["model"], params)
            weights[f, :, t], base[f, t] = w, b + shift[p] - shift[:p] @ w
    names = [f"x{i}" for i in range(p)]
    sel = df.select(F.col(q(fold_col)).cast("int").alias("f"), F.col(q(label)).cast("double").alias("y"), *[F.col(q(c)).cast("double").alias(n) for c, n in zip(feats, names, strict=True)])

    def errors(batches):
        total = np.zeros((k, len(trials) + 1))
        for batch in batches:
            fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(p)], 1) if p else np.zeros((len(y), 0))
            for f in range(k):
                mine = (fold == f) & ~np.isnan(y) & ~np.isnan(x).any(1)
                pred = np.expm1(np.clip(x[mine] @ weights[f] + base[f], -10.0, 20.0))
                total[f, :-1] += ((pred - y[mine, None]) ** 2).sum(0)
                total[f, -1] += mine.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["f", "v"])

    rows = sel.mapInArrow(errors, "f int, v array<double>").groupBy("f").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    got = {r["f"]: r["v"].toArray() for r in rows}
    return [[float(np.sqrt(got[f][t] / round(got[f][-1]))) if f in got and round(got[f][-1]) else float("nan") for f in range(k)] for t in range(len(trials))]


def cv_scores(df: DataFrame, fold_col: str, k: int, feats, label: str, trials: list[dict], task: str, log_target: bool = False, moments=None, weight_col: str | None = None, parallelism: int | None = None, cells: dict | None = None) -> list[list[float]]:
    """Per-trial, per-fold scores.  Linear-family trials come from the fold
    moments (no pass, or two for all of them on a log target); every other (trial, fold) fit is a Spark job
    submitted from a thread pool, so small fits overlap on the cluster
    (as CrossValidator's ``parallelism`` does).  Tree trials of a fold share its
    ``cells`` ({fold: cells}, filled here; one call's can be given to the next)."""
    from concurrent.futures import ThreadPoolExecutor

    out: list[list[float]] = [[float("nan")] * k for _ in trials]
    jobs = []
    logged = [t for t, p in enumerate(trials) if log_target and p.get("model") in LINEAR]
    if logged:
        for t, scores in zip(logged, _log_linear_scores(df, fold_col, k, feats, label, [trials[t] for t in logged]), strict=True):
            out[t] = scores
    for t, params in enumerate(trials):
        model = params.get("model", "knn")
        if t in logged:
            continue
        if model in LINEAR and moments is not None:
            tot_n = sum(v[0] for v in moments.values())
            tot_s = sum(v[1] for v in moments.values())
            tot_g = sum(v[2] for v in moments.values())
            for f in range(k):
                n, S, G = moments[f]
                w, b = _linear_from_moments(tot_n - n, tot_s - S, tot_g - G, model, params)
                out[t][f] = _rmse_from_moments(w, b, n, S, G)
        else:
            jobs += [(t, f) for f in range(k)]
    if jobs:
        # tree learners on small folds run many one-task jobs: up to 8 fits
        # at once keep the cluster's cores busy
        parallelism = parallelism or max(1, min(8, df.sparkSession.sparkContext.defaultParallelism))
        cells = {} if cells is None else cells
        if any(trials[t].get("model") in TREES for t, _f in jobs):
            for f in set(range(k)) - set(cells):
                cells[f] = _fold_cells(df, fold_col, f, feats, label, task, log_target, weight_col)
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            futs = {pool.submit(_fold_score, df, fold_col, f, feats, label, trials[t], task, log_target, weight_col, cells.get(f)): (t, f) for t, f in jobs}
            for fu, (t, f) in futs.items():
                out[t][f] = fu.result()
    return out


def cv_score(df: DataFrame, fold_col: str, k: int, feats: Sequence[str], label: str, params: dict, task: str, log_target: bool = False, moments=None, weight_col: str | None = None, cells: dict | None = None) -> list[float]:
    """Per-fold scores (accuracy or RMSE) of one parameter set."""
    return cv_scores(df, fold_col, k, feats, label, [params], task, log_target, moments, weight_col, cells=cells)[0]


TRIAL_SCHEMA = "trial int, model string, params string, metric string, score double, fold_scores string"


def tune(
    df: DataFrame,
    target: str,
    key: str,
    n_trials: int = 50,
    cv_folds: int = 5,
    preset: str = "generic",
    seed: int = 42,
    cfg: ProfileConfig = DEFAULT_PROFILE,
    parallelism: int | None = None,
    trials: list[dict] | None = None,
):
    """Returns (trials DataFrame, summary dict with baseline / best);
    ``parallelism`` fits run at once (by default as many as cores, 8 at most);
    ``trials``: these parameter sets instead of ``n_trials`` drawn ones.

    presets: generic (type detected, text coded, rf / gbt / knn or ridge /
    lasso / elastic net / gbt), scaled_knn, imputed_rf, log_target."""
    spark = df.sparkSession
    d = df.where(F.col(q(target)).isNotNull()).withColumn("__key", F.col(q(key)))
    task = "regression" if preset == "log_target" else ("classification" if preset in ("scaled_knn", "imputed_rf") else detect_task(d, target, cfg))
    if preset == "imputed_rf":
        nums = numeric_cols(d, exclude=[target, key, "__key"])
        d = impute(d, nums, "median")
        d = one_hot(d, categorical_cols(d, exclude=[target]))
    else:
        d = category_codes(d, categorical_cols(d, exclude=[target]))
    feats = numeric_cols(d, exclude=[target, key, "__key"])
    d = impute(d, feats, "mean")
    if task == "classification":
        d = stratified_kfold(d, "__key", target, cv_folds, seed)
    else:
        d = kfold(d, "__key", cv_folds, seed)
    weight_col = None
    if preset == "imputed_rf":
        from .fixes import balanced_weights

        d = balanced_weights(d, target, out="__w")
        weight_col = "__w"
    if preset == "log_target":
        d = d.withColumn("__ylog", F.log1p(F.col(q(target)).cast("double")))
    d = d.persist()  # read by every trial and fold; released below
    try:
        metric = "accuracy" if task == "classification" else "rmse"
        space = {"scaled_knn": "scaled_knn", "imputed_rf": "imputed_rf", "log_target": "log_target"}.get(preset, "classification" if task == "classification" else "regression")
        trials = draw_trials(space, n_trials, seed) if trials is None else list(trials)
        moments = fold_moments(d, feats, target, "fold", cv_folds) if task == "regression" and preset != "log_target" else None
        rows = []
        if preset == "scaled_knn":
            rows = _tune_knn(d, feats, target, cv_folds, trials)
            base = float(np.mean(cv_score(d, "fold", cv_folds, feats, target, {"model": "knn", "n_neighbors": 5}, task)))
        else:
            cells: dict = {}  # of each fold, for all trials and the baseline
            all_sc = cv_scores(d, "fold", cv_folds, feats, target, trials, task, preset == "log_target", moments, weight_col, parallelism, cells)
            for t, (params, sc) in enumerate(zip(trials, all_sc)):
                rows.append((t, params.get("model", "knn"), json.dumps(params, sort_keys=True), metric, float(np.mean(sc)), json.dumps([round(s, 6) for s in sc])))
            if task == "classification":
                base = float(np.mean(cv_score(d, "fold", cv_folds, feats, target, {"model": "rf", "n_estimators": 100, "max_depth": None, "max_features": "sqrt"}, task, cells=cells)))
            elif preset == "log_target":
                base = float(np.mean(cv_score(d, "fold", cv_folds, feats, target, {"model": "ols"}, task, True)))
            else:
                base = float(np.mean(cv_score(d, "fold", cv_folds, feats, target, {"model": "ridge", "alpha": 1.0}, task, False, moments)))
    finally:
        d.unpersist()
    trials_df = spark.createDataFrame(rows, TRIAL_SCHEMA)
    best = min(rows, key=lambda r: (r[4], r[0])) if metric == "rmse" else max(rows, key=lambda r: (r[4], -r[0]))
    improvement = (base - best[4]) if metric == "rmse" else (best[4] - base)
    summary = {"preset": preset, "task": task, "metric": metric, "baseline": base, "best": best[4], "best_trial": best[0], "best_params": best[2], "improvement": improvement, "n_trials": len(rows)}
    return trials_df, summary


def _tune_knn(d: DataFrame, feats, label, k: int, trials: list[dict]):
    """Neighbours with the largest k once per (scaler, metric, p), all folds and
    all metrics of a scaler in one join: a fold's rows meet the other folds' rows
    as scaled by the statistics of those.  Each trial votes with its own k and
    weights."""
    scalers: dict = {}
    for t, p in enumerate(trials):
        scalers.setdefault(p["scaler"], {}).setdefault((p["metric"], float(p.get("p", 2))), []).append((t, p))
    scores: dict = {}
    labels = d.select(F.col("__key"), F.col(q(label)).alias("__y"), F.col("fold"))
    for scaler, spaces in scalers.items():
        sides = [[], []]
        for f in range(k):
            tr, va = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
            prm = scale_params(tr, feats, scaler)
            for side, rows in zip(sides, (va, tr), strict=True):
                side.append(apply_scale(rows, prm).withColumn("__f", F.lit(f)))
        left, right = (reduce(DataFrame.unionByName, side) for side in sides)
        right = right.select("__f", F.col("__key").alias("__rk"), F.col(q(label)).alias("__nl"), *[F.col(q(c)) for c in feats])
        most = [(max(p["n_neighbors"] for _t, p in items), metric, pp) for (metric, pp), items in spaces.items()]
        nb = knn_joins(left, right, "__key", "__rk", most, feats=feats, carry="__nl", by="__f", complete=True).persist()
        for at, items in enumerate(spaces.values()):
            for t, p in items:
                mine = nb.where((F.col("space") == at) & (F.col("rank") <= p["n_neighbors"]))
                pred = labels.join(vote(mine, "__key", p["weights"]), "__key", "left")
                got = {r["fold"]: r["a"] for r in pred.groupBy("fold").agg(M.accuracy_expr("__y", "prediction").alias("a")).collect()}
                scores[t] = [got.get(f, float("nan")) for f in range(k)]
        nb.unpersist()
    return [(t, "knn", json.dumps(trials[t], sort_keys=True), "accuracy", float(np.mean(scores[t])), json.dumps([round(s, 6) for s in scores[t]])) for t in range(len(trials))]


def best_trial(trials: DataFrame, metric: str) -> DataFrame:
    """Best row by the metric's direction; ties -> lowest trial number."""
    order = [F.col("score").asc() if metric == "rmse" else F.col("score").desc(), F.col("trial").asc()]
    return trials.orderBy(*order).limit(1)


def compare_tuning(spark, summaries: Sequence[dict]) -> DataFrame:
    rows = [(s["preset"], s["metric"], float(s["baseline"]), float(s["best"]), float(s["improvement"]), int(s["n_trials"])) for s in summaries]
    return spark.createDataFrame(rows, "preset string, metric string, baseline double, best double, improvement double, n_trials int")
