"""Scoring a table and a repair: baseline model score, before/after reward,
data checks and the points scorecard.

The split is decided once per row from the key hash, so the before and
after scores test the same rows.  The scorecard gives points for what
the data shows after the repair (e.g. the scale mismatch is gone), not
for names found in code text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_PROFILE, DEFAULT_REWARD, ProfileConfig, RewardConfig
from ..functions.exprs import categorical_cols, expm1_clip, g1_skew, numeric_cols, q
from . import models as M
from .fixes import apply_fixes, encoded_columns, one_hot, one_hot_vector
from .levels import level_moments, ridge, test_rmse
from .profile import detect_task
from .split import train_test_split

META_COLS = ("is_test", "weight", "fold")


@dataclass
class Score:
    task: str
    metric: str
    value: float
    n_features: int


def usable_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric non-target columns holding at least one value (one count pass)."""
    return list(filled_means(df, target, F.lit(True), exclude))


def filled_means(df: DataFrame, target: str, fit_rows, exclude: Sequence[str] = ()) -> dict:
    """{numeric non-target column holding at least one value: its mean over the
    rows ``fit_rows``} in one pass."""
    feats = numeric_cols(df, exclude=[target, *META_COLS, *exclude])
    if not feats:
        return {}
    x = {c: F.col(q(c)) for c in feats}
    pairs = [(F.count(x[c]).alias(f"n{i}"), F.avg(F.when(fit_rows, x[c].cast("double"))).alias(f"m{i}")) for i, c in enumerate(feats)]
    row = df.agg(*[e for pair in pairs for e in pair]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(feats) if row[f"n{i}"]}


def fill(df: DataFrame, means: dict) -> DataFrame:
    """Missing values of each column -> its given mean (none given: left)."""
    floats = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    repl = {}
    for c, m in means.items():
        if m is not None:
            kind = floats.get(c, T.DoubleType())
            repl[c] = F.coalesce(F.col(q(c)).cast(kind), F.lit(float(m)).cast(kind))
    return df.withColumns(repl) if repl else df


def baseline_score(
    df: DataFrame,
    target: str,
    key,
    task: str | None = None,
    cfg: ProfileConfig = DEFAULT_PROFILE,
    fit_on: str = "train",
    exclude: Sequence[str] = (),
    log_target: bool = False,
    levels: Sequence[str] = (),
) -> Score:
    """Drop rows without a target; numeric features that are not wholly
    missing; mean-impute (fitted on the training rows, or on all rows with
    fit_on='all' as the reference does); hash split 80/20; ridge (alpha 1)
    test RMSE for regression, logistic (C 1) test accuracy for
    classification.  No usable feature: target std (regression) or 0.
    ``levels``: text columns that count as one 0/1 feature per training level
    but the first, however many there are (sparse sums in the ridge, sparse
    vectors in the logistic fit).
    ``log_target`` fits the ridge on log1p of the target and scores expm1 of
    its predictions, on the target's scale."""
    task = task or detect_task(df, target, cfg)
    metric = "rmse" if task == "regression" else "accuracy"
    d = df.where(F.col(q(target)).isNotNull())
    keys = [key] if isinstance(key, str) else list(key)
    if "is_test" not in d.columns:
        d = train_test_split(d, keys, cfg.test_size, cfg.random_state)
    means = filled_means(d, target, ~F.col("is_test") if fit_on == "train" else F.lit(True), exclude)
    feats = list(means)
    if not feats and not levels:
        return _no_features(d, target, task, metric)
    d = fill(d, means)
    if task == "regression":
        y = target
        if log_target:
            y = "__ylog"
            d = d.withColumn(y, F.when(F.col(q(target)) > -1, F.log1p(F.col(q(target)).cast("double"))))
        mo = level_moments(d, feats, y, levels)
        if not feats and not mo.slots:
            return _no_features(d, target, task, metric)
        w, b = ridge(mo.train)
        if log_target:
            predicted = mo.predict(d.where(F.col("is_test")), feats, w, b).withColumn("prediction", expm1_clip(F.col("prediction")))
            return Score(task, metric, M.metric_value(predicted, target, "prediction", "rmse"), len(feats) + mo.slots)
        return Score(task, metric, test_rmse(mo.test, w, b), len(feats) + mo.slots)
    vectors: dict[str, int] = {}
    for i, c in enumerate(levels):
        name = f"__levels_{i}"
        d = one_hot_vector(d, c, out=name, fit_on=d.where(~F.col("is_test")))
        if name in d.columns:
            vectors[name] = d.schema[name].metadata["ml_attr"]["num_attrs"]
    if not feats and not vectors:
        return _no_features(d, target, task, metric)
    fit = M.fit_classifier(d.where(~F.col("is_test")), feats, target, "logistic", {"C": 1.0}, vectors=list(vectors))
    v = M.metric_value(fit.predict(d.where(F.col("is_test"))), target, "pred_label", "accuracy")
    return Score(task, metric, v, len(feats) + sum(vectors.values()))


def _no_features(d: DataFrame, target: str, task: str, metric: str) -> Score:
    if task != "regression":
        return Score(task, metric, 0.0, 0)
    v = d.agg(F.stddev_samp(F.col(q(target)).cast("double"))).first()[0]
    return Score(task, metric, float(v) if v is not None else 0.0, 0)


def reward_of(task: str, before: float, after: float) -> float:
    if task == "regression":
        return max(0.0, (before - after) / before) if before > 0 else 0.0
    return max(0.0, after - before)


EVAL_SCHEMA = "task_type string, metric string, before double, after double, reward double, improved boolean, n_features_before int, n_features_after int, exec_error string"


def evaluate_fix(
    df: DataFrame,
    fix: DataFrame | Callable[[DataFrame], DataFrame] | list,
    target: str,
    key,
    cfg: ProfileConfig = DEFAULT_PROFILE,
    task: str | None = None,
    expand: bool = True,
):
    """Score before and after a repair (a plan table / list from
    ``recommend_fixes`` or a DataFrame -> DataFrame function).  Returns
    (one-row result DataFrame, fixed DataFrame).  A failing repair is
    reported, not raised: after = before, reward 0.

    Text columns that a plan encodes count in the score with all their levels;
    ``expand=False`` leaves them as text in the fixed frame, which else gets
    their 0/1 columns (or vectors).  ``n_features_after`` counts the levels."""
    spark = df.sparkSession
    task = task or detect_task(df, target, cfg)
    keys = [key] if isinstance(key, str) else list(key)
    # the split input feeds both scores and every fit pass of the repair:
    # kept once (memory, spilling to disk) and released before returning
    d = train_test_split(df, keys, cfg.test_size, cfg.random_state).persist()
    before = baseline_score(d, target, keys, task, cfg)
    err, fixed = None, d
    try:
        levels, logged = [], False
        if callable(fix) and not isinstance(fix, DataFrame):
            kept = fix(d)
            kept.schema  # analysis errors surface here
        else:
            steps = fix.orderBy("seq").collect() if isinstance(fix, DataFrame) else list(fix)
            held = [k for k in keys if k != target]
            logged = any(s["action"] == "log_target" for s in steps)
            kept = apply_fixes(d, [s for s in steps if s["action"] != "log_target"], target, split_col="is_test", key=held, expand=False)
            levels = encoded_columns(steps, kept, [*held, target])
        scored = kept.persist()  # read by every pass of the score
        try:
            # a logged target is scored on its own scale, over the same rows as before
            after = baseline_score(scored, target, keys, task, cfg, log_target=logged and task == "regression", levels=levels)
        finally:
            scored.unpersist(blocking=False)
        fixed = kept
        if logged:
            fixed = apply_fixes(fixed, [s for s in steps if s["action"] == "log_target"], target)
        if levels and expand:
            fixed = one_hot(fixed, levels, drop_first=True, fit_on=d.where(~F.col("is_test")))
    except Exception as exc:  # reported in the result row
        err = f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"
        after, fixed = before, d
    d.unpersist(blocking=False)  # the returned frame recomputes from its lineage when used
    reward = reward_of(task, before.value, after.value) if err is None else 0.0
    row = (
        task,
        before.metric,
        round(before.value, 4),
        round(after.value, 4),
        round(reward, 4),
        reward > 0,
        before.n_features,
        after.n_features,
        err,
    )
    return spark.createDataFrame([row], EVAL_SCHEMA), fixed


def compare_scores(result: DataFrame) -> DataFrame:
    """(stage, metric, value) rows for the before / after chart."""
    return result.select(
        F.explode(
            F.array(
                F.struct(F.lit("before").alias("stage"), F.col("metric"), F.col("before").alias("value")),
                F.struct(F.lit("after").alias("stage"), F.col("metric"), F.col("after").alias("value")),
            )
        ).alias("s")
    ).select("s.*")


# ── data checks ─────────────────────────────────────────────────────────────


def check_nulls_cleared(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(col_name, n_missing) of the listed (or all) columns that still hold
    missing values; empty = cleared."""
    from .profile import missing_counts

    cols = [c for c in (cols or df.columns) if c in df.columns]
    return missing_counts(df, cols)


def check_encoded(df: DataFrame, target: str) -> DataFrame:
    """(col_name) of text feature columns that remain, plus a target row
    when the target column is missing."""
    rows = [(c, "text_feature") for c in categorical_cols(df, exclude=[target])]
    if target not in df.columns:
        rows.append((target, "target_missing"))
    return df.sparkSession.createDataFrame(rows, "col_name string, problem string")


def check_improvement(before: float, after: float, rule: str, cfg: RewardConfig = DEFAULT_REWARD) -> tuple[bool, str]:
    """'accuracy_gain': after - before >= 0.15; 'rmsle_half': after < 0.5 x before."""
    if rule == "accuracy_gain":
        ok = (after - before) >= cfg.improvement_threshold
        return ok, f"gain {after - before:+.4f} (threshold {cfg.improvement_threshold})"
    thr = before * cfg.rmse_improvement_factor
    return after < thr, f"RMSLE {after:.4f} vs threshold {thr:.4f}"


SCORE_SCHEMA = "check string, points double, passed boolean, detail string"


def scorecard(kind: str, checks: dict) -> DataFrame:
    """Points per fix run from measured checks.
    scaling: runs .2, scale mismatch gone .4, accuracy gain >= .15 .4;
    missing: runs .2, nulls cleared .4, model trains .4;
    skew: target skew below threshold .4, predictions back on the original
    scale .3, RMSLE below half the baseline .3.  Total capped at 1."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    # fixed values: points per check
    points = {
        "scaling": [("runs", 0.2), ("scale_fixed", 0.4), ("accuracy_gain", 0.4)],
        "missing": [("runs", 0.2), ("nulls_cleared", 0.4), ("model_trains", 0.4)],
        "skew": [("log_target", 0.4), ("inverse", 0.3), ("rmsle", 0.3)],
    }[kind]
    rows = []
    for name, pts in points:
        ok, detail = checks.get(name, (False, "not run"))
        rows.append((name, pts if ok else 0.0, bool(ok), detail))
    total = round(min(sum(r[1] for r in rows), 1.0), 2)
    rows.append(("total", total, total >= 1.0, "done" if total >= 1.0 else "not done"))
    return spark.createDataFrame(rows, SCORE_SCHEMA)


def grade_missing(df: DataFrame, fix, target: str, key, cols: Sequence[str] | None = None, cfg: ProfileConfig = DEFAULT_PROFILE) -> DataFrame:
    """Scorecard of a repair of missing values (a plan or a function): it runs,
    the listed columns (else all) hold no missing value any more, and a forest
    trains on the result and predicts the test rows."""
    keys = [key] if isinstance(key, str) else list(key)
    checks: dict = {}
    try:
        d = train_test_split(df, keys, cfg.test_size, cfg.random_state)
        fixed = fix(d) if callable(fix) and not isinstance(fix, DataFrame) else apply_fixes(d, fix, target, split_col="is_test", key=[k for k in keys if k != target])
        fixed = fixed.persist()
        checks["runs"] = (True, f"{fixed.count()} rows")
    except Exception as exc:
        return scorecard("missing", {"runs": (False, f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}")})
    try:
        lacking = [r["col_name"] for r in check_nulls_cleared(fixed, cols).collect()]
        checks["nulls_cleared"] = (not lacking, f"still missing: {lacking}" if lacking else "no missing values")
        problems = [f"{r['problem']}: {r['col_name']}" for r in check_encoded(fixed, target).collect()]
        if problems:
            checks["model_trains"] = (False, ", ".join(problems))
        else:
            vectors = [f.name for f in fixed.schema.fields if f.name.endswith("_vec")]
            feats = numeric_cols(fixed, exclude=[target, *META_COLS, *keys])
            known = fixed.where(F.col(q(target)).isNotNull())
            fit = M.fit_classifier(known.where(~F.col("is_test")), feats, target, "rf", {}, vectors=vectors)
            acc = M.metric_value(fit.predict(known.where(F.col("is_test"))), target, "pred_label", "accuracy")
            checks["model_trains"] = (acc == acc, f"accuracy {acc:.4f}")
    except Exception as exc:
        checks.setdefault("nulls_cleared", (False, str(exc).splitlines()[0] if str(exc) else ""))
        checks["model_trains"] = (False, f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}")
    finally:
        fixed.unpersist(blocking=False)
    return scorecard("missing", checks)


def rmsle_scores(df: DataFrame, feats: Sequence[str], target: str, key, cfg: ProfileConfig = DEFAULT_PROFILE) -> dict:
    """Test RMSLE of a ridge on the target as it is (``before``), of one on
    log1p of it taken back by expm1 (``after``), and of the latter's predictions
    left on the log scale (``logged``)."""
    d = train_test_split(df.where(F.col(q(target)) > -1), key, cfg.test_size, cfg.random_state)
    d = d.withColumn("__ylog", F.log1p(F.col(q(target)).cast("double")))
    d = fill(d, filled_means(d, target, ~F.col("is_test"), exclude=[c for c in numeric_cols(d) if c not in feats]))
    raw, log = (level_moments(d, list(feats), y) for y in (target, "__ylog"))
    test = d.where(F.col("is_test"))
    test = raw.predict(test, list(feats), *ridge(raw.train), out="__raw")
    test = log.predict(test, list(feats), *ridge(log.train), out="__log").withColumn("__back", expm1_clip(F.col("__log")))
    row = test.agg(*[M.rmsle_expr(target, c).alias(c) for c in ("__raw", "__back", "__log")]).first()
    return {"before": row["__raw"], "after": row["__back"], "logged": row["__log"]}


def grade_skew(df: DataFrame, feats: Sequence[str], target: str, key, cfg: ProfileConfig = DEFAULT_PROFILE) -> DataFrame:
    """Scorecard of the log-target repair, from what the data shows: the target
    is skewed and its log1p is not; predictions are back on the target's scale
    (closer to it than the log-scale ones); RMSLE below half the baseline's."""
    y = F.col(q(target)).cast("double")
    skew = df.agg(g1_skew(y).alias("raw"), g1_skew(F.when(y > -1, F.log1p(y))).alias("log")).first()
    scores = rmsle_scores(df, feats, target, key, cfg)
    limit = cfg.skew_threshold
    return scorecard(
        "skew",
        {
            "log_target": (abs(skew["raw"] or 0.0) > limit >= abs(skew["log"] or 0.0), f"skew {skew['raw'] or 0.0:.4f} -> {skew['log'] or 0.0:.4f}"),
            "inverse": (scores["after"] < scores["logged"], f"RMSLE {scores['after']:.4f}, on the log scale {scores['logged']:.4f}"),
            "rmsle": check_improvement(scores["before"], scores["after"], "rmsle_half"),
        },
    )
