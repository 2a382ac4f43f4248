"""The whole repair pipeline as one composition of the operators:
profile -> plan -> apply (fitted on training rows) -> before/after score ->
greedy feature search -> correlation filter.  Only small result tables
(reports, logs, metrics) are built on the driver; the data stays in Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CORR, DEFAULT_FEATURES, DEFAULT_PROFILE, CorrelationConfig, FeatureConfig, ProfileConfig
from ..operators import correlate as C
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import fixes as FX
from ..operators import profile as P
from ..functions.exprs import numeric_cols
from ..session import cut_lineage

SUMMARY_SCHEMA = "step int, stage string, status string, metric string, value double, detail string"


def run_pipeline(
    df: DataFrame,
    target: str,
    key: str,
    cfg: ProfileConfig = DEFAULT_PROFILE,
    fcfg: FeatureConfig = DEFAULT_FEATURES,
    ccfg: CorrelationConfig = DEFAULT_CORR,
    candidate_kinds=("log1p", "ratio", "product"),
) -> dict:
    """Returns a dict of DataFrames: health, plan, evaluation, features_log,
    drop_report, heatmap, final, summary.  A failing stage is recorded in
    the summary (status 'error') and later stages are skipped; ``final`` is then
    the frame as the last good stage left it (the input, if none did)."""
    spark = df.sparkSession
    out: dict = {}
    summary = []
    step = 0

    def note(stage, status, metric=None, value=None, detail=None):
        nonlocal step
        step += 1
        summary.append((step, stage, status, metric, None if value is None else float(value), detail))

    df = df.persist()  # profiled, planned and scored in several passes
    final, levels = df, []  # the best frame so far: what a failing stage leaves
    try:
        task = P.detect_task(df, target, cfg)
        note("task", "ok", "n_classes_max", cfg.max_classes, task)
        health = P.health_report(df, cfg, target, task)
        out["health"] = health
        counts = {r["issue"]: r["n"] for r in P.issue_counts(health).collect()}
        note("profile", "ok", "issues", sum(counts.values()), json.dumps(counts, sort_keys=True))
        plan = FX.recommend_fixes(health, target)
        out["plan"] = plan
        steps = plan.collect()  # one row per finding
        note("plan", "ok", "steps", len(steps), ",".join(f"{s['action']}:{s['col_name']}" for s in steps))
        result, fixed = EV.evaluate_fix(df, steps, target, key, cfg, task, expand=False)
        out["evaluation"] = result
        r = result.first()
        note("repair", "error" if r["exec_error"] else "ok", r["metric"], r["after"], f"before={r['before']} reward={r['reward']}" + (f" error={r['exec_error']}" if r["exec_error"] else ""))
        if r["exec_error"]:
            raise RuntimeError(r["exec_error"])
        # the repaired frame feeds the feature search and the filter (several
        # passes): its lineage is cut with a reliable checkpoint in the
        # cluster's shared checkpoint folder
        final = fixed = cut_lineage(fixed.drop(*[c for c in ("weight",) if c in fixed.columns]))
        levels = FX.encoded_columns(steps, fixed, [key, target])
        # candidates come from columns of the input
        cands = FE.candidate_features(fixed, target, candidate_kinds, cols=[c for c in numeric_cols(fixed, exclude=[target, key]) if c in df.columns])
        final, log = FE.greedy_features(fixed, target, cands, key, fcfg, cfg, task, levels=levels)
        out["features_log"] = log
        kept = [x["feature_name"] for x in log.where("kept").collect()]
        note("features", "ok", "kept", len(kept), ",".join(kept))
        filtered, report, drop_report, heat = C.filter_features(final, target, ccfg, levels, ~F.col("is_test"))
        out["drop_report"], out["heatmap"], final, levels = drop_report, heat, filtered, []
        note("filter", "ok", "features_after", report["n_features_after"], f"low={report['dropped_low_target_corr']} redundant={report['dropped_redundant']}")
    except Exception as exc:  # the partial result is kept
        note("pipeline", "error", None, None, f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}")
    out["final"] = _encoded(final, levels).drop("is_test")
    out["summary"] = spark.createDataFrame(summary, SUMMARY_SCHEMA)
    df.unpersist(blocking=False)  # every returned frame is local or checkpointed
    return out


def _encoded(df: DataFrame, levels: list[str]) -> DataFrame:
    """Text columns that the plan encodes as 0/1 columns, one per level however
    many there are, levels taken from the training rows."""
    return FX.one_hot(df, levels, max_levels=None, fit_on=df.where("NOT is_test")) if levels else df
