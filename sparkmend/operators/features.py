"""Candidate features and the greedy keep-if-better loop.

Regression: candidates are taken in blocks of ``BLOCK``; one centred moments
pass over training and test rows covers the features in the model and the
block, each trial borders the current ridge by one column, and its test RMSE
is exact from the test moments.  So no matrix spans all candidates, and later
blocks are read only if the loop gets there.  Classification: the frame is
cached once and each trial is a logistic fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_FEATURES, DEFAULT_PROFILE, FeatureConfig, ProfileConfig
from ..functions.exprs import numeric_cols, q
from . import models as M
from .evaluate import fill, filled_means
from .fixes import one_hot_vector
from .levels import LevelMoments, centred, level_moments, test_rmse
from .profile import detect_task
from .split import train_test_split


def candidate_features(df: DataFrame, target: str, kinds: Sequence[str] = ("log1p", "ratio", "product"), cols: Sequence[str] | None = None, limit: int | None = None, extra: dict[str, str] | None = None) -> dict[str, tuple[Column, str]]:
    """{fe_name: (Column, SQL text)}: the user's own ``extra`` {fe_name: SQL}
    first, then by rule from the numeric features log1p(x) (x > -1), x / y
    (NULL when y = 0), x * y; at most ``limit`` in that order."""
    cols = list(cols) if cols is not None else numeric_cols(df, exclude=[target])
    out: dict[str, tuple[Column, str]] = {n: (F.expr(sql), sql) for n, sql in (extra or {}).items()}
    if "log1p" in kinds:
        for c in cols:
            x = F.col(q(c)).cast("double")
            out[f"fe_log1p_{c}"] = (F.when(x > -1, F.log1p(x)), f"CASE WHEN {c} > -1 THEN ln(1 + {c}) END")
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            xa, xb = F.col(q(a)).cast("double"), F.col(q(b)).cast("double")
            if "ratio" in kinds:
                out[f"fe_ratio_{a}_{b}"] = (F.try_divide(xa, xb), f"CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / {b} END")
            if "product" in kinds:
                out[f"fe_prod_{a}_{b}"] = (xa * xb, f"CAST({a} AS DOUBLE) * {b}")
    return out if limit is None else dict(list(out.items())[:limit])


# fixed values: texts of the checks, in the order they are applied
FEATURE_CHECKS = {
    "none": "No new column was added",
    "many": "Expected 1 new column, got {n}: {names}",
    "name": "New column '{name}' does not start with 'fe_'",
    "null": "New column '{name}' is entirely NaN",
    "touched": "Columns changed or lost: {names}",
}


def validate_feature(before: DataFrame | Sequence[str], after: DataFrame, non_null: dict | None = None) -> tuple[bool, str]:
    """(ok, name or text): the step must add exactly one column, named fe_*
    and not wholly missing, and leave every old column in place with its type
    (and, for a DataFrame ``before``, with its values: checksums of both frames
    are compared, one pass over each)."""
    old = {f.name: f.dataType for f in before.schema.fields} if isinstance(before, DataFrame) else dict.fromkeys(before)
    now = {f.name: f.dataType for f in after.schema.fields}
    added = [c for c in after.columns if c not in old]
    name = added[0] if added else ""
    touched = sorted(c for c, t in old.items() if c not in now or (t is not None and now[c] != t))
    named = len(added) == 1 and name.startswith("fe_")
    filled = non_null[name] if named and non_null is not None else 0
    if named and not touched and non_null is None:
        cols = list(old) if isinstance(before, DataFrame) else []
        *sums, filled = after.agg(*_checksums(cols), F.count(F.col(q(name)))).first()
        if cols:
            touched = _differ(cols, list(before.agg(*_checksums(cols)).first()), sums)
    failed = next(
        (
            kind
            for kind, bad in (("none", not added), ("many", len(added) > 1), ("name", not named), ("touched", bool(touched)), ("null", filled == 0))
            if bad
        ),
        None,
    )
    if failed is None:
        return True, name
    return False, FEATURE_CHECKS[failed].format(n=len(added), names=touched if failed == "touched" else added, name=name)


def _checksums(cols: Sequence[str]) -> list[Column]:
    """Sums of hashes, of every column and of whole rows; the same however rows
    are dealt or ordered."""
    parts = [[F.col(q(c))] for c in cols] + ([[F.col(q(c)) for c in cols]] if cols else [])
    return [F.sum(F.xxhash64(*p).cast("decimal(38,0)")) for p in parts] + ([F.count(F.lit(1))] if cols else [])


def _differ(cols: list[str], was: list, now: list) -> list[str]:
    """Columns whose values changed; all of them where only their pairing did."""
    changed = sorted(c for c, a, b in zip(cols, was, now, strict=False) if a != b)
    return changed or (sorted(cols) if was != now else [])


class BorderedRidge:
    """Ridge over a growing set of columns of one ``LevelMoments``.  The
    inverse of the current columns' matrix (unit diagonal) is kept, so trying one more column
    borders it: a product with that column's row, no solve of its own."""

    def __init__(self, mo: LevelMoments, current: Sequence[int], alpha: float = 1.0):
        self.mo, self.alpha = mo, alpha
        self.c, self.r, self.mean = centred(mo.train)
        self.keep(list(current))

    def keep(self, current: list[int]) -> None:
        self.idx = current
        m = self.c[np.ix_(current, current)] + self.alpha * np.eye(len(current))
        d = 1.0 / np.sqrt(np.diag(m)) if current else np.zeros(0)
        self.inverse = np.linalg.inv(m * np.outer(d, d)) * np.outer(d, d) if current else np.zeros((0, 0))
        self.w = self.inverse @ self.r[current]

    def score(self, extra: int | None = None) -> float:
        w = np.zeros(len(self.r))
        w[self.idx] = self.w
        if extra is not None:
            row = self.c[self.idx, extra]
            u = self.inverse @ row
            w[extra] = (self.r[extra] - row @ self.w) / (self.c[extra, extra] + self.alpha - row @ u)
            w[self.idx] -= u * w[extra]
        return test_rmse(self.mo.test, w, float(self.mean[-1] - self.mean[:-1] @ w))


BLOCK = 32  # candidates whose moments are read in one pass


def greedy_features(
    df: DataFrame,
    target: str,
    candidates: dict[str, tuple[Column, str]],
    key,
    cfg: FeatureConfig = DEFAULT_FEATURES,
    pcfg: ProfileConfig = DEFAULT_PROFILE,
    task: str | None = None,
    levels: Sequence[str] = (),
):
    """Try candidates in order; keep one when the score is strictly better
    (RMSE lower / accuracy higher); stop at the budget
    max(1, int(ratio * n_original_columns)), after ``patience`` misses in a
    row, or when candidates run out.  ``levels``: text columns that count with
    all their levels.  Returns (frame with kept features, log DataFrame)."""
    spark = df.sparkSession
    task = task or detect_task(df, target, pcfg)
    keys = [key] if isinstance(key, str) else list(key)
    levels = [c for c in levels if c != target]
    d = df.where(F.col(q(target)).isNotNull())
    if "is_test" not in d.columns:
        d = train_test_split(d, keys, pcfg.test_size, pcfg.random_state)
    trials = (_RidgeTrials if task == "regression" else _LogisticTrials)(d, target, levels, candidates)
    names = list(candidates)
    sign = 1.0 if task == "regression" else -1.0  # RMSE falls, accuracy rises
    log: list[tuple] = []
    try:
        trials.load(names[:BLOCK])
        n_orig = len([c for c in df.columns if c not in (target, "is_test", *levels)]) + trials.slots
        cur = trials.score()
        room, misses = max(1, int(cfg.max_feature_ratio * n_orig)), 0
        for it, name in enumerate(names, 1):
            if room == 0 or misses == cfg.early_stop_patience:
                break
            if it > 1 and (it - 1) % BLOCK == 0:
                trials.load(names[it - 1 : it - 1 + BLOCK])
            good, text = validate_feature(d.columns, d.withColumn(name, F.lit(None)), {name: trials.filled(name)})
            new = trials.score(name) if good else cur
            keep = good and sign * new < sign * cur
            # fixed values: reasons in the log
            why = ("Improved metric" if keep else "No improvement") if good else f"Validation failed: {text}"
            log.append((it, name if good else "", candidates[name][1], round(cur, 4), round(new, 4), round(sign * (cur - new), 4), bool(keep), why))
            if keep:
                trials.keep(name)
            cur = new if keep else cur
            room -= keep
            misses = 0 if keep else misses + 1
    finally:
        trials.close()
    out = df.withColumns({n: candidates[n][0] for n in trials.kept}) if trials.kept else df
    schema = "iteration int, feature_name string, code string, metric_before double, metric_after double, delta double, kept boolean, reason string"
    return out, spark.createDataFrame(log, schema)


class _RidgeTrials:
    """Scores by ridge: a block of candidates costs one pass for means and one
    for moments over the base, the kept and the block's columns."""

    def __init__(self, d: DataFrame, target: str, levels: Sequence[str], candidates: dict):
        self.d, self.target, self.levels, self.candidates = d, target, levels, candidates
        self.kept: list[str] = []
        self.slots = 0
        self.base: list[str] | None = None

    def load(self, block: Sequence[str]) -> None:
        wide = self.d.withColumns({n: self.candidates[n][0] for n in [*self.kept, *block]})
        means = filled_means(wide, self.target, ~F.col("is_test"))
        if self.base is None:
            self.base = [c for c in means if c not in self.candidates]
        self.block = {n for n in block if n in means and n.startswith("fe_")}
        cols = [*self.base, *self.kept, *[n for n in block if n in self.block]]
        mo = level_moments(fill(wide, {c: means[c] for c in cols}), cols, self.target, self.levels)
        self.slots, self.place = mo.slots, {c: i for i, c in enumerate(cols)}
        self.model = BorderedRidge(mo, range(len(self.base) + len(self.kept)))

    def filled(self, name: str) -> int:
        return int(name in self.block)

    def score(self, name: str | None = None) -> float:
        return self.model.score(None if name is None else self.place[name])

    def keep(self, name: str) -> None:
        self.kept.append(name)
        self.model.keep([*self.model.idx, self.place[name]])

    def close(self) -> None:
        pass


class _LogisticTrials:
    """Scores by a logistic fit per trial on the cached base frame."""

    def __init__(self, d: DataFrame, target: str, levels: Sequence[str], candidates: dict):
        self.d, self.target, self.candidates = d, target, candidates
        self.kept: list[str] = []
        self.vectors: list[str] = []
        self.base = list(filled_means(d, target, ~F.col("is_test")))
        self.slots = 0
        for i, c in enumerate(levels):
            name = f"__levels_{i}"
            self.d = one_hot_vector(self.d, c, out=name, fit_on=d.where(~F.col("is_test")))
            if name in self.d.columns:
                self.vectors.append(name)
                self.slots += self.d.schema[name].metadata["ml_attr"]["num_attrs"]
        self.cached = self.d.persist()

    def load(self, block: Sequence[str]) -> None:
        wide = self.cached.withColumns({n: self.candidates[n][0] for n in [*self.kept, *block]})
        self.means = filled_means(wide, self.target, ~F.col("is_test"))

    def filled(self, name: str) -> int:
        return int(name in self.means)

    def score(self, name: str | None = None) -> float:
        more = [*self.kept, *([name] if name else [])]
        cols = [*self.base, *more]
        if not cols and not self.vectors:
            return 0.0
        frame = fill(self.cached.withColumns({n: self.candidates[n][0] for n in more}), {c: self.means[c] for c in cols})
        fit = M.fit_classifier(frame.where(~F.col("is_test")), cols, self.target, "logistic", {"C": 1.0}, vectors=self.vectors)
        return M.metric_value(fit.predict(frame.where(F.col("is_test"))), self.target, "pred_label", "accuracy")

    def keep(self, name: str) -> None:
        self.kept.append(name)

    def close(self) -> None:
        self.cached.unpersist()
