"""Repair operators and the report -> plan -> apply chain.

Every fit is one aggregate pass over the fit rows (optionally only the
training rows) whose few numbers come back as literals; every apply is a
projection (no shuffle).  Level lists for encoders are bounded and
checked before they are used as literals.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_PROFILE, DEFAULT_REWARD
from ..functions.exprs import clip_keep_null, coerce_numeric, q
from ..session import cut_lineage
from .levels import SMALL, join_levels
from .quantiles import exact_quantiles, order_statistics

MAX_LEVELS = 1000  # of a literal level list; more are joined or become one sparse vector


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "mean", fit_on: DataFrame | None = None) -> DataFrame:
    """Missing -> column mean or exact median, fitted on ``fit_on`` rows
    (default: all rows)."""
    cols = list(cols)
    if not cols:
        return df
    src = df if fit_on is None else fit_on
    if strategy == "mean":
        row = src.agg(*[F.avg(F.col(q(c)).cast("double")).alias(c) for c in cols]).first()
        vals = {c: row[c] for c in cols}
    elif strategy == "median":
        qs = exact_quantiles(src, cols, [0.5])
        vals = {c: qs[c][0] for c in cols}
    else:
        raise ValueError(f"unknown strategy {strategy}")
    repl = {}
    for c in cols:
        if vals[c] is None:
            continue
        dt = df.schema[c].dataType
        target_t = dt if isinstance(dt, (T.DoubleType, T.FloatType)) else T.DoubleType()
        repl[c] = F.coalesce(F.col(q(c)).cast(target_t), F.lit(float(vals[c])).cast(target_t))
    return df.withColumns(repl)


def few_levels(df: DataFrame, col: str, max_levels: int | None = MAX_LEVELS) -> list | None:
    """Sorted distinct non-missing levels, None if there are more than
    ``max_levels`` (a distinct + limit job; without a limit: all of them)."""
    found = df.select(F.col(q(col))).where(F.col(q(col)).isNotNull()).distinct()
    rows = (found if max_levels is None else found.limit(max_levels + 1)).collect()
    return sorted(r[0] for r in rows) if max_levels is None or len(rows) <= max_levels else None


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-missing levels of a column known to have few."""
    found = few_levels(df, col, max_levels)
    if found is None:
        raise ValueError(f"{col}: more than {max_levels} levels; use category_codes_join")
    return found


def level_column(col: str, level) -> Column:
    """The 0/1 column of one level, named col_level; missing -> 0."""
    return F.col(q(col)).eqNullSafe(F.lit(level)).cast("int").alias(f"{col}_{level}")


def one_hot(df: DataFrame, cols: Sequence[str], drop_first: bool = True, max_levels: int | None = MAX_LEVELS, fit_on: DataFrame | None = None) -> DataFrame:
    """One 0/1 column per sorted level named col_level, first level dropped,
    missing -> all 0; the source column is removed and the dummies go to
    the end (in column, then level order).  A column of more than
    ``max_levels`` levels becomes one sparse vector col_vec of the same slots
    instead (``one_hot_vector``); with None every level has its column."""
    src = df if fit_on is None else fit_on
    known = {c: few_levels(src, c, max_levels) for c in cols}
    for c in [c for c in cols if known[c] is None]:
        df = one_hot_vector(df, c, drop_first=drop_first, fit_on=src)
    keep = [F.col(q(c)) for c in df.columns if known.get(c) is None]
    dummies = []
    for c, lv in known.items():
        for v in (lv or [])[1 if drop_first else 0 :]:
            dummies.append(level_column(c, v))
    return df.select(*keep, *dummies)


def one_hot_vector(df: DataFrame, col: str, out: str | None = None, drop_first: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """Wide case of ``one_hot``: one sparse vector column with a slot per
    sorted level (the first one left out with ``drop_first``) instead of one
    column per level.  The level table stays on the cluster and is joined.
    Missing and unseen levels -> an all-zero vector; a column with no slot at
    all is only removed."""
    from pyspark.ml.feature import OneHotEncoder

    out = out or f"{col}_vec"
    codes = level_codes(df if fit_on is None else fit_on, col)
    first = 1 if drop_first else 0
    slots = codes.count() - first
    if slots <= 0:
        return df.drop(col)
    # the slot after the last one stands for "none" and is dropped by the encoder
    size = df.sparkSession.createDataFrame([(float(slots),)], "__idx double")
    enc = OneHotEncoder(inputCols=["__idx"], outputCols=["__vec"], dropLast=True).fit(size)
    idx = F.when(F.col("__code") >= first, F.col("__code") - first).otherwise(slots).cast("double")
    coded = join_levels(df, codes.withColumnRenamed("__lv", "__l"), col, small=slots <= SMALL).withColumn("__idx", idx)
    # the number of slots in the schema, without a name for each
    vec = F.col("__vec").alias(out, metadata={"ml_attr": {"num_attrs": slots}})
    return enc.transform(coded).select(*[F.col(q(c)) for c in df.columns if c != col], vec)


def category_codes(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """String -> position of its level in sorted order; missing -> -1.
    Few levels: a literal map lookup (no join).  Many levels: the distinct
    level table is ranked and broadcast-joined (``category_codes_join``)."""
    repl = {}
    for c in cols:
        lv = few_levels(df, c, max_levels)
        if lv is None:
            df = category_codes_join(df, c)
            continue
        m = F.create_map(*[x for i, v in enumerate(lv) for x in (F.lit(v), F.lit(i))]) if lv else None
        repl[c] = F.coalesce(m[F.col(q(c))], F.lit(-1)).cast("int") if m is not None else F.lit(-1).cast("int")
    return df.withColumns(repl) if repl else df


def level_codes(df: DataFrame, col: str, n_ranges: int | None = None) -> DataFrame:
    """(__lv, __code): sorted position of every level, without a single-task
    window: the distinct levels are range-partitioned (sampled boundaries, so
    no partition holds most levels), each range is numbered locally, and the
    per-range counts (one row per range) give the offsets."""
    from pyspark.sql import Window

    spark = df.sparkSession
    n_ranges = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lv = df.select(F.col(q(col)).alias("__lv")).where(F.col("__lv").isNotNull()).distinct()
    # ranges and their numbers are written once: both uses below must see the
    # same boundaries, which a second evaluation need not give
    ranged = cut_lineage(lv.repartitionByRange(n_ranges, "__lv").withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    # one row per range: a window over this small table only
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy("__pid").orderBy("__lv")) - 1
    return ranged.join(F.broadcast(offs), "__pid").select("__lv", (F.col("__off") + place).cast("int").alias("__code"))


def category_codes_join(df: DataFrame, col: str, n_ranges: int | None = None) -> DataFrame:
    """Codes for a column with many levels, by a join with ``level_codes``."""
    codes = level_codes(df, col, n_ranges)
    out = join_levels(df, codes.withColumnRenamed("__lv", "__l"), col, small=False)
    return out.withColumn(col, F.coalesce(F.col("__code"), F.lit(-1)).cast("int")).drop("__code")


def scale_params(src: DataFrame, cols: Sequence[str], method: str) -> dict:
    """{col: (center, scale)} with sklearn's conventions: standard uses the
    population std, a zero scale becomes 1."""
    cols = list(cols)
    out = {}
    if method == "standard":
        row = src.agg(*[x for c in cols for x in (F.avg(F.col(q(c)).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(q(c)).cast("double")).alias(f"s_{c}"))]).first()
        for c in cols:
            s = row[f"s_{c}"]
            out[c] = (row[f"m_{c}"], s if s not in (None, 0.0) else 1.0)
    elif method == "minmax":
        row = src.agg(*[x for c in cols for x in (F.min(F.col(q(c)).cast("double")).alias(f"lo_{c}"), F.max(F.col(q(c)).cast("double")).alias(f"hi_{c}"))]).first()
        for c in cols:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            rng = None if lo is None else hi - lo
            out[c] = (lo, rng if rng not in (None, 0.0) else 1.0)
    elif method == "robust":
        qs = exact_quantiles(src, cols, [0.25, 0.5, 0.75])
        for c in cols:
            q1, med, q3 = qs[c]
            iqr = None if q1 is None else q3 - q1
            out[c] = (med, iqr if iqr not in (None, 0.0) else 1.0)
    else:
        raise ValueError(f"unknown scaler {method}")
    return out


def apply_scale(df: DataFrame, params: dict) -> DataFrame:
    repl = {}
    for c, (center, sc) in params.items():
        if center is None:
            continue
        repl[c] = (F.col(q(c)).cast("double") - F.lit(float(center))) / F.lit(float(sc))
    return df.withColumns(repl)


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """standard: (x-mean)/std_pop; minmax: (x-min)/(max-min), constant -> 0;
    robust: (x-median)/IQR.  Fitted on ``fit_on`` rows (default all)."""
    return apply_scale(df, scale_params(df if fit_on is None else fit_on, cols, method))


def row_normalize(df: DataFrame, vec: str | None = None, cols: Sequence[str] | None = None, out: str | None = None) -> DataFrame:
    """Each row divided by its L2 norm (a zero row stays zero)."""
    if vec is not None:
        v = F.transform(F.col(q(vec)), lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        res = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
        return df.withColumn(out or vec, res)
    cols = list(cols or [])
    norm = F.sqrt(sum((F.coalesce(F.col(q(c)).cast("double"), F.lit(0.0)) ** 2 for c in cols), F.lit(0.0)))
    return df.withColumns({c: F.when(norm > 0, F.col(q(c)) / norm).otherwise(F.col(q(c)).cast("double")) for c in cols})


def clip_outliers(df: DataFrame, cols: Sequence[str], k: float = DEFAULT_REWARD.clip_iqr_factor, fit_on: DataFrame | None = None) -> DataFrame:
    """Clip into [Q1 - k*IQR, Q3 + k*IQR] with exact quartiles; NULL stays."""
    cols = list(cols)
    qs = exact_quantiles(df if fit_on is None else fit_on, cols, [0.25, 0.75])
    repl = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        repl[c] = clip_keep_null(F.col(q(c)).cast("double"), q1 - k * iqr, q3 + k * iqr)
    return df.withColumns(repl)


def balanced_weights(df: DataFrame, label: str, out: str = "weight", fit_on: DataFrame | None = None) -> DataFrame:
    """Row weight n / (k * n_class) (sklearn 'balanced'); the class table
    (one row per class) is broadcast up to MAX_LEVELS classes."""
    src = df if fit_on is None else fit_on
    counts = src.where(F.col(q(label)).isNotNull()).groupBy(F.col(q(label)).alias("__cls")).agg(F.count("*").alias("__nc"))
    # internal names differ from any ``out`` name
    from pyspark.sql import Window

    every = Window.partitionBy()  # over the class table only (one row per class)
    w = counts.select("__cls", (F.sum("__nc").over(every) / (F.count("*").over(every) * F.col("__nc"))).alias("__bw_val"))
    small = counts.limit(MAX_LEVELS + 1).count() <= MAX_LEVELS
    joined = df.join(F.broadcast(w) if small else w, df[label].eqNullSafe(w["__cls"]), "left")
    return joined.withColumn(out, F.col("__bw_val")).drop("__cls", "__bw_val")


# ── report -> plan -> apply ─────────────────────────────────────────────────

# fixed values: the repair order (cast -> impute -> encode -> clip -> scale
# -> log-target -> weights) and the action chosen for each issue kind
PLAN_RULES = [
    ("wrong_dtypes", 1, "cast_numeric", "{}"),
    ("missing_values", 2, "impute_median", "{}"),
    ("dtype", 3, "one_hot", '{"drop_first": true}'),
    ("outliers", 4, "clip_iqr", '{"k": 1.5}'),
    ("scale_mismatch", 5, "standard_scale", "{}"),
    ("high_skew", 6, "log_target", "{}"),
    ("class_imbalance", 7, "balanced_weights", "{}"),
]

PLAN_SCHEMA = "seq int, issue string, col_name string, action string, params string"


def recommend_fixes(report: DataFrame, target: str) -> DataFrame:
    """Ordered repair steps from a health report, as a join of the report
    with the rule table:
    cast wrong-typed text columns; median-impute numeric missing columns
    (missing text is left to the encoder: all-zero dummies); one-hot the
    remaining text features; clip outlier features; standard-scale the
    numeric features on a scale mismatch; log-transform a skewed target;
    weight classes on imbalance."""
    spark = report.sparkSession
    rules = spark.createDataFrame(PLAN_RULES, "issue string, step int, action string, params string")
    rep = report.select("issue", F.col("col_name"), "detail")
    wrong = rep.where(F.col("issue") == "wrong_dtypes").select(F.col("col_name").alias("__w"))
    types = rep.where(F.col("issue") == "dtype").select(F.col("col_name").alias("__c"), F.col("detail").alias("__t"))
    r = rep.join(F.broadcast(wrong), rep["col_name"] == wrong["__w"], "left").join(F.broadcast(types), rep["col_name"] == types["__c"], "left")
    is_text = (F.col("__t") == "string") & F.col("__w").isNull()
    keep = (
        (F.col("issue") == "wrong_dtypes")
        | ((F.col("issue") == "missing_values") & ~is_text & (F.col("col_name") != target))
        | ((F.col("issue") == "dtype") & is_text & (F.col("col_name") != target))
        | ((F.col("issue") == "outliers") & (F.col("col_name") != target))
        | (F.col("issue") == "scale_mismatch")
        | ((F.col("issue") == "high_skew") & (F.col("col_name") == target))
        | (F.col("issue") == "class_imbalance")
    )
    steps = r.where(keep).join(F.broadcast(rules), "issue").select(
        "step",
        "issue",
        F.when(F.col("issue") == "class_imbalance", F.lit(target)).otherwise(F.col("col_name")).alias("col_name"),
        "action",
        "params",
    )
    from pyspark.sql import Window

    # one row per report finding (bounded by the column count): a small window
    w = Window.orderBy("step", F.col("col_name").asc_nulls_first())
    return steps.select(F.row_number().over(w).cast("int").alias("seq"), "issue", "col_name", "action", "params")


def apply_fixes(
    df: DataFrame, plan: DataFrame | list, target: str, split_col: str | None = None, key: str | Sequence[str] | None = None, expand: bool = True
) -> DataFrame:
    """Run the ordered steps.  With ``split_col`` every statistic is fitted
    on training rows only (split_col false).  ``key`` columns are never changed.
    Encoded text columns go last, after the other steps (which leave 0/1 columns
    as they are); ``expand=False`` leaves them as text, for the scores that take
    text columns (``encoded_columns`` names them).

    Steps on one column depend on each other, those on different columns do
    not: the k-th statistics of all columns are read together (``_Repair``), and
    the result is one projection."""
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    steps = plan.orderBy("seq").collect() if isinstance(plan, DataFrame) else plan  # plan rows: one per column at most
    fit = df.where(~F.col(q(split_col))) if split_col else df
    repair = _Repair(df, fit)
    logged = weighted = False
    for action in dict.fromkeys(s["action"] for s in steps):
        mine = [s for s in steps if s["action"] == action]
        cols = [s["col_name"] for s in mine if s["col_name"] in df.columns and s["col_name"] not in keys]
        if action == "cast_numeric":
            repair.cast(cols)
        elif action == "impute_median":
            repair.order(cols, median=True)
        elif action == "clip_iqr":
            repair.order(cols, clip=json.loads(mine[0]["params"]).get("k", DEFAULT_REWARD.clip_iqr_factor))
        elif action == "standard_scale":
            skip = {target, *keys, *([split_col] if split_col else [])}
            repair.scale([c for c in df.columns if repair.numeric(c) and c not in skip])
        elif action == "log_target":
            logged = True
        elif action == "balanced_weights":
            weighted = True
        elif action != "one_hot":
            raise ValueError(f"unknown action {action}")
    out = repair.frame()
    if weighted:
        out = balanced_weights(out, target, fit_on=out.where(~F.col(q(split_col))) if split_col else None)
    if logged:
        y = F.col(q(target)).cast("double")
        out = out.withColumn(target, F.when(y > -1, F.log1p(y)))
    cols = encoded_columns(steps, out, keys)
    return one_hot(out, cols, drop_first=True, fit_on=fit) if cols and expand else out


def encoded_columns(steps: list, df: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """Text columns that a plan's one_hot steps encode."""
    return [s["col_name"] for s in steps if s["action"] == "one_hot" and s["col_name"] in df.columns and s["col_name"] not in keys]


class _Repair:
    """Column expressions that grow step by step.  Statistics are asked for per
    column and read when a later step on any of these columns needs them: one
    round of passes for all columns that wait."""

    def __init__(self, df: DataFrame, fit: DataFrame):
        self.df, self.fit = df, fit
        self.expr: dict = {}
        self.waiting: dict[str, dict] = {}  # column -> median / clip not yet read

    def now(self, c: str):
        return self.expr.get(c, F.col(q(c)))

    def numeric(self, c: str) -> bool:
        return c in self.expr or isinstance(self.df.schema[c].dataType, T.NumericType)

    def cast(self, cols: Sequence[str]) -> None:
        self.settle(cols)
        self.expr |= {c: coerce_numeric(self.now(c)) for c in cols}

    def order(self, cols: Sequence[str], median: bool = False, clip: float | None = None) -> None:
        # a clip may join a median that waits (not the other way round)
        self.settle([c for c in cols if c in self.waiting and (median or "clip" in self.waiting[c])])
        for c in cols:
            self.waiting.setdefault(c, {}).update({"median": True} if median else {"clip": clip})

    def scale(self, cols: Sequence[str]) -> None:
        self.settle(cols)
        fitted = self.fit.select(*[self.now(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
        prm = scale_params(fitted, fitted.columns, "standard")
        for i, c in enumerate(cols):
            center, sc = prm[f"x{i}"]
            if center is not None:
                self.expr[c] = (self.now(c).cast("double") - F.lit(float(center))) / F.lit(float(sc))

    def frame(self) -> DataFrame:
        self.settle(list(self.waiting))
        return self.df.withColumns(self.expr) if self.expr else self.df

    def settle(self, cols: Sequence[str]) -> None:
        """Reads what is asked of ``cols`` and, with it, of every column."""
        if not any(c in self.waiting for c in cols):
            return
        asked, self.waiting = self.waiting, {}
        xs = {c: self.now(c).cast("double") for c in asked}
        row = self.fit.agg(F.count(F.lit(1)).alias("all"), *[F.count(x).alias(f"n{i}") for i, x in enumerate(xs.values())]).first()
        n = {c: int(row[f"n{i}"]) for i, c in enumerate(xs)}
        values = _filled_quantiles(self.fit, xs, n, int(row["all"]), asked)
        for c, want in asked.items():
            if not n[c]:
                continue
            kind = self.df.schema[c].dataType
            kind = kind if isinstance(kind, (T.DoubleType, T.FloatType)) and c not in self.expr else T.DoubleType()
            if want.get("median"):
                self.expr[c] = F.coalesce(self.now(c).cast(kind), F.lit(float(values[c, 0.5])).cast(kind))
            if want.get("clip") is not None:
                q1, q3 = values[c, 0.25], values[c, 0.75]
                self.expr[c] = clip_keep_null(self.now(c).cast("double"), q1 - want["clip"] * (q3 - q1), q3 + want["clip"] * (q3 - q1))


def _filled_quantiles(fit: DataFrame, xs: dict, n: dict, rows: int, asked: dict) -> dict:
    """{(column, p): quantile}: medians, and quartiles of the columns once their
    missing values are the median.  With k copies of the median m added, the
    i-th smallest is x[i] where that is below m, x[i - k] where that is above,
    else m; so all of it takes order statistics of the column as it is."""
    targets: dict = {}
    for c, want in asked.items():
        if not n[c]:
            continue
        added = rows - n[c] if want.get("median") else 0
        if want.get("median"):
            targets[c, 0.5, 0] = (c, *_ranks(n[c], 0.5))
        for p in (0.25, 0.75) if want.get("clip") is not None else ():
            lo, hi = _ranks(n[c] + added, p)
            for shift in {0, added}:
                a, b = (min(max(r - shift, 0), n[c] - 1) for r in (lo, hi))
                targets[c, p, shift] = (c, a, b)
    if not targets:
        return {}
    delta = 2.0 / DEFAULT_PROFILE.quantile_accuracy
    keys = list(targets)
    sketch = []
    for t, k in enumerate(keys):
        c, lo, hi = targets[k]
        at = [max(lo / n[c] - delta, 0.0), min((hi + 1) / n[c] + delta, 1.0)]
        sketch.append(F.percentile_approx(xs[c], at, DEFAULT_PROFILE.quantile_accuracy).alias(f"s{t}"))
    row = fit.agg(*sketch).first()
    found = order_statistics(fit, xs, targets, {k: list(row[f"s{t}"]) for t, k in enumerate(keys)})
    out: dict = {}
    for c, want in asked.items():
        if not n[c]:
            continue
        added = rows - n[c] if want.get("median") else 0
        if want.get("median"):
            out[c, 0.5] = _between_ranks(found[c, 0.5, 0], n[c], 0.5)
        for p in (0.25, 0.75) if want.get("clip") is not None else ():
            pair = found[c, p, 0]
            if added:
                m, lo_hi = out[c, 0.5], _ranks(n[c] + added, p)
                pair = tuple(
                    low if r < n[c] and low < m else high if r >= added and high > m else m
                    for r, low, high in zip(lo_hi, pair, found[c, p, added], strict=True)
                )
            out[c, p] = _between_ranks(pair, n[c] + added, p)
    return out


def _ranks(n: int, p: float) -> tuple[int, int]:
    h = (n - 1) * p
    return math.floor(h), math.ceil(h)


def _between_ranks(pair: tuple, n: int, p: float) -> float:
    h = (n - 1) * p
    return pair[0] + (pair[1] - pair[0]) * (h - math.floor(h))
