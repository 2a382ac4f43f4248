"""Data-health checks: fused statistics passes, long-form outputs.

Every check reads only the columns it needs (Catalyst prunes the parquet
scan) and computes all columns in one ``agg``; only the small aggregate
row reaches the driver.  Results are long tables (one row per column /
issue), built from those few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_PROFILE, ProfileConfig
from ..functions.exprs import (
    categorical_cols,
    coerce_numeric,
    g1_skew,
    is_missing,
    numeric_cols,
    q,
)
from .quantiles import bracket_exprs, exact_quantiles, read_brackets, resolve


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ── missing values ──────────────────────────────────────────────────────────


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing) for columns holding at least one missing value.

    Stays lazy: one aggregate row, unpivoted, filtered."""
    cols = list(cols) if cols is not None else df.columns
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, n_missing bigint")
    agg = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in cols])
    long = agg.unpivot([], cols, "col_name", "n_missing")
    return long.where(F.col("n_missing") > 0).select("col_name", F.col("n_missing").cast("bigint").alias("n_missing"))


# ── skew, scale, ranges ─────────────────────────────────────────────────────


def skewness_report(df: DataFrame, cfg: ProfileConfig = DEFAULT_PROFILE, cols=None) -> DataFrame:
    """(column, skew): bias-corrected G1 rounded to 4 dp, |G1| > threshold."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, skew double")
    agg = df.agg(*[g1_skew(F.col(q(c)).cast("double")).alias(c) for c in cols])
    long = agg.unpivot([], cols, "col_name", "g1")
    return long.where(F.abs("g1") > cfg.skew_threshold).select("col_name", F.round("g1", 4).alias("skew"))


def scale_mismatch(df: DataFrame, cfg: ProfileConfig = DEFAULT_PROFILE, cols=None) -> DataFrame:
    """One row: (max_col, min_col, ratio, mismatch) over the sample std of
    the numeric columns; fewer than two non-zero stds -> not a mismatch."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([(None, None, None, False)], "max_col string, min_col string, ratio double, mismatch boolean")
    agg = df.agg(*[F.stddev_samp(F.col(q(c)).cast("double")).alias(c) for c in cols])
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    long = agg.unpivot([], cols, "col_name", "std").where(F.col("std") > 0).withColumn("ord", order[F.col("col_name")])
    top = F.max(F.struct(F.col("std"), (-F.col("ord")).alias("neg"), F.col("col_name")))
    bot = F.min(F.struct(F.col("std"), F.col("ord"), F.col("col_name")))
    summary = long.agg(F.count("*").alias("k"), top.alias("top"), bot.alias("bot"))
    ratio = F.col("top.std") / F.col("bot.std")
    return summary.select(
        F.when(F.col("k") >= 2, F.col("top.col_name")).alias("max_col"),
        F.when(F.col("k") >= 2, F.col("bot.col_name")).alias("min_col"),
        F.when(F.col("k") >= 2, ratio).alias("ratio"),
        F.coalesce((F.col("k") >= 2) & (ratio > cfg.scale_ratio), F.lit(False)).alias("mismatch"),
    )


def column_ranges(df: DataFrame, cols=None) -> DataFrame:
    """(column, min, max, range) for numeric columns."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    exprs = []
    for c in cols:
        x = F.col(q(c)).cast("double")
        exprs.append(F.struct(F.lit(c).alias("col_name"), F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    agg = df.agg(*exprs)
    long = agg.select(F.explode(F.array(*[F.col(q(c)) for c in cols])).alias("s")).select("s.*")
    return long.withColumn("range", F.col("max") - F.col("min"))


# ── quantiles and outliers ──────────────────────────────────────────────────


def quantiles(df: DataFrame, cols=None, probs=(0.25, 0.5, 0.75, 0.95), cfg: ProfileConfig = DEFAULT_PROFILE, mode: str = "exact") -> DataFrame:
    """(column, q, value).  mode='exact' (linear interpolation, bracketed so
    no task holds a whole column) or 'approx' (percentile_approx)."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    spark = df.sparkSession
    schema = _schema(("col_name", T.StringType()), ("q", T.DoubleType()), ("value", T.DoubleType()))
    if mode == "approx":
        agg = df.agg(*[F.percentile_approx(F.col(q(c)).cast("double"), list(probs), cfg.quantile_accuracy).alias(c) for c in cols])
        long = agg.unpivot([], cols, "col_name", "vals")
        pv = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("q"), F.col("vals").alias("value"))
        return long.select("col_name", F.explode(pv).alias("z")).select("col_name", F.col("z.q").alias("q"), F.col("z.value").alias("value"))
    vals = exact_quantiles(df, cols, probs, cfg)
    rows = [(c, float(p), vals[c][j]) for c in cols for j, p in enumerate(probs)]
    return _frame(spark, rows, schema)


def iqr_fences(df: DataFrame, cols, k: float, cfg: ProfileConfig = DEFAULT_PROFILE) -> dict:
    """{column: (q1, q3, lower, upper)} with exact quartiles."""
    vals = exact_quantiles(df, cols, (0.25, 0.75), cfg)
    out = {}
    for c in cols:
        q1, q3 = vals[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def _outlier_pred(c: str, lower: float, upper: float):
    x = F.col(q(c)).cast("double")
    return (x < F.lit(lower)) | (x > F.lit(upper))


def outlier_counts_from_fences(df: DataFrame, fences: dict, cfg: ProfileConfig = DEFAULT_PROFILE) -> list[tuple]:
    keep = {c: f for c, f in fences.items() if (f[1] - f[0]) >= cfg.iqr_floor}
    if not keep:
        return []
    row = df.agg(*[F.count_if(_outlier_pred(c, f[2], f[3])).alias(c) for c, f in keep.items()]).first()
    out = []
    for c, (q1, q3, lo, hi) in keep.items():
        cnt = int(row[c])
        if cnt >= cfg.outlier_min_count:
            out.append((c, q1, q3, lo, hi, cnt))
    return out


OUTLIER_SCHEMA = _schema(
    ("col_name", T.StringType()),
    ("q1", T.DoubleType()),
    ("q3", T.DoubleType()),
    ("lower", T.DoubleType()),
    ("upper", T.DoubleType()),
    ("n_outliers", T.LongType()),
)


def outlier_counts(df: DataFrame, cfg: ProfileConfig = DEFAULT_PROFILE, cols=None, k: float | None = None) -> DataFrame:
    """(column, q1, q3, lower, upper, n_outliers) outside k*IQR fences;
    columns with IQR below the floor are skipped."""
    cols = list(cols) if cols is not None else numeric_cols(df)
    k = cfg.outlier_iqr_factor if k is None else k
    fences = iqr_fences(df, cols, k, cfg)
    return _frame(df.sparkSession, outlier_counts_from_fences(df, fences, cfg), OUTLIER_SCHEMA)


def outlier_flag(df: DataFrame, cols, k: float | None = None, cfg: ProfileConfig = DEFAULT_PROFILE, filter_only: bool = False) -> DataFrame:
    """Adds is_outlier_<c> (NULL input -> false); or keeps outlier rows only."""
    k = cfg.outlier_iqr_factor if k is None else k
    fences = iqr_fences(df, list(cols), k, cfg)
    preds = {c: F.coalesce(_outlier_pred(c, f[2], f[3]), F.lit(False)) for c, f in fences.items()}
    if filter_only:
        cond = F.lit(False)
        for p in preds.values():
            cond = cond | p
        return df.where(cond)
    return df.withColumns({f"is_outlier_{c}": p for c, p in preds.items()})


# ── target: classes, task type ──────────────────────────────────────────────


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, count) of the target, missing excluded."""
    t = F.col(q(target))
    return df.where(t.isNotNull()).groupBy(t.alias("class")).agg(F.count("*").alias("count"))


def some_values(df: DataFrame, col: str, most: int) -> DataFrame:
    """(value) distinct non-missing values of a column, as text, all of them if there are
    at most ``most`` and else at least so many: a task keeps ``most`` values and stops reading
    there, so a column of many values is neither read nor shuffled whole."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            seen |= dict.fromkeys(pc.unique(batch.column(0)).to_pylist())
            if len(seen) >= most:
                break
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)[:most], pa.string())], ["value"])

    x = F.col(q(col))
    return df.where(x.isNotNull()).select(x.cast("string").alias("value")).mapInArrow(part, "value string").distinct()


def task_type(df: DataFrame, target: str, cfg: ProfileConfig = DEFAULT_PROFILE) -> DataFrame:
    """(n_distinct, task_type): classification when at most 10 distinct
    non-missing target values; ``n_distinct`` counts to 11 (more than 10)."""
    n = F.least(F.count(F.lit(1)), F.lit(cfg.max_classes + 1)).cast("bigint")
    few = F.col("n_distinct") <= cfg.max_classes
    counted = some_values(df, target, cfg.max_classes + 1).agg(n.alias("n_distinct"))
    return counted.select("n_distinct", F.when(few, F.lit("classification")).otherwise(F.lit("regression")).alias("task_type"))


def detect_task(df: DataFrame, target: str, cfg: ProfileConfig = DEFAULT_PROFILE) -> str:
    """Driver-side task type."""
    return task_type(df, target, cfg).first()["task_type"]


def class_imbalance(df: DataFrame, target: str, cfg: ProfileConfig = DEFAULT_PROFILE, task: str | None = None) -> DataFrame:
    """(minority, ratio, imbalanced, message): smallest class count over all
    rows (missing target rows count in the denominator).  Ties -> smallest
    label.  No row for a regression target or an empty table.  With ``task``
    the number of classes does not matter; without, more than
    ``cfg.max_classes`` values mean regression."""
    t = F.col(q(target))
    g = df.groupBy(t.alias("cls")).agg(F.count("*").alias("n"))
    if task == "regression":
        g = g.limit(0)
    s = g.agg(
        F.sum("n").alias("total"),
        F.count("cls").alias("n_classes"),
        F.min(F.when(F.col("cls").isNotNull(), F.struct(F.col("n"), F.col("cls")))).alias("m"),
    )
    ratio = F.col("m.n") / F.col("total")
    ratio_txt = F.format_string("%.4f", ratio.cast("double"))
    msg = F.concat(
        F.lit(f"Imbalanced target '{target}': class '"),
        F.col("m.cls").cast("string"),
        F.lit("' has ratio "),
        ratio_txt,
        F.lit(f" (threshold {cfg.imbalance_threshold})"),
    )
    imb = ratio < cfg.imbalance_threshold
    few = F.lit(True) if task == "classification" else F.col("n_classes") <= cfg.max_classes
    return s.where(few & (F.col("n_classes") >= 1)).select(
        F.col("m.cls").cast("string").alias("minority"),
        ratio.cast("double").alias("ratio"),
        imb.alias("imbalanced"),
        F.when(imb, msg).alias("message"),
    )


def target_std(df: DataFrame, target: str, task: str) -> DataFrame:
    """Fallback score with no usable feature: sample std of the target for
    regression with more than one row, else 0."""
    t = F.col(q(target)).cast("double")
    v = F.coalesce(F.stddev_samp(t), F.lit(0.0)) if task == "regression" else F.lit(0.0)
    return df.where(t.isNotNull()).agg(v.alias("score"))


# ── wrong dtypes ────────────────────────────────────────────────────────────


def wrong_dtypes_exprs(df: DataFrame, cols):
    out = []
    for c in cols:
        x = F.col(q(c))
        out.append(F.count(x).alias(f"wd_n_{c}"))
        out.append(F.count_if(x.isNotNull() & coerce_numeric(x).isNull() & ~F.lower(F.trim(x)).isin("nan")).alias(f"wd_bad_{c}"))
    return out


def wrong_dtypes(df: DataFrame, cols=None, sample: int | None = None, key: str | None = None) -> DataFrame:
    """(column, dtype, n_checked, n_bad, message) for string columns whose
    every non-missing value parses as a number (full scan, one pass).
    ``sample=50, key=k`` checks only the first 50 non-missing values of each
    column in key order (the reference's sample, made deterministic): one
    bounded top-k per column."""
    cols = list(cols) if cols is not None else categorical_cols(df)
    if sample is not None and key is not None and cols:
        rows = []
        for c in cols:
            head = head_non_null(df, c, sample, key)
            r = head.agg(*wrong_dtypes_exprs(head, [c])).first()
            rows += _wrong_rows(r, [c])
        return _frame(df.sparkSession, rows, _schema(
            ("col_name", T.StringType()), ("dtype", T.StringType()), ("n_checked", T.LongType()), ("n_bad", T.LongType()), ("message", T.StringType())))
    spark = df.sparkSession
    schema = _schema(
        ("col_name", T.StringType()),
        ("dtype", T.StringType()),
        ("n_checked", T.LongType()),
        ("n_bad", T.LongType()),
        ("message", T.StringType()),
    )
    if not cols:
        return _frame(spark, [], schema)
    row = df.agg(*wrong_dtypes_exprs(df, cols)).first()
    return _frame(spark, _wrong_rows(row, cols), schema)


def _wrong_rows(row, cols):
    out = []
    for c in cols:
        n, bad = int(row[f"wd_n_{c}"]), int(row[f"wd_bad_{c}"])
        if n > 0 and bad == 0:
            out.append((c, "string", n, bad, "stored as string, appears numeric"))
    return out


# ── histogram, null map, heads ──────────────────────────────────────────────


def histogram(df: DataFrame, col: str, bins: int = 40, series: str = "before") -> DataFrame:
    """(series, bin, lo, hi, count, density): equal-width bins between min
    and max (the max value falls into the last bin), density =
    count / (n * width).  A constant column gets the range [v-0.5, v+0.5]."""
    x = F.col(q(col)).cast("double")
    mm = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n")).first()
    spark = df.sparkSession
    schema = _schema(
        ("series", T.StringType()),
        ("bin", T.IntegerType()),
        ("lo", T.DoubleType()),
        ("hi", T.DoubleType()),
        ("count", T.LongType()),
        ("density", T.DoubleType()),
    )
    if mm["n"] == 0:
        return _frame(spark, [], schema)
    mn, mx, n = float(mm["mn"]), float(mm["mx"]), int(mm["n"])
    if mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    width = (mx - mn) / bins
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = edges.join(F.broadcast(counts), "bin", "left").select(
        F.lit(series).alias("series"),
        "bin",
        (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
        (F.coalesce(F.col("count"), F.lit(0)) / F.lit(n * width)).alias("density"),
    )
    return out


def null_map(df: DataFrame, cols, key: str) -> DataFrame:
    """Long 0/1 missing indicator per (key, column) cell."""
    cols = list(cols)
    wide = df.select(F.col(q(key)), *[is_missing(df, c).cast("int").alias(c) for c in cols])
    return wide.unpivot([key], cols, "col_name", "is_null")


def null_rate_blocks(df: DataFrame, cols, key: str, n_blocks: int = 100, seed: int = 42) -> DataFrame:
    """Chartable null map at any size: null rate per (hash block, column)."""
    from ..functions.exprs import row_hash

    cols = list(cols)
    blk = F.pmod(row_hash([key], seed), F.lit(n_blocks)).alias("block")
    agg = df.groupBy(blk).agg(F.count("*").alias("n_rows"), *[F.avg(is_missing(df, c).cast("double")).alias(c) for c in cols])
    return agg.unpivot(["block", "n_rows"], cols, "col_name", "null_rate")


def head_non_null(df: DataFrame, col: str, n: int, key: str) -> DataFrame:
    """First n non-missing values of a column in key order (top-k: the
    limit is the feature; planned as TakeOrderedAndProject)."""
    return df.where(F.col(q(col)).isNotNull()).select(F.col(q(key)), F.col(q(col))).orderBy(F.col(q(key))).limit(n)


# ── selectors and row/column drops ──────────────────────────────────────────


def select_numeric(df: DataFrame, exclude=()) -> DataFrame:
    return df.select(*[F.col(q(c)) for c in numeric_cols(df, exclude)])


def select_categorical(df: DataFrame, exclude=()) -> DataFrame:
    return df.select(*[F.col(q(c)) for c in categorical_cols(df, exclude)])


def dtypes_report(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_name string, dtype string")


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(q(target)).isNotNull())


def drop_null_rows(df: DataFrame, cols) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def drop_all_null_cols(df: DataFrame, cols=None) -> DataFrame:
    """Drop the listed columns that hold no value at all (one count pass)."""
    cols = list(cols) if cols is not None else df.columns
    if not cols:
        return df
    row = df.agg(*[F.count(F.col(q(c))).alias(c) for c in cols]).first()
    empty = [c for c in cols if int(row[c]) == 0]
    return df.drop(*empty)


# ── fused health report ─────────────────────────────────────────────────────

HEALTH_SCHEMA = _schema(
    ("issue", T.StringType()),
    ("col_name", T.StringType()),
    ("value", T.DoubleType()),
    ("detail", T.StringType()),
)

ISSUE_KINDS = ("missing_values", "high_skew", "scale_mismatch", "outliers", "class_imbalance", "wrong_dtypes")


def health_rows(df: DataFrame, cfg: ProfileConfig = DEFAULT_PROFILE, target: str | None = None, task: str | None = None) -> list[tuple]:
    """All checks with three passes over the data:
    (1) one agg: missing counts, G1, std, quantile brackets, parse checks;
    (2) exact quartiles from the brackets; (3) outlier counts.
    The target's class counts are one small groupBy."""
    cols = df.columns
    num = numeric_cols(df)
    cat = categorical_cols(df)
    exprs = [F.count(F.lit(1)).alias("__n")]
    exprs += [F.count_if(is_missing(df, c)).alias(f"miss_{c}") for c in cols]
    exprs += [g1_skew(F.col(q(c)).cast("double")).alias(f"skew_{c}") for c in num]
    exprs += [F.stddev_samp(F.col(q(c)).cast("double")).alias(f"std_{c}") for c in num]
    exprs += bracket_exprs(num, (0.25, 0.75), cfg.quantile_accuracy)
    exprs += wrong_dtypes_exprs(df, cat)
    row = df.agg(*exprs).first()

    out: list[tuple] = []
    for c in cols:
        m = int(row[f"miss_{c}"])
        if m > 0:
            out.append(("missing_values", c, float(m), None))
    for c in num:
        s = row[f"skew_{c}"]
        if s is not None and abs(s) > cfg.skew_threshold:
            out.append(("high_skew", c, round(float(s), 4), None))
    stds = [(c, float(row[f"std_{c}"])) for c in num if row[f"std_{c}"] is not None and row[f"std_{c}"] > 0]
    if len(stds) >= 2:
        hi = max(stds, key=lambda t: t[1])
        lo = min(stds, key=lambda t: t[1])
        ratio = hi[1] / lo[1]
        if ratio > cfg.scale_ratio:
            out.append(("scale_mismatch", None, ratio, f"{hi[0]} / {lo[0]}"))
    if num:
        n, br = read_brackets(row, num, (0.25, 0.75))
        qs = resolve(df, num, (0.25, 0.75), n, br, cfg)
        fences = {}
        for i, c in enumerate(num):
            q1, q3 = qs[(i, 0)], qs[(i, 1)]
            if q1 is None:
                continue
            iqr = q3 - q1
            k = cfg.outlier_iqr_factor
            fences[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
        for c, _q1, _q3, _lo, _hi, cnt in outlier_counts_from_fences(df, fences, cfg):
            out.append(("outliers", c, float(cnt), None))
    if target is not None and task == "classification":
        for r in class_imbalance(df, target, cfg, task).collect():  # one row at most
            if r["imbalanced"]:
                out.append(("class_imbalance", r["minority"], float(r["ratio"]), r["message"]))
    for c, _dt, _n, _bad, msg in _wrong_rows(row, cat):
        out.append(("wrong_dtypes", c, None, msg))
    for f in df.schema.fields:
        out.append(("dtype", f.name, None, f.dataType.simpleString()))
    return out


def health_report(df: DataFrame, cfg: ProfileConfig = DEFAULT_PROFILE, target: str | None = None, task: str | None = None) -> DataFrame:
    """(issue, column, value, detail), one row per finding plus one 'dtype'
    row per column."""
    return _frame(df.sparkSession, health_rows(df, cfg, target, task), HEALTH_SCHEMA)


def issue_counts(report: DataFrame) -> DataFrame:
    """(issue, n): number of findings per issue kind, zero-filled."""
    kinds = report.sparkSession.createDataFrame([(k,) for k in ISSUE_KINDS], "issue string")
    counts = report.where(F.col("issue") != "dtype").groupBy("issue").agg(F.count("*").alias("n"))
    return kinds.join(F.broadcast(counts), "issue", "left").select("issue", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def health_json(report: DataFrame) -> DataFrame:
    """The report as one JSON string (the long table stays the primary
    output); built by an aggregate, no rows through the driver."""
    items = F.collect_list(F.struct("issue", "col_name", "value", "detail"))
    return report.agg(F.to_json(F.struct(F.array_sort(items).alias("findings"))).alias("report"))
