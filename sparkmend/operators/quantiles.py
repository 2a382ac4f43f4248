"""Exact linear-interpolated quantiles without gathering a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a global exact quantile of a high-cardinality
column ends in one task holding the column.  Here the work is:

1. one pass: ``count`` and ``percentile_approx`` at p +- delta for every
   (column, p) (mergeable sketches, partial aggregation);
2. one pass: rows below / inside each bracket (``count_if``), which checks
   that the bracket holds the wanted order statistics; a missed side is
   widened, an over-full bracket is narrowed by another sketch pass over
   the bracket rows only;
3. one pass: ``groupBy(pair, value).count()`` over bracket rows, which is
   bounded by the bracket size (ties collapse map-side); a running count
   per pair finds both order statistics, and one row per pair is collected.
   Brackets without such a bound (ties that no sketch can split, or never
   settled) are dealt by range of value: counts per range give the range that
   holds an order statistic, and only that range runs a count.

The quantile definition is the linear one (h = (n-1)p, interpolate
between order statistics floor(h) and ceil(h)).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_PROFILE, ProfileConfig
from ..functions.exprs import q
from ..session import cut_lineage

ROUNDS = 12  # of widening or narrowing brackets


def bracket_exprs(cols: Sequence[str], probs: Sequence[float], accuracy: int, prefix: str = "qb"):
    """Aggregate expressions for pass 1 (can be fused into another pass)."""
    delta = 2.0 / accuracy
    out = []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        out.append(F.count(x).alias(f"{prefix}_n_{i}"))
        ps = []
        for p in probs:
            ps += [max(p - delta, 0.0), min(p + delta, 1.0)]
        out.append(F.percentile_approx(x, ps, accuracy).alias(f"{prefix}_b_{i}"))
    return out


def read_brackets(row, cols, probs, prefix: str = "qb"):
    n = {}
    br = {}
    for i, _ in enumerate(cols):
        n[i] = int(row[f"{prefix}_n_{i}"] or 0)
        arr = row[f"{prefix}_b_{i}"]
        for j, _p in enumerate(probs):
            if arr is None:
                br[(i, j)] = None
            else:
                br[(i, j)] = [arr[2 * j], arr[2 * j + 1]]
    return n, br


def _between(x, lo, hi):
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x >= F.lit(lo))
    if hi is not None:
        cond = cond & (x <= F.lit(hi))
    return cond


def resolve(df: DataFrame, cols, probs, n, br, cfg: ProfileConfig = DEFAULT_PROFILE) -> dict:
    """Passes 2-3: exact values.  Returns {(col_index, prob_index): value}."""
    xs = {i: F.col(q(c)).cast("double") for i, c in enumerate(cols)}
    targets, brackets, result = {}, {}, {}
    for i, _ in enumerate(cols):
        for j, p in enumerate(probs):
            if n[i] == 0 or br[(i, j)] is None:
                result[(i, j)] = None
                continue
            h = (n[i] - 1) * p
            targets[(i, j)] = (i, math.floor(h), math.ceil(h))
            brackets[(i, j)] = list(br[(i, j)])
    found = order_statistics(df, xs, targets, brackets, cfg)
    for key, (v0, v1) in found.items():
        h = (n[key[0]] - 1) * probs[key[1]]
        result[key] = v0 + (v1 - v0) * (h - math.floor(h))
    return result


def order_statistics(df: DataFrame, xs: dict, targets: dict, brackets: dict, cfg: ProfileConfig = DEFAULT_PROFILE) -> dict:
    """{key: (value at rank lo, value at rank hi)} for ``targets`` {key: (column
    of ``xs``, lo, hi)}: ranks from 0 in the column's non-missing values, hi at
    most lo + 1.  ``brackets``: first guesses [low value, high value]."""
    result: dict = {}
    pending = dict(brackets)
    ready, wide = {}, {}
    for _round in range(ROUNDS):
        if not pending:
            break
        keys = list(pending)
        exprs = []
        for t, key in enumerate(keys):
            lo, hi = pending[key]
            x = xs[targets[key][0]]
            below = (x < F.lit(lo)) if lo is not None else F.lit(False)
            exprs.append(F.count_if(x.isNotNull() & below).alias(f"b{t}"))
            exprs.append(F.count_if(_between(x, lo, hi)).alias(f"m{t}"))
        row = df.agg(*exprs).first()
        narrow = []
        for t, key in enumerate(keys):
            lo, hi = pending[key]
            below, inside = int(row[f"b{t}"]), int(row[f"m{t}"])
            _i, klo, khi = targets[key]
            if below > klo:
                pending[key] = [None, hi]
                continue
            if below + inside <= khi:
                pending[key] = [lo, None]
                continue
            if lo is not None and hi is not None and lo == hi:
                result[key] = (float(lo), float(lo))
                del pending[key]
                continue
            if inside > cfg.quantile_max_bracket:
                narrow.append((key, below, inside))
                continue
            ready[key] = (lo, hi, below)
            del pending[key]
        if narrow:
            acc = cfg.quantile_accuracy
            delta = 2.0 / acc
            nexprs = []
            for t, (key, below, inside) in enumerate(narrow):
                lo, hi = pending[key]
                i, klo, khi = targets[key]
                plo = max((klo - below) / inside - delta, 0.0)
                phi = min((khi - below) / inside + delta, 1.0)
                nexprs.append(F.percentile_approx(F.when(_between(xs[i], lo, hi), xs[i]), [plo, phi], acc).alias(f"n{t}"))
            nrow = df.agg(*nexprs).first()
            for t, (key, below, _inside) in enumerate(narrow):
                arr = nrow[f"n{t}"]
                if [arr[0], arr[1]] == pending[key]:
                    wide[key] = (arr[0], arr[1], below)  # ties: the sketch cannot split the bracket
                    del pending[key]
                else:
                    pending[key] = [arr[0], arr[1]]
    wide |= {key: (None, None, 0) for key in pending}  # never settled: the whole column
    for part, gather in ((ready, _in_one_run), (wide, _by_range)):
        keys = list(part)
        if keys:
            wanted = [(targets[k][1] - part[k][2], targets[k][2] - part[k][2]) for k in keys]
            values = gather(_value_counts(df, [(xs[targets[k][0]], part[k][0], part[k][1]) for k in keys]), wanted)
            result |= {k: values[t] for t, k in enumerate(keys)}
    return result


def _value_counts(df: DataFrame, brackets: Sequence[tuple]) -> DataFrame:
    """(pair, v, count) of the values inside each bracket (column, low, high)."""
    parts, any_in = [], F.lit(False)
    for t, (x, lo, hi) in enumerate(brackets):
        inside = _between(x, lo, hi)
        any_in = any_in | inside
        parts.append(F.when(inside, F.struct(F.lit(t).alias("pair"), x.alias("v"))))
    # only rows inside some bracket build the pair array
    rows = df.where(any_in).select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s"))
    return rows.select("s.pair", "s.v").groupBy("pair", "v").count()


def _in_one_run(counts: DataFrame, wanted: Sequence[tuple[int, int]]) -> dict:
    """{pair: (value, value)}: a running count by value, a window per pair (a
    bracket holds ``quantile_max_bracket`` rows at most); a row per pair is
    collected."""
    upto = F.sum("count").over(Window.partitionBy("pair").orderBy("v"))
    at = [F.element_at(F.array(*[F.lit(w[e]) for w in wanted]), F.col("pair") + 1) for e in (0, 1)]
    got = counts.withColumn("upto", upto).groupBy("pair").agg(*[F.min(F.when(F.col("upto") > at[e], F.col("v"))).alias(f"v{e}") for e in (0, 1)])
    return {r["pair"]: (r["v0"], r["v1"]) for r in got.collect()}


def _by_range(counts: DataFrame, wanted: Sequence[tuple[int, int]]) -> dict:
    """The same without a bound on a pair's values: they are dealt by range
    (written once, so that both passes see the same ranges), the counts of the
    ranges (pairs x ranges rows) tell where a rank lies, and only those ranges
    run a count."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counts.repartitionByRange(parts, "pair", "v").withColumn("range", F.spark_partition_id()))
    sizes: dict = {}
    for r in ranged.groupBy("pair", "range").agg(F.sum("count").alias("n")).orderBy("pair", "range").collect():
        sizes.setdefault(r["pair"], []).append((r["range"], r["n"]))
    asked = []
    for t, ranks in enumerate(wanted):
        for e, rank in enumerate(ranks):
            for rng, size in sizes[t]:
                if rank < size:
                    asked.append((t, rng, e, rank))
                    break
                rank -= size
    ask = spark.createDataFrame(asked, "pair int, range int, e int, rank bigint")  # two rows a pair
    upto = F.sum("count").over(Window.partitionBy("pair", "range").orderBy("v"))
    found = ranged.join(F.broadcast(ask.select("pair", "range").distinct()), ["pair", "range"]).withColumn("upto", upto)
    found = found.join(F.broadcast(ask), ["pair", "range"]).where(F.col("upto") > F.col("rank")).groupBy("pair", "e").agg(F.min("v").alias("v"))
    got = {(r["pair"], r["e"]): r["v"] for r in found.collect()}
    return {t: (got[t, 0], got[t, 1]) for t in range(len(wanted))}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], cfg: ProfileConfig = DEFAULT_PROFILE) -> dict:
    """{column: [value per prob]} of linear-interpolated exact quantiles."""
    cols = list(cols)
    if not cols:
        return {}
    row = df.agg(*bracket_exprs(cols, probs, cfg.quantile_accuracy)).first()
    n, br = read_brackets(row, cols, probs)
    res = resolve(df, cols, probs, n, br, cfg)
    return {c: [res[(i, j)] for j, _ in enumerate(probs)] for i, c in enumerate(cols)}


def quantiles_frame(spark, values: dict, probs: Sequence[float]) -> DataFrame:
    rows = [(c, float(p), None if v[j] is None else float(v[j])) for c, v in values.items() for j, p in enumerate(probs)]
    schema = T.StructType(
        [T.StructField("col_name", T.StringType()), T.StructField("q", T.DoubleType()), T.StructField("value", T.DoubleType())]
    )
    return spark.createDataFrame(rows, schema)
