"""Ridge with text columns of any number of levels.

A text column stands for one 0/1 column per level (the first sorted training
level left out; missing and unseen levels are all zero), but those columns are
never made.  What the normal equations need of them is sparse: per level the
row count and the sums of the dense columns, and per pair of text columns how
often two levels meet.  Both are grouped sums, combined on the map side, so
neither a level that holds most rows nor millions of levels meet in one task.

With Z the level columns, X the dense ones (the intercept among them) and y the
target, the level weights are eliminated: A = (Z'Z + alpha I)^-1 Z'[X y], by
division when there is one text column (Z'Z is then diagonal), else by
conjugate gradients over the sparse blocks.  What is left are dense moments of
the few dense columns, which the callers treat like any others: a ridge over
them is the ridge over all columns, and its error on test rows is exact.

Up to ``ON_DRIVER`` levels and pairs the gradient steps run on the driver; beyond, they
are Spark joins over the tables, with the same equations and tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q
from ..session import cut_lineage
from .gram import moments

ON_DRIVER = 200_000  # levels and pairs of levels solved on the driver
SMALL = 100_000  # levels whose weights are broadcast to the rows
TOLERANCE = 1e-13  # of the residual, relative to the right-hand side
MAX_STEPS = 5_000


@dataclass
class Moments:
    """Sums over rows of the products of columns; ``n`` and ``s`` are those of
    the intercept column with itself and the others."""

    rows: float
    n: float
    s: np.ndarray
    g: np.ndarray

    @classmethod
    def of(cls, rows: float, m: np.ndarray) -> Moments:
        return cls(rows, float(m[0, 0]), m[0, 1:], m[1:, 1:])


@dataclass
class LevelMoments:
    """Moments of [columns, target] (less ``shift``) with the level columns
    eliminated; ``effects`` (c, level, a): what a level takes off each."""

    train: Moments
    test: Moments
    shift: np.ndarray
    slots: int = 0
    effects: DataFrame | None = None
    levels: list[str] = field(default_factory=list)

    def predict(self, df: DataFrame, cols: Sequence[str], w: np.ndarray, intercept: float, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction of weights ``w`` over ``cols`` (the moments'
        columns) and the intercept of the shifted columns."""
        k = len(cols)
        value = F.lit(float(intercept + self.shift[k]))
        for c, wi, si in zip(cols, w, self.shift, strict=False):
            value = value + (F.col(q(c)).cast("double") - F.lit(float(si))) * F.lit(float(wi))
        if self.effects is not None:
            mix = F.array(*[F.lit(float(v)) for v in [-intercept, *(-w), 1.0]])
            weight = F.aggregate(F.zip_with("a", mix, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            table = self.effects.select(F.col("c").alias("__c"), F.col("level").alias("__l"), weight.alias("__w"))
            for i, c in enumerate(self.levels):
                one = table.where(F.col("__c") == i).select("__l", F.col("__w").alias(f"__w{i}"))
                df = join_levels(df, one, c, small=self.slots <= SMALL)
                value = value + F.coalesce(F.col(f"__w{i}"), F.lit(0.0))
        return df.withColumn(out, value).drop(*[f"__w{i}" for i in range(len(self.levels))])


def join_levels(df: DataFrame, table: DataFrame, col: str, small: bool) -> DataFrame:
    """Left join of ``table`` (__l and more) on a text column.  Rows without a
    value match nothing and are spread over the tasks by a number of their own."""
    key = F.col(q(col)).cast("string")
    mine = F.when(key.isNull(), F.concat(F.lit("-"), F.monotonically_increasing_id() % 997)).otherwise(F.concat(F.lit("="), key))
    left = df.withColumn("__key", mine)
    right = table.withColumn("__key", F.concat(F.lit("="), F.col("__l").cast("string"))).drop("__l")
    return left.join(F.broadcast(right) if small else right, "__key", "left").drop("__key")


def _dense(cols: Sequence[str], shift: np.ndarray) -> list[Column]:
    return [F.lit(1.0), *[F.col(q(c)).cast("double") - F.lit(float(s)) for c, s in zip(cols, shift, strict=True)]]


def level_moments(df: DataFrame, cols: Sequence[str], y: str, levels: Sequence[str] = (), alpha: float = 1.0, split: str = "is_test") -> LevelMoments:
    """Moments over the training rows (``split`` false) and the test rows of
    ``cols`` and ``y``, text columns ``levels`` eliminated at ridge penalty
    ``alpha``.  Rows with a missing value in ``cols`` or ``y`` are left out."""
    cols, levels = [*cols, y], list(levels)
    m = len(cols)
    d = df.na.drop(subset=cols)
    found, shift = moments(d.withColumn("__split", F.col(q(split)).cast("int")), cols, by="__split")

    def full(group: int) -> np.ndarray:
        n, s, g = found.get(group, (0.0, np.zeros(m), np.zeros((m, m))))
        return np.block([[np.array([[n]]), s[None, :]], [s[:, None], g]])

    train, test = full(0), full(1)
    dense = lambda: LevelMoments(Moments.of(train[0, 0], train), Moments.of(test[0, 0], test), shift)
    if not levels:
        return dense()

    z = _dense(cols, shift)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(q(c)).cast("string").alias("level")) for i, c in enumerate(levels)])).alias("at")
    rows = d.select(F.col(q(split)).alias("t"), *[x.alias(f"z{j}") for j, x in enumerate(z)], at).where(F.col("at.level").isNotNull())
    sums = [F.sum(f"z{j}").alias(f"z{j}") for j in range(m + 1)]
    table = rows.groupBy("t", F.col("at.c").alias("c"), F.col("at.level").alias("level")).agg(*sums)
    table = cut_lineage(table.select("t", "c", "level", F.array(*[f"z{j}" for j in range(m + 1)]).alias("r")))
    # the first training level of each column has no column of its own
    first = {r["c"]: r["first"] for r in table.where(~F.col("t")).groupBy("c").agg(F.min("level").alias("first")).collect()}
    known = F.lit(False)
    for c, lv in first.items():
        known = known | ((F.col("c") == c) & (F.col("level") > F.lit(lv)))
    fit = table.where(~F.col("t") & known).select("c", "level", "r")
    seen = table.where(F.col("t")).select("c", "level", F.col("r").alias("rt")).join(fit.select("c", "level"), ["c", "level"])
    slots = fit.count()
    if not slots:
        return dense()

    pairs = None
    if len(levels) > 1:
        met = [
            F.struct(F.lit(i).alias("c"), F.col(q(a)).cast("string").alias("level"), F.lit(j).alias("d"), F.col(q(b)).cast("string").alias("other"))
            for i, a in enumerate(levels)
            for j, b in enumerate(levels)
            if i < j
        ]
        pairs = d.select(F.col(q(split)).alias("t"), F.inline(F.array(*met))).where(F.col("level").isNotNull() & F.col("other").isNotNull())
        pairs = pairs.groupBy("t", "c", "level", "d", "other").agg(F.count(F.lit(1)).cast("double").alias("n"))
        # levels without a column leave the system
        lefts = fit.select("c", "level")
        rights = fit.select(F.col("c").alias("d"), F.col("level").alias("other"))
        pairs = cut_lineage(pairs.join(lefts, ["c", "level"], "left_semi").join(rights, ["d", "other"], "left_semi"))
    effects = _solve(fit, None if pairs is None else pairs.where(~F.col("t")), alpha, slots, df)
    effects = cut_lineage(effects)

    joined = fit.join(effects, ["c", "level"])
    train = train - _outer(joined, "r", "a", m + 1)
    tested = seen.join(effects, ["c", "level"])
    cross = _outer(tested, "rt", "a", m + 1)
    test = test - cross - cross.T + _outer(tested.withColumn("w", F.get("rt", F.lit(0))), "a", "a", m + 1, "w")
    if pairs is not None:
        both = pairs.where(F.col("t")).join(effects, ["c", "level"])
        both = both.join(effects.select(F.col("c").alias("d"), F.col("level").alias("other"), F.col("a").alias("b")), ["d", "other"])
        twice = _outer(both, "a", "b", m + 1, "n")
        test = test + twice + twice.T
    n_train, n_test = (found[g][0] if g in found else 0.0 for g in (0, 1))
    return LevelMoments(Moments.of(n_train, train), Moments.of(n_test, test), shift, slots, effects, levels)


def _outer(df: DataFrame, left: str, right: str, m: int, weight: str | None = None) -> np.ndarray:
    """Sum over rows of weight * left' right, two arrays of ``m`` numbers: one
    m x m partial per partition, added by Spark row by row."""
    w = F.col(weight) if weight else F.lit(1.0)

    def part(batches):
        acc = np.zeros((m, m))
        for pdf in batches:
            if len(pdf):
                a, b = np.stack(pdf["a"].to_list()), np.stack(pdf["b"].to_list())
                acc += (a * pdf["w"].to_numpy()[:, None]).T @ b
        yield pd.DataFrame({"i": np.arange(m), "v": list(acc)})

    rows = df.select(F.col(left).alias("a"), F.col(right).alias("b"), w.cast("double").alias("w")).mapInPandas(part, "i long, v array<double>")
    out = np.zeros((m, m))
    for r in rows.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect():  # m rows
        out[int(r["i"])] = r["v"].toArray()
    return out


def _solve(fit: DataFrame, pairs: DataFrame | None, alpha: float, slots: int, df: DataFrame) -> DataFrame:
    """(c, level, a): the solution of (Z'Z + alpha I) a = r for every level."""
    count = F.get("r", F.lit(0)) + F.lit(float(alpha))
    if pairs is None:
        return fit.select("c", "level", F.transform("r", lambda v: v / count).alias("a"))
    if slots <= ON_DRIVER and pairs.limit(ON_DRIVER + 1).count() <= ON_DRIVER:
        return _solve_here(fit, pairs, alpha, df)
    return _solve_there(fit, pairs, alpha)


def _solve_here(fit: DataFrame, pairs: DataFrame, alpha: float, df: DataFrame) -> DataFrame:
    rows, met = fit.collect(), pairs.collect()  # at most ON_DRIVER each
    place = {(r["c"], r["level"]): i for i, r in enumerate(rows)}
    r = np.array([x["r"] for x in rows])
    diag = r[:, :1] + alpha
    i = np.array([place[p["c"], p["level"]] for p in met], int)
    j = np.array([place[p["d"], p["other"]] for p in met], int)
    n = np.array([p["n"] for p in met], float)
    i, j, n = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([n, n])
    order = np.argsort(i, kind="stable")
    i, j, n = i[order], j[order], n[order, None]
    starts = np.flatnonzero(np.diff(i, prepend=-1))

    def times(p):
        out = diag * p
        if len(i):
            out[i[starts]] += np.add.reduceat(n * p[j], starts, axis=0)
        return out

    x = np.zeros_like(r)
    res = r.copy()
    z = res / diag
    p, rz = z.copy(), (res * z).sum(0)
    goal = TOLERANCE**2 * np.maximum(rz, 1e-300)
    for _ in range(MAX_STEPS):
        if (rz <= goal).all():
            break
        ap = times(p)
        step = np.where(rz > goal, rz / np.maximum((p * ap).sum(0), 1e-300), 0.0)
        x += step * p
        res -= step * ap
        z = res / diag
        now = (res * z).sum(0)
        p = z + np.where(rz > goal, now / np.maximum(rz, 1e-300), 0.0) * p
        rz = now
    return df.sparkSession.createDataFrame([(x_["c"], x_["level"], v.tolist()) for x_, v in zip(rows, x, strict=True)], "c int, level string, a array<double>")


def _solve_there(fit: DataFrame, pairs: DataFrame, alpha: float) -> DataFrame:
    """The same steps with the vectors as tables, cut to the checkpoint folder
    at each."""
    both = pairs.select("c", "level", "d", "other", "n").unionByName(
        pairs.select(F.col("d").alias("c"), F.col("other").alias("level"), F.col("c").alias("d"), F.col("level").alias("other"), "n")
    )
    both = cut_lineage(both)

    def add(a, b, f):  # a + f * b, f one factor per right-hand side
        return F.transform(F.arrays_zip(F.col(a).alias("u"), F.col(b).alias("v"), f.alias("f")), lambda t: t["u"] + t["f"] * t["v"])

    def factors(v: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in v])

    def total(frame: DataFrame, *products: Column) -> list[np.ndarray]:
        row = frame.agg(*[Summarizer.sum(array_to_vector(p)).alias(f"s{k}") for k, p in enumerate(products)]).first()
        return [np.asarray(v.toArray()) for v in row]

    def product(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda u, v: u * v)

    scaled = F.transform("res", lambda v: v / F.col("diag"))
    state = fit.select("c", "level", (F.get("r", F.lit(0)) + F.lit(float(alpha))).alias("diag"), F.col("r").alias("res"))
    state = state.withColumn("x", F.transform("res", lambda v: F.lit(0.0))).withColumn("p", scaled)
    state = cut_lineage(state)
    (rz,) = total(state, product("res", "p"))
    goal = TOLERANCE**2 * np.maximum(rz, 1e-300)
    for _ in range(MAX_STEPS):
        if (rz <= goal).all():
            break
        given = state.select(F.col("c").alias("d"), F.col("level").alias("other"), "p")
        off = both.join(given, ["d", "other"]).groupBy("c", "level").agg(Summarizer.sum(array_to_vector("p"), F.col("n")).alias("o"))
        # Summarizer weights each row's vector by n
        ap = F.zip_with("p", F.coalesce(vector_to_array("o"), F.transform("p", lambda v: F.lit(0.0))), lambda u, o: u * F.col("diag") + o)
        state = cut_lineage(state.join(off, ["c", "level"], "left").withColumn("ap", ap).drop("o"))
        (pap,) = total(state, product("p", "ap"))
        step = np.where(rz > goal, rz / np.maximum(pap, 1e-300), 0.0)
        state = state.withColumn("x", add("x", "p", factors(step))).withColumn("res", add("res", "ap", factors(-step)))
        state = state.withColumn("z", scaled)
        (now,) = total(state, product("res", "z"))
        turn = np.where(rz > goal, now / np.maximum(rz, 1e-300), 0.0)
        state = state.withColumn("p", add("z", "p", factors(turn))).drop("z", "ap")
        rz = now
    return state.select("c", "level", F.col("x").alias("a"))


# ── ridge over the moments ──────────────────────────────────────────────────


def centred(mo: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(products of the columns less the intercept's part, that of each with
    the target, factors of the intercept), target last."""
    if not mo.n:
        return np.zeros_like(mo.g[:-1, :-1]), np.zeros(len(mo.s) - 1), np.zeros(len(mo.s))
    c = mo.g - np.outer(mo.s, mo.s) / mo.n
    return c[:-1, :-1], c[:-1, -1], mo.s / mo.n


def test_rmse(mo: Moments, w: np.ndarray, b: float) -> float:
    """RMSE on the rows of ``mo`` of weights ``w`` (all columns) and intercept."""
    if not mo.rows:
        return float("nan")
    a = np.append(-w, 1.0)
    sse = a @ mo.g @ a - 2 * b * (a @ mo.s) + b * b * mo.n
    return float(np.sqrt(max(sse, 0.0) / mo.rows))


def ridge(mo: Moments, alpha: float = 1.0, cols: Sequence[int] | None = None) -> tuple[np.ndarray, float]:
    """(weights of all columns, zero outside ``cols``; intercept)."""
    c, r, mean = centred(mo)
    idx = list(range(len(r))) if cols is None else list(cols)
    w = np.zeros(len(r))
    if idx:
        w[idx] = np.linalg.solve(c[np.ix_(idx, idx)] + alpha * np.eye(len(idx)), r[idx])
    return w, float(mean[-1] - mean[:-1] @ w)
