"""Training rows as weighted cells, for the tree learners.

Spark ML's trees see a feature only through its at most 32 bins, so rows with
equal bins (and, for classes, equal labels) are one training row to them, with
a weight.  Three passes over the rows (few or many values, cuts, sums) replace
the passes of every level of every tree.  All rows count, whatever their values:
``p`` features have at most 32^p cells, and a table that fills more of them than
it repeats is only fitted on about as many rows as it has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q
from ..session import cut_lineage

BINS = 32  # of a feature: the learners' default maxBins
ROWS = 1 << 13  # up to so many rows are fitted row by row
UNITS = 1 << 16  # bootstraps and subsamples draw so many units at least, or single rows
PER_TASK = 1 << 13  # training rows in a task
SKETCH = 0.05  # 512 registers: 32 values count as 33 at most


@dataclass
class Bins:
    """Cuts per feature; None: few values, each a bin of its own."""

    cuts: dict[str, list[float] | None]

    def apply(self, df: DataFrame) -> DataFrame:
        """Features of many values -> number of their bin; missing stays missing."""
        from pyspark.ml.feature import Bucketizer

        many = [c for c, cut in self.cuts.items() if cut is not None]
        df = df.withColumns({c: F.col(q(c)).cast("double") for c in self.cuts})
        if not many:
            return df
        raw, out = ([f"__{kind}{i}" for i in range(len(many))] for kind in ("raw", "bin"))
        df = df.withColumns({r: F.coalesce(q_nan(c), F.lit(0.0)) for r, c in zip(raw, many, strict=True)})
        # a bucket is closed below and open above, a tree's split the other way round
        with np.errstate(over="ignore"):
            above = {c: [float(np.nextafter(x, math.inf)) for x in self.cuts[c]] for c in many}
        splits = [[-math.inf, *(x for x in above[c] if x < math.inf), math.inf] for c in many]
        df = Bucketizer(inputCols=raw, outputCols=out, splitsArray=splits).transform(df)
        return df.withColumns({c: F.when(q_nan(c).isNotNull(), F.col(o)) for c, o in zip(many, out, strict=True)}).drop(*raw, *out)


def q_nan(c: str) -> Column:
    """The feature as a double, NaN as null."""
    x = F.col(q(c)).cast("double")
    return F.when(~F.isnan(x), x)


def _few_values(df: DataFrame, feats: Sequence[str]) -> tuple[int, list[bool]]:
    """(rows, per feature: it has at most BINS values), from a sketch whose count is
    at most BINS + 1 for so few values; counts near BINS are counted again exactly."""
    x = [q_nan(c) + F.lit(0.0) for c in feats]  # -0.0 is 0.0
    n, *got = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(v, SKETCH) for v in x]).first()
    near = [i for i, k in enumerate(got) if BINS * 3 // 4 <= k <= BINS + 1] if n > ROWS else []
    if near:
        exact = df.agg(*[F.count_distinct(x[i]).alias(f"n{i}") for i in near]).first()
        for i, k in zip(near, exact, strict=True):
            got[i] = k
    return int(n), [k <= BINS for k in got]


def fit_bins(df: DataFrame, feats: Sequence[str]) -> tuple[int, Bins]:
    """(rows, bins): features of more than BINS values are cut at their
    quantiles j / BINS over all rows."""
    n, few = _few_values(df, feats)
    many = [c for c, f in zip(feats, few, strict=True) if not f] if n > ROWS else []
    cuts: dict[str, list[float] | None] = dict.fromkeys(feats)
    if many:
        at = [j / BINS for j in range(1, BINS)]
        row = df.agg(*[F.percentile_approx(q_nan(c), at, 10000) for c in many]).first()
        cuts |= {c: sorted(set(v)) for c, v in zip(many, row, strict=True)}
    return n, Bins(cuts)


@dataclass
class Cells:
    """``frame``: features (binned), ``by``, rows ``__n``, sum of weights ``__wt``
    and any ``sums`` of each cell."""

    bins: Bins
    frame: DataFrame
    n: int

    def units(self, least: int = 1, draws: bool = False, weighted: bool = False) -> DataFrame:
        """Training rows with weight ``__w``: a cell of n rows as one, or as enough
        equal ones that a node has ``least`` of them where it has as many rows,
        and (``draws``) that a bootstrap or subsample draws single rows or one of
        UNITS parts of the table."""
        n = F.col("__n")
        share = F.ceil(n * F.lit(UNITS / max(self.n, UNITS))) if draws else F.lit(1)
        parts = F.least(n, F.greatest(F.lit(int(least)), share)).cast("int")
        d = self.frame.withColumn("__parts", parts)
        total = d.agg(F.sum("__parts")).first()[0] or 0
        d = d.withColumn("__w", (F.col("__wt") if weighted else n) / F.col("__parts"))
        d = d.withColumn("__part", F.explode(F.sequence(F.lit(1), F.col("__parts"))))
        return d.drop("__parts", "__part").repartition(max(1, -(-int(total) // PER_TASK)))


def collapse(df: DataFrame, feats: Sequence[str], by: Sequence[str] = (), vectors: Sequence[str] = (), weight_col: str | None = None, sums: Sequence[Column] = (), fit_on: Column | None = None) -> Cells | None:
    """Cells of ``df``, binned as fitted on the rows ``fit_on`` (else all); None
    if those are at most ROWS."""
    n, bins = fit_bins(df if fit_on is None else df.where(fit_on), feats)
    if n <= ROWS:
        return None
    weight = F.col(q(weight_col)).cast("double") if weight_col else F.lit(1.0)
    keys = [F.col(q(c)) for c in [*feats, *vectors, *by]]
    grouped = bins.apply(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(weight).alias("__wt"), *sums)
    return Cells(bins, cut_lineage(grouped), n)
