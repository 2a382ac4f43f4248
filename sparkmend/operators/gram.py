"""Moments of many numeric columns in one pass: per partition, numpy sums
n, sum z and z'z of z = x - shift (shift = column means from a cheap first
aggregate, to keep the sums well conditioned); Spark adds the partials as
vectors, one per (group, matrix row), so a partition sends p + 1 rows of p + 1
numbers whatever its row count and the sums of one group are spread over p + 1
keys.  The work per row is one BLAS rank update inside Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q


def column_means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(q(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))])


def moments(df: DataFrame, cols: Sequence[str], by: str | None = None, shift: np.ndarray | None = None):
    """{group: (n, S, G)} (or (n, S, G) when by is None) of z = x - shift over
    rows with no missing value in ``cols``; returns (result, shift)."""
    cols = list(cols)
    m = len(cols)
    d = df.na.drop(subset=cols)
    if shift is None:
        shift = column_means(d, cols)
    names = [f"x{i}" for i in range(m)]
    gcol = [F.col(q(by)).cast("long").alias("g")] if by else [F.lit(0).cast("long").alias("g")]
    sel = d.select(*gcol, *[F.col(q(c)).cast("double").alias(n) for c, n in zip(cols, names)])
    sh = np.asarray(shift, dtype=float)

    def part(batches):
        # rows of the augmented matrix [1, z]'[1, z]: row 0 is (n, S), row i
        # is (S_i, G_i)
        acc: dict = {}
        for pdf in batches:
            for g, grp in pdf.groupby("g"):
                z = np.insert(grp[names].to_numpy(dtype=float) - sh, 0, 1.0, axis=1)
                acc[g] = acc.get(g, 0.0) + z.T @ z
        for g, a in acc.items():
            yield pd.DataFrame({"g": np.full(m + 1, g, dtype="int64"), "idx": np.arange(m + 1, dtype="int64"), "v": list(a)})

    rows = sel.mapInPandas(part, "g long, idx long, v array<double>")
    tot = rows.groupBy("g", "idx").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()  # groups x (1+m)
    full: dict = {}
    for r in tot:
        full.setdefault(int(r["g"]), np.zeros((m + 1, m + 1)))[int(r["idx"])] = r["v"].toArray()
    res = {g: (float(round(a[0, 0])), a[0, 1:], a[1:, 1:]) for g, a in full.items()}
    if by is None:
        return res.get(0, (0.0, np.zeros(m), np.zeros((m, m)))), shift
    return res, shift
