"""Packing into optimal length buckets.

The global histogram of document lengths is counted on the cluster; dynamic
programming over it (divide and conquer, as the padding cost is
quadrangle-convex) picks the bucket boundaries that need the least padding.
Inside a bucket documents are numbered and cut into batches of
``budget // boundary`` documents, so that no batch exceeds the token budget
(a document beyond it is a batch of its own).

Numbers inside a bucket are global and without gaps: rows are dealt to
groups of about ``GROUP`` rows by a hash of their id, counted, numbered inside
the group and moved by the counts before it.  A bucket that holds a third of
all rows is thus many groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, stage

BUCKETS = 16
BUDGET = 32768  # tokens of a batch, padding included
GROUP = 4096  # rows numbered together, more where there would be over MAX_GROUPS groups
MAX_GROUPS = 1 << 16
TOKEN = r"[^\x20\x09-\x0D]+"
RESULT = ("n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")


def token_count(text: Column) -> Column:
    """Words and one end mark; a null text is the end mark alone."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)) + 1


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries (taken from ``lengths``, ascending) of at most
    ``buckets`` buckets with the least total padding."""
    m = len(lengths)
    if not m:
        return []
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(lengths * counts)))

    best = np.concatenate(([0], lengths * rows[1:] - tokens[1:]))
    choice = []
    for _ in range(1, min(buckets, m)):
        nxt, cut = best.copy(), np.zeros(m + 1, np.int32)
        # ranges lo .. hi of ends, whose last cut lies in a .. z; one level of
        # halving at a time, about m candidates each
        lo, hi, a, z = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            n = np.minimum(z, j - 1) - a + 1
            start = np.cumsum(n) - n
            i = np.arange(n.sum()) + np.repeat(a - start, n)
            v = best[i] - np.repeat(lengths[j - 1], n) * rows[i] + tokens[i]
            least = np.minimum.reduceat(v, start)
            hits = np.flatnonzero(v == np.repeat(least, n))
            k = i[hits[np.searchsorted(hits, start)]]  # the first one
            nxt[j], cut[j] = least + lengths[j - 1] * rows[j] - tokens[j], k
            lo, hi, a, z = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (a, k), (k, z)))
            some = lo <= hi
            lo, hi, a, z = lo[some], hi[some], a[some], z[some]
        choice.append(cut)
        best = nxt
    out, j = [], m
    for cut in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
        if j == 0:
            return out[::-1]
    out.append(int(lengths[j - 1]))
    return out[::-1]


def exact_histogram(df: DataFrame, length_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Every distinct length, ascending, and its count.  m distinct lengths
    take m * m / 2 tokens at least, so the driver receives at most
    sqrt(2 * tokens) rows of two numbers."""
    got = df.groupBy(F.col(length_col).alias("n")).agg(F.count("*").alias("c")).toArrow().sort_by("n")
    return got["n"].to_numpy().astype(np.int64), got["c"].to_numpy().astype(np.int64)


def assign(df: DataFrame, length_col: str, id_col: str, row_col: str, boundaries: list[int], rows: int, budget: int) -> DataFrame:
    """``df`` (staged) plus bucket, bucket_len, batch_id, slot, padding.  Rows
    are dealt over groups by their number ``row_col`` too, so equal rows and null
    ids spread over all groups."""
    bucket, group, num, first, salt = free_names(df, "bucket", "group", "num", "first", "salt")
    edges = F.array(*[F.lit(int(b)) for b in boundaries])
    number = F.size(F.filter(edges, lambda b: b < F.col(length_col)))
    parts = min(MAX_GROUPS, max(1, -(-rows // GROUP)))
    dealt = df.withColumn("bucket", number).withColumn(group, F.pmod(F.xxhash64(id_col, length_col, row_col), F.lit(parts)))
    counts = dealt.groupBy("bucket", group).agg(F.count("*").alias("n"))
    # at most MAX_GROUPS rows per bucket
    before = Window.partitionBy("bucket").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("bucket").alias(bucket + "_of"), F.col(group).alias(salt), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)
    )
    inside = Window.partitionBy("bucket", group).orderBy(F.col(id_col).asc_nulls_first(), length_col, row_col)
    numbered = dealt.withColumn(num, F.row_number().over(inside) - 1)
    met = numbered.join(starts, (F.col("bucket") == F.col(bucket + "_of")) & (F.col(group) == F.col(salt)))
    size = F.get(edges, F.col("bucket"))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / size))
    place = F.col(first) + F.col(num)
    return (
        met.withColumn("bucket_len", size.cast("bigint"))
        .withColumn("batch_id", F.floor(place / each).cast("bigint"))
        .withColumn("slot", (place % each).cast("bigint"))
        .withColumn("padding", (size - F.col(length_col)).cast("bigint"))
        .drop(group, num, first, salt, bucket + "_of")
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Per row: id, n_tokens, bucket (0 is the shortest), bucket_len, batch_id
    (numbered inside the bucket), slot in the batch, padding.

    Batches of a bucket are full but for the last one.  A null or empty text
    has one token; null ids and repeated rows are rows like any other; other
    columns are not read.  An empty table gives an empty result."""
    ids = df.select(F.col(id_col).alias("id"), token_count(F.col(text_col)).cast("bigint").alias("n_tokens"))
    lengths = stage(ids.withColumn("row", F.monotonically_increasing_id()), "lengths")  # written: numbers do not change
    at, counts = exact_histogram(lengths, "n_tokens")
    boundaries = optimal_boundaries(at, counts, buckets) or [1]
    out = assign(lengths, "n_tokens", "id", "row", boundaries, int(counts.sum()), budget)
    return out.select(F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")
