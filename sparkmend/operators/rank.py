"""Exact ranks by a seeded hash without a single-task window.

A window with no partition key (or a few-valued one such as a class
label) runs in one task.  Here rows are spread over ``2**bits`` hash
buckets inside each group; per-(group, bucket) counts form a small table
whose running sum gives each bucket's offset; the rank of a row is that
offset plus its ``row_number`` inside its own (group, bucket).  Order is
(hash, key), so ties on the 32-bit hash are broken by the key and the
result equals a global ``row_number() over (partition by group order by
hash, key)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import q, row_hash

HASH_BITS = 32


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    salt: str = "",
    bits: int = 12,
    out: str = "_rank",
    max_groups: int = 1_000_000,
) -> DataFrame:
    """Add ``out`` = 1-based rank of the row inside its ``by`` group, in
    (hash(keys, seed, salt), keys) order.  The offsets table (one row per
    group and bucket) is broadcast up to ``max_groups`` rows, and joined by
    shuffle beyond that."""
    keys = list(keys)
    by = list(by)
    h = row_hash(keys, seed, salt)
    tmp = df.withColumn("__h", h).withColumn("__b", F.shiftright(F.col("__h"), HASH_BITS - bits))
    grp = [F.col(q(c)) for c in by]
    counts = tmp.groupBy(*grp, "__b").agg(F.count("*").alias("__cnt"))
    small = counts.limit(max_groups + 1).count() <= max_groups
    w_cum = Window.partitionBy(*grp).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(w_cum), F.lit(0))).drop("__cnt")
    joined = tmp.join(F.broadcast(offsets) if small else offsets.hint("merge"), by + ["__b"], "inner")
    w = Window.partitionBy(*grp, "__b").orderBy("__h", *[F.col(q(k)) for k in keys])
    ranked = joined.withColumn(out, (F.col("__off") + F.row_number().over(w)).cast("bigint"))
    return ranked.drop("__h", "__b", "__off")


def smallest_cutoffs(df: DataFrame, key: str, seed: int, wanted: dict[str, int]) -> dict:
    """{salt: (hash, key or None)}: the ``wanted[salt]``-th smallest
    (hash(key, seed, salt), key); key is None when every row with that hash is
    wanted.  Two histograms (upper and lower half of the 32-bit hash), each
    one pass for all salts and at most 2**16 rows per salt on the driver, and
    a key look-up only for a hash that is shared across the cut."""
    half = HASH_BITS // 2
    hashes = {s: row_hash([key], seed, s) for s in wanted}

    def histogram(cells) -> dict:
        rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("b").isNotNull())
        out: dict = {}
        for r in rows.groupBy("s", "b").agg(F.count("*").alias("n")).collect():
            out.setdefault(r["s"], {})[r["b"]] = r["n"]
        return out

    def cut(counts: dict, m: int) -> tuple[int, int]:
        """(bucket that holds the m-th row, rows wanted from it)"""
        for b in sorted(counts):
            if m <= counts[b]:
                return b, m
            m -= counts[b]
        raise ValueError("more rows wanted than there are")

    def cell(s, b):
        return F.struct(F.lit(s).alias("s"), b.cast("bigint").alias("b"))

    top = histogram([cell(s, F.shiftright(h, half)) for s, h in hashes.items()])
    up = {s: cut(top[s], m) for s, m in wanted.items()}
    low = histogram([cell(s, F.when(F.shiftright(h, half) == up[s][0], h.bitwiseAND((1 << half) - 1))) for s, h in hashes.items()])
    out = {}
    for s, h in hashes.items():
        b, left = cut(low[s], up[s][1])
        edge = (up[s][0] << half) + b
        last = None
        if left < low[s][b]:
            keys = df.where(h == edge).select(F.col(q(key)).alias("k")).orderBy("k").limit(left)
            last = keys.agg(F.max("k")).first()[0]
        out[s] = (edge, last)
    return out
