"""Exact dedup by content sort (native).

Rows are dealt to ranges of (first characters, SHA-256) of the normalised
text; Spark samples the splitters.  Inside a range an external sort by the
whole normalised text puts equal texts next to each other, and the window
operator compares each neighbour's whole text.  Of equal texts the row with
the largest (or smallest) id stays.

A text with very many copies would make one range heavy, so a first pass
pre-aggregates (SHA-256 -> rows, best id) on the map side; texts with more
than ``rows / (4 * partitions)`` copies (at most 4 * partitions of them, so
the broadcast is bounded) get a salt of their id, and their totals come from
the first pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, free_names, without

RESULT = ("keep_id", "group_size", "kept", "text_sha256")
HEAD_CHARS = 16  # of the splitter keys only; rows are compared by whole text


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``df`` with keep_id, group_size, kept, text_sha256, one row per input
    row.

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty.  ``keep``: 'largest' or 'smallest' id stays.  Null ids lose to
    any id (a group of null ids only keeps one of its rows, keep_id null).
    Repeated rows with the kept id: exactly one of them is kept.  Input
    columns named like a result column are dropped.  An empty table gives an
    empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    df = without(df, *RESULT)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head, salt, norm, pos, hot_n, hot_id, hot_sha = free_names(
        df, "head", "salt", "norm", "pos", "hot_n", "hot_id", "hot_sha"
    )
    best = F.max if keep == "largest" else F.min
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    hot_rows = max(64, df.count() // (4 * parts))

    hot = (
        df.select(F.col(id_col).alias(hot_id), F.sha2(text.cast("binary"), 256).alias(hot_sha))
        .groupBy(hot_sha)
        .agg(F.count("*").alias(hot_n), best(hot_id).alias(hot_id))
        .filter(F.col(hot_n) > hot_rows)
    )
    keyed = df.withColumn(norm, text).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.substring(norm, 1, HEAD_CHARS).alias(head),
        F.sha2(F.col(norm).cast("binary"), 256).alias("text_sha256"),
    )
    # at most 4 * partitions rows: a bounded broadcast
    keyed = keyed.join(F.broadcast(hot), F.col("text_sha256") == F.col(hot_sha), "left").withColumn(
        salt, F.when(F.col(hot_n).isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), F.lit(parts)))
    )
    ranged = keyed.repartitionByRange(head, "text_sha256", salt).withColumn(norm, text)
    equal = Window.partitionBy(norm, head, "text_sha256", salt)
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    first = equal.orderBy(order)
    is_hot = F.col(hot_n).isNotNull()
    return (
        ranged.withColumn(pos, F.row_number().over(first))
        .withColumn("keep_id", F.when(is_hot, F.col(hot_id)).otherwise(F.first(id_col).over(first)))
        .withColumn("group_size", F.when(is_hot, F.col(hot_n)).otherwise(F.count(F.lit(1)).over(equal)))
        .withColumn("kept", (F.col(pos) == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")))
        .select(*[F.col(f"`{c}`") for c in df.columns], *RESULT)
    )
