"""Sources, sinks and fault injectors.

Injectors plant the faults the checks look for (missing values, scale,
wrong type, heavy tail) on real tables.  Row choices use a seeded hash of
a key, never row position, so they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import float_cols, nan_to_null, q, row_hash
from ..operators.quantiles import exact_quantiles
from ..operators.rank import smallest_cutoffs


# conditions that no missing value meets, so a filter on the stored column keeps
# all rows that one on the cleaned column keeps
CONDITIONS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "=": lambda c, v: c == v,
    "in": lambda c, v: c.isin(*v),
}

SPREAD_ROWS = 1 << 20  # in one task; fewer are not worth a shuffle


def load(
    spark: SparkSession, path: str, fmt: str = "parquet", target: str | None = None, where: Sequence[tuple[str, str, object]] = (), **options
) -> DataFrame:
    """Read a table (parquet, csv, json, orc) and make float NaN missing.
    ``target`` is checked to exist.  ``where``: (column, condition, value)
    filters; they reach the scan on the stored columns, and on floats once more
    behind the NaN rule (a stored NaN is larger than any number)."""
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true")).option("inferSchema", options.get("inferSchema", "true"))
    df = reader.format(fmt).load(path)
    if target is not None and target not in df.columns:
        raise ValueError(f"target column {target!r} not in {df.columns}")
    for c, how, value in where:
        df = df.where(CONDITIONS[how](F.col(q(c)), value))
    floats = set(float_cols(df))
    df = nan_to_null(df)
    for c, how, value in where:
        if c in floats:
            df = df.where(CONDITIONS[how](F.col(q(c)), value))
    return df


def table(spark: SparkSession, sf_dir: str, name: str, where: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    return load(spark, f"{sf_dir}/{name}.parquet", where=where)


def spread(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt over the cores if one task would read far more of them
    than the others (a file of one row group cannot be split).  The counts come
    from the file footers; equal rows and keys spread like others."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    most, rows = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    if rows is None or most <= SPREAD_ROWS or most * cores <= 2 * rows:
        return df
    at = F.monotonically_increasing_id() % (4 * cores)
    return df.withColumn("__at", at).repartition(4 * cores, "__at").drop("__at")


def write_report(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> str:
    """Persist a report / log table (parquet or json)."""
    df.write.mode(mode).format(fmt).save(path)
    return path


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Seeded sample of exactly n rows: the n smallest hashes of the key
    (top-k per partition, then one merge of n rows per partition)."""
    h = row_hash([key], seed)
    return df.withColumn("__h", h).orderBy("__h", F.col(q(key))).limit(n).drop("__h")


def inject_nulls(df: DataFrame, fracs: dict, key: str, seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """Set exactly int(n * frac) rows of each listed column to NULL; the
    rows are those with the smallest hash of (key, seed, column name), so
    each column gets its own rows.  ``key`` must be unique: rows sharing a
    key share a hash, and the exact count is then broken arbitrarily among
    them (and a hot key would land in the one ranked bucket)."""
    n = df.count() if n_rows is None else n_rows
    wanted = {c: int(n * frac) for c, frac in fracs.items() if int(n * frac) > 0}
    cutoffs = smallest_cutoffs(df, key, seed, wanted) if wanted else {}
    repl = {}
    for c, (edge, last) in cutoffs.items():
        h = row_hash([key], seed, c)
        hit = h <= edge if last is None else (h < edge) | ((h == edge) & (F.col(q(key)) <= F.lit(last)))
        repl[c] = F.when(~hit, F.col(q(c)))
    return df.withColumns(repl) if repl else df


def inject_scale(df: DataFrame, col: str, factor: float = 1500.0) -> DataFrame:
    return df.withColumn(col, F.col(q(col)) * F.lit(factor))


def inject_dtype(df: DataFrame, col: str) -> DataFrame:
    """Store a numeric column as text."""
    return df.withColumn(col, F.col(q(col)).cast("string"))


def inject_tail(df: DataFrame, col: str, key: str, p: float = 0.95, lo: float = 1.3, hi: float = 2.5, seed: int = 42) -> DataFrame:
    """Multiply values above the exact p-quantile by a factor in [lo, hi)
    drawn from the row's hash (a heavier right tail)."""
    thr = exact_quantiles(df, [col], [p])[col][0]
    if thr is None:
        return df
    u = row_hash([key], seed, "tail") / F.lit(4294967296.0)
    f = F.lit(lo) + (F.lit(hi) - F.lit(lo)) * u
    x = F.col(q(col))
    return df.withColumn(col, F.when(x > F.lit(thr), x * f).otherwise(x))
