"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known, package on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later
    passes neither recompute it nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(uri: str):
    """(pyarrow file system, path) of a folder that driver and executors
    share; for code that runs inside tasks and reads byte ranges."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is.  ``lower`` is exact
    and fast on ASCII texts; ``translate`` does the rest."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5.  A null id is
    held out: nothing is learned from it."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)), F.lit(0)) == 0


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (clashes get underscores)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that clash with result columns."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def anti_join(df: DataFrame, drop: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys (null-safe) are not in ``drop``."""
    names = free_names(df, *[f"drop_{k}" for k in keys])
    right = drop.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    cond = None
    for k, n in zip(keys, names, strict=True):
        one = df[k].eqNullSafe(right[n])
        cond = one if cond is None else cond & one
    return df.join(right, cond, "left_anti")
