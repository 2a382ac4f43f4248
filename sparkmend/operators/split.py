"""Train/test split and folds, decided per row by a seeded key hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q, row_hash
from .rank import hash_rank


def train_test_split(df: DataFrame, key, test: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """Adds ``is_test``: hash(key, seed) mod 100 < 100*test.  Row-local (no
    shuffle), stable across runs and partitionings; a multi-column key
    moves whole groups together."""
    keys = [key] if isinstance(key, str) else list(key)
    pct = int(round(test * 100))
    return df.withColumn(out, F.pmod(row_hash(keys, seed), F.lit(100)) < F.lit(pct))


def kfold(df: DataFrame, key, k: int = 5, seed: int = 42, exact: bool = False, out: str = "fold") -> DataFrame:
    """Adds ``fold`` in [0, k).  Default: hash mod k (row-local).  exact=True:
    rank by hash then mod k, so fold sizes differ by at most one row."""
    keys = [key] if isinstance(key, str) else list(key)
    if not exact:
        return df.withColumn(out, F.pmod(row_hash(keys, seed, "fold"), F.lit(k)).cast("int"))
    ranked = hash_rank(df, keys, seed, salt="fold", out="__r")
    return ranked.withColumn(out, F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r")


def stratified_kfold(df: DataFrame, key, label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Adds ``fold``: rank inside the label's class by hash, mod k, so every
    fold holds each class's share to within one row."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = hash_rank(df, keys, seed, by=[label], salt="fold", out="__r")
    return ranked.withColumn(out, F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r")


def fold_frames(df: DataFrame, fold_col: str, fold: int):
    return df.where(F.col(q(fold_col)) != fold), df.where(F.col(q(fold_col)) == fold)
