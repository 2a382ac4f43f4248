"""Column expressions shared by the operators.

Everything here returns a ``Column`` (JVM side, inside whole-stage
codegen) or reads only the schema; nothing starts a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the text forms accepted as numbers by ``coerce_numeric``.
# Decimal digits with optional sign, fraction and exponent, or inf /
# infinity / nan in any letter case, surrounded by optional blanks.
# A trailing type letter such as '1d' or '2f' is not a number.
NUM_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"

_FLOATS = (T.FloatType, T.DoubleType)


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order (integers, floats, decimals; not
    booleans)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def float_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: float NaN becomes NULL (a projection only)."""
    fl = set(float_cols(df))
    if not fl:
        return df
    return df.select(
        *[
            (F.when(F.isnan(F.col(q(f.name))), F.lit(None)).otherwise(F.col(q(f.name)))).cast(f.dataType).alias(f.name)
            if f.name in fl
            else F.col(q(f.name))
            for f in df.schema.fields
        ]
    )


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(q(name))
    if isinstance(df.schema[name].dataType, _FLOATS):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def row_hash(keys: Sequence[str], seed: int, salt: str = "") -> Column:
    """Seeded 32-bit hash of a key: the first 8 hex digits of
    md5('k1:k2:...:seed[:salt]') read as an unsigned integer.  Row-local,
    stable across re-execution and partitioning, and the same formula can
    be written in any SQL engine with md5."""
    parts: list[Column] = [F.col(q(k)).cast("string") for k in keys]
    parts.append(F.lit(str(seed)))
    if salt:
        parts.append(F.lit(salt))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def row_hash_sql(keys: Sequence[str], seed: int, salt: str = "") -> str:
    """The same hash as ``row_hash`` in DuckDB SQL (for oracles)."""
    parts = [f"CAST({k} AS VARCHAR)" for k in keys] + [f"'{seed}'"]
    if salt:
        parts.append(f"'{salt}'")
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


def coerce_numeric(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL.
    NaN text becomes NULL too (one notion of missing)."""
    s = strip_ws(c.cast("string"))
    v = F.when(s.rlike(NUM_RE), s.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


# fixed values: the white-space characters stripped around text (space,
# tab, newline, carriage return, vertical tab, form feed)
WS_CHARS = " \t\n\r\x0b\x0c"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing white space (linear BTRIM, not a regex:
    a trailing-space regex rescans long texts at every blank)."""
    return F.trim(c, F.lit(WS_CHARS))


def g1_skew(c: Column) -> Column:
    """Bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2);
    NULL below 3 values or for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation on pairwise-complete rows; 0 when either side
    has zero variance on those rows (corr would divide by zero)."""
    xx = F.when(y.isNotNull(), x)
    yy = F.when(x.isNotNull(), y)
    den = F.sqrt(F.var_pop(xx) * F.var_pop(yy))
    return F.coalesce(F.when(den > 0, F.covar_pop(xx, yy) / den), F.lit(0.0))


def clip_keep_null(c: Column, lo, hi) -> Column:
    """Clip into [lo, hi]; greatest/least skip NULLs, so keep NULL as NULL."""
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def log1p(c: Column) -> Column:
    return F.log1p(c)


def expm1_clip(c: Column, lo: float = -10.0, hi: float = 20.0) -> Column:
    """expm1 of a log-scale prediction, input clipped to [-10, 20]."""
    return F.expm1(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


# fixed values: the fence patterns recognised in a model reply.  First a
# fence opened by ```python / ```Python then a newline, else a bare ```
# fence then a newline; the text up to the next ``` is the code.  Without
# a fence every ```word marker and ``` is removed.
_FENCE_PY = r"(?s)```[Pp]ython\s*\r?\n(.*?)```"
_FENCE_ANY = r"(?s)```\s*\r?\n(.*?)```"
_FENCE_MARK = r"```[A-Za-z0-9_]*"


def extract_code(c: Column) -> Column:
    py = F.regexp_extract(c, _FENCE_PY, 1)
    anyf = F.regexp_extract(c, _FENCE_ANY, 1)
    bare = F.regexp_replace(c, _FENCE_MARK, "")
    has_py = c.rlike(_FENCE_PY)
    has_any = c.rlike(_FENCE_ANY)
    return strip_ws(F.when(has_py, py).when(has_any, anyf).otherwise(bare))


def extract_metric(c: Column, label: str = "New RMSLE:") -> Column:
    """Number written after a label in a log line, e.g. 'New RMSLE: 0.4312'."""
    pat = "(?:" + label.replace(".", r"\.") + r")\s*([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)"
    txt = F.regexp_extract(c, pat, 1)
    return F.when(txt != "", txt.try_cast("double"))
