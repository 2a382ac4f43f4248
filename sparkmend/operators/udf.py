"""User steps: any DataFrame -> DataFrame function, or a batch function over
pandas frames (``mapInPandas``) or Arrow record batches (``mapInArrow``).
Errors are reported, not raised, and the input frame is never changed
(DataFrames are immutable; the function gets the same lazy plan)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.exprs import q
from ..session import cut_lineage

ERROR = "__step_error"


def user_transform(df: DataFrame, fn: Callable, batch_schema: str | T.StructType | None = None, check: bool = True, batches: str = "pandas"):
    """Returns (result, error_text or None).  With ``batch_schema`` the
    function is an iterator of batches -> iterator of batches, of the kind
    ``batches`` names ('pandas' or 'arrow'); otherwise it maps a DataFrame to a
    DataFrame (``DataFrame.transform``).

    ``check`` runs the step once over every row and keeps its rows in the
    checkpoint folder, so that an error in any row is reported here rather than
    raised later and nothing runs again: batch functions write their error text
    beside the rows.  Without it the result is lazy."""
    try:
        if not batch_schema:
            out = df.transform(fn)  # raises for anything but a DataFrame
            out.schema  # analysis errors
            return (cut_lineage(out) if check else out), None
        schema = batch_schema if isinstance(batch_schema, T.StructType) else T.StructType.fromDDL(batch_schema)
        if not check:
            return _mapped(df, fn, schema, batches), None
        wide = T.StructType([*schema.fields, T.StructField(ERROR, T.StringType())])
        ran = cut_lineage(_mapped(df, _reporting(fn, schema, batches), _nullable(wide), batches))
        failed = ran.where(F.col(ERROR).isNotNull()).select(ERROR).first()
        if failed is not None:
            return df, failed[0]
        return ran.select(*[F.col(q(f.name)) for f in schema.fields]), None
    except Exception as exc:
        return df, _text(exc)


def _mapped(df: DataFrame, fn: Callable, schema: T.StructType, batches: str) -> DataFrame:
    return {"pandas": df.mapInPandas, "arrow": df.mapInArrow}[batches](fn, schema)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def _text(exc: Exception) -> str:
    return f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"


def _reporting(fn: Callable, schema: T.StructType, batches: str) -> Callable:
    """``fn`` whose batches carry an empty error column; an error ends its
    partition with one row that holds the text."""
    arrow = to_arrow_schema(_nullable(schema))
    names = [f.name for f in schema.fields]

    def failure(exc: Exception):
        row = pa.RecordBatch.from_arrays([*[pa.nulls(1, t.type) for t in arrow], pa.array([_text(exc)])], [*names, ERROR])
        return row if batches == "arrow" else row.to_pandas(integer_object_nulls=True)

    def run(parts: Iterator) -> Iterator:
        try:
            for out in fn(parts):
                if batches == "arrow":
                    out = out.select(names)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.string())], [*names, ERROR])
                else:
                    if not isinstance(out, pd.DataFrame):
                        raise TypeError(f"step gave {type(out).__name__}, not a pandas frame")
                    lost = [c for c in names if c not in out.columns]
                    if lost:
                        raise KeyError(f"columns missing in a batch: {lost}")
                    yield out[names].assign(**{ERROR: pd.Series([None] * len(out), index=out.index, dtype="object")})
        except Exception as exc:
            yield failure(exc)

    return run
