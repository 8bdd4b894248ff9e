"""Small column helpers shared by the operators."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace floating NaN by NULL in one projection."""
    fixed = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*fixed)


def outside(col: str | Column, low, high) -> Column:
    """Strictly outside the fences; a value on a fence and a NULL are both inside."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce((c < low) | (c > high), F.lit(False))


def level_name(col: str, level) -> str:
    return f"{col}_{level}"


def melt(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long, NULL values kept; values become double."""
    narrow = df.select(*[F.col(i) for i in ids], *[F.col(c).cast("double").alias(c) for c in cols])
    return narrow.unpivot(list(ids), list(cols), name, value)


def as_vector(cols: Sequence[str]) -> Column:
    """Columns packed in order into ``array<double>``."""
    return F.array(*[F.col(c).cast("double") for c in cols])
