"""Reshaping: long matrices, threshold masks, triangles, wide displays, merged metric records."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import melt


def wide_to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "variable", value: str = "value") -> DataFrame:
    return melt(df, cols, ids, name, value)


def mask_below(df: DataFrame, value: str, threshold: float, decimals: int = 3) -> DataFrame:
    """Null out values whose magnitude is under ``threshold``; round the rest."""
    return df.withColumn(value, F.when(F.abs(value) >= threshold, F.round(value, decimals)))


def lower_triangle(df: DataFrame, row_pos: str = "pos_a", col_pos: str = "pos_b") -> DataFrame:
    """Keep the cells strictly under the diagonal of a long matrix."""
    return df.filter(F.col(row_pos) > F.col(col_pos))


def merge_records(*frames: DataFrame) -> DataFrame:
    """Stack metric records whose columns differ; a missing metric is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Add a label column computed elsewhere, aligned by key."""
    return df.join(labels, key, "inner")


def remove_rows(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is not in ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def first_rows(df: DataFrame, n: int = 5, key: str = "row_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def without_noise(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Drop the points a density model left unassigned (label -1)."""
    return df.filter(F.col(label) != -1)
