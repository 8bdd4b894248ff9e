"""Preprocessing as fit / transform: a fit returns small parameters, a transform is one projection or filter."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import as_vector, level_name, outside
from quarry.functions.quantiles import DIRECT_ROWS, quantiles
from quarry.operators import describe

class Fence(NamedTuple):
    q1: float
    q3: float
    low: float
    high: float


class Scale(NamedTuple):
    mean: float
    std: float


def fit_medians(df: DataFrame, cols: Sequence[str], direct_rows: int = DIRECT_ROWS) -> dict[str, float]:
    return {r["variable"]: r["q0"] for r in quantiles(df, cols, [0.5], direct_rows=direct_rows).collect()}


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Smallest most frequent value per column, in the column's own type."""
    found = {r["variable"]: r["mode"] for r in describe.modes(df, cols).collect()}
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    cast = {"double": float, "float": float, "integer": int, "long": int, "short": int, "byte": int, "boolean": lambda v: v == "true"}
    return {c: cast.get(kinds[c], str)(v) for c, v in found.items() if v is not None}


def impute(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in fills.items()})


def fit_fences(df: DataFrame, cols: Sequence[str], factor: float = 1.5, direct_rows: int = DIRECT_ROWS) -> dict[str, Fence]:
    """Interquartile fences of all columns, taken from the same table."""
    rows = describe.fences(df, cols, (), factor, direct_rows).collect()
    found = {r["variable"]: Fence(r["q1"], r["q3"], r["low"], r["high"]) for r in rows}
    return {c: found[c] for c in cols if c in found}


def _flag(c: str, f: Fence) -> Column:
    return outside(c, F.lit(f.low), F.lit(f.high))


def outlier_report(df: DataFrame, fit: dict[str, Fence]) -> DataFrame:
    """``(variable, q1, q3, low, high, outliers, rows_any)`` from one pass; ``rows_any`` counts rows
    outside at least one fence."""
    any_flag = reduce(lambda a, b: a | b, [_flag(c, f) for c, f in fit.items()])
    count = lambda flag: F.coalesce(F.sum(flag.cast("bigint")), F.lit(0).cast("bigint"))
    one = df.agg(count(any_flag).alias("any"), *[count(_flag(c, f)).alias(f"n_{i}") for i, (c, f) in enumerate(fit.items())])
    rows = [
        F.struct(
            F.lit(c).alias("variable"), F.lit(f.q1).alias("q1"), F.lit(f.q3).alias("q3"), F.lit(f.low).alias("low"),
            F.lit(f.high).alias("high"), F.col(f"n_{i}").alias("outliers"), F.col("any").alias("rows_any"),
        )
        for i, (c, f) in enumerate(fit.items())
    ]
    return one.select(F.inline(F.array(*rows)))


def drop_outliers(df: DataFrame, fit: dict[str, Fence]) -> DataFrame:
    """Drop every row outside at least one fence: a single filter that stays in the scan stage."""
    return df.filter(~reduce(lambda a, b: a | b, [_flag(c, f) for c, f in fit.items()]))


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values per column, NULLs left out. Each becomes a column of :func:`one_hot`, so they are listed on the
    driver; :func:`one_hot_long` needs no list."""
    out = {}
    for c in cols:
        out[c] = sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect())
    return out


def one_hot(df: DataFrame, levels: dict[str, list], keep: Sequence[str] = (), unseen: str = "error") -> DataFrame:
    """``keep`` columns followed by one 0/1 column per level, named ``column_level``.

    A value that the fit has not seen raises by default; ``unseen="zeros"`` encodes it as all zeros.
    """
    cells = []
    for c, lvls in levels.items():
        source = F.col(c)
        if unseen == "error":
            known = source.isin(lvls) if lvls else F.lit(False)
            source = F.when(known | source.isNull(), source).otherwise(
                F.raise_error(F.concat(F.lit(f"value not seen when fitting {c}: "), source.cast("string"))).cast(df.schema[c].dataType)
            )
        cells += [F.when(source == F.lit(lv), 1.0).otherwise(0.0).alias(level_name(c, lv)) for lv in lvls]
    return df.select(*keep, *cells)


def one_hot_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., variable, level, value)``: the ones of :func:`one_hot` as rows, for any number of levels. NULLs have none."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    rows = df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.variable", "cell.level")
    return rows.filter(F.col("level").isNotNull()).withColumn("value", F.lit(1.0))


def level_columns(levels: dict[str, list]) -> list[str]:
    return [level_name(c, lv) for c, lvls in levels.items() for lv in lvls]


def model_matrix(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], levels: dict[str, list], key: str = "row_id") -> DataFrame:
    """Key, continuous, binary and one-hot columns in that order, all numeric ones as double."""
    numeric = [F.col(c).cast("double").alias(c) for c in [*continuous, *binary]]
    plain = df.select(key, *numeric, *[c for c in levels if c not in {*continuous, *binary}])
    return one_hot(plain, levels, [key, *continuous, *binary])


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, Scale]:
    """Mean and population standard deviation of every column in one aggregate."""
    aggs = [a for i, c in enumerate(cols) for a in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]
    row = df.agg(*aggs).first()
    return {c: Scale(row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, fit: dict[str, Scale]) -> DataFrame:
    """z-scores; a column without variance becomes 0."""
    return df.withColumns({c: (F.col(c) - s.mean) / (s.std if s.std else 1.0) for c, s in fit.items()})


def inverse_standardize(df: DataFrame, fit: dict[str, Scale]) -> DataFrame:
    return df.withColumns({c: F.col(c) * (s.std if s.std else 1.0) + s.mean for c, s in fit.items()})


def standardize_check(df: DataFrame, cols: Sequence[str], decimals: int = 4) -> DataFrame:
    """``(variable, mean, std)`` of scaled columns: about 0 and about 1."""
    stats = describe.melt(df, cols).groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    tidy = lambda c: (F.round(c, decimals) + F.lit(0.0)).alias(c)
    return stats.select("variable", tidy("mean"), tidy("std"))


def assemble(df: DataFrame, cols: Sequence[str], key: str = "row_id", name: str = "x") -> DataFrame:
    """``(key, x array<double>)``, the form that the distance, PCA and clustering operators take."""
    return df.select(key, as_vector(cols).alias(name))
