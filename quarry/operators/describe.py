"""Descriptive statistics. Results are long tables, one row per variable (and group)."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import melt, outside
from quarry.functions.quantiles import DIRECT_ROWS, quantiles
from quarry.operators.reshape import lower_triangle
from quarry.session import cut

#: Fences by group are sent to all tasks only when they are at most so many rows.
SMALL_TABLE = 100_000
#: Columns whose correlations are aggregates of one plan.
DIRECT_COLUMNS = 24
#: Tasks' sums are added up in so many parts first.
SUM_PARTS = 32


def _per_column(df: DataFrame, cols: Sequence[str], aggs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``(variable, <aggs>...)`` from one aggregate over the columns as they are, without copying rows per column."""
    one = df.agg(*[make(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, make in aggs.items()])
    rows = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{name}_{i}").alias(name) for name in aggs]) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def _beside(long: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join long rows with a row per group; the rows stay where they are if the groups are few, which is checked."""
    few = list(keys) == ["variable"] or small.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE  # else as few as the columns
    return long.join(F.broadcast(small) if few else small, list(keys))


def center_spread(df: DataFrame, cols: Sequence[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """``(variable, mean, median, std)``; std is the sample one."""
    moments = _per_column(df, cols, {"mean": F.avg, "std": F.stddev_samp})
    med = quantiles(df, cols, [0.5], direct_rows=direct_rows)
    return moments.join(med, "variable").select("variable", "mean", F.col("q0").alias("median"), "std")


def summary(df: DataFrame, cols: Sequence[str], decimals: int | None = 2, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """``(variable, count, mean, std, min, q25, q50, q75, max)`` with exact quartiles."""
    moments = _per_column(df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], direct_rows=direct_rows).select("variable", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    out = moments.join(qs, "variable")
    show = (lambda c: F.col(c)) if decimals is None else (lambda c: F.round(c, decimals).alias(c))
    return out.select("variable", "count", *[show(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, count)`` sorted by value, NULLs left out."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy("value")


def null_report(df: DataFrame, cols: Sequence[str] | None = None, only_positive: bool = True) -> DataFrame:
    """``(variable, nulls)``, counted in one pass; by default only columns that have some."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0).cast("bigint")).alias(c) for c in cols])
    out = one.unpivot([], cols, "variable", "nulls")
    return out.filter(F.col("nulls") > 0) if only_positive else out


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, mode, count)``: the smallest of the most frequent values, as text in ``mode``.

    The values of all columns are counted in one pass, so the final pick sees one row per distinct value.
    """
    cols = list(cols)
    columns = [F.col(c) for c in cols]
    counted = df.groupingSets([[c] for c in columns], *columns).agg(F.count(F.lit(1)).alias("_n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(cols)])
    best = lambda i, c: F.min(F.when((F.col(f"_g{i}") == 0) & F.col(c).isNotNull(), F.struct((-F.col("_n")).alias("neg"), F.col(c).alias("v"))))
    one = counted.agg(*[best(i, c).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"m{i}.v").cast("string").alias("mode"), (-F.col(f"m{i}.neg")).alias("count")) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., variable, bin, left, right, count, mean)``: equal-width bins, the last one closed.

    Empty bins are present with count 0. A constant column gets the range value -0.5 .. value +0.5.
    """
    keys = [*by, "variable"]
    long = melt(df, cols, by).filter(F.col("value").isNotNull())
    flat = F.min("value") == F.max("value")
    bounds = long.groupBy(*keys).agg(
        (F.min("value") - F.when(flat, 0.5).otherwise(0.0)).alias("lo"),
        (F.max("value") + F.when(flat, 0.5).otherwise(0.0)).alias("hi"),
        F.avg("value").alias("mean"),
    )
    slot = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)).cast("int")
    bounds = cut(bounds) if by else df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)
    counted = _beside(long, bounds, keys).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("left"),
        (F.col("lo") + F.col("bin") * width).alias("right"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"), "mean",
    )


def fences(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), factor: float = 1.5, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """``(by..., variable, n, q1, median, q3, low, high)``."""
    iqr = F.col("q2") - F.col("q0")
    return quantiles(df, cols, [0.25, 0.5, 0.75], by, direct_rows).select(
        *by, "variable", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
        (F.col("q0") - factor * iqr).alias("low"), (F.col("q2") + factor * iqr).alias("high"),
    )


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), factor: float = 1.5, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Fences plus whiskers (the extreme values still inside) and the number of fliers."""
    keys = [*by, "variable"]
    f = fences(df, cols, by, factor, direct_rows)
    if not by:
        return _ungrouped_box(df, cols, f)
    f = cut(f)
    long = _beside(melt(df, cols, by).filter(F.col("value").isNotNull()), f.select(*keys, "low", "high"), keys)
    inside = ~outside("value", F.col("low"), F.col("high"))
    ends = long.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum((~inside).cast("bigint")).alias("fliers"),
    )
    return f.join(ends, keys)


def _ungrouped_box(df: DataFrame, cols: Sequence[str], f: DataFrame) -> DataFrame:
    """Fences of whole columns are as few as the columns: they go into one aggregate as literals."""
    found = {r["variable"]: r for r in f.collect()}
    cols = [c for c in cols if c in found]
    if not cols:
        return f.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("whisker_low", "double"), ("whisker_high", "double"), ("fliers", "bigint"))])
    value = {c: F.col(c).cast("double") for c in cols}
    out = {c: outside(value[c], F.lit(found[c]["low"]), F.lit(found[c]["high"])) for c in cols}
    one = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.min(F.when(~out[c], value[c])).alias(f"a{i}"), F.max(F.when(~out[c], value[c])).alias(f"b{i}"), F.coalesce(F.sum(out[c].cast("bigint")), F.lit(0).cast("bigint")).alias(f"n{i}"))])
    rows = [F.struct(
        F.lit(c).alias("variable"), F.lit(found[c]["n"]).cast("bigint").alias("n"), *[F.lit(found[c][k]).cast("double").alias(k) for k in ("q1", "median", "q3", "low", "high")],
        F.col(f"a{i}").alias("whisker_low"), F.col(f"b{i}").alias("whisker_high"), F.col(f"n{i}").alias("fliers")) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def fliers(df: DataFrame, cols: Sequence[str], id_col: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """The rows beyond the fences: ``(id, by..., variable, value)``."""
    keys = [*by, "variable"]
    f = cut(fences(df, cols, by, factor).select(*keys, "low", "high"))
    return _beside(melt(df, cols, [id_col, *by]), f, keys).filter(outside("value", F.col("low"), F.col("high"))).select(id_col, *keys, "value")


def box_before_after(before: DataFrame, after: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Box statistics of two versions of a table, told apart by ``stage``."""
    both = before.select(F.lit("before").alias("stage"), *cols).unionByName(after.select(F.lit("after").alias("stage"), *cols))
    return box_stats(both, cols, ["stage"], factor)


def _pair_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(i, j, n, s, q, p)`` for every pair of columns over the rows where both are present: how many, and the sums of column i, of
    its squares and of the products, all about the columns' means. Matrix products per batch, added up in two stages."""
    width = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([np.nan if m is None else m for m in means], dtype=float)
    kinds = ("n", "s", "q", "p")

    def scan(batches):
        total = np.zeros((4, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - mean
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        lists = [pa.array(list(t), pa.list_(pa.float64())) for t in total]
        part = TaskContext.get().partitionId() % SUM_PARTS
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int32()), *lists], ["i", "part", *kinds])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], **{k: [np.sum(np.stack(pdf[k].to_numpy()), axis=0)] for k in kinds}})

    arrays = ", ".join(f"{k} array<double>" for k in kinds)
    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(scan, f"i int, part int, {arrays}")
    sums = parts.groupBy("i", "part").applyInPandas(add, f"i int, {arrays}").groupBy("i").applyInPandas(add, f"i int, {arrays}")
    return cut(sums.select("i", F.posexplode(F.arrays_zip(*kinds)).alias("j", "e")).select("i", "j", "e.*"))


def correlation(df: DataFrame, cols: Sequence[str], direct_columns: int | None = None) -> DataFrame:
    """Pearson matrix as ``(a, b, pos_a, pos_b, r)``; each pair uses the rows where both are present.

    For few columns, ``direct_columns``, one aggregate computes the upper half and the lower half is mirrored from it. With more
    the pairs would make too long a plan; sums of all pairs come from matrix products then, NULL where a column does not vary.
    """
    cols = list(cols)
    p = len(cols)
    if p > (DIRECT_COLUMNS if direct_columns is None else direct_columns):
        a = _pair_sums(df, cols)
        b = a.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("s2"), F.col("q").alias("q2"))
        n, s, q, s2, q2 = (F.col(c) for c in ("n", "s", "q", "s2", "q2"))
        va, vb = n * q - s * s, n * q2 - s2 * s2
        r = F.when((va > 0) & (vb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * F.col("p") - s * s2) / (F.sqrt(va) * F.sqrt(vb)))))
        name = F.array(*[F.lit(c) for c in cols])
        return a.join(b, ["i", "j"]).select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.col("i").alias("pos_a"), F.col("j").alias("pos_b"), r.alias("r"))
    both = lambda i, j: F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double"))
    one = df.agg(*[both(i, j).alias(f"r_{i}_{j}") for i in range(p) for j in range(i, p)])
    cells = [
        F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.lit(i).alias("pos_a"), F.lit(j).alias("pos_b"), F.col(f"r_{min(i, j)}_{max(i, j)}").alias("r"))
        for i in range(p)
        for j in range(p)
    ]
    return one.select(F.inline(F.array(*cells)))


def strong_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.3, decimals: int = 3) -> DataFrame:
    """Pairs under the diagonal with ``|r| >= threshold``, strongest first."""
    long = lower_triangle(correlation(df, cols)).filter(F.abs("r") >= threshold)
    return long.select("a", "b", F.round("r", decimals).alias("r")).orderBy(F.abs("r").desc(), "a", "b")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long table of joint counts ``(a, b, n)``; only the combinations that occur."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence | None = None) -> DataFrame:
    """Counts with one column per level of ``col`` and a row ``total``. Levels become columns, so they are listed on the
    driver; :func:`contingency` has the same counts as rows, however many levels there are."""
    if levels is None:
        levels = sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())
    kept = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    wide = kept.groupBy(row).pivot(col, list(levels)).agg(F.count(F.lit(1)))
    cells = [F.coalesce(F.col(f"`{lv}`"), F.lit(0).cast("bigint")).alias(str(lv)) for lv in levels]
    total = F.aggregate(F.array(*cells), F.lit(0).cast("bigint"), lambda acc, v: acc + v) if cells else F.lit(0).cast("bigint")
    return wide.select(row, *cells, total.alias("total")).orderBy(row)


def cluster_profile(df: DataFrame, label: str, cols: Sequence[str], decimals: int = 2) -> DataFrame:
    """Mean of each column per cluster, in the units of ``df``."""
    return df.groupBy(label).agg(*[F.round(F.avg(c), decimals).alias(c) for c in cols]).orderBy(label)


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """``(cluster, size)``, noise (-1) included."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size")).orderBy(label)


def noise_summary(df: DataFrame, label: str = "cluster") -> DataFrame:
    """One row ``(n, clusters, noise, noise_pct, min_size, max_size)``; sizes leave noise out."""
    real = F.col(label) != -1
    return cluster_sizes(df, label).agg(
        F.sum("size").alias("n"),
        F.sum(real.cast("bigint")).alias("clusters"),
        F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0).cast("bigint")).alias("noise"),
        F.min(F.when(real, F.col("size"))).alias("min_size"),
        F.max(F.when(real, F.col("size"))).alias("max_size"),
    ).select("n", "clusters", "noise", (100.0 * F.col("noise") / F.col("n")).alias("noise_pct"), "min_size", "max_size")
