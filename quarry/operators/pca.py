"""Principal components: one distributed covariance, everything after it is model-sized."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.columns import as_vector


@dataclass
class PcaModel:
    variables: list[str]
    mean: np.ndarray         # p
    components: np.ndarray   # p x p, one column per component
    eigenvalues: np.ndarray  # p, sample variances along the components

    @property
    def rank(self) -> int:
        """Components that are not zero but for rounding."""
        return int((self.eigenvalues > 1e-9 * max(float(self.eigenvalues.max(initial=0.0)), 1e-300)).sum())


def fit(df: DataFrame, cols: Sequence[str]) -> PcaModel:
    """All ``len(cols)`` components. Signs are fixed by making the largest loading of each one positive."""
    cols = list(cols)
    p = len(cols)
    stats = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    mean = np.array([stats[f"m{i}"] for i in range(p)])
    total = sum(stats[f"v{i}"] for i in range(p))
    centred = df.select(array_to_vector(F.array(*[F.col(c).cast("double") - float(m) for c, m in zip(cols, mean)])).alias("x"))
    model = PCA(k=p, inputCol="x", outputCol="y").fit(centred)
    comps = model.pc.toArray()
    lead = np.argmax(np.round(np.abs(comps), 9), axis=0)
    comps = comps * np.where(comps[lead, np.arange(p)] < 0, -1.0, 1.0)
    return PcaModel(cols, mean, comps, model.explainedVariance.toArray() * total)


def variance_table(spark: SparkSession, model: PcaModel) -> DataFrame:
    """``(pc, eigenvalue, ratio, cum)``, the scree data; one row per component."""
    rows = [(i + 1, float(v)) for i, v in enumerate(model.eigenvalues)]
    one = spark.createDataFrame(rows, "pc int, eigenvalue double")
    every = Window.partitionBy()
    upto = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
    ratio = one.withColumn("ratio", F.col("eigenvalue") / F.sum("eigenvalue").over(every))
    return ratio.withColumn("cum", F.sum("ratio").over(upto))


def kaiser(variance: DataFrame, threshold: float = 1.0) -> DataFrame:
    """One row ``(components, cum)``: components with an eigenvalue above ``threshold`` and their share."""
    kept = F.col("eigenvalue") > threshold
    return variance.agg(F.coalesce(F.sum(kept.cast("bigint")), F.lit(0).cast("bigint")).alias("components"), F.max(F.when(kept, F.col("cum"))).alias("cum"))


def components_for(variance: DataFrame, share: float = 0.8) -> DataFrame:
    """One row ``(components, cum)``: the fewest components whose share reaches ``share``; NULL if none do."""
    enough = F.col("cum") >= share
    return variance.agg(F.min(F.when(enough, F.col("pc"))).alias("components"), F.min(F.when(enough, F.col("cum"))).alias("cum"))


def scree(variance: DataFrame, eigen_line: float = 1.0, share_line: float = 0.8) -> DataFrame:
    """Scree plot data: the variance table with percentages and the two threshold lines."""
    return variance.select(
        "pc", "eigenvalue", (F.col("ratio") * 100).alias("ratio_pct"), (F.col("cum") * 100).alias("cum_pct"),
        F.lit(eigen_line).alias("eigen_line"), F.lit(share_line * 100).alias("share_line_pct"),
        (F.col("eigenvalue") > eigen_line).alias("above_eigen_line"),
    )


def loadings(spark: SparkSession, model: PcaModel, m: int | None = None) -> DataFrame:
    """Long ``(variable, pc, loading)`` for the first ``m`` components."""
    m = m or model.components.shape[1]
    return spark.createDataFrame([(v, j + 1, float(model.components[i, j])) for i, v in enumerate(model.variables) for j in range(m)], "variable string, pc int, loading double")


def loadings_wide(spark: SparkSession, model: PcaModel, m: int = 5) -> DataFrame:
    """``(variable, PC1, PC2, ...)``."""
    long = loadings(spark, model, m).withColumn("name", F.concat(F.lit("PC"), F.col("pc")))
    return long.groupBy("variable").pivot("name", [f"PC{j + 1}" for j in range(m)]).agg(F.first("loading"))


def _dot(cols: Sequence[Column], weights: np.ndarray) -> Column:
    return sum((c * float(w) for c, w in zip(cols, weights)), F.lit(0.0))


def project(df: DataFrame, model: PcaModel, m: int = 2, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``(keep..., d1, ..., dm)``: scores of centred rows, as plain arithmetic in the scan stage."""
    centred = [F.col(c).cast("double") - float(mu) for c, mu in zip(model.variables, model.mean)]
    return df.select(*keep, *[_dot(centred, model.components[:, j]).alias(f"d{j + 1}") for j in range(m)])


def inverse(scores: DataFrame, model: PcaModel, m: int = 2, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Back to the variables from the first ``m`` scores, the other scores taken as zero."""
    parts = [F.col(f"d{j + 1}") for j in range(m)]
    return scores.select(*keep, *[(_dot(parts, model.components[i, :m]) + float(model.mean[i])).alias(v) for i, v in enumerate(model.variables)])


def as_points(scores: DataFrame, m: int = 2, key: str = "row_id") -> DataFrame:
    """``(key, x)`` for the distance and clustering operators."""
    return scores.select(key, as_vector([f"d{j + 1}" for j in range(m)]).alias("x"))


def side_by_side(projections: dict[str, DataFrame | None], key: str = "row_id") -> DataFrame:
    """Stack projections ``(key, d1, d2)`` with a ``method`` column; a method that is None gives no rows."""
    parts = [p.select(F.lit(name).alias("method"), key, "d1", "d2") for name, p in projections.items() if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
