"""The whole study: from a raw table to compared cluster models."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import compare, density, kmeans, neighbours, prepare, quality, reshape, validate
from quarry.session import cut


@dataclass
class Prepared:
    """A cleaned and scaled table with everything needed to undo the scaling."""

    clean: DataFrame
    scaled: DataFrame
    columns: list[str]
    scaler: dict[str, prepare.Scale]
    fences: dict[str, prepare.Fence]
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)


def clean_and_scale(df: DataFrame, continuous: Sequence[str], binary: Sequence[str], nominal: Sequence[str], outlier_cols: Sequence[str], impute_median: Sequence[str] = (), impute_mode: Sequence[str] = (), key: str = "row_id") -> Prepared:
    """Fill gaps, then drop rows outside the fences, then encode and scale what is left, in this order."""
    medians = prepare.fit_medians(df, list(impute_median)) if impute_median else {}
    modes = prepare.fit_modes(df, list(impute_mode)) if impute_mode else {}
    full = prepare.impute(df, {**medians, **modes}) if medians or modes else df
    fences = prepare.fit_fences(full, list(outlier_cols)) if outlier_cols else {}
    clean = cut(prepare.drop_outliers(full, fences) if fences else full)
    levels = prepare.fit_levels(clean, list(nominal))
    matrix = prepare.model_matrix(clean, continuous, binary, levels, key)
    columns = [*continuous, *binary, *prepare.level_columns(levels)]
    scaler = prepare.fit_scaler(matrix, columns)
    return Prepared(clean, cut(prepare.standardize(matrix, scaler)), columns, scaler, fences, medians, modes)


def projection_quality(high: DataFrame, projections: dict[str, DataFrame], k_rank: int = 5, k_overlap: int = 10) -> DataFrame:
    """Long ``(metric, method, value)``: trustworthiness, continuity, neighbour overlap, distance rank
    correlation and the silhouette of a two-cluster k-means, for each projection ``(row_id, x)``."""
    near_high = cut(neighbours.knn(high, max(k_rank, k_overlap)))
    rows = []
    for method, low in projections.items():
        near_low = cut(neighbours.knn(low, max(k_rank, k_overlap)))
        two = kmeans.fit_grid(low, [2], restarts=1)[2]
        top = lambda e: e.filter(F.col("rank") <= k_overlap)
        parts = {
            "trustworthiness": quality.trustworthiness(high, low, k_rank, low_edges=near_low),
            "continuity": quality.continuity(high, low, k_rank, high_edges=near_high),
            "jaccard": neighbours.mean_overlap(top(near_high), top(near_low)),
            "spearman": quality.distance_rank_correlation(high, low).select("spearman"),
            "silhouette": validate.silhouette(kmeans.assign(low, {"cluster": two.centres})).select("silhouette"),
        }
        rows += [p.select(F.lit(m).alias("metric"), F.lit(method).alias("method"), F.col(p.columns[0]).alias("value")) for m, p in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return cut(out)


def density_metrics(points: DataFrame, labels: DataFrame, target: DataFrame | None, run: str, summary: DataFrame | None = None) -> DataFrame:
    """Long ``(model, metric, value)`` of one density run, noise left out of every quality metric. ``summary`` may hand in what
    :func:`density.run_summary` has found for the same points and labels."""
    spark = points.sparkSession
    joined = points.join(reshape.without_noise(labels), "row_id")
    if target is not None:
        joined = joined.join(target, "row_id")
    joined = cut(joined)
    summary = density.run_summary(points, labels) if summary is None else summary
    sizes = summary.select(F.lit(run).alias("model"), *[F.col(c).cast("double").alias(c) for c in ("clusters", "noise_pct", "min_size", "max_size", "silhouette")])
    long = sizes.unpivot(["model"], ["clusters", "noise_pct", "min_size", "max_size", "silhouette"], "metric", "value")
    if joined.select("cluster").distinct().limit(2).count() < 2:
        empty = [(run, m, None) for m in kmeans.GRID_METRICS if m not in ("inertia", "silhouette")]
        return long.unionByName(spark.createDataFrame(empty, "model string, metric string, value double"))
    return long.unionByName(kmeans.label_metrics(joined, {run: "cluster"}, "y" if target is not None else None, without=("inertia", "silhouette")))


def normalised(metrics: DataFrame) -> DataFrame:
    """Min-max scaled quality metrics across models, for a grouped bar chart."""
    kept = metrics.filter(F.col("metric").isin("silhouette", "davies_bouldin", "calinski_harabasz", "ari", "nmi", "dunn"))
    return compare.minmax(kept)
