"""Readings of grids, centres and noisy labels on clusterings that SQL can repeat."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry import sources
from quarry.operators import compare, density, describe, kmeans, neighbours, pca, prepare, reshape, umap
from quarry.plans import pipeline
from quarry.plans.features import CONTINUOUS, embeddings, embeddings_low, events_with_spikes, labelled_points, rfm, table
from quarry.session import cut, scratch


def rounded(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def iqr_union(spark, d):
    ev = events_with_spikes(spark, d)
    return rounded(prepare.outlier_report(ev, prepare.fit_fences(ev, ["value", "load", "user_id"])), ["q1", "q3", "low", "high"])


def _cleaned(spark, d):
    ev = events_with_spikes(spark, d).withColumnRenamed("event_id", "row_id")
    return pipeline.clean_and_scale(ev, ["value", "load"], [], ["event_type"], ["value", "load"], ["value"], ["event_type"])


def clean_matrix(spark, d):
    done = _cleaned(spark, d)
    return rounded(done.scaled, done.columns)


def target_after_cleaning(spark, d):
    return describe.value_counts(_cleaned(spark, d).clean, "event_type")


def merge_records(spark, d):
    """Records of two kinds of models, each with a metric that the other lacks."""
    orders = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count(F.lit(1)).alias("rows"))
    parts = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_size"), 4).alias("mean_size"), F.count(F.lit(1)).alias("rows"))
    return reshape.merge_records(orders, parts)


def label_file(spark, d):
    path = scratch(spark)
    sources.write_csv(table(spark, d, "labels").select(F.col("toxic").cast("int").alias("target")), path)
    return describe.value_counts(sources.read_labels(spark, path), "target")


def onehot_long(spark, d):
    return prepare.one_hot_long(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_orderkey"])


def noise_filter(spark, d):
    return reshape.without_noise(labelled_points(spark, d).select("row_id", F.col("marked").alias("cluster")))


def label_grid(spark, d):
    long = kmeans.label_metrics(labelled_points(spark, d), {"2": "k2", "3": "k3", "4": "k4"}, "y")
    return cut(rounded(long.select(F.col("model").cast("int").alias("k"), "metric", "value"), ["value"]))


def label_elbow(spark, d):
    return rounded(kmeans.elbow(label_grid(spark, d)), ["value", "drop", "bend"], 4)


def label_select_k(spark, d):
    return kmeans.select_k(label_grid(spark, d))


def noisy_bundle(spark, d):
    points = labelled_points(spark, d)
    labels = points.select("row_id", F.col("marked").alias("cluster"))
    return rounded(pipeline.density_metrics(points.select("row_id", "x"), labels, points.select("row_id", "y"), "noisy"), ["value"], 5)


def _label_models(spark, d):
    one = label_grid(spark, d).where("metric <> 'inertia'").select(F.concat(F.lit("k="), F.col("k").cast("string")).alias("model"), "metric", "value")
    return one.unionByName(noisy_bundle(spark, d))


def label_comparison(spark, d):
    return compare.model_table(_label_models(spark, d), kmeans.GRID_METRICS[1:] + ["clusters", "noise_pct", "min_size", "max_size"])


def label_normalised(spark, d):
    return rounded(pipeline.normalised(_label_models(spark, d)), ["scaled"], 4)


def fixed_points(spark, d):
    """Two scaled columns and the first ids' rows as centres."""
    base = rfm(spark, d).select("row_id", *CONTINUOUS)
    z = prepare.standardize(base, prepare.fit_scaler(base, CONTINUOUS)).select("row_id", F.col("n_orders").alias("a"), F.col("total").alias("t"), F.col("recency").alias("b"))
    start = np.array([[r["a"], r["b"]] for r in z.filter("row_id <= 4").orderBy("row_id").collect()])
    return z.select("row_id", F.array("a", "b").alias("x")), start


def _centres(spark, d):
    base = rfm(spark, d).select("row_id", *CONTINUOUS)
    scaler, p = prepare.fit_scaler(base, CONTINUOUS), len(CONTINUOUS)
    return kmeans.centroid_table(spark, fixed_points(spark, d)[1], pca.PcaModel(list(CONTINUOUS), np.zeros(p), np.eye(p), np.ones(p)), scaler)


def fixed_centroid_units(spark, d):
    return rounded(_centres(spark, d), ["z", "value"])


def fixed_centroid_top5(spark, d):
    return rounded(kmeans.top_variables(_centres(spark, d)), ["z"])


def _labels(spark, d):
    points, centres = fixed_points(spark, d)
    return points, centres, kmeans.assign(points, {"cluster": centres}).select("row_id", "cluster")


def fixed_profile(spark, d):
    return describe.cluster_profile(reshape.attach_labels(rfm(spark, d), _labels(spark, d)[2]), "cluster", CONTINUOUS, 1)


def fixed_crosstab(spark, d):
    return describe.crosstab(reshape.attach_labels(rfm(spark, d), _labels(spark, d)[2]), "cluster", "c_mktsegment")


def fixed_scatter(spark, d):
    points, centres, labels = _labels(spark, d)
    return rounded(kmeans.scatter(points.join(labels, "row_id"), centres=centres), ["d1", "d2"])


def _plot(points, min_samples, **settings):
    plot = density.reachability(points, min_samples, **settings)
    return rounded(plot.select("pos", "row_id", "reachability", "core", "predecessor"), ["reachability", "core"])


def optics_walk(spark, d):
    """The reachability plot of the projected embeddings."""
    return _plot(embeddings_low(spark, d), 5).drop("predecessor")


def optics_walk_lists(spark, d):
    """The same plot by path lists, as beyond the edges that one task walks over."""
    return _plot(embeddings_low(spark, d), 5, walk_edges=0)


#: Cell width and radius of the tied and the limited plot.
BIN, MAX_EPS = 0.3, 0.12


def binned_low(spark, d):
    """The projected embeddings on a grid: many copies and equal distances."""
    return embeddings_low(spark, d).select("row_id", F.transform("x", lambda v: F.floor(v / BIN).cast("double")).alias("x"))


def optics_walk_ties(spark, d):
    return _plot(binned_low(spark, d), 5)


def optics_walk_radius(spark, d):
    """Regions of points within a radius, each with a start of its own, and points that no region lets in."""
    return _plot(embeddings_low(spark, d), 5, max_eps=MAX_EPS)


def optics_walk_radius_ties(spark, d):
    return _plot(binned_low(spark, d), 9, max_eps=1.0)


def fuzzy_graph_embeddings(spark, d):
    return rounded(umap.fuzzy_graph(neighbours.knn(embeddings(spark, d), 14)), ["w"], 5)


QUERIES = [
    optics_walk, optics_walk_lists, optics_walk_ties, optics_walk_radius, optics_walk_radius_ties, fuzzy_graph_embeddings,
    iqr_union, clean_matrix, target_after_cleaning, merge_records, label_file, onehot_long, noise_filter, label_grid, label_elbow, label_select_k, noisy_bundle,
    label_comparison, label_normalised, fixed_centroid_units, fixed_centroid_top5, fixed_profile, fixed_crosstab, fixed_scatter,
]
