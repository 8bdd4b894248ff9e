"""The registered queries: each operator over whole given tables."""
from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import sources
from quarry.functions.columns import as_vector
from quarry.operators import compare, density, describe, kmeans, neighbours, pca, prepare, quality, reshape, umap, validate
from quarry.plans import features, labelled, pipeline
from quarry.plans.features import CONTINUOUS, embeddings, embeddings_low, events_with_gaps, rfm, table
from quarry.session import cut, scratch

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
K_RANGE = range(2, 13)  # fixed value: the numbers of clusters that are compared
_FITTED: dict = {}
_MAKING: dict = {}  # a lock per model: parts that go on side by side make it once


def _once(name: str, spark: SparkSession, sf_dir: str, make: Callable):
    """Fit once per session and input; several queries read the same model."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    with _MAKING.setdefault(key, threading.RLock()):
        if key not in _FITTED:
            _FITTED[key] = make()
        return _FITTED[key]


def rounded(df: DataFrame, cols: Sequence[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def _z(spark, d):
    base = rfm(spark, d).select("row_id", *CONTINUOUS)
    return prepare.standardize(base, prepare.fit_scaler(base, CONTINUOUS))


# ------------------------------------------------------------------ sources


def q_schema_report(spark, d):
    roles = {
        "c_custkey": {"role": "key", "description": "customer number"}, "c_nationkey": {"role": "nominal", "description": "nation"},
        "c_acctbal": {"role": "continuous", "description": "account balance"}, "c_mktsegment": {"role": "nominal", "description": "market segment"},
    }
    return sources.schema_report(sources.with_roles(table(spark, d, "customer"), roles))


def q_join_features_target(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_mktsegment", "c_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target"))
    return sources.join_on_key(customer.drop("c_nationkey"), customer.join(nation, "c_nationkey").select("row_id", "target"))


def q_csv_round_trip(spark, d):
    scaled, path = _z(spark, d), scratch(spark)
    sources.write_csv(scaled, path)
    return rounded(sources.read_table(spark, path, scaled.schema, "csv"), CONTINUOUS)


# ------------------------------------------------------------------ describe and prepare


def q_boxplot_before_after(spark, d):
    ev = table(spark, d, "events")
    after = prepare.drop_outliers(ev, prepare.fit_fences(ev, ["value"]))
    return _box(describe.box_before_after(ev, after, ["value"]))


def _box(df):
    return rounded(df, ["q1", "median", "q3", "low", "high", "whisker_low", "whisker_high"])


def q_histogram(spark, d):
    return rounded(describe.histogram(table(spark, d, "events"), ["value"], 20), ["left", "right", "mean"])


def q_noise_summary(spark, d):
    marked = table(spark, d, "embeddings").select(F.when(F.col("label") < 2, -1).otherwise(F.col("label")).alias("cluster"))
    return rounded(describe.noise_summary(marked), ["noise_pct"])


def q_iqr_report(spark, d):
    ev = table(spark, d, "events")
    return rounded(prepare.outlier_report(ev, prepare.fit_fences(ev, ["value"])), ["q1", "q3", "low", "high"])


def q_iqr_filter(spark, d):
    ev = table(spark, d, "events")
    return prepare.drop_outliers(ev, prepare.fit_fences(ev, ["value"])).select("event_id", "value")


def q_impute_median(spark, d):
    ev = events_with_gaps(spark, d).select("event_id", "value")
    return prepare.impute(ev, prepare.fit_medians(ev, ["value"]))


def q_impute_mode(spark, d):
    ev = events_with_gaps(spark, d).select("event_id", "event_type")
    return prepare.impute(ev, prepare.fit_modes(ev, ["event_type"]))


def q_onehot(spark, d):
    orders = table(spark, d, "orders")
    return prepare.one_hot(orders, prepare.fit_levels(orders, ["o_orderpriority", "o_orderstatus"]), ["o_orderkey"])


def q_model_matrix(spark, d):
    base = rfm(spark, d)
    return rounded(prepare.model_matrix(base, CONTINUOUS, [], prepare.fit_levels(base, ["c_mktsegment"])), CONTINUOUS)


def q_inverse_standardize(spark, d):
    base = rfm(spark, d).select("row_id", *CONTINUOUS)
    fit = prepare.fit_scaler(base, CONTINUOUS)
    back = prepare.inverse_standardize(prepare.standardize(base, fit), fit)
    # Means of whole cents often end in a five; the shift moves them off the edge between two roundings.
    return rounded(back.withColumns({c: F.col(c) + 0.00001234 for c in CONTINUOUS}), CONTINUOUS, 4)


# ------------------------------------------------------------------ PCA


def _pca2(spark, d):
    base = rfm(spark, d).select("row_id", "recency", "n_orders")
    return base, pca.fit(base, ["recency", "n_orders"])


def q_pca_eigen2(spark, d):
    v = pca.variance_table(spark, _pca2(spark, d)[1])
    return rounded(v.withColumn("eigenvalue", F.round("eigenvalue", 4)), ["ratio", "cum"])


def q_pca2_project(spark, d):
    base, m = _pca2(spark, d)
    return rounded(pca.project(base, m), ["d1", "d2"], 5)


def q_pca2_inverse(spark, d):
    base, m = _pca2(spark, d)
    return rounded(pca.inverse(pca.project(base, m, 1), m, 1), ["recency", "n_orders"], 5)


def _variance2(spark, d):
    v = pca.variance_table(spark, _pca2(spark, d)[1])
    return v.withColumn("eigenvalue", F.col("eigenvalue") / 100.0)


def q_pca2_target(spark, d):
    base, m = _pca2(spark, d)
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("y"))
    return rounded(reshape.attach_labels(pca.project(base, m), target), ["d1", "d2"], 5)


def q_pca_invariants(spark, d):
    """What any eigendecomposition of the covariance must fulfil, from the fitted model and the data."""
    scaled, cols, _, m, _ = _wide(spark, d)
    p, real = range(len(cols)), range(1, m.rank)
    scores = pca.project(scaled, m, len(cols))
    found = scores.agg(*[F.var_samp(f"d{j + 1}").alias(f"v{j}") for j in p], *[F.corr("d1", f"d{j + 1}").alias(f"c{j}") for j in real]).first()
    total = scaled.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    gram = m.components.T @ m.components
    rows = [
        ("total_variance", round(float(sum(m.eigenvalues)), 6)), ("variance_of_columns", round(float(sum(total)), 6)),
        ("orthonormality_error", round(float(abs(gram - np.eye(len(cols))).max()), 6)),
        ("score_variance_error", round(max(abs(found[f"v{j}"] - float(m.eigenvalues[j])) for j in p), 6)),
        ("score_correlation", round(max([abs(found[f"c{j}"]) for j in real], default=0.0), 6)),
    ]
    return spark.createDataFrame(rows, "fact string, value double")


def _wide(spark, d):
    """Scaled matrix, its columns, scaler, PCA model and the written 2-d points."""

    def make():
        scaled, cols, scaler = features.scaled_rfm(spark, d)
        model = pca.fit(scaled, cols)
        points = cut(pca.as_points(pca.project(scaled, model)))
        return scaled, cols, scaler, model, points

    return _once("wide", spark, d, make)


def q_pca_project(spark, d):
    scaled, _, _, model, _ = _wide(spark, d)
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("y"))
    return reshape.attach_labels(pca.project(scaled, model), target)


def q_pca_inverse(spark, d):
    scaled, _, _, model, _ = _wide(spark, d)
    return pca.inverse(pca.project(scaled, model), model)


# ------------------------------------------------------------------ projection quality


def _projection_metrics(spark, d):
    """The metrics of two linear projections of the embeddings."""
    high, k, rows = embeddings(spark, d).select("row_id", "x"), 10, []
    eh = cut(neighbours.knn(high, k))
    for name, rules in (("low", features.LOW), ("other", features.OTHER)):
        low = cut(embeddings_low(spark, d, rules))
        el = cut(neighbours.knn(low, k))
        parts = [
            neighbours.mean_overlap(eh, el), quality.distance_rank_correlation(high, low).select("spearman"),
            quality.trustworthiness(high, low, 5, low_edges=el), quality.continuity(high, low, 5, high_edges=eh),
        ]
        rows += [p.select(F.lit(p.columns[0]).alias("metric"), F.lit(name).alias("method"), F.round(p.columns[0], 6).alias("value")) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return cut(out)


def q_projection_compare(spark, d):
    m = _once("projection", spark, d, lambda: _projection_metrics(spark, d))
    return rounded(quality.compare_methods(m, "low", "other"), ["delta"])


def q_projection_decide(spark, d):
    m = _once("projection", spark, d, lambda: _projection_metrics(spark, d))
    return quality.decide(quality.compare_methods(m, "low", "other"), "other", "low")


# ------------------------------------------------------------------ k-means


def _fixed(spark, d):
    z = _z(spark, d).select("row_id", F.col("n_orders").alias("a"), F.col("recency").alias("b"))
    start = np.array([[r["a"], r["b"]] for r in z.filter("row_id <= 4").orderBy("row_id").collect()])
    return z.select("row_id", as_vector(["a", "b"]).alias("x")), start


def q_assign_fixed(spark, d):
    z, centres = _fixed(spark, d)
    return kmeans.assign(z, {"cluster": centres}).select("row_id", "cluster")


def q_lloyd(spark, d):
    z, centres = _fixed(spark, d)
    z = cut(z)
    for _ in range(2):
        step = {r["cluster"]: (r["c1"], r["c2"]) for r in kmeans.lloyd_step(z, centres).collect()}
        centres = np.array([step.get(i, tuple(c)) for i, c in enumerate(centres)])
    return rounded(kmeans.lloyd_step(z, centres), ["c1", "c2"])


def _models(spark, d):
    return _once("kmeans", spark, d, lambda: kmeans.fit_grid(_wide(spark, d)[4], K_RANGE))


def facts(spark, **values):
    """(fact, value) rows for statements about a fitted result."""
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "fact string, value double")


def q_kmeans_invariants(spark, d):
    """The models of the grid hold what every such fit must: all rows assigned, centres the means of their rows, and inertia falling
    with k, each below that of a step from plain starting centres."""
    points, models = _wide(spark, d)[4], _models(spark, d)
    model = models[max(models)]
    labels = kmeans.assign(points, {"cluster": model.centres})
    moments = validate.cluster_moments(labels).collect()
    start = np.array([r["x"] for r in points.orderBy("row_id").limit(model.k).collect()])
    plain = validate.inertia(validate.cluster_moments(kmeans.assign(points, {"cluster": start}))).first()[0]
    costs = [models[k].inertia for k in sorted(models)]
    drift = max(float(np.abs(np.array(r["centre"]) - model.centres[r["cluster"]]).max()) for r in moments)
    return facts(
        spark, rows=sum(r["n"] for r in moments), models=len(models), clusters=len(moments), inertia_falls=all(b <= a for a, b in zip(costs, costs[1:])),
        inertia_is_that_of_labels=abs(sum(r["sum_sq"] for r in moments) / model.inertia - 1) < 1e-3, below_plain_start=model.inertia <= plain, centres_are_means=drift < 0.05,
    )


def _plot_facts(spark, plot, labels, summary):
    """What every plot and its clusters must satisfy: all rows once, clusters that are runs of the plot, a summary that adds up."""
    both = plot.join(labels, "row_id")
    runs = both.filter("cluster <> -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos") + 1).alias("span"), (F.max("pos") - F.min("pos")).alias("last"))
    held = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.col("n") != F.col("span")), F.lit(False))).first()
    one = plot.agg(F.count(F.lit(1)), F.count_distinct("row_id"), F.max("pos"), F.sum(F.col("reachability").isNull().cast("int")), F.sum((F.col("pred_pos") >= F.col("pos")).cast("int"))).first()
    said = summary.first()
    return facts(
        spark, rows=one[0], ids=one[1], last_position=one[2], starts=one[3], entered_from_later=one[4], labelled=both.count(), torn_clusters=held[2],
        summary_adds_up=said["n"] == one[0] and said["clusters"] == held[1] and said["noise"] == one[0] - held[0],
    )


def q_optics_invariants(spark, d):
    plot, labels = _optics(spark, d)
    return _plot_facts(spark, plot, labels, density.run_summary(_wide(spark, d)[4], labels))


def q_umap_invariants(spark, d):
    """Every row is placed, at finite coordinates that spread."""
    r = _embedded(spark, d).agg(F.count(F.lit(1)), F.count_distinct("row_id"), F.sum((F.isnan("d1") | F.isnan("d2") | (F.abs("d1") > 1e6) | (F.abs("d2") > 1e6)).cast("int")), F.stddev("d1") > 0, F.stddev("d2") > 0).first()
    return facts(spark, rows=r[0], ids=r[1], lost=r[2], spread=r[3] and r[4])


def q_one_projection(spark, d):
    """Going on without the second projection: its rows are left out, nothing else changes."""
    return pca.side_by_side({"PCA": q_pca2_project(spark, d), "UMAP": None})


def q_fixed_projections(spark, d):
    """Two given projections next to each other."""
    flat = {name: embeddings_low(spark, d, rules).select("row_id", F.col("x")[0].alias("d1"), F.col("x")[1].alias("d2")) for name, rules in (("low", features.LOW), ("other", features.OTHER))}
    return rounded(pca.side_by_side(flat), ["d1", "d2"])


def _grid(spark, d):
    def make():
        codes = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("y"))
        return cut(kmeans.grid_metrics(_wide(spark, d)[4].join(codes, "row_id"), _models(spark, d), "y"))

    return _once("grid", spark, d, make)


def _best_k(spark, d):
    return kmeans.select_k(_grid(spark, d)).filter("metric = 'silhouette'").first()["k"]


def q_centroids(spark, d):
    _, _, scaler, model, _ = _wide(spark, d)
    return kmeans.centroid_table(spark, _models(spark, d)[_best_k(spark, d)].centres, model, scaler)


def q_kmeans_profile(spark, d):
    labels = kmeans.assign(_wide(spark, d)[4], {"cluster": _models(spark, d)[_best_k(spark, d)].centres}).select("row_id", "cluster")
    return describe.cluster_profile(reshape.attach_labels(rfm(spark, d), labels), "cluster", CONTINUOUS)


def q_kmeans_crosstab(spark, d):
    labels = kmeans.assign(_wide(spark, d)[4], {"cluster": _models(spark, d)[_best_k(spark, d)].centres}).select("row_id", "cluster")
    return describe.crosstab(reshape.attach_labels(rfm(spark, d), labels), "cluster", "c_mktsegment")


def q_kmeans_scatter(spark, d):
    c = _models(spark, d)[_best_k(spark, d)].centres
    return kmeans.scatter(kmeans.assign(_wide(spark, d)[4], {"cluster": c}), centres=c)


# ------------------------------------------------------------------ density clustering and embedding


def _high(spark, d):
    scaled, cols, *_ = _wide(spark, d)
    return _once("high", spark, d, lambda: cut(prepare.assemble(scaled, cols)))


def _embedded(spark, d):
    return _once("umap", spark, d, lambda: cut(umap.embed(_high(spark, d))))


def _optics(spark, d):
    return _once("optics", spark, d, lambda: density.optics(_wide(spark, d)[4], 5))


def q_core_distance(spark, d):
    edges = neighbours.knn(embeddings(spark, d), 4)
    return rounded(density.core_distances(edges, 5), ["core"])


def q_optics_scatter(spark, d):
    return kmeans.scatter(_wide(spark, d)[4].join(_optics(spark, d)[1], "row_id"))


def _spaces(spark, d):
    return {"PCA": _wide(spark, d)[4], "UMAP": _once("umap points", spark, d, lambda: cut(pca.as_points(_embedded(spark, d))))}


def _sensitivity(spark, d):
    return _once("sensitivity", spark, d, lambda: density.sensitivity(_spaces(spark, d)))


def q_optics_best(spark, d):
    return compare.best_per_batch(_sensitivity(spark, d)[0], "min_samples", "run", "silhouette")


def _target(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("y"))


def _comparison(spark, d):
    """Metrics of the best k-means and of two density runs in each space. The k-means grids go on beside the density runs: both have
    many short jobs that leave most cores idle, and only the density runs have tasks over all edges."""

    def best_kmeans(name: str) -> DataFrame:
        if name == "PCA":
            grid = _grid(spark, d)
        else:
            points = _spaces(spark, d)[name]
            grid = cut(kmeans.grid_metrics(points.join(_target(spark, d), "row_id"), kmeans.fit_grid(points, K_RANGE), "y"))
        best = kmeans.select_k(grid).filter("metric = 'silhouette'").first()["k"]
        return grid.filter(F.col("k") == best).select(F.lit(f"k-means {name}").alias("model"), "metric", "value")

    def density_run(points: DataFrame, name: str, ms: int) -> DataFrame:
        summaries, _, runs = _sensitivity(spark, d)
        one = (F.col("space") == name) & (F.col("min_samples") == ms)
        return cut(pipeline.density_metrics(points, runs.filter(one).select("row_id", "cluster"), _target(spark, d), f"density {name} ms={ms}", summaries.filter(one)))

    def make():
        _wide(spark, d)
        with ThreadPoolExecutor(1) as pool, ThreadPoolExecutor(density.RUNS_AT_ONCE) as runs_pool:
            grids = {name: pool.submit(inheritable_thread_target(best_kmeans), name) for name in ("PCA", "UMAP")}
            spaces = _spaces(spark, d)
            _sensitivity(spark, d)
            runs = {(name, ms): runs_pool.submit(inheritable_thread_target(density_run), points, name, ms) for name, points in spaces.items() for ms in (5, 15)}
            parts = [p for name in spaces for p in (grids[name].result(), *[runs[name, ms].result() for ms in (5, 15)])]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out)

    return _once("comparison", spark, d, make)


def _methods(spark, d):
    return _once("methods", spark, d, lambda: pipeline.projection_quality(_high(spark, d), _spaces(spark, d)))


def q_side_by_side(spark, d):
    flat = pca.project(_wide(spark, d)[0], _wide(spark, d)[3])
    return pca.side_by_side({"PCA": flat, "UMAP": _embedded(spark, d)})


# ------------------------------------------------------------------ validation and comparison


def _moments(spark, d):
    return validate.cluster_moments(embeddings(spark, d))


def _metric_rows(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_extendedprice").alias("mean_price"), F.avg("l_discount").alias("mean_discount"), F.count(F.lit(1)).cast("double").alias("rows"))
    return li.unpivot(["model"], ["mean_price", "mean_discount", "rows"], "metric", "value")


def q_best_per_batch(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("batch"), F.col("o_orderpriority").alias("run")).agg(F.avg("o_totalprice").alias("score"))
    return rounded(compare.best_per_batch(runs, "batch", "run", "score"), ["score"], 4)


def catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "schema_report": q_schema_report,
        "shape": lambda s, d: sources.shape(t(s, d, "lineitem")),
        "join_features_target": q_join_features_target,
        "csv_round_trip": q_csv_round_trip,
        "wide_to_long": lambda s, d: reshape.wide_to_long(t(s, d, "lineitem"), ["l_discount", "l_tax"], ["l_orderkey", "l_linenumber"]),
        "first_rows": lambda s, d: reshape.first_rows(t(s, d, "orders").withColumnRenamed("o_orderkey", "row_id").select("row_id", "o_totalprice")),
        "remove_rows": lambda s, d: reshape.remove_rows(
            t(s, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal"),
            t(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("row_id"))),
        "attach_labels": lambda s, d: reshape.attach_labels(
            t(s, d, "documents").select(F.col("doc_id").alias("row_id"), "n_chars"),
            t(s, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("cluster"))),
        "describe_summary": lambda s, d: describe.summary(t(s, d, "lineitem"), LINE),
        "center_spread": lambda s, d: rounded(describe.center_spread(t(s, d, "lineitem"), LINE), ["mean", "median", "std"]),
        "value_counts": lambda s, d: describe.value_counts(t(s, d, "orders"), "o_orderpriority"),
        "null_report": lambda s, d: describe.null_report(events_with_gaps(s, d)),
        "modes": lambda s, d: describe.modes(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]),
        "histogram20": q_histogram,
        "boxplot_stats": lambda s, d: _box(describe.box_stats(t(s, d, "events"), ["value"], ["event_type"])),
        "boxplot_long": lambda s, d: _box(describe.box_stats(t(s, d, "lineitem"), LINE)),
        "boxplot_before_after": q_boxplot_before_after,
        "box_fliers": lambda s, d: describe.fliers(t(s, d, "events"), ["value"], "event_id"),
        "corr_matrix": lambda s, d: rounded(describe.correlation(rfm(s, d), CONTINUOUS), ["r"]),
        "corr_strong_pairs": lambda s, d: describe.strong_pairs(rfm(s, d), CONTINUOUS),
        "corr_masked": lambda s, d: reshape.mask_below(reshape.lower_triangle(describe.correlation(rfm(s, d), CONTINUOUS)), "r", 0.3).select("a", "b", "r"),
        "crosstab_total": lambda s, d: describe.crosstab(t(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
        "contingency_long": lambda s, d: describe.contingency(t(s, d, "labels"), "quality", "toxic"),
        "cluster_profile": lambda s, d: describe.cluster_profile(t(s, d, "customer"), "c_mktsegment", ["c_acctbal"]),
        "cluster_sizes": lambda s, d: describe.cluster_sizes(embeddings(s, d)),
        "noise_summary": q_noise_summary,
        "impute_median": q_impute_median,
        "impute_mode": q_impute_mode,
        "iqr_report": q_iqr_report,
        "iqr_filter": q_iqr_filter,
        "onehot_all_levels": q_onehot,
        "model_matrix": q_model_matrix,
        "standardize": lambda s, d: rounded(_z(s, d), CONTINUOUS),
        "standardize_check": lambda s, d: prepare.standardize_check(_z(s, d), CONTINUOUS),
        "inverse_standardize": q_inverse_standardize,
        "pca_eigen2": q_pca_eigen2,
        "pca2_loadings": lambda s, d: rounded(pca.loadings(s, _pca2(s, d)[1]), ["loading"]),
        "pca2_project": q_pca2_project,
        "pca2_inverse": q_pca2_inverse,
        "pca_variance": lambda s, d: pca.variance_table(s, _wide(s, d)[3]),
        "pca_kaiser": lambda s, d: pca.kaiser(pca.variance_table(s, _wide(s, d)[3])),
        "pca_components_for": lambda s, d: pca.components_for(pca.variance_table(s, _wide(s, d)[3])),
        "pca_scree": lambda s, d: pca.scree(pca.variance_table(s, _wide(s, d)[3])),
        "pca_loadings": lambda s, d: pca.loadings_wide(s, _wide(s, d)[3]),
        "pca_project": q_pca_project,
        "pca_inverse": q_pca_inverse,
        "knn_edges": lambda s, d: rounded(neighbours.knn(embeddings(s, d), 10), ["dist"]),
        "jaccard_knn": lambda s, d: rounded(neighbours.mean_overlap(neighbours.knn(embeddings(s, d), 10), neighbours.knn(embeddings_low(s, d), 10)), ["jaccard"]),
        "trustworthiness": lambda s, d: rounded(quality.trustworthiness(embeddings(s, d), embeddings_low(s, d)), ["trustworthiness"]),
        "continuity": lambda s, d: rounded(quality.continuity(embeddings(s, d), embeddings_low(s, d)), ["continuity"]),
        "spearman_dist": lambda s, d: rounded(quality.distance_rank_correlation(embeddings(s, d), embeddings_low(s, d)).drop("error"), ["spearman"]),
        "projection_compare": q_projection_compare,
        "projection_decide": q_projection_decide,
        "kmeans_assign_fixed": q_assign_fixed,
        "kmeans_lloyd_step": q_lloyd,
        "kmeans_grid": _grid,
        "kmeans_elbow": lambda s, d: kmeans.elbow(_grid(s, d)),
        "select_k": lambda s, d: kmeans.select_k(_grid(s, d)),
        "centroid_units": q_centroids,
        "centroid_top5": lambda s, d: kmeans.top_variables(q_centroids(s, d)),
        "kmeans_profile": q_kmeans_profile,
        "kmeans_crosstab": q_kmeans_crosstab,
        "kmeans_scatter": q_kmeans_scatter,
        "silhouette": lambda s, d: rounded(validate.silhouette(embeddings(s, d)), ["silhouette"]),
        "silhouette_samples": lambda s, d: rounded(validate.silhouette_samples(embeddings(s, d)), ["silhouette", "mean"]),
        "dunn": lambda s, d: rounded(validate.dunn(embeddings(s, d)), ["closest", "widest", "dunn"]),
        "davies_bouldin": lambda s, d: rounded(validate.davies_bouldin(_moments(s, d)), ["davies_bouldin"]),
        "calinski_harabasz": lambda s, d: rounded(validate.calinski_harabasz(_moments(s, d)), ["calinski_harabasz"]),
        "inertia": lambda s, d: rounded(validate.inertia(_moments(s, d)), ["inertia"]),
        "agreement_labels": lambda s, d: rounded(validate.agreement(t(s, d, "labels"), "quality", "toxic"), ["ari", "nmi"]),
        "agreement_flags": lambda s, d: rounded(validate.agreement(t(s, d, "lineitem"), "l_returnflag", "l_linestatus", ["l_linenumber"]), ["ari", "nmi"]),
        "metric_minmax": lambda s, d: rounded(compare.minmax(_metric_rows(s, d)), ["scaled"]).withColumn("value", F.round("value", 4)),
        "model_compare": lambda s, d: compare.model_table(_metric_rows(s, d), ["mean_price", "mean_discount", "rows"]),
        "best_per_batch": q_best_per_batch,
        "core_distance": q_core_distance,
        "optics_reachability": lambda s, d: _optics(s, d)[0],
        "optics_labels": lambda s, d: _optics(s, d)[1],
        "optics_summary": lambda s, d: density.run_summary(_wide(s, d)[4], _optics(s, d)[1]),
        "optics_scatter": q_optics_scatter,
        "umap_graph": lambda s, d: umap.fuzzy_graph(neighbours.knn(_high(s, d), 14)),
        "umap_embed": _embedded,
        "umap_sweep": lambda s, d: umap.sweep(_high(s, d)),
        "projections_side_by_side": q_side_by_side,
        "projection_quality": _methods,
        "projection_winners": lambda s, d: quality.compare_methods(_methods(s, d), "PCA", "UMAP"),
        "projection_decision": lambda s, d: quality.decide(quality.compare_methods(_methods(s, d), "PCA", "UMAP"), "UMAP", "PCA"),
        "optics_sensitivity": lambda s, d: _sensitivity(s, d)[0],
        "optics_sensitivity_plots": lambda s, d: _sensitivity(s, d)[1],
        "optics_best": q_optics_best,
        "final_comparison": lambda s, d: compare.model_table(_comparison(s, d), kmeans.GRID_METRICS + ["clusters", "noise_pct", "min_size", "max_size"]),
        "final_normalised": lambda s, d: pipeline.normalised(_comparison(s, d)),
    }
    q |= {f.__name__: f for f in labelled.QUERIES}
    return q | {
        "pca2_kaiser": lambda s, d: rounded(pca.kaiser(_variance2(s, d)), ["cum"]),
        "pca2_components_for": lambda s, d: rounded(pca.components_for(_variance2(s, d)), ["cum"]),
        "pca2_scree": lambda s, d: rounded(pca.scree(_variance2(s, d)), ["eigenvalue", "ratio_pct", "cum_pct"], 4),
        "pca2_target": q_pca2_target,
        "pca_invariants": q_pca_invariants,
        "corr_matrix_products": lambda s, d: rounded(describe.correlation(rfm(s, d), CONTINUOUS, direct_columns=0), ["r"]),
        "silhouette_bounds": lambda s, d: rounded(validate.silhouette(embeddings(s, d), dense_width=0), ["silhouette"]),
        "kmeans_invariants": q_kmeans_invariants,
        "optics_invariants": q_optics_invariants,
        "umap_invariants": q_umap_invariants,
        "projection_alone": q_one_projection,
        "projections_fixed": q_fixed_projections,
    }
