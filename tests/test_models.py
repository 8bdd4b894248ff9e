import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from quarry import sources
from quarry.operators import compare, density, kmeans, pca, prepare, quality, validate
from quarry.plans import catalog, pipeline

RNG = np.random.default_rng(9)


def frame(spark, m, cols):
    return spark.createDataFrame([(i, *[float(v) for v in r]) for i, r in enumerate(m)], "row_id long, " + ", ".join(f"{c} double" for c in cols))


def test_pca_against_numpy(spark):
    base = RNG.normal(size=(200, 3))
    m = np.hstack([base, base @ RNG.normal(size=(3, 4))]) + 5  # seven columns of rank three
    cols = [f"v{i}" for i in range(7)]
    df = frame(spark, m, cols)
    model = pca.fit(df, cols)
    want = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert model.eigenvalues == pytest.approx(want, abs=1e-8)
    assert model.eigenvalues[3:] == pytest.approx(0, abs=1e-8)
    assert model.components.T @ model.components == pytest.approx(np.eye(7), abs=1e-8)
    lead = model.components[np.argmax(np.abs(model.components), axis=0), np.arange(7)]
    assert (lead[:3] > 0).all()
    scores = {r["row_id"]: (r["d1"], r["d2"], r["d3"]) for r in pca.project(df, model, 3).collect()}
    got = np.array([scores[i] for i in range(200)])
    assert got == pytest.approx((m - m.mean(0)) @ model.components[:, :3], abs=1e-8)
    back = {r["row_id"]: tuple(r)[1:] for r in pca.inverse(pca.project(df, model, 3), model, 3).collect()}
    assert np.array([back[i] for i in range(200)]) == pytest.approx(m, abs=1e-6)
    v = pca.variance_table(spark, model)
    assert pca.components_for(v, 0.9999).first()["components"] == 3
    assert pca.components_for(v, 1.5).first()["components"] is None
    assert pca.kaiser(v, 1e-6).first()["components"] == 3


def test_published_scree_table(spark):
    # The published eigenvalues of 22 standardised columns, and what the study reads from them.
    eig = [4.372, 2.147, 1.744, 1.569, 1.447, 1.303, 1.193, 1.134, 1.040, 1.010, 0.898, 0.839]
    cumulated = [19.8, 29.5, 37.4, 44.5, 51.1, 57.0, 62.4, 67.5, 72.2, 76.8, 80.9, 84.7]
    total = eig[0] / 0.198  # the ten components that are not listed share the rest
    rest = [(total - sum(eig)) / 10] * 10
    v = pca.variance_table(spark, pca.PcaModel([], np.zeros(0), np.zeros((0, 0)), np.array(eig + rest)))
    assert pca.kaiser(v).first()["components"] == 10
    assert pca.components_for(v).first()["components"] == 11
    assert [r["cum"] * 100 for r in v.orderBy("pc").collect()[:12]] == pytest.approx(cumulated, abs=0.2)


def test_kmeans_recovers_planted_groups(spark):
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [5, 20]])
    truth = np.arange(300) % 5
    x = centres[truth] + RNG.normal(size=(300, 2)) * 0.5
    pts = brute.points(spark, x, y=truth)
    models = kmeans.fit_grid(pts, range(2, 8), restarts=3)
    assert all(models[k].inertia >= models[k + 1].inertia for k in range(2, 7))
    grid = kmeans.grid_metrics(pts, models, "y")
    rows = {(r["k"], r["metric"]): r["value"] for r in grid.collect()}
    assert rows[(5, "ari")] == pytest.approx(1.0) and rows[(5, "nmi")] == pytest.approx(1.0)
    assert rows[(5, "inertia")] == pytest.approx(models[5].inertia, rel=1e-9)
    lab = np.argmin(((x[:, None] - models[3].centres[None]) ** 2).sum(-1), axis=1)
    assert rows[(3, "silhouette")] == pytest.approx(brute.silhouette(x, lab).mean(), abs=1e-9)
    assert rows[(3, "dunn")] == pytest.approx(brute.dunn(x, lab), abs=1e-9)
    assert rows[(3, "davies_bouldin")] == pytest.approx(brute.davies_bouldin(x, lab), abs=1e-9)
    assert rows[(3, "calinski_harabasz")] == pytest.approx(brute.calinski_harabasz(x, lab), rel=1e-9)
    chosen = {r["metric"]: r["k"] for r in kmeans.select_k(grid).collect()}
    assert chosen == {"silhouette": 5, "calinski_harabasz": 5, "davies_bouldin": 5}
    bends = {r["k"]: r["bend"] for r in kmeans.elbow(grid).collect()}
    assert bends[2] is None and bends[7] is None


def test_select_k_on_published_grid(spark):
    # fixed values: a published k grid (k, silhouette, Davies-Bouldin, Calinski-Harabasz)
    table = [(2, 0.439, 0.914, 291.903), (3, 0.436, 0.766, 294.924), (4, 0.447, 0.788, 338.214), (5, 0.445, 0.731, 338.030), (6, 0.442, 0.747, 368.566),
             (7, 0.407, 0.807, 351.565), (8, 0.414, 0.789, 354.143), (9, 0.408, 0.803, 350.359), (10, 0.393, 0.811, 348.490), (11, 0.391, 0.788, 352.966), (12, 0.397, 0.770, 360.839)]
    names = ["silhouette", "davies_bouldin", "calinski_harabasz"]
    grid = spark.createDataFrame([(k, n, v) for k, *vs in table for n, v in zip(names, vs)], "k int, metric string, value double")
    assert {r["metric"]: r["k"] for r in kmeans.select_k(grid).collect()} == {"silhouette": 4, "davies_bouldin": 5, "calinski_harabasz": 6}


def test_centroids_back_to_units(spark):
    m = RNG.normal(size=(100, 3)) * [1, 10, 100] + [5, 50, 500]
    cols = ["a", "b", "c"]
    df = frame(spark, m, cols)
    scaler = prepare.fit_scaler(df, cols)
    z = prepare.standardize(df, scaler)
    model = pca.fit(z, cols)
    zm = (m - m.mean(0)) / m.std(0)
    scores = (zm - zm.mean(0)) @ model.components
    rows = {(r["cluster"], r["variable"]): (r["z"], r["value"]) for r in kmeans.centroid_table(spark, scores[:2], model, scaler).collect()}
    for c in range(2):
        for i, v in enumerate(cols):
            assert rows[(c, v)] == pytest.approx((zm[c, i], m[c, i]), abs=1e-8)
    top = kmeans.top_variables(kmeans.centroid_table(spark, scores[:2], model, scaler), 2).filter("cluster = 0 and rank = 1").first()
    assert top["variable"] == cols[int(np.argmax(np.abs(zm[0])))]


def test_method_comparison_rules(spark):
    # fixed values: published projection scores; the second method wins four of five
    rows = [("trustworthiness", 0.774, 0.969), ("continuity", 0.900, 0.964), ("jaccard", 0.165, 0.445), ("spearman", 0.540, 0.340), ("silhouette", 0.439, 0.586)]
    long = [(m, n, v) for m, a, b in rows for n, v in (("PCA", a), ("UMAP", b))]
    got = quality.compare_methods(spark.createDataFrame(long, "metric string, method string, value double"), "PCA", "UMAP")
    assert quality.decide(got, "UMAP", "PCA").first()[:] == (4, 5, "UMAP")
    alone = spark.createDataFrame([r for r in long if r[1] == "PCA"], "metric string, method string, value double")
    absent = quality.compare_methods(alone, "PCA", "UMAP").collect()
    assert all(r["winner"] == "PCA" and r["UMAP"] is None and r["delta"] is None for r in absent)


def test_minmax_spans_zero_to_one(spark):
    rows = [("a", "s", 0.4), ("b", "s", 0.6), ("c", "s", None), ("a", "db", 0.8), ("b", "db", 0.5), ("a", "flat", 1.0), ("b", "flat", 1.0)]
    df = spark.createDataFrame(rows, "model string, metric string, value double")
    got = {(r["model"], r["metric"]): r["scaled"] for r in compare.minmax(df).collect()}
    assert got == {("a", "s"): 0.0, ("b", "s"): 1.0, ("c", "s"): None, ("a", "db"): 1.0, ("b", "db"): 0.0, ("a", "flat"): None, ("b", "flat"): None}
    flipped = {(r["model"], r["metric"]): r["scaled"] for r in compare.minmax(df, {"db": False}).collect()}
    assert flipped[("b", "db")] == 1.0
    runs = spark.createDataFrame([("x", "r1", None), ("x", "r2", 0.1), ("x", "r3", 0.1)], "batch string, run string, score double")
    assert compare.best_per_batch(runs, "batch", "run", "score").first()["run"] == "r2"


def test_label_file_and_csv(spark, tmp_path):
    counts = {0: 158, 1: 53, 2: 33, 3: 29, 4: 11}
    path = tmp_path / "labels.csv"
    path.write_text("target\n" + "\n".join(str(v) for v, n in counts.items() for _ in range(n)) + "\n")
    from quarry.operators import describe

    assert {r["value"]: r["count"] for r in describe.value_counts(sources.read_labels(spark, str(path)), "target").collect()} == counts
    with pytest.raises(ValueError):
        sources.read_table(spark, str(path))
    report = sources.schema_report(spark.createDataFrame([], sources.CLINICAL_SCHEMA))
    assert report.count() == 15


def test_clean_and_scale_order(spark):
    rows = [(i, float(v), int(i % 2), "xyz"[i % 3], None if i % 10 == 0 else float(i % 4)) for i, v in enumerate(np.append(RNG.normal(size=99), 80.0))]
    df = spark.createDataFrame(rows, "row_id long, v double, b int, n string, g double")
    done = pipeline.clean_and_scale(df, ["v", "g"], ["b"], ["n"], ["v"], impute_median=["g"])
    assert done.columns == ["v", "g", "b", "n_x", "n_y", "n_z"]
    assert done.clean.filter("row_id = 99").count() == 0 and done.clean.filter("g is null").count() == 0
    check = prepare.standardize_check(done.scaled, done.columns, 6).collect()
    n = done.clean.count()
    assert all(r["mean"] == 0 and r["std"] == pytest.approx((n / (n - 1)) ** 0.5, abs=1e-6) for r in check)


def test_density_metrics_work_out_no_silhouette_twice(spark, monkeypatch):
    x = np.vstack([RNG.normal(size=(30, 2)) + c for c in ([0, 0], [9, 0], [0, 9])])
    points = brute.points(spark, x)
    labels = points.select("row_id", F.when(F.col("row_id") % 7 == 0, -1).otherwise((F.col("row_id") / 30).cast("int")).alias("cluster"))
    target = points.select("row_id", (F.col("row_id") % 3).alias("y"))
    rows = lambda d: sorted((r["model"], r["metric"], None if r["value"] is None else round(r["value"], 9)) for r in d.collect())
    summary = density.run_summary(points, labels).localCheckpoint()
    calls, silhouette = [], validate.silhouette
    monkeypatch.setattr(validate, "silhouette", lambda *a, **k: silhouette(*a, **k) if not calls.append(1) else None)
    alone = rows(pipeline.density_metrics(points, labels, target, "run"))
    assert len(calls) == 1 and len(alone) == 10 and {m for _, m, _ in alone} >= {"silhouette", "dunn", "ari"}
    assert rows(pipeline.density_metrics(points, labels, target, "run", summary)) == alone and len(calls) == 1


def test_grids_go_on_beside_density_runs(spark, monkeypatch):
    met, made = threading.Barrier(2), []
    points = brute.points(spark, np.arange(6.0).reshape(3, 2))
    grid = spark.createDataFrame([(2, "silhouette", 0.5), (3, "silhouette", 0.25)], "k int, metric string, value double")
    runs = points.select("row_id", F.lit(0).alias("cluster"), F.explode(F.array(F.lit("PCA"), F.lit("UMAP"))).alias("space"), F.explode(F.array(F.lit(5))).alias("min_samples"))

    def sensitivity(spaces):
        made.append(sorted(spaces))
        met.wait(120)  # for the grid of the other thread; one after the other would break it
        return runs, runs, runs

    monkeypatch.setattr(catalog, "_wide", lambda s, d: (None, None, None, None, points))
    monkeypatch.setattr(catalog, "_spaces", lambda s, d: {"PCA": points, "UMAP": points})
    monkeypatch.setattr(catalog, "_grid", lambda s, d: met.wait(120) and None or grid)
    monkeypatch.setattr(catalog, "_target", lambda s, d: points.select("row_id", F.lit(1).alias("y")))
    monkeypatch.setattr(catalog.kmeans, "fit_grid", lambda *a: {})
    monkeypatch.setattr(catalog.kmeans, "grid_metrics", lambda *a: grid)
    monkeypatch.setattr(catalog.density, "sensitivity", sensitivity)
    monkeypatch.setattr(catalog.pipeline, "density_metrics", lambda p, lab, t, run, summary: spark.createDataFrame([(run, "silhouette", 1.0)], "model string, metric string, value double"))
    found = catalog._comparison(spark, "side by side").collect()
    assert made == [["PCA", "UMAP"]]
    assert sorted(r["model"] for r in found) == sorted(f"{m} {s}{e}" for s in ("PCA", "UMAP") for m, e in (("k-means", ""), ("density", " ms=5"), ("density", " ms=15")))


def test_sums_of_few_and_of_many_tasks_agree(spark, monkeypatch):
    points = brute.points(spark, RNG.normal(size=(300, 2))).repartition(5)
    found = []
    for few in (0, 64):
        monkeypatch.setattr(kmeans, "FEW_TASKS", few)
        found.append(kmeans.fit_grid(points, [2, 5], restarts=2))
    for k in (2, 5):
        assert found[0][k].centres == pytest.approx(found[1][k].centres, abs=1e-9)
        assert found[0][k].inertia == pytest.approx(found[1][k].inertia, rel=1e-9)
