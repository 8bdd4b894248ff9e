import numpy as np
import pytest

import brute
from quarry.operators import neighbours, quality, validate

RNG = np.random.default_rng(7)
SETS = {
    "plane": RNG.normal(size=(400, 2)),
    "lattice": RNG.integers(0, 6, size=(300, 2)).astype(float),
    "wide": RNG.normal(size=(260, 40)),
    "hot": np.vstack([np.zeros((120, 3)), RNG.normal(size=(240, 3))]),
}


@pytest.fixture(params=["all pairs", "pruned"])
def pruning(request, monkeypatch):
    """Small inputs skip pruning; force it in half of the runs."""
    if request.param == "pruned":
        monkeypatch.setattr("quarry.operators.blocks.SMALL_PAIRS", 0)


@pytest.mark.parametrize("name", SETS)
def test_knn_matches_brute_force(spark, pruning, name):
    x = SETS[name]
    ids = [int(v) for v in RNG.permutation(len(x))]
    got = {}
    for r in sorted(neighbours.knn(brute.points(spark, x, ids), 5).collect(), key=lambda r: (r["i"], r["rank"])):
        got.setdefault(r["i"], []).append(r["j"])
    assert got == brute.knn(x, ids, 5)


@pytest.mark.parametrize("name", SETS)
def test_silhouette_and_dunn(spark, pruning, name):
    x = SETS[name]
    lab = np.arange(len(x)) % 4
    lab[:3] = [9, 0, 0]
    df = brute.points(spark, x, cluster=lab, other=np.arange(len(x)) % 2)
    got = {r["model"]: r["silhouette"] for r in validate.silhouette(df, ["cluster", "other"]).collect()}
    assert got["cluster"] == pytest.approx(brute.silhouette(x, lab).mean(), abs=1e-9)
    assert got["other"] == pytest.approx(brute.silhouette(x, np.arange(len(x)) % 2).mean(), abs=1e-9)
    assert validate.dunn(df).first()["dunn"] == pytest.approx(brute.dunn(x, lab), abs=1e-12)


@pytest.mark.parametrize("name", SETS)
def test_silhouette_by_bounds(spark, pruning, name):
    """The way for many clusters, with singletons, copies and labels that overlap in space."""
    x = SETS[name]
    lab = np.arange(len(x)) % 30
    lab[:3] = [-9, 77, 78]
    near = (np.round(x[:, 0]) * 10 + np.round(x[:, 1])).astype(int)
    df = brute.points(spark, x, cluster=lab, other=near, one=np.zeros(len(x)))
    got = {r["model"]: r["silhouette"] for r in validate.silhouette(df, ["cluster", "other", "one"], dense_width=0).collect()}
    assert got["cluster"] == pytest.approx(brute.silhouette(x, lab).mean(), abs=1e-9)
    assert got["other"] == pytest.approx(brute.silhouette(x, near).mean(), abs=1e-9) and got["one"] is None


def test_silhouette_of_many_clusters_measures_few(spark, monkeypatch):
    """A point's sums are a few, however many clusters there are."""
    r = np.random.default_rng(8)
    lab = np.arange(6000) % 600
    x = np.column_stack([lab % 25, lab // 25]) * 10.0 + r.normal(size=(6000, 2))
    rows, sweep = [], validate.blocks.sweep

    def counted(*args, **kw):
        out = sweep(*args, **kw)
        if isinstance(args[3], validate._NearSums):
            rows.append(out.count())
        return out

    monkeypatch.setattr(validate.blocks, "sweep", counted)
    got = validate.silhouette(brute.points(spark, x, cluster=lab)).first()["silhouette"]
    sums = brute.dist(x) @ np.eye(600)[lab]  # ten points each
    own = sums[np.arange(6000), lab] / 9
    sums[np.arange(6000), lab] = np.inf
    other = sums.min(axis=1) / 10
    assert got == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=1e-9)
    assert rows[0] < 6000 * 8


@pytest.mark.parametrize("small_pairs", [2_000_000_000, 0])
def test_tiles_equal_broadcast(spark, monkeypatch, small_pairs):
    """Nothing fits a broadcast: blocks are dealt over tiles, pruned or not."""
    from quarry.operators import blocks

    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "SMALL_PAIRS", small_pairs)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 32)
    x, ids = SETS["plane"], list(range(400))
    got = {}
    for r in sorted(neighbours.knn(brute.points(spark, x, ids), 5).collect(), key=lambda r: (r["i"], r["rank"])):
        got.setdefault(r["i"], []).append(r["j"])
    assert got == brute.knn(x, ids, 5)
    lab = np.arange(len(x)) % 4
    df = brute.points(spark, x, cluster=lab)
    assert validate.silhouette(df).first()["silhouette"] == pytest.approx(brute.silhouette(x, lab).mean(), abs=1e-9)
    assert validate.dunn(df).first()["dunn"] == pytest.approx(brute.dunn(x, lab), abs=1e-12)
    rho = quality.distance_rank_correlation(brute.points(spark, x), brute.points(spark, x[:, :1])).first()[0]
    assert rho == pytest.approx(brute.spearman(x, x[:, :1]), abs=1e-6)


@pytest.mark.parametrize("dims", [2, 40])
def test_rows_in_parts_and_known_bounds_keep_neighbours(monkeypatch, dims):
    """Rows are worked on a few at a time; with a bound only points within it are sorted. Both give the same neighbours, ties by id."""
    from quarry.functions import kernels

    r = np.random.default_rng(12)
    x = np.vstack([r.normal(size=(150, dims)), np.floor(r.normal(size=(150, dims)))])
    x = np.vstack([x, x[140:160]])
    ids, q = np.arange(len(x)) * 3, x[::2]
    d2 = kernels.sq_dist(q, x)
    order = np.lexsort((np.broadcast_to(ids, d2.shape), d2))[:, :7]
    want, limits = np.take_along_axis(d2, order, axis=1), r.random((len(q), 3)) * dims
    counts = np.stack([(d2 < limits[:, [m]]).sum(axis=1) for m in range(3)], axis=1)
    monkeypatch.setattr(kernels, "CACHED_PAIRS", 5 * len(x))
    assert (kernels.sq_dist(q, x) == d2).all() and (kernels.count_nearer(q, limits, x, np.ones(len(x))) == counts).all()
    for bound in (want[:, -1] * (1 + 1e-12), np.full(len(q), 1e9), np.full(len(q), np.inf)):
        dist, who = kernels.nearest_within(q, x, ids, 7, bound)
        assert (dist == want).all() and (who == ids[order]).all()
    monkeypatch.setattr(kernels, "nearest", None)  # nothing but the points within a bound is looked at again
    half = want[:, 3]
    dist, who = kernels.nearest_within(q, x, ids, 7, half)
    near = np.isfinite(dist)
    assert (dist[near] == want[near]).all() and (who[near] == ids[order][near]).all() and (near[:, :4]).all() and (dist[near] <= np.repeat(half, near.sum(axis=1)) + 1e-6).all()


def test_balls_skip_most_pairs_in_many_dimensions(spark, monkeypatch):
    """Groups in 64 dimensions: most block pairs are never looked at, for neighbours, rank counts, Dunn and the spanning tree."""
    from quarry.operators import blocks

    monkeypatch.setattr(blocks, "SMALL_PAIRS", 0)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 40)
    r = np.random.default_rng(9)
    lab = np.arange(800) % 16
    x = (r.normal(size=(16, 64)) * 1.5)[lab] + r.normal(size=(800, 64)) * 0.6
    kept, links = [], blocks.pruned_links

    def counted(q, d, n_q, n_d, *rest):
        out = links(q, d, n_q, n_d, *rest)
        kept.append(out.count() / (n_q * n_d))
        return out

    monkeypatch.setattr(blocks, "pruned_links", counted)
    got = {}
    for row in sorted(neighbours.knn(brute.points(spark, x), 5).collect(), key=lambda row: (row["i"], row["rank"])):
        got.setdefault(row["i"], []).append(row["j"])
    assert got == brute.knn(x, list(range(800)), 5) and max(kept) < 0.5
    kept.clear()
    assert validate.dunn(brute.points(spark, x, cluster=lab)).first()["dunn"] == pytest.approx(brute.dunn(x, lab), abs=1e-12)
    high, low = brute.points(spark, x), brute.points(spark, x[:, :20])
    assert quality.trustworthiness(high, low).first()[0] == pytest.approx(brute.trustworthiness(x, x[:, :20], 5), abs=1e-12)
    assert sorted(kept)[len(kept) // 2] < 0.5


def test_tiles_hold_bounded_blocks(spark, monkeypatch):
    from quarry.operators import blocks

    class B:
        def __init__(self, rows, count):
            self.rows, self.count, self.dim, self.extra_width, self.df = rows, count, 127, 0, spark.range(1)

    rows, columns = blocks.tile_grid(B(10_000_000, 10_000), B(10_000_000, 10_000))
    assert 10_000_000 * 1024 / rows <= blocks.TILE_BYTES / 2 and rows == columns < 400  # each block goes to as many tiles, not to 10,000 partners
    assert np.prod(blocks.tile_grid(B(100, 3), B(100, 3))) == 9


def test_silhouette_samples_stack(spark):
    x = SETS["plane"]
    lab = np.arange(len(x)) % 3
    rows = sorted(validate.silhouette_samples(brute.points(spark, x, cluster=lab)).collect(), key=lambda r: r["y"])
    assert [r["y"] for r in rows] == list(range(len(x)))
    keys = [(r["cluster"], r["silhouette"], r["row_id"]) for r in rows]
    assert keys == sorted(keys)
    exact = brute.silhouette(x, lab)
    assert all(abs(r["silhouette"] - exact[r["row_id"]]) < 1e-9 for r in rows)


@pytest.mark.parametrize("name", SETS)
def test_linear_metrics(spark, name):
    x = SETS[name]
    lab = np.arange(len(x)) % 4
    m = validate.cluster_moments(brute.points(spark, x, cluster=lab))
    assert validate.davies_bouldin(m).first()[0] == pytest.approx(brute.davies_bouldin(x, lab), rel=1e-9)
    assert validate.calinski_harabasz(m).first()[0] == pytest.approx(brute.calinski_harabasz(x, lab), rel=1e-9)


@pytest.mark.parametrize("name", SETS)
def test_projection_quality(spark, pruning, name):
    x = SETS[name]
    high, low = brute.points(spark, x), brute.points(spark, x[:, :2])
    assert quality.trustworthiness(high, low).first()[0] == pytest.approx(brute.trustworthiness(x, x[:, :2], 5), abs=1e-12)
    assert quality.continuity(high, low).first()[0] == pytest.approx(brute.trustworthiness(x[:, :2], x, 5), abs=1e-12)
    row = quality.distance_rank_correlation(high, low).first()
    assert row["n_pairs"] == len(x) * (len(x) - 1) // 2
    assert row["spearman"] == pytest.approx(brute.spearman(x, x[:, :2]), abs=1e-7)


def test_rank_correlation_of_crowded_distances(spark):
    """One far point and a crowd: at first all distances within the crowd share a bin. Passes tell them apart, exactly if wanted."""
    r = np.random.default_rng(10)
    x = np.vstack([r.normal(size=(120, 3)) * 1e-7, [[1e6, 0, 0]]])
    high, low = brute.points(spark, x), brute.points(spark, x[:, :2] * 3 + r.normal(size=(121, 2)) * 1e-8)
    want = brute.spearman(x, np.array([r["x"] for r in sorted(low.collect(), key=lambda r: r["row_id"])]))
    rough = quality.distance_rank_correlation(high, low, passes=1).first()
    assert abs(rough["spearman"] - want) > 1e-3 and abs(rough["spearman"] - want) <= rough["error"]
    got = quality.distance_rank_correlation(high, low).first()
    assert abs(got["spearman"] - want) <= got["error"] + 1e-12 and got["error"] <= quality.RANK_ERROR
    exact = quality.distance_rank_correlation(high, low, tol=0.0).first()
    assert exact["error"] == 0 and abs(exact["spearman"] - want) < 1e-12 and exact["n_pairs"] == 121 * 60


def test_rank_correlation_by_counts_alone(spark, monkeypatch):
    """Many rows: two passes, one that counts and one for the products; crowds that counts cannot tell apart go on as before."""
    from quarry.operators import blocks

    r = np.random.default_rng(11)
    x = r.normal(size=(340, 4))
    swept, sweep = [], blocks.sweep
    monkeypatch.setattr(blocks, "sweep", lambda b, d, links, kernel, *rest: swept.append(type(kernel).__name__) or sweep(b, d, links, kernel, *rest))
    high, low = brute.points(spark, x), brute.points(spark, x[:, :2])
    got = quality.distance_rank_correlation(high, low, tol=1e-3, plain=True).first()
    assert swept == ["_PairCounts", "_RankProducts"]
    assert got["n_pairs"] == 340 * 339 // 2 and got["error"] <= 1e-3
    assert got["spearman"] == pytest.approx(brute.spearman(x, x[:, :2]), abs=1e-5)
    swept.clear()
    grid = brute.points(spark, np.floor(x))
    got = quality.distance_rank_correlation(high, grid, plain=True).first()
    assert swept[-1] == "_RankProducts" and "_PairBins" in swept
    assert got["spearman"] == pytest.approx(brute.spearman(x, np.floor(x)), abs=1e-7)
    monkeypatch.setattr(blocks, "SMALL_PAIRS", 0)
    swept.clear()
    assert quality.distance_rank_correlation(high, low, tol=1e-3).first()["n_pairs"] == 340 * 339 // 2 and swept == ["_PairCounts", "_RankProducts"]


def test_overlap(spark):
    x = SETS["wide"]
    a, b = brute.knn(x, range(len(x)), 10), brute.knn(x[:, :2], range(len(x)), 10)
    want = np.mean([len(set(a[i]) & set(b[i])) / len(set(a[i]) | set(b[i])) for i in a])
    high, low = brute.points(spark, x), brute.points(spark, x[:, :2])
    got = neighbours.mean_overlap(neighbours.knn(high, 10), neighbours.knn(low, 10)).first()[0]
    assert got == pytest.approx(want)


def test_degenerate_labels(spark):
    x = np.array([[0.0, 0], [1, 0], [5, 5], [6, 5]])
    one = brute.points(spark, x, cluster=[0, 0, 0, 0])
    assert validate.silhouette(one).first()["silhouette"] is None
    assert validate.dunn(one).first()["dunn"] is None
    assert validate.davies_bouldin(validate.cluster_moments(one)).first()[0] is None
    assert validate.calinski_harabasz(validate.cluster_moments(one)).first()[0] is None
    single = brute.points(spark, x, cluster=[0, 1, 2, 3])
    assert validate.silhouette(single).first()["silhouette"] == 0.0
    assert validate.dunn(single).first()["dunn"] is None


def test_agreement_of_published_crosstab(spark):
    # fixed values: a published 4 x 5 contingency table with its published scores
    table = [[10, 18, 15, 18, 8], [72, 6, 0, 0, 0], [57, 10, 2, 1, 1], [19, 19, 16, 10, 2]]
    rows = [(c, y) for c, line in enumerate(table) for y, n in enumerate(line) for _ in range(n)]
    got = validate.agreement(spark.createDataFrame(rows, "cluster int, y int"), "cluster", "y").first()
    assert got["n"] == 284
    assert round(got["ari"], 4) == 0.1766
    assert round(got["nmi"], 4) == 0.2192
