"""What keeps large tables within time and memory gives the same results."""
import numpy as np
import pytest

import brute
from quarry.operators import blocks, density, neighbours, validate


@pytest.mark.parametrize("dim", [1, 2])
def test_smooth_silhouette_equals_brute_force(spark, monkeypatch, dim):
    """Far blocks by nodes, near ones point by point; copies carry weight, far rows and several labelings."""
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(500, dim)), r.normal(size=(400, dim)) + 40, np.full((30, dim), 7.0), r.normal(size=(20, dim)) * 500])
    lab, many = (x[:, 0] > 20).astype(int), np.floor(x[:, 0] / 3).astype(int) % 9
    monkeypatch.setattr(blocks, "SMALL_PAIRS", 0)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 32)
    used = []
    real = blocks.sweep
    monkeypatch.setattr(blocks, "sweep", lambda *a, **k: (used.append(type(a[3]).__name__), real(*a, **k))[1])
    df = brute.points(spark, x, cluster=lab, other=many)
    got = {q["model"]: q["silhouette"] for q in validate.silhouette(df, ["cluster", "other"]).collect()}
    assert used == ["_SmoothSums"]
    assert got["cluster"] == pytest.approx(brute.silhouette(x, lab).mean(), abs=1e-10)
    assert got["other"] == pytest.approx(brute.silhouette(x, many).mean(), abs=1e-10)


def test_nodes_of_separated_boxes():
    """At the distance from which boxes count as apart, the error stays far below the digits that are kept."""
    r, n = np.random.default_rng(0), validate.NODES
    from quarry.functions.kernels import chebyshev_nodes, chebyshev_weights, distances

    for turn in np.linspace(0, np.pi / 4, 5):
        off = np.array([np.cos(turn), np.sin(turn)]) * (2 * np.sqrt(2) + validate.APART)
        off = np.array([2 + validate.APART, 0.0]) if turn == 0 else off
        x, y = r.uniform(-1, 1, (200, 2)), r.uniform(-1, 1, (200, 2)) + off
        mid = distances(chebyshev_nodes(np.zeros(2), 1.0, n), chebyshev_nodes(off, 1.0, n))
        found = chebyshev_weights(x, np.zeros(2), 1.0, n) @ mid @ chebyshev_weights(y, off, 1.0, n).T
        assert np.abs(found / distances(x, y) - 1).max() < 1e-10


@pytest.mark.parametrize("dim", [2, 20])
def test_extremes_look_at_few_pairs(spark, monkeypatch, dim):
    """All labelings share the distances of the sets of labels that can hold an extreme one."""
    r = np.random.default_rng(5)
    x = r.normal(size=(900, dim))
    labels = {f"k{k}": (np.floor((x[:, 0] + 4) * k / 4)).astype(int) for k in (2, 5, 9)}
    monkeypatch.setattr(blocks, "SMALL_PAIRS", 0)
    got = {q["model"]: q["dunn"] for q in validate.dunn(brute.points(spark, x, **labels), list(labels)).collect()}
    for name, lab in labels.items():
        assert got[name] == pytest.approx(brute.dunn(x, lab), rel=1e-12)


def test_extremes_skip_pairs_that_cannot_matter(monkeypatch):
    """A block pair that cannot beat what is known computes no distance."""
    r = np.random.default_rng(1)
    make = lambda x, c: blocks.Block({"x": x.ravel(), "bid": 0, "ids": np.arange(len(x)), "cluster": np.full(len(x), c)}, 2)
    q, d = make(r.uniform(size=(50, 2)), 1), make(r.uniform(size=(50, 2)) + 3, 2)
    kernel = validate._Extremes(["cluster"], (np.array([100.0]), np.array([0.01])))
    monkeypatch.setattr(validate, "sq_dist", lambda *a: pytest.fail("looked at"))
    kernel.feed(kernel.start(q), q, d)


def test_blocks_stay_small(spark, monkeypatch):
    """The distances of two blocks, not only their rows, bound the memory of a task."""
    monkeypatch.setattr(blocks, "parallelism", lambda s: 1)
    x = np.random.default_rng(2).normal(size=(9000, 2))
    df = brute.points(spark, x)
    assert max(r["n"] for r in blocks.build(df, "row_id", "x", spatial=True).df.collect()) <= 1100
    assert max(r["n"] for r in blocks.build(df, "row_id", "x", spatial=True, near=True).df.collect()) <= 600


@pytest.mark.parametrize("max_eps", [np.inf, 0.3])
def test_walk_needs_few_neighbours(spark, max_eps):
    """Neighbours at or above the core distance of the point they let in are left to the trees."""
    x = np.random.default_rng(4).normal(size=(90, 2))
    pts = brute.points(spark, x).select("row_id", "x")
    near = neighbours.knn(pts, 4)
    steps, core = density.step_edges(pts, near, 5, max_eps)
    cores = {r["row_id"]: r["core"] for r in core.collect()}
    tree = {(r["i"], r["j"]) for r in density.spanning_edges(core.filter("core is not null"), max_eps).collect()}
    other = [r for r in steps.filter("q is not null").collect() if (min(r["q"], r["v"]), max(r["q"], r["v"])) not in tree]
    assert all(cores[r["v"]] is None or r["w"] < cores[r["v"]] for r in other)
    walk = density.reachability(pts, 5, max_eps=max_eps).orderBy("pos").collect()
    lists = density.reachability(pts, 5, max_eps=max_eps, walk_edges=0).orderBy("pos").collect()
    assert walk == lists
    if max_eps == np.inf:
        order, reach, *_ = brute.optics_walk(x, 5)
        assert [r["row_id"] for r in walk] == list(order)


def test_extremes_of_blocks_with_missing_coordinates():
    """They are compared as wholes: a missing coordinate leaves the gaps of its block out and never becomes an extreme itself."""
    r = np.random.default_rng(6)
    make = lambda x: blocks.Block({"x": x.ravel(), "bid": 0, "ids": np.arange(len(x)), "cluster": np.arange(len(x)) % 3}, 2)
    x, y = r.normal(size=(40, 2)), r.normal(size=(40, 2))
    y[5] = np.nan
    kernel = validate._Extremes(["cluster"])
    widest, closest = kernel.feed(kernel.start(make(x)), make(x), make(y))
    assert np.isinf(closest[0]) and not np.isnan(widest[0])
    widest, closest = kernel.feed((widest, closest), make(x), make(x[::-1]))
    assert np.isfinite(closest[0]) and widest[0] > 0


def test_no_more_rows_are_fetched_than_pivots_are_drawn_from(spark, monkeypatch):
    seen = []

    class Spy(blocks.PivotCells):
        ROWS = 100

        def __init__(self, sample, cells):
            seen.append(len(sample))
            super().__init__(sample, cells)

    monkeypatch.setattr("quarry.operators.blocks.PivotCells", Spy)
    x = np.random.default_rng(1).normal(size=(2000, 20))
    b = blocks.build(brute.points(spark, x), spatial=True, block_rows=100)
    assert 0 < seen[0] < 200
    assert b.df.selectExpr("sum(n)").first()[0] == 2000


@pytest.mark.parametrize("wide", ["query", "data"])
def test_blocks_apart_for_the_smaller_one_do_not_meet_point_by_point(monkeypatch, wide):
    """A block of far rows has a wide box that is near to all others; the nodes of the small one stand for its points."""
    r = np.random.default_rng(9)
    make = lambda x, c: blocks.Block({"x": x.ravel(), "bid": 0, "ids": np.arange(len(x)), "w": r.integers(1, 3, len(x)), "cluster": c, "other": c // 2}, 2)
    big, small = make(r.normal(size=(300, 2)) * 50, r.integers(0, 3, 300)), make(r.uniform(size=(200, 2)) + [400, 0], r.integers(0, 4, 200))
    q, d = (big, small) if wide == "query" else (small, big)
    met, real = [], validate.distances
    monkeypatch.setattr(validate, "distances", lambda a, b: (met.append(len(a) * len(b)), real(a, b))[1])
    kernel = validate._SmoothSums([np.arange(4), np.arange(2)], ["cluster", "other"])
    batch = kernel.finish(kernel.feed(kernel.start(q), q, d), q)
    assert sum(met) == validate.NODES**2 * len(big.ids)  # and not one for each pair of points
    want = brute.dist(np.vstack([q.x, d.x]))[: len(q.x), len(q.x) :]
    want = np.stack([(want * d.w)[:, lab == v].sum(axis=1) for lab, n in ((d.cluster, 4), (d.other, 2)) for v in range(n)], axis=1)
    assert np.abs(np.array(batch.column("s").to_pylist()) / np.maximum(want, 1e-9) - 1)[want > 0].max() < 1e-10


def test_ranks_list_pairs_only_where_rounding_matters(monkeypatch):
    """In many dimensions most blocks hold no point at a limit: counts settle them. Where one does, ties are not nearer."""
    from quarry.functions.kernels import count_nearer, sq_dist

    r = np.random.default_rng(4)
    q, x, w = r.normal(size=(70, 30)), r.normal(size=(90, 30)), r.integers(1, 4, 90).astype(float)
    d2 = sq_dist(q, x)
    at = np.sort(d2, axis=1)[:, [3, 20, 60]]
    limits = at * (1 + 1e-6)
    want = np.stack([(d2 < limits[:, m, None]) @ w for m in range(3)], axis=1)
    listed = np.nonzero
    with monkeypatch.context() as m:
        m.setattr(np, "nonzero", lambda a: listed(a) if a.ndim == 1 else pytest.fail("pairs were listed"))
        assert (count_nearer(q, limits, x, w) == want).all()
    assert (count_nearer(q, at, x, w) == np.stack([(d2 < at[:, m, None]) @ w for m in range(3)], axis=1)).all()
