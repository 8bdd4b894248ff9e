import math

import numpy as np
import pytest

from quarry.llm import whiten


def brute(rows):
    """From the contract, with Python's integers and an eigensolver of the covariance."""
    kept = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, tuple(math.floor(256 * float(c)) for c in v)))
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    a = np.array([[float(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    value, vector = np.linalg.eigh(a.T @ a / n)
    return kept, n, s, value[::-1], vector[:, ::-1]


def check(spark, rows, components=4, tol=1e-9):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, component int").repartition(5)
    got = whiten.whiten(df, components).collect()
    kept, n, s, value, vector = brute(rows)
    k = min(components, int((value > 1e-12 * value[0]).sum()))
    assert len(got) == len(kept) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    z = {}
    for i, x in kept:
        dev = sum((n * c - t) ** 2 for c, t in zip(x, s))
        for c in range(k):
            own = [r for r in by[i, c + 1] if r.deviation == (dev if dev < 1 << 63 else None)]
            assert own and own[0].n == n and abs(own[0].explained - value[c] / value.sum()) <= 1e-9
            assert own[0].identity_error <= 1e-8
            z[x, c] = own[0].whitened
    for c in range(k):
        want = np.array([sum((n * a - t) / n * vector[j, c] for j, (a, t) in enumerate(zip(x, s))) / math.sqrt(value[c]) for x in sorted({x for _, x in kept})])
        have = np.array([z[x, c] for x in sorted({x for _, x in kept})])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < tol


def test_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (None, rows[4][1]), (1002, None), (1003, []), (1004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1005, [float("nan")] * 6), (1006, [float("inf")] * 6)]
    check(spark, rows)


def test_common_offset_and_scales(spark):
    """A large offset and columns of very different scale lose no digits."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * np.array([1e4, 1e2, 4.0, 2.0]) + np.array([1e10, -1e9, 1e8, 5])
    check(spark, [(i, list(map(float, v))) for i, v in enumerate(x)], tol=1e-6)


@pytest.mark.parametrize("case", ["dependent", "constant column", "fewer rows"])
def test_without_full_rank(spark, case):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    x[:, 0] *= 3
    x[:, 1] *= 2
    x = np.floor(256 * x) / 256
    if case == "dependent":
        x[:, 2:] = x[:, :2] @ np.array([[1.0, 2, 0], [1, 0, 3]])
    elif case == "constant column":
        x[:, 2:] = 7
    else:
        x = x[:3]
    check(spark, [(i, list(map(float, v))) for i, v in enumerate(x)], tol=1e-7)


def test_empty_equal_and_ragged(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    got = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 2.0]), (3, [1.0]), (4, [1.0, 2.5])], schema))
    assert {r.vec_id for r in got.collect()} == {1, 2, 4}


def test_deviation_beyond_words(spark):
    centre = whiten.Centre(3_000_000_019, [7_000_000_000_001, -5, 123456789])
    x = np.array([[2333, 0, 0], [10**9, -(10**9), 4]])
    want = [sum((centre.n * int(c) - s) ** 2 for c, s in zip(row, centre.sums)) for row in x]
    assert centre.deviation(x) == [v if v < 1 << 63 else None for v in want]


def test_shift_keeps_what_squaring_loses(spark):
    """Columns almost dependent: the covariance's own eigenvectors are wrong there, R's are not."""
    rng = np.random.default_rng(4)
    a = rng.integers(-(10**9), 10**9, 500)
    x = np.stack([a, a + rng.integers(-3, 4, 500), a - rng.integers(-3, 4, 500)], 1)
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, x array<long>")
    model = whiten.fit(rows, 3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(np.sqrt(model.values * len(x)), s, rtol=1e-6) and model.identity_error < 1e-6
