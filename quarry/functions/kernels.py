"""Numeric helpers that run inside tasks on one pair of bounded blocks at a time."""
from __future__ import annotations

import numpy as np

# Up to this many dimensions the plain sum of squared differences is as fast as a matrix product.
LOOP_DIMS = 16
# Relative slack that covers the rounding of |a|^2 + |b|^2 - 2ab.
GRAM_SLACK = 1e-11
# Pairs that are worked on at a time, so that they stay in a core's cache.
CACHED_PAIRS = 1 << 15


def sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension so that a pair always gives the same bits."""
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    rows = cached_rows(len(b))
    room = np.empty((min(rows, len(a)), len(b)))
    for lo in range(0, len(a), rows):
        part, diff = out[lo : lo + rows], room[: len(a) - lo]
        for t, column in enumerate(columns):
            np.subtract(a[lo : lo + rows, t, None], column, out=diff)
            np.multiply(diff, diff, out=diff)
            part += diff
    return out


def cached_rows(columns: int) -> int:
    """Rows that have ``CACHED_PAIRS`` pairs with so many columns."""
    return max(1, CACHED_PAIRS // max(1, columns))


def sq_dist_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-aligned version of :func:`sq_dist`, bit for bit equal to it."""
    out = np.zeros(len(a))
    for t in range(a.shape[1]):
        diff = a[:, t] - b[:, t]
        out += diff * diff
    return out


def sq_dist_gram(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by matrix product, and a bound on their absolute error per row of ``a``."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    out = na[:, None] + nb[None, :]
    out -= 2.0 * (a @ b.T)
    np.maximum(out, 0.0, out=out)
    return out, GRAM_SLACK * (na + nb.max(initial=0.0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances accurate to about 1e-9 relative, near-copies included."""
    if a.shape[1] <= LOOP_DIMS:
        return np.sqrt(sq_dist(a, b))
    d2, err = sq_dist_gram(a, b)
    r, c = np.nonzero(d2 < 1e4 * err[:, None])
    if len(r):
        d2[r, c] = sq_dist_pairs(a[r], b[c])
    return np.sqrt(d2)


def box_low(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance from each row of ``q`` to the box ``lo..hi``."""
    gap = np.maximum(np.maximum(lo - q, q - hi), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


def boxes_low_high(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest possible squared distance between two sets of boxes, all against all."""
    low = np.zeros((len(lo_a), len(lo_b)))
    high = np.zeros_like(low)
    for t in range(lo_a.shape[1]):
        gap = np.maximum(np.maximum(lo_b[None, :, t] - hi_a[:, t, None], lo_a[:, t, None] - hi_b[None, :, t]), 0.0)
        reach = np.maximum(hi_b[None, :, t] - lo_a[:, t, None], hi_a[:, t, None] - lo_b[None, :, t])
        low += gap * gap
        high += reach * reach
    return low, high


def _chebyshev(n: int) -> np.ndarray:
    return np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))


def chebyshev_nodes(centre: np.ndarray, half: float, n: int) -> np.ndarray:
    """``n`` nodes per dimension over the cube around ``centre``, as rows."""
    axes = np.meshgrid(*[c + half * _chebyshev(n) for c in centre], indexing="ij")
    return np.stack([a.ravel() for a in axes], axis=1)


def chebyshev_weights(x: np.ndarray, centre: np.ndarray, half: float, n: int) -> np.ndarray:
    """Per row of ``x`` the weights that interpolate a function from its values at :func:`chebyshev_nodes`."""
    node, degree = np.arccos(_chebyshev(n)), np.arange(1, n)
    out = np.ones((len(x), 1))
    for t in range(x.shape[1]):
        at = np.arccos(np.clip((x[:, t] - centre[t]) / half, -1.0, 1.0))
        one = (1 + 2 * np.cos(at[:, None] * degree) @ np.cos(degree[:, None] * node)) / n
        out = (out[:, :, None] * one[:, None, :]).reshape(len(x), -1)
    return out


#: Widens balls and narrows gaps between them, so that rounding never rules out a pair.
BALL_SLACK = 1e-8


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of some rows and the distance from it that all are within."""
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) * (1 + BALL_SLACK)


def balls_low_high(centre_a, radius_a, centre_b, radius_b) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`boxes_low_high` by the triangle inequality: in many dimensions boxes overlap where balls are far apart."""
    apart, reach = distances(centre_a, centre_b), radius_a[:, None] + radius_b[None, :]
    return np.maximum(apart * (1 - BALL_SLACK) - reach, 0.0) ** 2, (apart * (1 + BALL_SLACK) + reach) ** 2


def spans_low_high(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`boxes_low_high` from the smallest and largest distances to common pivots: two points are no nearer than their
    distances to a pivot differ, and no farther than these add up to."""
    low, high = np.zeros((len(lo_a), len(lo_b))), np.full((len(lo_a), len(lo_b)), np.inf)
    for t in range(lo_a.shape[1]):
        far = hi_a[:, t, None] + hi_b[None, :, t]
        gap = np.maximum(lo_b[None, :, t] - hi_a[:, t, None], lo_a[:, t, None] - hi_b[None, :, t])
        low, high = np.maximum(low, gap - far * BALL_SLACK), np.minimum(high, far * (1 + BALL_SLACK))
    return low**2, high**2


def rows_low(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance from each row of ``q`` to any row of ``x``, by the box of ``x`` or its ball."""
    low = box_low(q, x.min(axis=0), x.max(axis=0))
    if q.shape[1] <= LOOP_DIMS:
        return low
    centre, radius = ball(x)
    return np.maximum(low, balls_low_high(q, np.zeros(len(q)), centre[None, :], np.array([radius]))[0][:, 0])


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``q`` the ``k`` smallest (squared distance, id) of the block; padded with inf / -1.

    ``ids`` ascend, so a stable sort breaks ties by id.
    """
    rows = cached_rows(len(x))
    if len(q) > rows:
        parts = [nearest(q[lo : lo + rows], x, ids, k) for lo in range(0, len(q), rows)]
        return np.concatenate([d for d, _ in parts]), np.concatenate([i for _, i in parts])
    n, m = len(q), len(x)
    if m <= k or q.shape[1] <= LOOP_DIMS:
        return _smallest(sq_dist(q, x), ids, k)
    d2, err = sq_dist_gram(q, x)
    wide = min(m, k + 16)
    if wide == m:
        return _smallest(sq_dist(q, x), ids, k)
    part = np.argpartition(d2, wide, axis=1)
    cols = np.sort(part[:, :wide], axis=1)
    beyond = np.take_along_axis(d2, part[:, wide:wide + 1], axis=1)[:, 0]
    rows = np.repeat(np.arange(n), wide)
    exact = sq_dist_pairs(q[rows], x[cols.ravel()]).reshape(n, wide)
    order = np.argsort(exact, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(exact, order, axis=1)
    who = ids[np.take_along_axis(cols, order, axis=1)]
    unsure = np.nonzero(beyond - err <= dist[:, -1])[0]
    if len(unsure):
        dist[unsure], who[unsure] = _smallest(sq_dist(q[unsure], x), ids, k)
    return dist, who


def nearest_within(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest`, without points whose squared distance is beyond a row's ``bound``: where that leaves few points, only these
    are sorted."""
    if not np.isfinite(bound).all():
        return nearest(q, x, ids, k)
    rows = cached_rows(len(x))
    dist, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, dtype=np.int64)
    for lo in range(0, len(q), rows):
        part = slice(lo, lo + rows)
        plain = q.shape[1] <= LOOP_DIMS
        d2, err = (sq_dist(q[part], x), 0.0) if plain else sq_dist_gram(q[part], x)
        r, c = np.nonzero(d2 <= (bound[part] + err)[:, None])
        if len(r) > 4 * k * len(d2):
            dist[part], who[part] = nearest(q[part], x, ids, k)
            continue
        exact = d2[r, c] if plain else sq_dist_pairs(q[part][r], x[c])
        order = np.lexsort((exact, r))  # stable: equal distances stay in the order of the ids
        r, at = r[order], np.arange(len(r)) - np.searchsorted(r[order], r[order])
        keep = at < k
        dist[lo + r[keep], at[keep]], who[lo + r[keep], at[keep]] = exact[order][keep], ids[c[order][keep]]
    return dist, who


def _smallest(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = d2.shape
    if m <= k:
        order = np.argsort(d2, axis=1, kind="stable")
        dist = np.full((n, k), np.inf)
        who = np.full((n, k), -1, dtype=np.int64)
        dist[:, :m] = np.take_along_axis(d2, order, axis=1)
        who[:, :m] = ids[order]
        return dist, who
    part = np.sort(np.argpartition(d2, k - 1, axis=1)[:, :k], axis=1)
    near = np.take_along_axis(d2, part, axis=1)
    kth = near.max(axis=1)
    tied = np.nonzero((d2 <= kth[:, None]).sum(axis=1) > k)[0]
    if len(tied):
        part[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :k]
        near[tied] = np.take_along_axis(d2[tied], part[tied], axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1), ids[np.take_along_axis(part, order, axis=1)]


def merge_nearest(da, ia, db, ib) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise merge of two (distance, id) lists, keeping the width of the first."""
    k = da.shape[1]
    d, i = np.concatenate([da, db], axis=1), np.concatenate([ia, ib], axis=1)
    order = np.lexsort((i, d), axis=-1)[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(i, order, axis=1)


def count_nearer(q: np.ndarray, limits: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per row of ``q`` and limit: the weight of block points with squared distance strictly below it."""
    rows = cached_rows(len(x))
    if len(q) > rows:
        return np.concatenate([count_nearer(q[lo : lo + rows], limits[lo : lo + rows], x, w) for lo in range(0, len(q), rows)])
    out = np.zeros(limits.shape)
    if q.shape[1] <= LOOP_DIMS:
        d2 = sq_dist(q, x)
        for m in range(limits.shape[1]):
            out[:, m] = (d2 < limits[:, m, None]) @ w
        return out
    d2, err = sq_dist_gram(q, x)
    for m in range(limits.shape[1]):
        sure, close = d2 < (limits[:, m] - err)[:, None], d2 <= (limits[:, m] + err)[:, None]
        out[:, m] = sure @ w
        rows = np.flatnonzero(np.count_nonzero(close, axis=1) > np.count_nonzero(sure, axis=1))  # few rows have a pair to settle
        if len(rows):
            r, c = np.nonzero(close[rows] & ~sure[rows])
            r = rows[r]
            hit = sq_dist_pairs(q[r], x[c]) < limits[r, m]
            np.add.at(out[:, m], r[hit], w[c[hit]])
    return out


def tree_edges(w: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of all minimum spanning forests of a few points from their matrix of weights, infinity where there is no edge: ``(a, b)``,
    the points in the order in which the nearest one is reached next, and the weight of each such step (-inf for the first).

    In this order the heaviest step between two points is what it takes to get from one to the other; an edge of that
    weight is in some forest."""
    n = len(w)
    order, steps, gone, need = np.zeros(n, dtype=np.int64), np.full(n, -np.inf), np.zeros(n), np.full(n, -np.inf)
    a, b, v, near = [], [], first, np.full(n, np.inf)
    for t in range(n):
        if t:
            v = int(np.argmin(near))
            steps[t] = near[v]
            if not np.isfinite(steps[t]):
                v = int(np.argmin(gone))
            np.maximum(need[:t], steps[t], out=need[:t])
            if np.isfinite(steps[t]):
                hit = order[:t][w[v, order[:t]] <= need[:t]]
                hit = hit[np.isfinite(w[v, hit])]
                a.append(np.full(len(hit), v))
                b.append(hit)
        order[t], gone[v] = v, np.inf
        near = np.maximum(np.minimum(near, w[v]), gone)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), order, steps
    return np.concatenate(a), np.concatenate(b), order, steps


def range_max(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest of ``h[lo:hi]`` for many ranges, -inf for empty ones. Holds one table of maxima at a time."""
    out, level, t = np.full(len(lo), -np.inf), np.frexp((hi - lo).astype(float))[1] - 1, h
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(t[lo[at]], t[hi[at] - (1 << k)])
        t = np.maximum(t[: -(1 << k)], t[1 << k :])
    return out


class SplitTree:
    """A complete binary space partition learned from a bounded sample; used only to place rows in cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.cut = np.full((1 << depth) - 1, np.inf)
        parts = [sample]
        for level in range(depth):
            nxt = []
            for at, part in enumerate(parts):
                node = (1 << level) - 1 + at
                if len(part) > 1:
                    spread = part.max(axis=0) - part.min(axis=0)
                    d = int(np.argmax(spread))
                    if spread[d] > 0:
                        mid = float(np.median(part[:, d]))
                        if mid >= part[:, d].max():
                            mid = float(part[part[:, d] < mid, d].max())
                        self.dim[node], self.cut[node] = d, mid
                right = part[:, self.dim[node]] > self.cut[node] if len(part) else np.zeros(0, dtype=bool)
                nxt += [part[~right], part[right]]
            parts = nxt

    def place(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dim[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


class PivotCells:
    """Cells around pivots that a bounded sample gives, for many dimensions, where cutting along axes tears groups apart. Pivots are
    drawn one by one with odds that grow with the squared distance to those before."""

    ROWS = 20_000

    def __init__(self, sample: np.ndarray, cells: int):
        sample = sample[:: max(1, len(sample) // self.ROWS)]
        rng, gap, chosen = np.random.default_rng(0), np.ones(len(sample)), []
        for _ in range(min(cells, len(sample))):
            if gap.sum() <= 0:
                break
            chosen.append(sample[int(rng.choice(len(sample), p=gap / gap.sum()))])
            from_last = ((sample - chosen[-1]) ** 2).sum(axis=1)
            gap = from_last if len(chosen) == 1 else np.minimum(gap, from_last)
        self.pivots = np.array(chosen).reshape(-1, sample.shape[1])

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.pivots**2).sum(axis=1)[None, :] - 2 * x @ self.pivots.T, axis=1)
