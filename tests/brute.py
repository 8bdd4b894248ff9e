"""Plain NumPy versions of the pairwise operators, for small fixtures."""
import numpy as np


def dist(x):
    return np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))


def knn(x, ids, k):
    d = ((x[:, None, :] - x[None]) ** 2).sum(-1)
    out = {}
    for a in range(len(x)):
        near = sorted((d[a, b], ids[b]) for b in range(len(x)) if b != a)
        out[ids[a]] = [j for _, j in near[:k]]
    return out


def silhouette(x, lab):
    d, out = dist(x), []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


def dunn(x, lab):
    d = dist(x)
    same = lab[:, None] == lab[None]
    return d[~same].min() / d[same].max()


def davies_bouldin(x, lab):
    cs = sorted(set(lab))
    cen = np.array([x[lab == c].mean(0) for c in cs])
    s = np.array([np.sqrt(((x[lab == c] - cen[i]) ** 2).sum(1)).mean() for i, c in enumerate(cs)])
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(cen[i] - cen[j]) for j in range(len(cs)) if j != i) for i in range(len(cs))])


def calinski_harabasz(x, lab):
    cs, g = sorted(set(lab)), x.mean(0)
    b = sum((lab == c).sum() * ((x[lab == c].mean(0) - g) ** 2).sum() for c in cs)
    w = sum(((x[lab == c] - x[lab == c].mean(0)) ** 2).sum() for c in cs)
    return b / (len(cs) - 1) / (w / (len(x) - len(cs)))


def average_rank(v):
    order = np.argsort(v, kind="stable")
    _, start, n = np.unique(v[order], return_index=True, return_counts=True)
    r = np.empty(len(v))
    r[order] = np.repeat(start + (n + 1) / 2, n)
    return r


def spearman(h, low):
    i, j = np.triu_indices(len(h), 1)
    return np.corrcoef(average_rank(dist(h)[i, j]), average_rank(dist(low)[i, j]))[0, 1]


def trustworthiness(h, low, k):
    n, dh, dl = len(h), ((h[:, None] - h[None]) ** 2).sum(-1), ((low[:, None] - low[None]) ** 2).sum(-1)
    bad = 0
    for i in range(n):
        near = sorted((dl[i, b], b) for b in range(n) if b != i)[:k]
        for _, j in near:
            rank = 1 + sum(dh[i, m] < dh[i, j] for m in range(n) if m != i)
            bad += max(0, rank - k)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * bad


def points(spark, x, ids=None, **cols):
    ids = range(len(x)) if ids is None else ids
    names = list(cols)
    rows = [(int(i), [float(v) for v in row], *[int(cols[c][a]) for c in names]) for a, (i, row) in enumerate(zip(ids, x))]
    return spark.createDataFrame(rows, ", ".join(["row_id long", "x array<double>", *[f"{c} int" for c in names]]))


def optics_walk(x, min_samples, max_eps=np.inf):
    """Order, reachability, predecessor of the sequential walk (lowest index on ties); core is infinite beyond the radius."""
    n, d = len(x), dist(x)
    core = np.sort(d, axis=1)[:, min_samples - 1] if n >= min_samples else np.full(n, np.inf)
    core = np.where(core <= max_eps, core, np.inf)
    reach, pred, todo, order = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool), []
    for _ in range(n):
        left = np.nonzero(todo)[0]
        p = left[np.argmin(reach[left])]
        todo[p] = False
        order.append(int(p))
        w = np.maximum(core[p], d[p])
        up = todo & (w < reach) & (d[p] <= max_eps)
        reach[up], pred[up] = w[up], p
    return np.array(order), reach, pred, core


def _region(steep, against, start, min_samples):
    end, other = start, 0
    for i in range(start, len(steep)):
        if steep[i]:
            end, other = i, 0
        elif against[i]:
            break
        else:
            other += 1
            if other > min_samples:
                break
    return end


def xi_labels(order, reach, pred, min_samples, xi):
    """Labels by one sequential scan of the whole plot."""
    r = np.append(reach[order], np.inf)
    n, keep = len(order), 1 - xi
    with np.errstate(invalid="ignore", divide="ignore"):
        q = r[:-1] / r[1:]
    up, down, rise, fall = q <= keep, q >= 1 / keep, q < 1, q > 1
    where = {int(v): i for i, v in enumerate(order)}
    pp = [where.get(int(pred[v]), -1) for v in order]
    open_down, clusters, index, mib = [], [], 0, 0.0
    for at in np.nonzero(up | down)[0]:
        if at < index:
            continue
        mib = max(mib, r[index:at + 1].max())
        open_down = [] if np.isinf(mib) else [dict(a, mib=max(a["mib"], mib)) for a in open_down if mib <= r[a["s"]] * keep]
        if down[at]:
            e = _region(down, rise, at, min_samples)
            open_down.append({"s": int(at), "e": e, "mib": 0.0})
            index = e + 1
        else:
            e = _region(up, fall, at, min_samples)
            index = e + 1
            new = []
            for a in open_down:
                s, t, top = a["s"], e, r[a["s"]]
                if r[t + 1] * keep < a["mib"]:
                    continue
                if top * keep >= r[t + 1]:
                    while r[s + 1] > r[t + 1] and s < a["e"]:
                        s += 1
                elif r[t + 1] * keep >= top:
                    while r[t - 1] > top and t > at:
                        t -= 1
                while s < t and not (r[s] > r[t] or s <= pp[t] < t):
                    t -= 1
                if s >= t or t - s + 1 < min_samples or s > a["e"] or t < at:
                    continue
                new.append((s, t))
            clusters += new[::-1]
        mib = r[index]
    lab, c = np.full(n, -1), 0
    for s, t in clusters:
        if (lab[s:t + 1] == -1).all():
            lab[s:t + 1] = c
            c += 1
    out = np.empty(n, int)
    out[order] = lab
    return out
