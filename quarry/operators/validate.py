"""Cluster validation. A label of -1 is noise: drop it first with ``reshape.without_noise``."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.kernels import LOOP_DIMS, box_low, boxes_low_high, cached_rows, chebyshev_nodes, chebyshev_weights, distances, sq_dist, sq_dist_gram, sq_dist_pairs
from quarry.functions.ranking import global_position
from quarry.operators import blocks, neighbours
from quarry.operators.blocks import Block, Kernel, columns_batch, list_array
from quarry.session import cut


#: Centres are broadcast up to this size.
CENTRE_BYTES = 16 << 20
#: Clusters whose partners one task looks for.
CLUSTERS_PER_TASK = 512
#: Clusters of all labelings together up to which silhouettes take one sum for every point and cluster.
DENSE_WIDTH = 256
#: Chebyshev nodes per dimension, and by how many halves of the larger box's side two boxes are apart, for smooth sums.
NODES, APART = 12, 3.0
#: Dimensions up to which sums of distances are smoothed.
SMOOTH_DIMS = 2

# ---------------------------------------------------------------- metrics linear in the rows


def vector_mean(vec: str, dim: int) -> Column:
    return F.array(*[F.avg(F.col(vec)[t]) for t in range(dim)])


def sq_gap(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance of two array columns."""
    parts = F.zip_with(a, b, lambda u, v: (u - v) * (u - v))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def cluster_moments(df: DataFrame, label: str = "cluster", vec: str = "x", by: Sequence[str] = (), dim: int | None = None) -> DataFrame:
    """``(by..., label, n, centre, mean_dist, sum_sq)``: two aggregates with map-side combining. Rows without a label are left
    out. The vectors stay where they are as long as the centres are certain to fit a broadcast; else both sides are joined."""
    df = df.filter(F.col(label).isNotNull())
    dim = dim or df.select(F.max(F.size(vec))).first()[0] or 0
    keys = [*by, label]
    centres = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), vector_mean(vec, dim).alias("centre")))
    few = centres.count() * max(1, dim) * 8 <= CENTRE_BYTES
    gap = df.join(F.broadcast(centres) if few else centres, keys).select(*keys, sq_gap(vec, "centre").alias("d2"))
    spread = gap.groupBy(*keys).agg(F.avg(F.sqrt("d2")).alias("mean_dist"), F.sum("d2").alias("sum_sq"))
    return centres.join(spread, keys)


def davies_bouldin(moments: DataFrame, by: Sequence[str] = (), label: str = "cluster") -> DataFrame:
    """``(by..., davies_bouldin)`` from :func:`cluster_moments`; NULL with fewer than two clusters.

    Each cluster looks for its worst partner. The clusters are dealt over tasks, each of which sees all centres of its models,
    so that models with very many clusters are not the work of one task.
    """
    keys = list(by) or ["_all"]
    m = cut((moments if by else moments.withColumn("_all", F.lit(0))).select(*keys, F.col(label).alias("_a"), F.col("mean_dist").alias("_s"), F.col("centre").alias("_c")))
    parts = max(1, -(-m.count() // CLUSTERS_PER_TASK))
    own = m.withColumn("_part", F.pmod(F.xxhash64("_a"), F.lit(parts)).cast("int"))
    other = m.select(*keys, F.col("_a").alias("_b"), F.col("_s").alias("_s2"), F.col("_c").alias("_c2"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    gap = F.sqrt(sq_gap("_c", "_c2"))
    met = own.join(other, [*keys, "_part"]).where(F.col("_a") != F.col("_b")).select(*keys, "_a", (F.col("_s") + F.col("_s2")).alias("_sum"), gap.alias("_gap"))
    worst = met.groupBy(*keys, "_a").agg(F.max(F.when(F.col("_gap") > 0, F.col("_sum") / F.col("_gap")).otherwise(0.0)).alias("_worst"))
    mean = worst.groupBy(*keys).agg(F.avg("_worst").alias("davies_bouldin"))
    return m.select(*keys).distinct().join(mean, keys, "left").select(*by, "davies_bouldin")


def calinski_harabasz(moments: DataFrame, by: Sequence[str] = (), dim: int | None = None) -> DataFrame:
    """``(by..., calinski_harabasz)``: between- over within-cluster variance; NULL with fewer than two clusters."""
    dim = dim or moments.select(F.max(F.size("centre"))).first()[0] or 0
    keys = list(by) or ["_all"]
    moments = moments if by else moments.withColumn("_all", F.lit(0))
    mean = F.array(*[F.sum(F.col("n") * F.col("centre")[t]) / F.sum("n") for t in range(dim)]).alias("mean")
    one = moments.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("sum_sq").alias("w"), mean)
    # Distances to the overall mean, not a difference of two large sums, so that an offset of the data costs no digits.
    apart = moments.select(*keys, F.col("n").alias("_n"), "centre").join(one.select(*keys, "mean"), keys)
    between = apart.groupBy(*keys).agg(F.sum(F.col("_n") * sq_gap("centre", "mean")).alias("between"))
    value = F.when(F.col("w") > 0, (F.col("between") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).otherwise(1.0)
    return one.join(between, keys).select(*by, F.when(F.col("k") >= 2, value).alias("calinski_harabasz"))


def inertia(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return moments.groupBy(*by).agg(F.sum("sum_sq").alias("inertia"))


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, ari, nmi)`` of two labelings, from one grouping-sets aggregate of their joint counts."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    keys = list(by)
    sets = [[*keys, "_a", "_b"], [*keys, "_a"], [*keys, "_b"], keys]
    sets = [[F.col(c) for c in s] for s in sets]
    counted = cells.groupingSets(sets, *[F.col(c) for c in [*keys, "_a", "_b"]]).agg(
        F.sum("c").cast("double").alias("c"), F.grouping("_a").alias("ga"), F.grouping("_b").alias("gb")
    )
    pick = lambda ga, gb, e: F.sum(F.when((F.col("ga") == ga) & (F.col("gb") == gb), e))
    pairs = F.col("c") * (F.col("c") - 1) / 2
    ent = F.col("c") * F.log("c")
    m = counted.groupBy(*keys).agg(
        pick(0, 0, pairs).alias("s"), pick(0, 1, pairs).alias("pa"), pick(1, 0, pairs).alias("pb"), pick(1, 1, pairs).alias("t"),
        pick(0, 0, ent).alias("eab"), pick(0, 1, ent).alias("ea"), pick(1, 0, ent).alias("eb"), pick(1, 1, F.col("c")).alias("n"),
        pick(0, 1, F.lit(1)).alias("ka"), pick(1, 0, F.lit(1)).alias("kb"),
    )
    expected = F.col("pa") * F.col("pb") / F.col("t")
    mid = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(mid == expected, 1.0).otherwise((F.col("s") - expected) / (mid - expected))
    ha, hb, hab = (F.log("n") - F.col(c) / F.col("n") for c in ("ea", "eb", "eab"))
    mi = F.greatest(ha + hb - hab, F.lit(0.0))
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(0.0)
    return m.select(*keys, F.col("n").cast("bigint").alias("n"), F.when(F.col("n") > 1, ari).otherwise(1.0).alias("ari"), nmi.alias("nmi"))


# ---------------------------------------------------------------- silhouette


class _ClusterSums(Kernel):
    """Per query point and cluster of every labeling: the weighted sum of distances to its points."""

    schema = "id bigint, s array<double>"

    def __init__(self, levels: list[np.ndarray], label_cols: Sequence[str]):
        self.levels, self.label_cols = levels, list(label_cols)
        self.width = sum(len(v) for v in levels)

    def start(self, q: Block):
        return np.zeros((len(q.ids), self.width))

    def member(self, d: Block) -> np.ndarray:
        member = np.zeros((len(d.ids), self.width))
        rows, at = np.arange(len(d.ids)), 0
        for levels, col in zip(self.levels, self.label_cols):
            member[rows, at + np.searchsorted(levels, getattr(d, col))] = d.w
            at += len(levels)
        return member

    def feed(self, state, q: Block, d: Block):
        state += distances(q.x, d.x) @ self.member(d)
        return state

    def finish(self, state, q: Block):
        return columns_batch(id=q.ids, s=list_array(state))


class _SmoothSums(_ClusterSums):
    """The same sums in one or two dimensions. Between two blocks that are far apart for their size the distance is a smooth function
    of both ends: it is taken between the Chebyshev nodes of their boxes, with an error of about 1e-11 of the distance. Where they are
    far apart for the smaller one only, its nodes meet the points of the other. Every point counts, near blocks point by point."""

    def start(self, q: Block):
        return np.zeros((len(q.ids), self.width)), np.zeros((NODES ** q.x.shape[1], self.width))

    def _grid(self, b: Block):
        if not hasattr(b, "_nodes"):
            b.lo, b.hi = b.x.min(axis=0), b.x.max(axis=0)
            b.half = max(float((b.hi - b.lo).max()) / 2, 1e-300)
            b._nodes = chebyshev_nodes((b.lo + b.hi) / 2, b.half, NODES)
        return b

    def _source(self, d: Block):
        """Rows in the order of their labels, where each set of labels begins, and what the nodes weigh."""
        if not hasattr(d, "_first"):
            self._grid(d)
            order = np.lexsort([getattr(d, c) for c in self.label_cols])
            labels = np.stack([getattr(d, c)[order] for c in self.label_cols])
            d._first = np.flatnonzero(np.append(True, (labels[:, 1:] != labels[:, :-1]).any(axis=0)))
            member = self.member(d)[order]
            d.sorted_x, d.sorted_w, d.kinds = d.x[order], d.w[order], (member[d._first] > 0).astype(float)
            d.at = np.flatnonzero(d.kinds.any(axis=0))
            d.mass = chebyshev_weights(d.x[order], (d.lo + d.hi) / 2, d.half, NODES).T @ member[:, d.at]
        return d

    def feed(self, state, q: Block, d: Block):
        near, smooth = state
        self._grid(q), self._source(d)
        gap = np.maximum(np.maximum(d.lo - q.hi, q.lo - d.hi), 0.0)
        apart = np.sqrt((gap * gap).sum())
        if apart >= APART * max(q.half, d.half):
            smooth[:, d.at] += distances(q._nodes, d._nodes) @ d.mass
        elif apart >= APART * d.half:
            near[:, d.at] += distances(q.x, d._nodes) @ d.mass
        elif apart >= APART * q.half:
            smooth += self._by_points(q._nodes, d)
        else:
            near += self._by_points(q.x, d)
        return near, smooth

    def _by_points(self, x: np.ndarray, d: Block) -> np.ndarray:
        """Sums of distances from some places to the points of a block, as few places at a time as stay in a core's cache."""
        out, rows = np.empty((len(x), len(d._first))), cached_rows(len(d.sorted_x))
        for lo in range(0, len(x), rows):
            dist = distances(x[lo : lo + rows], d.sorted_x)
            dist *= d.sorted_w
            np.add.reduceat(dist, d._first, axis=1, out=out[lo : lo + rows])
        return out @ d.kinds

    def finish(self, state, q: Block):
        near, smooth = state
        self._grid(q)
        return super().finish(near + chebyshev_weights(q.x, (q.lo + q.hi) / 2, q.half, NODES) @ smooth, q)


class _NearSums(Kernel):
    """Per query point the weighted sum of distances to its own cluster and to each that can be the nearest other one. Data blocks
    lie by the centres of their clusters (``x``), their points are ``p``."""

    schema = "id bigint, c bigint, own boolean, n bigint, s double"

    def start(self, q: Block):
        return []

    def feed(self, state, q: Block, d: Block):
        order = np.argsort(d.c, kind="stable")
        c, first = np.unique(d.c[order], return_index=True)
        own = q.c[:, None] == c[None, :]
        # The mean distance to a cluster is never below the distance to its centre.
        wanted = own | (distances(q.x, d.x[order[first]]) <= q.most[:, None] * (1 + 1e-9))
        clusters = np.flatnonzero(wanted.any(axis=0))
        sizes = np.diff(np.append(first, len(order)))
        for t in clusters.tolist():
            rows, members = np.flatnonzero(wanted[:, t]), order[first[t] : first[t] + sizes[t]]
            sums = distances(q.x[rows], d.p[members]) @ d.w[members]
            state.append((q.ids[rows], np.full(len(rows), c[t]), own[rows, t], np.full(len(rows), d.size[members[0]]), sums))
        return state

    def finish(self, state, q: Block):
        if not state:
            return None
        i, c, own, n, s = (np.concatenate(v) for v in zip(*state))
        order = np.lexsort((c, i))  # a cluster may lie in several blocks
        i, c, own, n, s = i[order], c[order], own[order], n[order], s[order]
        first = np.flatnonzero(np.append(True, (np.diff(i) != 0) | (np.diff(c) != 0)))
        return columns_batch(id=i[first], c=c[first], own=own[first], n=n[first], s=np.add.reduceat(s, first))


def _near_silhouettes(df: DataFrame, groups: DataFrame, label: str) -> DataFrame:
    """``(id, value)`` of one labeling with any number of clusters. The nearest other centre bounds a point's mean distance to its
    nearest other cluster from above; only clusters whose centre is within the bound are measured."""
    spark = df.sparkSession
    cluster = F.col(label).cast("bigint").alias("c")
    points = groups.select("id", "x", cluster, "w")
    moments = cluster_moments(df.select(cluster, F.col("x")), "c", "x")
    facts = cut(moments.select("c", "n", "centre", (F.col("sum_sq") / F.col("n")).alias("v")))
    if facts.count() < 2:
        return groups.select("id", F.lit(None).cast("double").alias("value"))
    near = neighbours.nearest_lists(blocks.build(points, "id", "x", stable=True), blocks.build(facts, "c", "centre", stable=True), 2)
    bound = near.select("id", F.explode("near").alias("e")).select("id", F.col("e.j").alias("c2"), "e.d2")
    bound = bound.join(facts.select(F.col("c").alias("c2"), "v"), "c2").join(points.select("id", "c"), "id").where("c <> c2")
    # ... and never above the root mean square of the distances, which the centre gives too.
    points = cut(points.join(bound.groupBy("id").agg(F.min(F.sqrt(F.col("d2") + F.col("v"))).alias("most")), "id"))
    q = blocks.build(points, "id", "x", ["c", "most"], stable=True)
    d = blocks.build(cut(points.join(facts, "c").select("id", "centre", F.col("x").alias("p"), "c", "w", F.col("n").alias("size"))), "id", "centre", ["p", "c", "w", "size"], stable=True)
    if q.small:
        links = blocks.all_links(spark, q.count, d.count)
    else:
        ends = ["c_lo", "c_hi"]
        span = [F.array_min("c").alias("c_lo"), F.array_max("c").alias("c_hi")]
        box_q = cut(blocks.boxes(q, q.df.select("bid", *span, F.array_max("most").alias("reach")), [*ends, "reach"], d.pivots))
        box_d = cut(blocks.boxes(d, d.df.select("bid", *span), ends))

        def can_matter(a, b, low, high):
            share = (a.facts["c_lo"][:, None] <= b.facts["c_hi"][None, :]) & (b.facts["c_lo"][None, :] <= a.facts["c_hi"][:, None])
            return share | (np.sqrt(low) <= a.facts["reach"][:, None] * (1 + 1e-9))

        links = blocks.pruned_links(box_q, box_d, q.count, d.count, can_matter, [*ends, "reach"])
    sums = blocks.sweep(q, d, links, _NearSums()).repartition("id")
    mean = sums.groupBy("id", "c").agg(F.first("own").alias("own"), F.first("n").alias("n"), F.sum("s").alias("s"))
    a = F.max(F.when(F.col("own"), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))))
    b = F.min(F.when(~F.col("own"), F.col("s") / F.col("n")))
    both = mean.groupBy("id").agg(a.alias("a"), b.alias("b"), F.max(F.when(F.col("own"), F.col("n"))).alias("n"))
    top = F.greatest("a", "b")
    return both.select("id", F.when((F.col("n") <= 1) | (top <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("value"))


def silhouette_groups(df: DataFrame, labels: Sequence[str] = ("cluster",), vec: str = "x", key: str = "row_id", dense_width: int | None = None) -> DataFrame:
    """``(x, labels..., w, sil_<label>...)``: one row per distinct (vector, labels), ``w`` rows each.

    Labelings with few clusters, ``dense_width`` in all, share one pass over the distances; only sums per point and cluster
    leave a task. With more each labeling has a pass of its own, over the clusters that can matter to a point.
    """
    labels = list(labels)
    for c in labels:  # a row without a label belongs to no cluster
        df = df.filter(F.col(c).isNotNull())
    groups = cut(df.groupBy(F.col(vec).cast("array<double>").alias("x"), *labels).agg(F.min(F.col(key).cast("bigint")).alias("id"), F.count(F.lit(1)).alias("w")))
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(c).cast("bigint").alias("v")) for t, c in enumerate(labels)]))
    sizes = cut(groups.select("w", one.alias("e")).groupBy("e.t", "e.v").agg(F.sum("w").alias("n")))
    if sizes.count() > (DENSE_WIDTH if dense_width is None else dense_width):
        rows, out = df.select(F.col(vec).cast("array<double>").alias("x"), *labels), groups
        for c in labels:
            out = out.join(cut(_near_silhouettes(rows, groups, c)).withColumnRenamed("value", f"sil_{c}"), "id")
        return out.select("x", *labels, "id", "w", *[f"sil_{c}" for c in labels])
    found = sorted(sizes.collect(), key=lambda r: r["v"])
    levels = [np.array([r["v"] for r in found if r["t"] == t], dtype=np.int64) for t in range(len(labels))]
    counts = [np.array([float(r["n"]) for r in found if r["t"] == t]) for t in range(len(labels))]
    b = blocks.build(groups, "id", "x", [*labels, "w"], stable=True)
    smooth = b.dim <= SMOOTH_DIMS and not b.small
    kernel = (_SmoothSums if smooth else _ClusterSums)(levels, labels)
    parts = blocks.sweep(b, b, blocks.all_links(df.sparkSession, b.count, b.count), kernel, tiled=smooth)
    # a point's sums come from one task, or from few when the join was split
    merged = parts.groupBy("id").agg(F.collect_list("s").alias("s")).join(groups.select("id", *labels), "id")
    values = merged.select("id", "s", *labels).mapInArrow(_finish(levels, counts, labels), "id bigint, sil array<double>")
    return groups.join(values, "id").select("x", *labels, "id", "w", *[F.col("sil")[t].alias(f"sil_{c}") for t, c in enumerate(labels)])


def _finish(levels: list[np.ndarray], counts: list[np.ndarray], labels: Sequence[str]):
    """Silhouettes from the cluster sums; NULL for a labeling with a single cluster."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {f.name: batch.column(t) for t, f in enumerate(batch.schema)}
            width = sum(len(v) for v in levels)
            parts = cols["s"]
            flat = parts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            sums = np.zeros((batch.num_rows, width))
            np.add.at(sums, owner, flat)
            rows, out, at = np.arange(batch.num_rows), np.zeros((batch.num_rows, len(labels))), 0
            for m, (lv, n, c) in enumerate(zip(levels, counts, labels)):
                own = np.searchsorted(lv, cols[c].to_numpy(zero_copy_only=False))
                part = sums[:, at:at + len(lv)]
                at += len(lv)
                if len(lv) < 2:
                    out[:, m] = np.nan
                    continue
                mean = part / n
                mean[rows, own] = np.inf
                b, single = mean.min(axis=1), n[own] <= 1
                a = part[rows, own] / np.maximum(n[own] - 1, 1)
                top = np.maximum(a, b)
                out[:, m] = np.where(single | (top <= 0), 0.0, (b - a) / np.where(top > 0, top, 1.0))
            values = pa.array(out.ravel(), from_pandas=True)
            offsets = pa.array(np.arange(0, out.size + 1, len(labels), dtype=np.int32))
            yield pa.RecordBatch.from_pydict({"id": cols["id"], "sil": pa.ListArray.from_arrays(offsets, values)})

    return run


def silhouette(df: DataFrame, labels: Sequence[str] = ("cluster",), vec: str = "x", key: str = "row_id", dense_width: int | None = None) -> DataFrame:
    """``(model, silhouette)``: mean silhouette of each labeling; NULL with fewer than two clusters."""
    g = silhouette_groups(df, labels, vec, key, dense_width)
    one = g.agg(*[(F.sum(F.col(f"sil_{c}") * F.col("w")) / F.sum("w")).alias(c) for c in labels])
    return one.unpivot([], list(labels), "model", "silhouette")


def silhouette_samples(df: DataFrame, label: str = "cluster", vec: str = "x", key: str = "row_id") -> DataFrame:
    """``(row_id, cluster, silhouette, y, mean)``: the silhouette plot's bars, sorted within cluster and
    stacked cluster by cluster; ``y`` is the height of the bar."""
    g = silhouette_groups(df, [label], vec, key)
    rows = df.select(F.col(key).alias("row_id"), F.col(vec).cast("array<double>").alias("x"), F.col(label).alias("cluster"))
    points = rows.join(g.select("x", F.col(label).alias("cluster"), F.col(f"sil_{label}").alias("silhouette")), ["x", "cluster"]).drop("x")
    placed = global_position(points, ["cluster", "silhouette", "row_id"], "y")
    mean = placed.agg(F.avg("silhouette")).first()[0]
    return placed.select("row_id", "cluster", "silhouette", "y", F.lit(mean).cast("double").alias("mean"))


# ---------------------------------------------------------------- Dunn


class _Extremes(Kernel):
    """Per labeling: the largest distance within a cluster and the smallest between two clusters."""

    schema = "widest array<double>, closest array<double>"
    per_task = True

    def __init__(self, label_cols: Sequence[str], known: tuple[np.ndarray, np.ndarray] | None = None):
        self.label_cols, self.known = list(label_cols), known

    def start(self, q: Block):
        m = len(self.label_cols)
        if self.known is None:
            return np.zeros(m), np.full(m, np.inf)
        return self.known[0].copy(), self.known[1].copy()

    def _parts(self, b: Block):
        """The block's rows by sets of labels: the sets, their rows and their boxes."""
        if not hasattr(b, "_sets"):
            labels = np.stack([getattr(b, c) for c in self.label_cols])
            order = np.lexsort(labels)
            own = labels[:, order]
            first = np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0)))
            b.kinds, x = own[:, first].T, b.x[order]
            b._sets = np.split(x, first[1:])
            b.lo, b.hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
            b.whole = not np.isnan(x).any()
        return b

    def _all(self, state, q: Block, d: Block):
        """Every pair of two blocks, for those with missing coordinates: an extreme that one of them takes part in stays as it was."""
        widest, closest = state
        plain = q.x.shape[1] <= LOOP_DIMS
        d2, err = (sq_dist(q.x, d.x), 0.0) if plain else sq_dist_gram(q.x, d.x)
        for m, col in enumerate(self.label_cols):
            same = getattr(q, col)[:, None] == getattr(d, col)[None, :]
            inner, outer = np.where(same, d2, -1.0), np.where(same, np.inf, d2)
            top, low = inner.max(), outer.min()
            if not plain:
                slack = 2 * float(np.max(err))
                top = _settle(q.x, d.x, inner >= top - slack).max() if top >= 0 else top
                low = _settle(q.x, d.x, outer <= low + slack).min() if np.isfinite(low) else low
            widest[m], closest[m] = max(widest[m], top), min(closest[m], low)
        return widest, closest

    def feed(self, state, q: Block, d: Block):
        """Only sets of labels whose boxes can hold a wider or a closer pair than the known ones are looked at, and in few
        dimensions only their rows that can."""
        widest, closest = state
        if not (self._parts(q).whole and self._parts(d).whole):
            return self._all(state, q, d)
        plain = q.x.shape[1] <= LOOP_DIMS
        low, high = boxes_low_high(q.lo, q.hi, d.lo, d.hi)
        same = q.kinds[:, None, :] == d.kinds[None, :, :]
        slack = 1e-9
        for a, b in np.argwhere(((same & (high[:, :, None] * (1 + slack) >= widest)) | (~same & (low[:, :, None] * (1 - slack) <= closest))).any(axis=2)).tolist():
            own = same[a, b]
            most, least = widest[own].min(initial=np.inf), closest[~own].max(initial=-np.inf)
            if high[a, b] * (1 + slack) < most and low[a, b] * (1 - slack) > least:
                continue
            x, y = q._sets[a], d._sets[b]
            if plain:
                x = x[_can_matter(x, d.lo[b], d.hi[b], most, least, slack)]
                y = y[_can_matter(y, q.lo[a], q.hi[a], most, least, slack)]
                if not len(x) or not len(y):
                    continue
            d2, err = (sq_dist(x, y), 0.0) if plain else sq_dist_gram(x, y)
            room = 2 * float(np.max(err))
            if own.any() and (top := d2.max()) >= most - room:
                top = top if plain else _settle(x, y, d2 >= top - room).max()
                widest[own] = np.maximum(widest[own], top)
            if not own.all() and (near := d2.min()) <= least + room:
                near = near if plain else _settle(x, y, d2 <= near + room).min()
                closest[~own] = np.minimum(closest[~own], near)
        return widest, closest

    def finish(self, state, q: Block):
        return columns_batch(widest=list_array(state[0][None, :]), closest=list_array(state[1][None, :]))


def _can_matter(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: float, least: float, slack: float) -> np.ndarray:
    """Rows that may be farther than ``most`` from a point of the box, or nearer than ``least``, both squared."""
    reach = np.maximum(np.abs(x - lo), np.abs(hi - x))
    return (np.einsum("ij,ij->i", reach, reach) * (1 + slack) >= most) | (box_low(x, lo, hi) * (1 - slack) <= least)


def _settle(a: np.ndarray, b: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact squared distances of the entries that can be the extreme one."""
    r, c = np.nonzero(candidates)
    return sq_dist_pairs(a[r], b[c])


def dunn(df: DataFrame, labels: Sequence[str] | str = ("cluster",), vec: str = "x", key: str = "row_id") -> DataFrame:
    """``(model, closest, widest, dunn)``: smallest single-link distance between clusters over the largest
    cluster diameter; NULL with one cluster or zero diameter.
    All labelings share one pass.
    """
    labels = [labels] if isinstance(labels, str) else list(labels)
    spark = df.sparkSession
    distinct = df.groupBy(F.col(vec).cast("array<double>").alias("x"), *labels).agg(F.min(F.col(key).cast("bigint")).alias("id"))
    b = blocks.build(distinct, "id", "x", labels, near=True)
    if b.small:
        wide, gap = _worst(blocks.sweep(b, b, blocks.all_links(spark, b.count, b.count, half=True), _Extremes(labels)), len(labels))
    else:
        wide, gap = _pruned_extremes(b, labels)
    rows = []
    for m, w, c in zip(labels, np.sqrt(wide).tolist(), np.sqrt(gap).tolist()):
        rows.append((m, c, w, c / w if w > 0 else None) if np.isfinite(c) else (m, None, None, None))
    return spark.createDataFrame(rows, "model string, closest double, widest double, dunn double")


def _worst(found: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    got = found.agg(F.array(*[F.max(F.col("widest")[t]) for t in range(m)]).alias("w"), F.array(*[F.min(F.col("closest")[t]) for t in range(m)]).alias("c")).first()
    return np.array(got["w"], dtype=float), np.array(got["c"], dtype=float)


def _pruned_extremes(b: blocks.Blocks, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A first round over each block's own, nearest and farthest pair gives a lower bound of the diameters
    and an upper bound of the gaps; only block pairs whose boxes and labels can beat them follow."""
    ends = [c for m in labels for c in (f"lo_{m}", f"hi_{m}")]
    facts = b.df.select("bid", *[e for m in labels for e in (F.array_min(m).alias(f"lo_{m}"), F.array_max(m).alias(f"hi_{m}"))])
    box = cut(blocks.boxes(b, facts, ends))

    def first(q, d, low, high):
        own = q.facts["bid"][:, None] == d.facts["bid"][None, :]
        away = np.where(own, np.inf, low)
        return own | (away <= away.min(axis=1, keepdims=True)) | (high >= high.max(axis=1, keepdims=True))

    wide, gap = _worst(blocks.sweep(b, b, blocks.pruned_links(box, box, b.count, b.count, first), _Extremes(labels)), len(labels))

    def can_beat(q, d, low, high):
        keep = np.zeros(low.shape, dtype=bool)
        for t, m in enumerate(labels):
            ql, qh, dl, dh = (f[k] for f, k in ((q.facts, f"lo_{m}"), (q.facts, f"hi_{m}"), (d.facts, f"lo_{m}"), (d.facts, f"hi_{m}")))
            may_share = (ql[:, None] <= dh[None, :]) & (dl[None, :] <= qh[:, None])
            may_differ = (ql[:, None] != dh[None, :]) | (qh[:, None] != dl[None, :])
            keep |= (may_share & (high > wide[t])) | (may_differ & (low < gap[t]))
        return keep & (q.facts["bid"][:, None] < d.facts["bid"][None, :])

    links = blocks.pruned_links(box, box, b.count, b.count, can_beat, ends)
    more_wide, more_gap = _worst(blocks.sweep(b, b, links, _Extremes(labels, (wide, gap))), len(labels))
    return np.fmax(wide, more_wide), np.fmin(gap, more_gap)
