"""Exact k nearest neighbours with box pruning, and what is read off them."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.kernels import merge_nearest, nearest, nearest_within, rows_low
from quarry.operators import blocks
from quarry.operators.blocks import Block, Blocks, Kernel, columns_batch, list_array
from quarry.session import cut

SLACK = 1 + 1e-12  # keeps a block whose box touches the current radius in spite of rounding


class _Radius(Kernel):
    """Distance to the k-th point of one nearby block: an upper bound of the true k-th distance."""

    schema = "bid int, radius array<double>, widest double"

    def __init__(self, k: int):
        self.k = k

    def start(self, q: Block):
        return None

    def feed(self, state, q: Block, d: Block):
        return nearest(q.x, d.x, d.ids, self.k)[0][:, -1]

    def finish(self, state, q: Block):
        return columns_batch(bid=pa.array([q.bid], pa.int32()), radius=list_array(state[None, :]), widest=[float(state.max())])


class _Nearest(Kernel):
    schema = "id bigint, near array<struct<d2: double, j: bigint>>"

    def __init__(self, k: int):
        self.k = k

    def start(self, q: Block):
        n = len(q.ids)
        bound = q.radius * SLACK if hasattr(q, "radius") else np.full(n, np.inf)
        return np.full((n, self.k), np.inf), np.full((n, self.k), np.iinfo(np.int64).max), bound

    def feed(self, state, q: Block, d: Block):
        dist, who, bound = state
        rows = np.nonzero(rows_low(q.x, d.x) <= bound)[0]
        if len(rows):
            nd, nw = nearest_within(q.x[rows], d.x, d.ids, self.k, bound[rows])
            dist[rows], who[rows] = merge_nearest(dist[rows], who[rows], nd, nw)
            bound[rows] = np.minimum(bound[rows], dist[rows, -1] * SLACK)
        return dist, who, bound

    def finish(self, state, q: Block):
        dist, who, _ = state
        sizes = np.isfinite(dist).sum(axis=1)
        keep = np.isfinite(dist).ravel()
        items = pa.StructArray.from_arrays([pa.array(dist.ravel()[keep]), pa.array(who.ravel()[keep])], names=["d2", "j"])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return columns_batch(id=q.ids, near=pa.ListArray.from_arrays(pa.array(offsets), items))


def nearest_lists(q: Blocks, d: Blocks, k: int) -> DataFrame:
    """``(id, near)``: per query point the ``k`` smallest ``(d2, id)`` of the data, itself included.

    Each query block first looks at the data block nearest to it. That bounds every point's k-th distance,
    and only blocks whose boxes come within the bound are visited after it.
    """
    if q.rows * d.rows <= blocks.SMALL_PAIRS:
        found = blocks.sweep(q, d, blocks.all_links(q.df.sparkSession, q.count, d.count), _Nearest(k))
        return _merged(found, k)
    box_q = cut(blocks.boxes(q, pivots=d.pivots))
    box_d = box_q if d is q else cut(blocks.boxes(d))
    closest = blocks.pruned_links(box_q, box_d, q.count, d.count, lambda a, c, low, high: low <= low.min(axis=1, keepdims=True))
    first = cut(blocks.sweep(q, d, closest.groupBy("i").agg(F.min("j").alias("j")), _Radius(k)))
    box_q = cut(box_q.join(first.select("bid", "widest"), "bid"))
    links = blocks.pruned_links(box_q, box_d, q.count, d.count, lambda a, c, low, high: low <= a.facts["widest"][:, None] * SLACK, ["widest"])
    return _merged(blocks.sweep(q, d, links, _Nearest(k), q_extra=first.select("bid", "radius")), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def has_copies(df: DataFrame, vec: str = "x") -> bool:
    """Whether some vector occurs twice; compares 8-byte hashes, so it errs only towards yes."""
    row = df.select(F.xxhash64(vec).alias("h")).agg(F.count("h").alias("n"), F.count_distinct("h").alias("u")).first()
    return row["u"] < row["n"]


def knn(df: DataFrame, k: int, key: str = "row_id", vec: str = "x") -> DataFrame:
    """``(i, j, dist, rank)``: the k nearest other rows, ties broken by the smaller key.

    Copies of one vector are searched once: only their k+1 smallest keys can be anyone's neighbours,
    and all copies share one list. Without that step a vector repeated in a third of the rows would
    make its block quadratic.
    """
    base = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("x"))
    if not has_copies(base):
        b = blocks.build(base, "id", "x", near=True)
        return _edges(nearest_lists(b, b, k + 1).withColumnRenamed("id", "i"), k)
    base = cut(base)
    order = Window.partitionBy("x").orderBy("id")
    ranked = base.withColumn("copy", F.row_number().over(order)).filter(F.col("copy") <= k + 1)
    ranked = cut(ranked)
    b_all = blocks.build(ranked, "id", "x", stable=True, near=True)
    b_one = blocks.build(ranked.filter(F.col("copy") == 1), "id", "x", stable=True, near=True)
    lists = nearest_lists(b_one, b_all, k + 1)
    lead = ranked.filter(F.col("copy") == 1).select("id", "x").join(lists, "id").select("x", "near")
    return _edges(base.join(lead, "x").select(F.col("id").alias("i"), "near"), k)


def _edges(lists: DataFrame, k: int) -> DataFrame:
    others = F.slice(F.filter("near", lambda r: r["j"] != F.col("i")), 1, k)
    spread = lists.select("i", F.posexplode(others).alias("p", "e"))
    return spread.select("i", F.col("e.j").alias("j"), F.sqrt("e.d2").alias("dist"), (F.col("p") + 1).alias("rank"))


def neighbour_overlap(high: DataFrame, low: DataFrame) -> DataFrame:
    """Per point the Jaccard overlap of its neighbour sets in two edge tables: ``(i, jaccard)``."""
    a = high.groupBy("i").agg(F.collect_set("j").alias("a"))
    b = low.groupBy("i").agg(F.collect_set("j").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    union = F.size(F.array_union("a", "b"))
    return a.join(b, "i").select("i", F.when(union > 0, common / union).otherwise(0.0).alias("jaccard"))


def mean_overlap(high: DataFrame, low: DataFrame) -> DataFrame:
    """One row ``(jaccard)``: mean overlap of the neighbour sets."""
    return neighbour_overlap(high, low).agg(F.avg("jaccard").alias("jaccard"))
