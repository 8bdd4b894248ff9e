"""Pairwise work over blocks of nearby rows.

Rows are placed in cells of a space partition, cells are cut into blocks of bounded size, and a block
becomes one row holding flat arrays. Pairs of blocks (never pairs of rows) are joined by block id, and
a kernel reduces each pair inside the task, so what is shuffled grows with blocks, not with row pairs.
Blocks that are too many for a broadcast are dealt over tiles of the pair matrix: a block travels once to each tile of its row or
column in which it has a partner, never to each partner.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from quarry.functions.kernels import LOOP_DIMS, PivotCells, SplitTree, ball, balls_low_high, boxes_low_high, distances, spans_low_high
from quarry.session import cut, parallelism

BLOCK_BYTES = 1 << 20      # coordinates held by one block
MAX_BLOCK_ROWS = 1024      # distances of two blocks stay in a core's cache, and the memory of a task does not grow with the table
NEAR_ROWS = 512            # the same in few dimensions, where boxes rule out most pairs
MIN_BLOCK_ROWS = 64
SAMPLE_BYTES = 64 << 20    # driver memory for the sample that places the splits
MAX_DEPTH = 16
MAX_PIVOTS_LOG2 = 10       # cells around pivots, for many dimensions
PIVOT_TABLE = 64           # pivots that blocks know their smallest and largest distance to
BROADCAST_BYTES = 32 << 20  # blocks are broadcast only when their computed size is under this
TILE_BYTES = 64 << 20      # blocks of either side that one tile holds
BOXES_PER_CHUNK = 2048
SMALL_PAIRS = 2_000_000_000  # with fewer row pairs than this, finding out what to skip costs more than it saves


@dataclass
class Blocks:
    """``df(bid, n, ids, x, <extras as arrays>)``; block ids run from 0 to ``count - 1``, some may be absent."""

    df: DataFrame
    count: int
    rows: int
    dim: int
    extras: list[str] = field(default_factory=list)
    extra_width: int = 0  # numbers that the extras hold per row
    pivots: np.ndarray | None = None

    @property
    def small(self) -> bool:
        return self.rows * self.rows <= SMALL_PAIRS

    @property
    def fits_broadcast(self) -> bool:
        return self.rows * (self.dim + 1 + self.extra_width) * 8 <= BROADCAST_BYTES


def build(df: DataFrame, key: str = "row_id", vec: str = "x", extras: Sequence[str] = (), block_rows: int | None = None, stable: bool = False, spatial: bool | None = None, near: bool = False) -> Blocks:
    """Pack ``(key, vec, extras...)``. ``stable`` says that ``df`` is already read from storage;
    ``spatial`` forces or forbids blocks of nearby rows, which small inputs do without; ``near`` says that only
    near pairs of blocks will be looked at."""
    spark = df.sparkSession
    cols = [F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("x"), *[F.col(e) for e in extras]]
    base = df.select(*cols) if stable else cut(df.select(*cols))
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.min(F.size("x")).alias("d0")).first()
    n, dim = facts["n"], facts["d"] or 0
    if n == 0:
        raise ValueError("no rows to pack")
    if facts["d0"] != dim:
        raise ValueError("vectors of different length")
    most = max(1, min(NEAR_ROWS if near and dim <= LOOP_DIMS else MAX_BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    rows = block_rows or min(most, max(MIN_BLOCK_ROWS, math.ceil(n / (2 * parallelism(spark)))))
    want = math.ceil(n / rows)
    if spatial is None:
        spatial = n * n > SMALL_PAIRS
    sample_rows = max(1024, min(1 << 20, SAMPLE_BYTES // (8 * max(1, dim))))
    if dim > LOOP_DIMS:  # pivots are drawn from no more than these
        sample_rows = min(sample_rows, PivotCells.ROWS)
    depth = 0 if not spatial else min(MAX_DEPTH, max(0, math.ceil(math.log2(want))), max(0, int(math.log2(max(1, min(n, sample_rows) / 8)))))
    every = max(1, math.ceil(n / sample_rows) if dim > LOOP_DIMS else n // sample_rows)
    picked = base.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("x").toArrow().column("x") if depth else None
    tree = None
    if depth:
        sample = _matrix(picked.combine_chunks(), dim)
        tree = SplitTree(sample, depth) if dim <= LOOP_DIMS else PivotCells(sample, 1 << min(depth, MAX_PIVOTS_LOG2))

    if tree is not None:

        @F.pandas_udf("int")
        def cell(x: pd.Series) -> pd.Series:
            return pd.Series(tree.place(np.stack(x.to_numpy())) if len(x) else [], dtype="int32")

        placed = base.withColumn("_cell", cell("x"))
    else:
        placed = base.withColumn("_cell", F.lit(0))
    if depth:
        sizes = {r["_cell"]: r["count"] for r in placed.groupBy("_cell").count().collect()}
    else:
        sizes = {0: n}
    first, parts, total = [], [], 0
    for c in range(max(sizes) + 1):
        k = math.ceil(sizes.get(c, 0) / rows)
        first.append(total)
        parts.append(max(1, k))
        total += k
    at = F.col("_cell") + 1
    within = F.pmod(F.xxhash64("id"), F.element_at(F.lit(np.array(parts, dtype="int32")), at).cast("bigint")).cast("int")
    slot = F.element_at(F.lit(np.array(first, dtype="int32")), at) + within
    packed = placed.withColumn("bid", slot).groupBy("bid").agg(F.sort_array(F.collect_list(F.struct("id", "x", *extras))).alias("r"))
    out = packed.select(
        "bid", F.size("r").alias("n"), F.col("r.id").alias("ids"), F.flatten("r.x").alias("x"), *[F.col(f"r.{e}").alias(e) for e in extras],
    )
    packed_ = cut(out)
    widths = [F.max(F.size(e) if not isinstance(base.schema[e].dataType, ArrayType) else F.size(F.flatten(e))) / F.max("n") for e in extras]
    width = sum(math.ceil(v or 0) for v in packed_.agg(*widths).first()) if extras else 0
    return Blocks(packed_, total, n, dim, list(extras), width, getattr(tree, "pivots", None))


def _matrix(arr: pa.Array, dim: int) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Block:
    """One packed row inside a task; array columns become attributes."""

    def __init__(self, values: dict, dim: int):
        self.__dict__.update(values)
        self.x = values["x"].reshape(-1, dim)


class Kernel:
    """Reduces one query block against its data blocks; picklable, no state between queries."""

    schema: str
    per_task = False  # one state for all queries of a task instead of one per query

    def start(self, q: Block):
        raise NotImplementedError

    def feed(self, state, q: Block, d: Block):
        raise NotImplementedError

    def finish(self, state, q: Block) -> pa.RecordBatch | None:
        raise NotImplementedError


def _cell_value(col: pa.Array, i: int):
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        part = col[i].values
        if pa.types.is_list(part.type):
            width = len(part[0])
            return part.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return part.to_numpy(zero_copy_only=False)
    return col[i].as_py()


def sweep(queries: Blocks, data: Blocks, links: DataFrame, kernel: Kernel, q_extra: DataFrame | None = None, d_extra: DataFrame | None = None, tiled: bool = False) -> DataFrame:
    """Join the block pairs in ``links(i, j)`` to both sides and run ``kernel`` over them, query by query.

    A kernel may be finished more than once per query when its pairs land in several tasks, so callers
    merge the partial rows it returns. ``tiled`` deals the blocks over tiles in any case, so that a task keeps what a kernel
    has worked out about a block.
    """
    dq, dd = queries.dim, data.dim
    q = queries.df if q_extra is None else queries.df.join(q_extra, "bid")
    d = data.df if d_extra is None else data.df.join(d_extra, "bid")
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])
    d = d.select(*[F.col(c).alias(f"d_{c}") for c in d.columns])
    links = links.select("i", "j")
    if tiled or not data.fits_broadcast:
        return _tiled(queries, data, links, kernel, q, d)
    side = F.broadcast if queries.fits_broadcast else lambda t: t.hint("merge")
    both = links.join(F.broadcast(d), F.col("j") == F.col("d_bid")).join(side(q), F.col("i") == F.col("q_bid")).drop("i", "j")

    def run(batches):
        held, q_block, state = None, None, None
        for batch in batches:
            cols = {f.name: batch.column(at) for at, f in enumerate(batch.schema)}
            for at in range(batch.num_rows):
                bid = cols["q_bid"][at].as_py()
                if bid != held:
                    if held is not None and not kernel.per_task:
                        out = kernel.finish(state, q_block)
                        if out is not None:
                            yield out
                    q_block = _block(cols, "q_", at, dq)
                    if held is None or not kernel.per_task:
                        state = kernel.start(q_block)
                    held = bid
                state = kernel.feed(state, q_block, _block(cols, "d_", at, dd))
        if held is not None:
            out = kernel.finish(state, q_block)
            if out is not None:
                yield out

    return both.mapInArrow(run, kernel.schema)


def _block(cols: dict, prefix: str, at: int, dim: int) -> Block:
    return Block({c[2:]: _cell_value(v, at) for c, v in cols.items() if c.startswith(prefix)}, dim)


def tile_grid(queries: Blocks, data: Blocks) -> tuple[int, int]:
    """Rows and columns of tiles: each holds blocks of TILE_BYTES at most, and there are enough for all cores."""
    sides = []
    for b in (queries, data):
        size = b.rows * (b.dim + 1 + b.extra_width) * 8
        sides.append(min(b.count, max(1, math.ceil(size / (TILE_BYTES // 2)))))
    want = 2 * parallelism(queries.df.sparkSession)
    while sides[0] * sides[1] < want and (sides[0] < queries.count or sides[1] < data.count):
        grow = 0 if sides[0] < queries.count and (sides[0] <= sides[1] or sides[1] == data.count) else 1
        sides[grow] += 1
    return sides[0], sides[1]


def _tiled(queries: Blocks, data: Blocks, links: DataFrame, kernel: Kernel, q: DataFrame, d: DataFrame) -> DataFrame:
    """The sweep over tiles: block ``i`` is in row ``i mod rows``, block ``j`` in column ``j mod columns``."""
    rows, columns = tile_grid(queries, data)
    dq, dd = queries.dim, data.dim
    placed = links.select("i", "j", (F.pmod("i", F.lit(rows)) * columns + F.pmod("j", F.lit(columns))).cast("int").alias("tile"))
    left = q.join(placed.select("i", "tile").distinct().hint("merge"), F.col("q_bid") == F.col("i")).drop("i")
    right = d.join(placed.select("j", "tile").distinct().hint("merge"), F.col("d_bid") == F.col("j")).drop("j")
    partners = placed.groupBy("tile", "i").agg(F.sort_array(F.collect_list("j")).alias("js"))
    met = left.unionByName(right, True).unionByName(partners, True)
    schema = to_arrow_schema(StructType.fromDDL(kernel.schema))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cols = {c: table.column(c).chunk(0) for c in table.column_names}
        mine = {c: v for c, v in cols.items() if c.startswith("q_")}
        theirs = {c: v for c, v in cols.items() if c.startswith("d_")}
        at_q = {b: at for at, b in enumerate(mine["q_bid"].to_pylist()) if b is not None}
        at_d = {b: at for at, b in enumerate(theirs["d_bid"].to_pylist()) if b is not None}
        held = {j: _block(theirs, "d_", at, dd) for j, at in at_d.items()}
        found, state, q_block = [], None, None
        for i, js in sorted((i, js) for i, js in zip(cols["i"].to_pylist(), cols["js"].to_pylist()) if js is not None):
            if i not in at_q:
                continue
            q_block = _block(mine, "q_", at_q[i], dq)
            if state is None or not kernel.per_task:
                state = kernel.start(q_block)
            for j in js:
                if j in held:
                    state = kernel.feed(state, q_block, held[j])
            if not kernel.per_task:
                found.append(kernel.finish(state, q_block))
        if kernel.per_task and state is not None:
            found.append(kernel.finish(state, q_block))
        return pa.Table.from_batches([f.select(schema.names).cast(schema) for f in found if f is not None], schema)

    return met.groupBy("tile").applyInArrow(run, kernel.schema)


def _tasks(spark: SparkSession, n_queries: int) -> int:
    """One wave of tasks for few blocks, several for many, so that slow tasks even out."""
    cores = parallelism(spark)
    return min(n_queries, cores if n_queries <= 16 * cores else 4 * cores)


def all_links(spark: SparkSession, n_queries: int, n_data: int, half: bool = False) -> DataFrame:
    """Every block pair, a query's own place first; with ``half`` each unordered pair once, the same
    number per block: block ``i`` is paired with the blocks that follow it on a circle, half-way round.
    """
    i = spark.range(0, n_queries, 1, _tasks(spark, n_queries)).select(F.col("id").cast("int").alias("i"))
    reach = n_data // 2 if half else n_data - 1
    steps = i.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    if half and n_data % 2 == 0:
        steps = steps.filter((F.col("o") < reach) | (F.col("i") < reach))
    return steps.select("i", ((F.col("i") + F.col("o")) % F.lit(n_data)).cast("int").alias("j"))


@dataclass
class Box:
    """What a pruning rule sees of one block."""

    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray
    facts: dict[str, np.ndarray]


def boxes(b: Blocks, facts: DataFrame | None = None, fact_cols: Sequence[str] = (), pivots: np.ndarray | None = None) -> DataFrame:
    """``(bid, n, lo, hi, centre, radius, near, far, of, <facts>)``: bounding box and ball per block, the smallest and largest distance
    to each of some pivots (``of`` tells which; those of ``b`` unless given), with per-block facts joined on."""
    dim = b.dim
    pivots = b.pivots if pivots is None else pivots
    pivots = np.zeros((0, dim)) if pivots is None else pivots[:PIVOT_TABLE]
    of = zlib.crc32(np.ascontiguousarray(pivots).tobytes())

    def run(batches):
        for batch in batches:
            bid = batch.column(0)
            lo, hi, balls, near, far = [], [], [], [], []
            for at in range(batch.num_rows):
                x = _cell_value(batch.column(2), at).reshape(-1, dim)
                lo.append(x.min(axis=0).tolist())
                hi.append(x.max(axis=0).tolist())
                balls.append(ball(x))
                to = distances(x, pivots) if len(pivots) else np.zeros((1, 0))
                near.append(to.min(axis=0).tolist())
                far.append(to.max(axis=0).tolist())
            vectors = {"lo": lo, "hi": hi, "centre": [c.tolist() for c, _ in balls], "near": near, "far": far}
            yield pa.RecordBatch.from_pydict({"bid": bid, "n": batch.column(1), **{k: pa.array(v, pa.list_(pa.float64())) for k, v in vectors.items()}, "radius": pa.array([r for _, r in balls], pa.float64()), "of": pa.array([of] * len(bid), pa.int64())})

    out = b.df.select("bid", "n", "x").mapInArrow(run, "bid int, n int, lo array<double>, hi array<double>, centre array<double>, near array<double>, far array<double>, radius double, of long")
    return out if facts is None else out.join(facts.select("bid", *fact_cols), "bid")


def pruned_links(queries: DataFrame, data: DataFrame, n_queries: int, n_data: int, rule: Callable[[Box, Box, np.ndarray, np.ndarray], np.ndarray], facts: Sequence[str] = ()) -> DataFrame:
    """Block pairs that ``rule(query_boxes, data_boxes, low2, high2)`` keeps, as ``(i, j)``; the bounds come from boxes, in many
    dimensions from balls and common pivots as well.

    Boxes are compared chunk against chunk, so the list of boxes is never held whole.
    """
    spark = queries.sparkSession
    chunks_q, chunks_d = math.ceil(n_queries / BOXES_PER_CHUNK), math.ceil(n_data / BOXES_PER_CHUNK)
    names = ["bid", "n", *facts]

    def chunked(df: DataFrame, chunks: int, tag: str) -> DataFrame:
        have = [c for c in names if c in df.columns]
        g = df.withColumn("chunk", F.pmod(F.xxhash64("bid"), F.lit(chunks)).cast("int")).groupBy("chunk")
        packed = g.agg(F.sort_array(F.collect_list(F.struct("bid", "lo", "hi", "centre", "radius", "near", "far", "of", *[c for c in have if c != "bid"]))).alias("r"))
        return packed.select(
            F.col("chunk").alias(f"{tag}_chunk"), F.size("r").alias(f"{tag}_rows"),
            *[F.flatten(f"r.{c}").alias(f"{tag}_{c}") for c in ("lo", "hi", "centre", "near", "far")], F.col("r.radius").alias(f"{tag}_radius"), F.col("r.of").alias(f"{tag}_of"), *[F.col(f"r.{c}").alias(f"{tag}_{c}") for c in have],
        )

    grid = all_links(spark, chunks_q, chunks_d)
    pairs = grid.join(chunked(data, chunks_d, "d"), F.col("j") == F.col("d_chunk")).join(chunked(queries, chunks_q, "q"), F.col("i") == F.col("q_chunk"))

    def run(batches):
        for batch in batches:
            cols = {f.name: batch.column(at) for at, f in enumerate(batch.schema)}
            for at in range(batch.num_rows):
                side = {}
                for tag in "qd":
                    v = {c[2:]: _cell_value(a, at) for c, a in cols.items() if c.startswith(f"{tag}_")}
                    side[tag] = Box(*(v[k].reshape(v["rows"], -1) for k in ("lo", "hi", "centre")), v["radius"], *(v[k].reshape(v["rows"], -1) for k in ("near", "far")), v)
                a, b = side["q"], side["d"]
                low, high = boxes_low_high(a.lo, a.hi, b.lo, b.hi)
                if a.lo.shape[1] > LOOP_DIMS:
                    near, far = balls_low_high(a.centre, a.radius, b.centre, b.radius)
                    low, high = np.maximum(low, near), np.minimum(high, far)
                    if a.facts["of"][0] == b.facts["of"][0]:
                        near, far = spans_low_high(a.near, a.far, b.near, b.far)
                        low, high = np.maximum(low, near), np.minimum(high, far)
                r, c = np.nonzero(rule(side["q"], side["d"], low, high))
                if len(r):
                    yield pa.RecordBatch.from_pydict({"i": pa.array(side["q"].facts["bid"][r], pa.int32()), "j": pa.array(side["d"].facts["bid"][c], pa.int32())})

    found = pairs.mapInArrow(run, "i int, j int")
    return found.repartition(_tasks(spark, n_queries), "i").sortWithinPartitions("i", "j")


def columns_batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})


def list_array(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column, without going through Python objects."""
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))
