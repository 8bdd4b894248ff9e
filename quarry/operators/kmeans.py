"""k-means with restarts over a grid of k, and what is read off the fitted centres."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import validate
from quarry.operators.blocks import list_array
from quarry.operators.pca import PcaModel
from quarry.operators.prepare import Scale
from quarry.operators.validate import sq_gap
from quarry.session import cut, parallelism

SEED_ROUNDS = 4     # passes over all rows that draw candidates for the starting centres
SEED_DRAWS = 2      # candidates per round and run, in multiples of k
CHUNK_ROWS = 4096
TASK_ROWS = 4_096   # fewer rows than this are not worth a task of their own
FEW_TASKS = 64      # tasks whose rows per centre are added up on the driver, without a shuffle


@dataclass
class KMeansModel:
    k: int
    centres: np.ndarray
    inertia: float
    restart: int
    iterations: int


def _plus_plus(sample: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy distance-weighted seeding on the weighted candidates of one run, and a few steps of k-means on them."""
    tries = 2 + int(np.log(k))
    pick = lambda p, m: np.minimum(np.searchsorted(np.cumsum(p), rng.random(m) * p.sum()), len(p) - 1)
    centres = [sample[pick(weight, 1)[0]]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        mass = near * weight
        picks = pick(mass, tries) if mass.sum() > 0 else rng.integers(len(sample), size=tries)
        options = [np.minimum(near, ((sample - sample[p]) ** 2).sum(axis=1)) for p in picks]
        best = int(np.argmin([(o * weight).sum() for o in options]))
        centres.append(sample[picks[best]])
        near = options[best]
    centres = np.array(centres)
    for _ in range(10):
        own = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(k):
            if (mass := weight[own == c]).sum() > 0:
                centres[c] = (sample[own == c] * mass[:, None]).sum(axis=0) / mass.sum()
    return centres


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for every id, the same wherever the row is read."""
    h = np.uint64(0x9E3779B97F4A7C15)
    x = ids.astype(np.uint64)
    for v in salt:
        x = (x ^ (np.uint64(v + 1) * h)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _draw(points: DataFrame, known: dict[int, np.ndarray], draws: dict[int, int], dim: int, seed: int) -> dict[int, np.ndarray]:
    """For every run some rows drawn without replacement in proportion to the squared distance from its candidates (evenly
    while it has none): those with the smallest ``-log(u) / weight``. All rows take part, a task returns as few as are drawn."""
    names = sorted(draws)

    def run(batches):
        keep = {m: (np.zeros(0), np.zeros((0, dim))) for m in names}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x_all = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(x_all), CHUNK_ROWS):
                x, own = x_all[at:at + CHUNK_ROWS], ids[at:at + CHUNK_ROWS]
                sq = (x * x).sum(axis=1)
                for m in names:
                    mass = np.ones(len(x))
                    if len(known[m]):
                        c = known[m]
                        mass = np.maximum(((c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)).min(axis=1) + sq, 0.0)
                    with np.errstate(divide="ignore"):
                        key = np.where(mass > 0, -np.log(_uniform(own, seed, m, len(known[m]))) / mass, np.inf)
                    n = draws[m]
                    best = np.argpartition(key, n - 1)[:n] if n < len(key) else np.arange(len(key))
                    keys, rows = np.concatenate([keep[m][0], key[best]]), np.concatenate([keep[m][1], x[best]])
                    order = np.argsort(keys, kind="stable")[:n]
                    keep[m] = keys[order], rows[order]
        part = TaskContext.get().partitionId()
        for m in names:
            keys, rows = keep[m]
            ok = np.isfinite(keys)
            if ok.any():
                yield pa.RecordBatch.from_pydict({"m": pa.array([m] * int(ok.sum()), pa.int32()), "part": pa.array([part] * int(ok.sum()), pa.int32()), "key": pa.array(keys[ok]), "x": list_array(rows[ok])})

    most = max(draws.values())
    few = F.slice(F.sort_array(F.collect_list(F.struct("key", "x"))), 1, most)
    found = points.select("id", "x").mapInArrow(run, "m int, part int, key double, x array<double>").groupBy("m", (F.col("part") % 64).alias("part")).agg(few.alias("r"))
    found = found.select("m", F.explode("r").alias("r")).select("m", "r.*").groupBy("m").agg(few.alias("r"))
    return {r["m"]: np.array([c["x"] for c in r["r"][: draws[r["m"]]]], dtype=float).reshape(-1, dim) for r in found.collect()}


def _seeds(points: DataFrame, runs: dict[int, tuple[int, int]], dim: int, seed: int, tasks: int) -> dict[int, np.ndarray]:
    """Starting centres of all runs (k, restart): candidates from all rows in a few passes, weighted by the rows nearest to them."""
    known = {m: np.zeros((0, dim)) for m in runs}
    for turn in range(1 + SEED_ROUNDS):
        draws = {m: 1 if turn == 0 else SEED_DRAWS * k for m, (k, _) in runs.items()}
        for m, rows in _draw(points, known, draws, dim, seed).items():
            known[m] = np.concatenate([known[m], rows])
    weights = {m: np.array([n for n, _, _ in parts]) for m, parts in _pass(points, known, dim, tasks).items()}
    return {m: _plus_plus(known[m], weights[m], k, np.random.default_rng([seed, k, r])) for m, (k, r) in runs.items()}


def _pass(points: DataFrame, models: dict[int, np.ndarray], dim: int, tasks: int) -> dict[int, list[tuple[int, np.ndarray, float]]]:
    """One scan for all models: per model and centre ``(n, sum of vectors, sum of squared distances)``.

    A task returns one row per centre, however many rows it read; the rows of many tasks are added up before they are collected.
    """
    names = sorted(models)
    stacked = np.vstack([models[m] for m in names])
    starts = np.concatenate([[0], np.cumsum([len(models[m]) for m in names])])
    sq = (stacked * stacked).sum(axis=1)

    def run(batches):
        n, s, cost = np.zeros(len(stacked)), np.zeros((len(stacked), dim)), np.zeros(len(stacked))
        seen = False
        for batch in batches:
            x_all = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(x_all), CHUNK_ROWS):
                x = x_all[at:at + CHUNK_ROWS]
                seen = True
                part = sq[None, :] - 2.0 * (x @ stacked.T)
                own = (x * x).sum(axis=1)
                for a, b in zip(starts[:-1], starts[1:]):
                    best = np.argmin(part[:, a:b], axis=1)
                    near = np.maximum(part[np.arange(len(x)), a + best] + own, 0.0)
                    n[a:b] += np.bincount(best, minlength=b - a)
                    cost[a:b] += np.bincount(best, near, minlength=b - a)
                    for t in range(dim):
                        s[a:b, t] += np.bincount(best, x[:, t], minlength=b - a)
        if seen:
            yield pa.RecordBatch.from_pydict({"c": pa.array(np.arange(len(stacked)), pa.int32()), "n": pa.array(n), "s": list_array(s), "cost": pa.array(cost)})

    found = points.select("x").mapInArrow(run, "c int, n double, s array<double>, cost double")
    if tasks > FEW_TASKS:
        found = found.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[t]) for t in range(dim)]).alias("s"), F.sum("cost").alias("cost"))
    got = found.toArrow().combine_chunks()
    c = got.column("c").to_numpy()
    n, cost = (np.bincount(c, got.column(v).to_numpy(), len(stacked)) for v in ("n", "cost"))
    sums = got.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    s = np.stack([np.bincount(c, sums[:, t], len(stacked)) for t in range(dim)], axis=1)
    return {m: [(n[c], s[c], cost[c]) for c in range(a, b)] for m, a, b in zip(names, starts[:-1], starts[1:])}


def fit_grid(df: DataFrame, ks: Sequence[int], restarts: int = 10, max_iter: int = 1000, tol: float = 1e-4, seed: int = 42, key: str = "row_id", vec: str = "x") -> dict[int, KMeansModel]:
    """The best of ``restarts`` runs for every k. All (k, restart) runs advance in the same scan, so the
    data is read once per iteration, not once per run and iteration; a run leaves when it has converged.

    ``tol`` is relative to the mean variance of the columns. An emptied centre stays where it was.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("x"))
    dim = rows.select(F.max(F.size("x"))).first()[0]
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[t]).alias(f"m{t}") for t in range(dim)], *[F.var_pop(F.col("x")[t]).alias(f"v{t}") for t in range(dim)]).first()
    n, mean = facts["n"], np.array([facts[f"m{t}"] for t in range(dim)])
    limit = tol * float(np.mean([facts[f"v{t}"] for t in range(dim)]))
    # Distances are taken on centred rows, so that an offset of the data costs no digits.
    points = cut(rows.select("id", F.array(*[F.col("x")[t] - float(mean[t]) for t in range(dim)]).alias("x")))
    points = points.coalesce(max(1, min(points.rdd.getNumPartitions(), n // TASK_ROWS))) if n < TASK_ROWS * parallelism(df.sparkSession) else points
    runs = dict(enumerate((k, r) for k in ks for r in range(restarts)))
    tasks = points.rdd.getNumPartitions()
    centres = _seeds(points, runs, dim, seed, tasks)
    active, steps = dict(centres), dict.fromkeys(centres, 0)
    for _ in range(max_iter):
        if not active:
            break
        for m, parts in _pass(points, active, dim, tasks).items():
            old = active[m]
            new = np.array([s / c if c else old[i] for i, (c, s, _) in enumerate(parts)])
            centres[m] = new
            steps[m] += 1
            if ((new - old) ** 2).sum() <= limit:
                del active[m]
            else:
                active[m] = new
    costs = {m: sum(c for _, _, c in parts) for m, parts in _pass(points, centres, dim, tasks).items()}
    best = {}
    for m, (k, r) in runs.items():
        if k not in best or costs[m] < best[k].inertia:
            ordered = (centres[m] + mean)[np.lexsort(centres[m].T[::-1])]
            best[k] = KMeansModel(k, ordered, costs[m], r, steps[m])
    return best


def assign_expr(vec: str | Column, centres: np.ndarray) -> Column:
    """Index of the nearest centre, the lowest on ties."""
    c = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in centres])
    scored = F.transform(c, lambda v, i: F.struct(sq_gap(vec, v).alias("d2"), i.alias("c")))
    return F.array_min(scored)["c"].cast("int")


def assign(df: DataFrame, models: dict[str, np.ndarray], vec: str = "x") -> DataFrame:
    """Add one cluster column per named set of centres."""
    return df.withColumns({name: assign_expr(vec, c) for name, c in models.items()})


def lloyd_step(df: DataFrame, centres: np.ndarray, vec: str = "x") -> DataFrame:
    """``(cluster, n, c1, ..., cd)``: the centres after one reassignment."""
    return df.groupBy(assign_expr(vec, centres).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(vec)[t]).alias(f"c{t + 1}") for t in range(centres.shape[1])]
    )


# The metrics that models are compared by.
GRID_METRICS = ["inertia", "silhouette", "davies_bouldin", "calinski_harabasz", "ari", "nmi", "dunn"]


def label_metrics(df: DataFrame, labels: dict[str, str], target: str | None = None, key: str = "row_id", vec: str = "x", without: Sequence[str] = ()) -> DataFrame:
    """Long ``(model, metric, value)`` for several label columns of one point table.

    ``labels`` maps a model name to its column. The quadratic metrics share one pass over the distances,
    the linear ones one aggregate keyed by model. Metrics named in ``without`` are not worked out.
    """
    cols = list(labels.values())
    names = F.create_map(*[F.lit(v) for c in labels.items() for v in (c[1], c[0])])
    dim = df.select(F.max(F.size(vec))).first()[0]
    base = cut(df.select(F.col(key).alias("row_id"), F.col(vec).alias("x"), *cols, *([F.col(target).alias("y")] if target else [])))
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("cluster")) for m, c in labels.items()]))
    long = base.select("x", *(["y"] if target else []), one.alias("m")).select("x", *(["y"] if target else []), "m.model", "m.cluster")
    moments = cut(validate.cluster_moments(long, "cluster", "x", ["model"], dim))
    made = {
        "inertia": lambda: validate.inertia(moments, ["model"]).unpivot(["model"], ["inertia"], "metric", "value"),
        "davies_bouldin": lambda: validate.davies_bouldin(moments, ["model"]).unpivot(["model"], ["davies_bouldin"], "metric", "value"),
        "calinski_harabasz": lambda: validate.calinski_harabasz(moments, ["model"], dim).unpivot(["model"], ["calinski_harabasz"], "metric", "value"),
        "silhouette": lambda: validate.silhouette(base, cols).select(names[F.col("model")].alias("model"), F.lit("silhouette").alias("metric"), F.col("silhouette").alias("value")),
        "dunn": lambda: validate.dunn(base, cols).select(names[F.col("model")].alias("model"), F.lit("dunn").alias("metric"), F.col("dunn").alias("value")),
    }
    parts = [one() for metric, one in made.items() if metric not in without]
    if target:
        parts.append(validate.agreement(long, "cluster", "y", ["model"]).unpivot(["model"], ["ari", "nmi"], "metric", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_metrics(df: DataFrame, models: dict[int, KMeansModel], target: str | None = None, key: str = "row_id", vec: str = "x") -> DataFrame:
    """Long ``(k, metric, value)`` over a fitted grid."""
    labelled = assign(df, {f"k{k}": m.centres for k, m in models.items()}, vec)
    long = label_metrics(labelled, {str(k): f"k{k}" for k in models}, target, key, vec)
    return long.select(F.col("model").cast("int").alias("k"), "metric", "value")


def elbow(grid: DataFrame, metric: str = "inertia") -> DataFrame:
    """``(k, value, drop, bend)``: first and second differences along k (as many rows as the grid)."""
    w = Window.partitionBy("metric").orderBy("k")
    one = grid.filter(F.col("metric") == metric).withColumn("drop", F.lag("value").over(w) - F.col("value"))
    return one.withColumn("bend", F.col("drop") - F.lead("drop").over(w)).select("k", "value", "drop", "bend")


# The criteria that choose k and whether a larger value is better.
K_CRITERIA = [("silhouette", True), ("calinski_harabasz", True), ("davies_bouldin", False)]


def select_k(grid: DataFrame) -> DataFrame:
    """``(metric, k, value)``: the best k per criterion, the smallest on ties, NULL values skipped."""
    up = F.create_map(*[F.lit(v) for m, b in K_CRITERIA for v in (m, 1.0 if b else -1.0)])
    scored = grid.filter(F.col("metric").isin([m for m, _ in K_CRITERIA]) & F.col("value").isNotNull() & ~F.isnan("value"))
    best = scored.groupBy("metric").agg(F.max(F.struct((F.col("value") * up[F.col("metric")]).alias("s"), (-F.col("k")).alias("nk"), "value")).alias("b"))
    return best.select("metric", (-F.col("b.nk")).alias("k"), F.col("b.value").alias("value"))


def centroid_table(spark: SparkSession, centres: np.ndarray, pca: PcaModel, scaler: dict[str, Scale]) -> DataFrame:
    """``(cluster, variable, z, value)``: centres taken back through PCA (missing scores as 0) to z-scores
    and to original units. Model-sized."""
    z = centres @ pca.components[:, : centres.shape[1]].T + pca.mean
    rows = [
        (c, v, float(z[c, i]), float(z[c, i] * (scaler[v].std or 1.0) + scaler[v].mean))
        for c in range(len(centres)) for i, v in enumerate(pca.variables)
    ]
    return spark.createDataFrame(rows, "cluster int, variable string, z double, value double")


def top_variables(centroids: DataFrame, n: int = 5) -> DataFrame:
    """``(cluster, rank, variable, z)``: the variables with the largest ``|z|`` per centre."""
    order = Window.partitionBy("cluster").orderBy(F.abs("z").desc(), "variable")
    return centroids.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("cluster", "rank", "variable", "z")


def scatter(points: DataFrame, label: str = "cluster", centres: np.ndarray | None = None, key: str = "row_id") -> DataFrame:
    """Cluster plot data ``(kind, row_id, d1, d2, cluster, is_noise)``; centres are extra rows."""
    rows = points.select(F.lit("point").alias("kind"), F.col(key).alias("row_id"), F.col("x")[0].alias("d1"), F.col("x")[1].alias("d2"), F.col(label).cast("int").alias("cluster"), (F.col(label) == -1).alias("is_noise"))
    if centres is None:
        return rows
    extra = [("centre", None, float(c[0]), float(c[1]), i, False) for i, c in enumerate(centres)]
    return rows.unionByName(points.sparkSession.createDataFrame(extra, "kind string, row_id bigint, d1 double, d2 double, cluster int, is_noise boolean"))
