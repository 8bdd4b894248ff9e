"""Whitening of embeddings by shifted CholeskyQR.

Vectors are taken to whole numbers x = floor(256 * entry). The fit list holds each distinct x once. Its centred rows A are
orthogonalised by passes over the table: a pass adds up the Gram matrix of the rows (after triangular solves with the factors
found so far), and its Cholesky factor is the next one. The first Gram matrix, and every one that has no factor, gets a shift
on its diagonal. The product R of the factors has the singular values and right vectors of A, without ever squaring what
condition A has: components are the right vectors of R, eigenvalues of the covariance its squared singular values over n.

Rows whose vector is NULL, empty or of another length than most (the longer of two as frequent), or holds NULL or non-finite
entries, give no result. Repeated vectors count once in the fit and are all whitened; a NULL vec_id is kept. Components that
the data do not span give no rows (all of them where all vectors are equal); among equal eigenvalues any basis is right, and
all rows use the same. A deviation beyond 64 bits is NULL. Other columns are not read; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

SCALE = 256
COMPONENTS = 4
#: Orthogonality that ends the passes (one more factor then takes it to rounding), and how many passes there may be.
NEAR_IDENTITY = 1e-8
PASSES = 9
#: Entries of vectors that a task works on at once.
BLOCK = 1 << 21
#: Tasks' sums are added up in two stages, the first in so many groups.
SALT = 32
_U = np.finfo(np.float64).eps / 2


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that count, written once."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.size("embedding") > 0).where(finite)
    rows = cut(rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long")).alias("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    return rows.where(F.size("x") == sizes[0].d) if len(sizes) > 1 else rows


def _matrices(batch: pa.RecordBatch):
    """The vectors of a batch as matrices of about BLOCK entries."""
    column = batch.column("x")
    d = len(column[0]) if batch.num_rows else 1
    for at in range(0, batch.num_rows, max(1, BLOCK // d)):
        part = column.slice(at, max(1, BLOCK // d))
        yield at, np.asarray(part.flatten()).reshape(len(part), d)


@dataclass
class Centre:
    """n vectors with sums S = n * q + r of each dimension, 0 <= r < n, as exact integers."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.q, r = (np.array(v, dtype=object) for v in zip(*(divmod(s, self.n) for s in self.sums)))
        self.q, self.r = self.q.astype(np.int64), r
        self.rest = (r / self.n).astype(np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is subtracted exactly, so a common offset of any size costs no digits."""
        return (x - self.q).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row, exactly."""
        u = x - self.q
        largest, d = int(np.abs(u).max(initial=0)), x.shape[1]
        if d * largest * max(largest, self.n) >= 1 << 62:
            u = u.astype(object)
        r = self.r.astype(np.int64) if u.dtype == np.int64 else self.r
        squares, mixed, own = (u * u).sum(1).tolist(), (u * r).sum(1).tolist(), sum(int(v) ** 2 for v in self.r)
        out = [self.n * (self.n * a - 2 * b) + own for a, b in zip(squares, mixed)]
        return [v if v < 1 << 63 else None for v in out]


def centre_of(fit: DataFrame) -> Centre | None:
    """The centre of a table of vectors; None without rows. Sums are exact: halves of 32 bits are added up apart."""

    def scan(batches):
        low = high = None
        for batch in batches:
            for _, x in _matrices(batch):
                lo, hi = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
                low, high = (lo, hi) if low is None else (low + lo, high + hi)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(high), pa.array(low)], ["i", "high", "low"])

    n = fit.count()
    parts = fit.mapInArrow(scan, "i int, high long, low long").groupBy("i")
    wide = parts.agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).orderBy("i").collect()
    return Centre(n, [(int(r.high) << 32) + int(r.low) for r in wide]) if n else None


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 for an upper triangle r, column by column."""
    out = np.empty_like(a)
    for j in range(a.shape[1]):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: DataFrame, rows: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The d x d Gram matrix of ``rows(x)`` over the table: summed in tasks, then in two stages."""

    def scan(batches):
        total = np.zeros((d, d))
        for batch in batches:
            for _, x in _matrices(batch):
                a = rows(x)
                total += a.T @ a
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([part % SALT] * d, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "salt", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    parts = fit.mapInArrow(scan, "i int, salt int, v array<double>")
    parts = parts.groupBy("i", "salt").applyInPandas(add, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    out = np.zeros((d, d))
    for r in parts.collect():
        out[r.i] = r.v
    return out


def _factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix, of the shifted one where asked for or needed."""
    d = len(g)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (d * min(n, 1 << 16) + d * (d + 1)) * _U * max(np.trace(g), np.finfo(np.float64).tiny)
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows: the product of the factors of all passes."""
    d = len(centre.sums)
    factors: list[np.ndarray] = []

    def rows(x: np.ndarray) -> np.ndarray:
        a = centre(x)
        for r in factors:
            a = solve(a, r)
        return a

    whole = np.eye(d)
    for k in range(PASSES):
        g = gram(fit, rows, d)
        if k and np.abs(g - np.eye(d)).max() <= NEAR_IDENTITY:
            return np.linalg.cholesky(g).T @ whole
        if k == PASSES - 1 or not g.any():  # directions without any length: the root of the Gram matrix does in place of a factor
            value, vector = np.linalg.eigh(g)
            return np.sqrt(np.maximum(value, 0))[:, None] * vector.T @ whole
        factors.append(_factor(g, centre.n, not k))
        whole = factors[-1] @ whole
    return whole


@dataclass
class Whitening:
    """Unit ``components`` (a column each) by falling ``values``, their shares of the trace, and how far the covariance of what
    they whiten is from the identity."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows`` (``x``); None without any."""
    own = cut(rows.select("x").distinct())
    centre = centre_of(own)
    if centre is None:
        return None
    r = triangle(own, centre)
    _, s, vt = np.linalg.svd(r)
    there = int((s > 4 * len(s) * _U * s[0]).sum()) if s[0] > 0 else 0
    k = min(components, there)
    vectors = vt[:k].T * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(1)])
    out = Whitening(centre, vectors, s[:k] ** 2 / centre.n, s[:k] ** 2 / max((s * s).sum(), np.finfo(np.float64).tiny))
    if k:
        out.identity_error = float(np.abs(gram(own, lambda x: out.rows(x), k) / centre.n - np.eye(k)).max())
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every vector that counts and every component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(embeddings, scale)
    model = fit(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        k = len(model.values)
        for batch in batches:
            for at, x in _matrices(batch):
                m = len(x)
                ids = batch.column("vec_id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                own = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.centre.n)), deviation, pa.array(model.rows(x).ravel())]
                own += [pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(own, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(scan, schema)
