"""Whitening of embeddings by principal components, found by QDWH spectral divide and conquer.

The covariance of the distinct vectors is one small matrix. Its shifted polar decomposition (QDWH: inverse-free
iterations of dynamically weighted Halley form) has the eigenvalues -1 and 1, so it gives the projector of the
subspace above the shift; the matrix is split along it and each part goes on by itself until the parts are
single components. Vectors are read from Spark in Arrow batches; every sum over them is a Spark aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors that a task multiplies at a time.
ROWS = 8192
#: Dimensions up to which matrices of the covariance's size go through the driver and are broadcast: 4096^2 doubles.
MOST_DIMENSIONS = 4096
#: Longs beyond this are held at it, so that differences of two stay longs.
MOST_LONG = 1 << 61
EPS = np.finfo(float).eps


def qdwh(a: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix: for one of full rank, its sign with eigenvalues -1 and 1."""
    n = len(a)
    size = np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())  # at least the 2-norm
    if not size:
        return np.eye(n)
    x, low = a / size, EPS  # low bounds the least singular value; too low a bound costs a round or two
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        w = np.sqrt(1 + d)
        p = w + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * w)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0]
        before, x = x, (q / r) * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if 1 - low < 10 * EPS and np.abs(x - before).max() < 1e-10:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the subspace of a's eigenvalues above a shift; None if a is c * I."""
    n, scale = len(a), np.abs(a).max()
    spread = np.abs(a - np.eye(n) * np.trace(a) / n).max()
    if spread <= 4 * n * EPS * scale:
        return None
    around = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = (np.diag(a) - around).min(), (np.diag(a) + around).max()  # all eigenvalues are between
    shift, rng, best = float(np.median(np.diag(a))), np.random.default_rng(n), None
    for _ in range(60):
        u = qdwh(a - shift * np.eye(n))
        k = round((n + np.trace(u)) / 2)
        if 0 < k < n:
            p = (u + np.eye(n)) / 2
            basis = np.linalg.qr(p @ rng.standard_normal((n, k)))[0]
            basis = np.linalg.qr(p @ basis, mode="complete")[0]
            left = np.abs(basis[:, :k].T @ a @ basis[:, k:]).max()
            if best is None or left < best[0]:
                best = left, basis, k
            if left <= 8 * n * EPS * scale:
                break
        # All eigenvalues are on one side, or one is at the shift itself.
        if k == n:
            low = max(low, shift)
        elif k == 0:
            high = min(high, shift)
        shift = low + (high - low) * (0.5 if k in (0, n) else rng.uniform(0.3, 0.7))
        if high - low <= 4 * EPS * max(abs(low), abs(high)):
            break
    return best and (best[1], best[2])


def components_of(v: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns, each with its greatest entry positive."""
    n = len(v)
    values, vectors, open_ = np.zeros(n), np.zeros((n, n)), [(v, np.eye(n), 0)]
    while open_:
        a, basis, at = open_.pop()
        found = _split(a) if len(a) > 1 else None
        if found is None:
            values[at : at + len(a)], vectors[:, at : at + len(a)] = np.diag(a), basis
            continue
        q, k = found
        for part, place in ((q[:, :k], at), (q[:, k:], at + k)):
            if most is None or place < most:
                own = part.T @ a @ part
                open_.append(((own + own.T) / 2, basis @ part, place))
    keep = n if most is None else min(most, n)
    order = np.argsort(-values[:keep], kind="stable")
    values, vectors = values[:keep][order], vectors[:, :keep][:, order]
    if keep:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(keep)] < 0, -1.0, 1.0)
    return values, vectors


@dataclass
class Model:
    """What the fit list gives: its size, exact sums, components with their variances and share, and how white it becomes."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null where it is no long."""
        far = max((int(np.abs(x - self.sums // self.n).max()) + 1) * self.n, 1) if x.size else 1
        if far * far * max(1, x.shape[1]) < 1 << 62:
            apart = self.n * (x - self.sums // self.n) - self.sums % self.n
            return (apart * apart).sum(1).tolist()
        apart = x.astype(object) * self.n - self.sums.astype(object)
        return [y if y < 1 << 63 else None for y in (apart * apart).sum(1)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the difference of whole numbers first, so that nothing of a large mean is lost."""
    return (x - sums // n).astype(float) - (sums % n) / n


def _matrices(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            yield part, part.column(column).flatten().to_numpy().reshape(len(part), d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for _, x in _matrices(batches, 0, d):
            n += len(x)
            sums = [s + int(y) for s, y in zip(sums, x.sum(0) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums])], names=["i", "n", "s"])

    return run


def _products(d: int, project):
    """Upper triangle of the sum of products of each task's projected vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0, d):
            y = project(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def _covariance(fit: DataFrame, d: int, n: int, size: int, project) -> np.ndarray:
    cells = fit.mapInArrow(_products(d, project), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    i, j, v = (cells.column(k).to_numpy() for k in range(3))
    out[i, j] = out[j, i] = v / n
    return out


def whole_numbers(vectors: DataFrame, id_column: str, column: str, scale: float, offset: int) -> DataFrame:
    """(id, x) of vectors without null or non-finite entries: x = floor(scale * c) + offset of each entry c."""
    able = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.lit(float(-MOST_LONG)), F.least(F.lit(float(MOST_LONG)), F.floor(F.lit(scale) * c).cast("double"))).cast("bigint") + F.lit(offset)
    return vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v")).filter(able).select("id", F.transform("v", held).alias("x"))


def fit_whitening(x: DataFrame, d: int, most: int = 16) -> Model:
    """Components of the distinct vectors x, `most` at most; those whose variance is nothing but rounding are left out."""
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; {MOST_DIMENSIONS} at most")
    fit = written(x.select("x").distinct(), "fit")
    totals = fit.mapInArrow(_sums(d), "i int, n bigint, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    n, sums = totals[0].n, [int(r.s) for r in totals]
    sums = np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)
    v = _covariance(fit, d, n, d, lambda y: centred(y, n, sums))
    values, vectors = components_of(v, most)
    real = values > d * EPS * max(np.trace(v), 0) if d else values > 0
    model = Model(n, sums, vectors[:, real], values[real], float(np.trace(v)))
    k = int(real.sum())
    if k:
        model.identity_error = float(np.abs(_covariance(fit, d, n, k, model.whitened) - np.eye(k)).max())
    return model


def _apply(model, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m.values)
        for batch, x in _matrices(batches, 1, d):
            again = lambda y: np.repeat(np.arange(len(y)), k)
            white, apart = m.whitened(x), pa.array(m.deviations(x), pa.int64())
            columns = [batch.column(0).take(pa.array(again(x))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), m.n, np.int64)), apart.take(pa.array(again(x))), pa.array(white.ravel())]
            columns += [pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(k * len(x), m.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component, `most` at most.

    Vectors that are null, empty or hold null or non-finite entries are dropped; so are those of another length than
    most vectors have (of lengths that tie, the greatest counts). Entries become x = floor(scale * c) + offset; the
    fit list is each distinct x once, so repeated rows weigh nothing but are returned each. Components fall by
    variance, of equal variances in any order; those without variance (as all are where there is one distinct vector)
    have no rows. deviation is null where it is no long. Null ids stay. Empty table, or no vector left: no rows.
    Other columns are ignored.
    """
    x = whole_numbers(vectors, id_column, column, scale, offset)
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    x = x.filter(F.size("x") == d)
    model = fit_whitening(x, d, most) if d else Model(0, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not len(model.values):
        return x.sparkSession.createDataFrame([], schema)
    return x.mapInArrow(_apply(x.sparkSession.sparkContext.broadcast(model), d), schema)
