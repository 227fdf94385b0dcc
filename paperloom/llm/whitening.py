"""Whitening of embeddings by QDWH spectral divide and conquer.

Spark sums the covariance of the distinct rounded vectors in whole numbers. Its eigenvectors come
from polar decompositions: the polar factor of the covariance, shifted by a number between two
eigenvalues, is the sign of that matrix; half of it plus the identity is the projector on the upper
invariant subspace. The matrix is split along both subspaces, and so on until every block is one
component. Only matrices of the vectors' dimension reach the driver and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors become whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rounded entries stay below this, so that they fit a long with room for the offset.
LARGEST = 2.0**62
#: Components returned.
COMPONENTS = 16
_EPS = np.finfo(float).eps


# Spectral divide and conquer ---------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by dynamically weighted Halley steps in
    their QR form, which need no inverse and converge in about six steps."""
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(len(a))
    x, low = a / norm, _EPS
    one = np.eye(len(a))
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        p, q = h, (h - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
        then = (q / r) * x + (p - q / r) / np.sqrt(r) * both[: len(a)] @ both[len(a) :].T
        moved = np.linalg.norm(then - x)
        x = then
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if moved <= 10 * _EPS * np.sqrt(len(a)) and low >= 1 - 1e-8:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two complementary invariant subspaces of a symmetric matrix, the upper
    eigenvalues first; None if no shift tells its eigenvalues apart."""
    k = len(a)
    bound = np.abs(a).sum(1) - np.abs(np.diag(a))
    low, high = float((np.diag(a) - bound).min()), float((np.diag(a) + bound).max())
    scale = max(abs(low), abs(high))
    shift = float(np.median(np.diag(a)))
    for _ in range(200):
        if high - low <= 4 * k * _EPS * scale:
            return None
        sign = polar(a - shift * np.eye(k))
        projector = (np.eye(k) + (sign + sign.T) / 2) / 2
        rank = int(round(np.trace(projector)))
        clean = np.linalg.norm(projector @ projector - projector) <= 1e-10 * np.sqrt(k)
        if clean and 0 < rank < k:
            # The projector's columns span the upper subspace; a random mix of them is well conditioned.
            mix = np.random.default_rng(k).standard_normal((k, k))
            upper, _ = np.linalg.qr(projector @ mix[:, :rank])
            upper, _ = np.linalg.qr(projector @ upper)
            rest = np.eye(k) - projector
            lower, _ = np.linalg.qr(rest @ mix[:, rank:])
            lower, _ = np.linalg.qr(rest @ lower - upper @ (upper.T @ (rest @ lower)))
            return upper, lower
        if not clean:  # the shift is an eigenvalue, or next to one
            shift += (high - low) * 2.0**-10 * (1 if shift < (low + high) / 2 else -1) * 0.618
        elif rank == 0:
            high, shift = min(high, shift), (low + min(high, shift)) / 2
        else:
            low, shift = max(low, shift), (max(low, shift) + high) / 2
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    scale = np.linalg.norm(a)

    def solve(block: np.ndarray, basis: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        k = len(block)
        off = np.linalg.norm(block - np.diag(np.diag(block)))
        parts = None if k == 1 or off <= k * _EPS * scale else _split((block + block.T) / 2)
        if parts is None:  # one component, or equal eigenvalues: any basis of them will do
            yield from zip(np.diag(block), basis.T)
            return
        for part in parts:
            yield from solve(part.T @ block @ part, basis @ part)

    found = sorted(solve(a, np.eye(len(a))), key=lambda x: -x[0])
    vectors, r = np.linalg.qr(np.array([v for _, v in found]).T)
    vectors = vectors * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# The fit -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitener:
    """What rows are whitened with: n and S of the fit list, a whole-number centre near S / n,
    eigenvalues and eigenvectors of the covariance, and the measured error."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])
        y = (x - self.centre).astype(float) - rest
        e = self.values[:most]
        live = e > len(self.values) * _EPS * max(float(self.values[0]), 0.0)
        return np.where(live, (y @ self.vectors[:, :most]) / np.sqrt(np.where(live, e, 1.0)), 0.0)


def rounded(docs: DataFrame, vector: str) -> DataFrame:
    """The rows that can be whitened, with their whole-number vector ``x`` as the first column."""
    entry = F.col(vector)
    value = lambda c: c.cast("double")
    good: Column = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) * SCALE < LARGEST))
    x = F.transform(entry, lambda c: F.floor(value(c) * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    return docs.filter(entry.isNotNull() & (F.size(entry) > 0) & good).select(x.alias("x"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by floating point where all partial sums are exact, else by integers of any size."""
    most = int(np.abs(y).max(initial=0))
    if most**2 >= 2**53:
        big = y.astype(object)
        return big.T @ big
    step = max(1, 2**53 // max(1, most**2))
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(float)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _summed(fit: DataFrame, make, kind: str) -> dict[int, object]:
    """Sums over the fit list of what ``make`` gives for a matrix of vectors, by position: one row for
    each position and task, added up by Spark."""
    arrow = pa.decimal128(38, 0) if kind == "decimal(38,0)" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0), len(batch.column(0)[0])))
                total = part if total is None else total + part
        if total is not None:
            flat = [Decimal(int(v)) for v in total] if arrow != pa.float64() else [float(v) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, arrow)], names=["at", "v"])

    rows = fit.select("x").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return {r["at"]: r["v"] for r in rows}


def learn(docs: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitener | None:
    """Fit on every distinct rounded vector once; None if no row has one.

    Vectors of another length than the most frequent one (of equally frequent ones, the longest)
    have no place in the covariance and are left out, like null vectors.
    """
    rows = rounded(docs, vector)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    dim = sizes["d"]
    fit = written(rows.filter(F.size("x") == dim).select("x").distinct(), "fit")
    n = fit.count()
    found = _summed(fit, lambda x: x.astype(object).sum(0), "decimal(38,0)")
    sums = [int(found[i]) for i in range(dim)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(centre, np.int64)
    found = _summed(fit, lambda x: _gram(x - middle).ravel(), "decimal(38,0)")
    rest = [s - n * c for s, c in zip(sums, centre)]
    # n * sum(y y') - (sum y)(sum y)' is a whole number, so nothing is lost to cancellation.
    cov = np.array([[(n * int(found[i * dim + j]) - rest[i] * rest[j]) / n**2 for j in range(dim)] for i in range(dim)], float)
    values, vectors = components(cov)
    trace = float(np.trace(cov))
    explained = values / trace if trace > 0 else np.zeros(dim)
    model = Whitener(n, sums, middle, values, vectors, explained, 0.0)
    kept = min(most, dim)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def moments(x: np.ndarray) -> np.ndarray:
        w = shared.value.whitened(x, kept)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = _summed(fit, moments, "double")
    mean = np.array([found[i] for i in range(kept)]) / n
    second = np.array([found[kept + i] for i in range(kept * kept)]).reshape(kept, kept) / n - np.outer(mean, mean)
    live = values[:kept] > dim * _EPS * max(float(values[0]), 0.0)
    error = float(np.abs((second - np.eye(kept))[np.ix_(live, live)]).max()) if live.any() else 0.0
    return Whitener(n, sums, middle, values, vectors, explained, error)


def _deviation(x: np.ndarray, n: int, sums: list[int], centre: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S)^2 in whole numbers; None where it doesn't fit a long."""
    y = x - centre
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if most**2 * max(1, len(sums)) < 2**63:
        return (((n * y) - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    total = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in total]


def whiten(docs: DataFrame, model: Whitener | None, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row that has a
    vector and every component up to ``most``.

    Rows whose vector is null, empty or of another length than the fitted ones, or holds null,
    non-finite or too large entries (64 times them passes 2^62) give nothing; an empty table gives
    no rows. Repeated rows and ids are whitened each; a null id stays null. Equal eigenvalues are
    numbered in any order, the same for all rows. A component without variance is 0 everywhere and
    stays out of ``identity_error``. A ``deviation`` that passes 63 bits is null. Other columns
    aren't looked at.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    rows = rounded(docs.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")), "v").filter(F.size("x") == len(model.sums)).select("x", F.col("c0").alias("id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kept = min(most, len(m.sums))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), len(m.sums))
            count = len(x)
            ids = batch.column(1).take(pa.array(np.repeat(np.arange(count), kept)))
            deviation = pa.array(_deviation(x, m.n, m.sums, m.centre), pa.int64()).take(pa.array(np.repeat(np.arange(count), kept)))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                pa.array(np.full(count * kept, m.n, np.int64)),
                deviation,
                pa.array(m.whitened(x, kept).ravel()),
                pa.array(np.tile(m.explained[:kept], count)),
                pa.array(np.full(count * kept, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
