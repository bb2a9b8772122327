"""Whitening vectors on the leading components of their covariance, found by spectrum slicing.

Spark makes the distinct vectors, their sums and their centred products, each task summing up its own rows, so that d x d
numbers reach the driver however many vectors there are. There the pivots of an LDL^T factorisation of V - s I (by Sylvester's law as
many positive ones as V has eigenvalues above s) tell how many eigenvalues lie above any s: bisection with these counts
gives each leading eigenvalue an interval of its own, Rayleigh quotient iteration converges in it, and counts on both sides
of what it finds certify its number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS, SCALE = 4, 256
EPS = float(np.finfo(float).eps)
LONG = (1 << 63) - 1
#: Where Bunch and Parlett's pivoting takes a block of two.
ALPHA = (1 + math.sqrt(17)) / 8


def above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are above ``s``: the positive pivots of the LDL^T of v - s I."""
    a, count = v - s * np.eye(len(v)), 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, 0)
        i, (r, c) = int(diagonal.argmax()), divmod(int(size.argmax()), len(a))
        if max(diagonal[i], size[r, c]) == 0:
            break
        pivot = [i] if diagonal[i] >= ALPHA * size[r, c] else [r, c]  # a block of two has an eigenvalue of either sign
        count += len(pivot) == 2 or a[i, i] > 0
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return count


def _solved(v: np.ndarray, s: float, y: np.ndarray, norm: float) -> np.ndarray:
    while True:
        try:
            z = np.linalg.solve(v - s * np.eye(len(v)), y)
            if np.isfinite(z).all():
                return z
        except np.linalg.LinAlgError:
            pass
        s += 2 * EPS * norm


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of the positive semidefinite ``v``, falling, and unit eigenvectors as columns; the
    largest entry of a vector is positive. Eigenvalues that rounding can't tell from zero are left out."""
    d, norm = len(v), float(np.abs(v).sum(1).max(initial=0))
    tol = 8 * d * EPS * norm
    counts = {-tol - norm * EPS: d, norm * (1 + 4 * EPS) + tol: 0}
    values: list[float] = []
    vectors = np.zeros((d, 0))
    rng = np.random.default_rng(0)
    for j in range(1, min(k, d) + 1 if norm else 1):
        found = None
        while found is None:
            low = max(s for s, c in counts.items() if c >= j)
            high = min(s for s, c in counts.items() if c < j)
            if counts[low] - counts[high] == 1 or high - low <= tol:
                found = _iterated(v, low, high, vectors, tol, norm, rng)
            if found is not None:
                value = found[0]
                for s in (value - 4 * tol, value + 4 * tol):
                    counts.setdefault(s, above(v, s))
                if not (counts[value - 4 * tol] >= j > counts[value + 4 * tol]):
                    found = None
            if found is None:
                if high - low <= tol:
                    raise ArithmeticError(f"eigenvalue {j} in ({low}, {high}) does not converge")
                s = (low + high) / 2
                counts[s] = above(v, s)
        if found[0] <= 4 * tol:
            break
        values.append(found[0])
        vectors = np.column_stack([vectors, found[1] * np.sign(found[1][np.abs(found[1]).argmax()])])
    return np.array(values), vectors


def _iterated(v, low, high, known, tol, norm, rng) -> tuple[float, np.ndarray] | None:
    """The eigenpair in (low, high), orthogonal to ``known``; None where the iteration leaves the interval."""
    y, s = rng.standard_normal(len(v)), (low + high) / 2
    for step in range(40):
        y = _solved(v, s, y, norm)
        for _ in range(2):
            y = y - known @ (known.T @ y)
            y /= np.linalg.norm(y)
        value = float(y @ v @ y)
        inside = low - tol <= value <= high + tol
        if np.linalg.norm(v @ y - value * y) <= tol:
            return (value, y) if inside else None
        if step >= 2:  # the first steps keep the middle as shift and so turn to what lies in the interval
            if not inside:
                return None
            s = value
    return None


def usable(vectors: DataFrame, col: str = "embedding") -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    odd = F.exists(col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.coalesce(odd, F.lit(True))


def whole_numbers(col: str = "embedding", scale: int = SCALE) -> Column:
    return F.transform(col, lambda c: F.floor(c.cast("double") * scale))


def _matrix(batch: pa.RecordBatch, d: int, col: str) -> np.ndarray:
    return batch.column(col).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _most(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: the fit list's size and sums, eigenvalues, eigenvectors as columns, and measures of it."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of the rows of ``x``."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null beyond a long."""
        d = len(self.sums)
        if d * (self.n * _most(x) + max(map(abs, self.sums))) ** 2 <= LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [y if y <= LONG else None for y in exact.tolist()]


def _summed(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    def run(batches):
        total, n = [0] * d, 0
        for batch in batches:
            x = _matrix(batch, d, "x")
            sums = (x if _most(x) * max(len(x), 1) <= LONG else x.astype(object)).sum(0)
            total, n = [a + int(b) for a, b in zip(total, sums, strict=True)], n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * d, pa.int64())], names=["i", "s", "n"])

    got = rows.mapInArrow(run, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (got[0]["n"], tuple(int(r["s"]) for r in got)) if got else (0, (0,) * d)


def _products(rows: DataFrame, d: int, k: int, of) -> np.ndarray:
    """The k x k sums of products of the columns that ``of`` makes of the rows' matrix. Each task adds up its own rows."""
    i, j = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            y = of(_matrix(batch, d, "x"))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((k, k))
    for r in rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(numbers: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` (array<long>) of ``numbers``, all of one size; None where there is none or
    none of them varies."""
    distinct = written(numbers.select("x").distinct(), "whitening")
    first = distinct.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, sums = _summed(distinct, d)
    mean = np.array([s / n for s in sums])
    v = _products(distinct, d, d, lambda x: x - mean) / n
    values, vectors = leading(v, components)
    if not len(values):
        return None
    found = Whitening(n, sums, values, vectors, values / np.trace(v), 0.0)
    k = len(values)
    error = float(np.abs(_products(distinct, d, k, found.project) / n - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, found.explained, error)


def whiten(vectors: DataFrame, col: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Null vectors and those with null or non-finite entries are dropped, so are empty ones and those that have not as many entries as most
    (of equally frequent sizes the greater). Repeated vectors count once in the fit. Components whose eigenvalue is zero to
    rounding have no rows, so equal or single vectors give none; an empty table gives an empty one. A deviation beyond a
    long is null. Of the input, only ``key`` and ``col`` are looked at.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    numbers = vectors.filter(usable(vectors, col)).select(F.col(key).alias("_key_of_vector"), whole_numbers(col, scale).alias("x"))
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = numbers.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    numbers = numbers.filter(F.size("x") == size["d"]) if size else numbers
    model = fit(numbers, components) if size else None
    if model is None:
        return spark.createDataFrame([], schema)
    d, k = size["d"], len(model.values)

    def run(batches):
        for batch in batches:
            x = _matrix(batch, d, "x")
            n = len(x)
            at = pa.array(np.repeat(np.arange(n), k))
            deviations = pa.array(model.deviations(x), pa.int64())
            cols = [batch.column("_key_of_vector").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, np.int64)), deviations.take(at),
                    pa.array(model.project(x).reshape(-1)), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.mapInArrow(run, schema)
