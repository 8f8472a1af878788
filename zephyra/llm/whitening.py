"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations on it.

Vectors become whole numbers, so sums over all of them are exact whatever the order of the tasks. A first pass sums each
dimension; a second one sums the products of the centred vectors: what is multiplied is a vector less the whole part of the
mean, and the part below one is taken off exactly. The covariance is factored as L L^T with pivoting, which tells the rank, and the columns
of the triangle L are rotated against each other until all are orthogonal: then their squared norms are the eigenvalues and the
normalised columns the components. Squares are never formed a second time, so small eigenvalues keep their digits.

What meets in one place has the size of the dimensions squared and does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that are multiplied at once.
ROWS = 4096
#: Whole numbers stop here, so that differences fit into 64 bits.
_MOST = 1 << 61
_SWEEPS = 60
_WIDE = pa.decimal128(38, 0)
_EXACT = Context(prec=60)


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x``: each component times ``scale``, rounded down, plus ``shift``. Vectors that are null or hold a null or a
    non-finite component are left out."""
    finite = f"{vector} is not null and forall({vector}, x -> coalesce(abs(cast(x as double)) < double('infinity'), false))"

    def whole(x: Column) -> Column:
        inside = F.greatest(F.least(x.cast("double") * scale, F.lit(float(_MOST))), F.lit(-float(_MOST)))
        return F.floor(inside).cast("long") + shift

    return rows.where(finite).select("vec_id", F.transform(F.col(vector), whole).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, _matrix(part, width)


def common_width(vectors: DataFrame) -> int:
    """The most frequent length; of equally frequent ones the greatest."""
    found = vectors.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found["width"] if found else 0


def _summed(parts: DataFrame) -> dict[int, list]:
    """Rows of numbers, added up by ``row``, element by element."""
    flat = parts.select("row", F.posexplode("numbers").alias("at", "value")).groupBy("row", "at").agg(F.sum("value").alias("value"))
    made = flat.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("numbers"))
    return {r["row"]: [x["value"] for x in r["numbers"]] for r in made.toLocalIterator()}


@dataclass
class Sums:
    """Of all vectors: how many, the sum of each dimension, and the greatest distance of a component from ``base``."""

    n: int
    sums: list[int]
    base: list[int]
    reach: int


def sums(vectors: DataFrame, width: int) -> Sums:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        low, high = np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
        for _, x in _blocks(batches, width):
            middle = x[0].copy()
            far = max(int(x.max()) - int(middle.min()), int(middle.max()) - int(x.min()))
            part = (x - middle).sum(axis=0).tolist() if far * len(x) < 2**63 else (x.astype(object) - middle.astype(object)).sum(axis=0).tolist()
            total = [t + p + len(x) * int(m) for t, p, m in zip(total, part, middle.tolist(), strict=True)]
            n += len(x)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            columns = [
                pa.array([n]), pa.array([[Decimal(t) for t in total]], pa.list_(_WIDE)),
                pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "total", "low", "high"])

    parts = vectors.select("x").mapInArrow(add, "n long, total array<decimal(38,0)>, low array<long>, high array<long>")
    found = parts.select("n", F.posexplode(F.arrays_zip("total", "low", "high")).alias("at", "s")).groupBy("at")
    rows = found.agg(F.sum("n").alias("n"), F.sum("s.total").alias("s"), F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    rows = sorted(rows.toLocalIterator(), key=lambda r: r["at"])
    if not rows:
        return Sums(0, [0] * width, [0] * width, 0)
    n, total = rows[0]["n"], [int(r["s"]) for r in rows]
    base = [t // n for t in total]
    reach = max(max(r["high"] - b, b - r["low"]) for r, b in zip(rows, base, strict=True))
    return Sums(n, total, base, reach)


def covariance(vectors: DataFrame, found: Sums) -> np.ndarray:
    """Covariance with divisor n. Sums of products are exact while they fit into 64 bits, else sums of doubles."""
    width, base = len(found.base), np.array(found.base)
    exact = found.reach**2 * found.n < 2**63
    rows = max(1, min(ROWS, 2**52 // max(found.reach**2, 1)))  # sums of products that are exact as doubles

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.int64 if exact else np.float64)
        for _, x in _blocks(batches, width, rows if exact else ROWS):
            y = (x - base).astype(np.float64)
            product = y.T @ y
            total += product.astype(np.int64) if exact else product
        numbers = pa.ListArray.from_arrays(pa.array(np.arange(width + 1, dtype=np.int32) * width), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), numbers], names=["row", "numbers"])

    kind = "long" if exact else "double"
    made = _summed(vectors.select("x").mapInArrow(multiply, f"row int, numbers array<{kind}>"))
    n, rest = found.n, [s - found.n * b for s, b in zip(found.sums, found.base, strict=True)]
    if exact:  # in whole numbers up to the one division
        rows = [[made[i][j] * n - rest[i] * rest[j] for j in range(width)] for i in range(width)]
        return np.array([[v / (n * n) for v in row] for row in rows])
    part = np.array(rest) / n
    return np.array([made[i] for i in range(width)]) / n - np.outer(part, part)


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``L`` and ``order`` with ``matrix[order][:, order] = L L^T``; L has as many columns as the matrix has rank."""
    left = matrix.copy()
    size = len(left)
    order, factor = np.arange(size), np.zeros((size, size))
    smallest = size * np.finfo(float).eps * float(np.diag(matrix).max(initial=0.0))
    for k in range(size):
        pivot = k + int(np.argmax(np.diag(left)[k:]))
        if left[pivot, pivot] <= smallest:
            return factor[:, :k], order
        if pivot != k:
            left[[k, pivot]], factor[[k, pivot]] = left[[pivot, k]], factor[[pivot, k]]
            left[:, [k, pivot]] = left[:, [pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        factor[k:, k] = left[k:, k] / np.sqrt(left[k, k])
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor``, rotated in pairs until all are orthogonal. Every round has disjoint pairs, so that it is one
    array operation; a sweep of rounds meets each pair once."""
    columns = factor.T.copy()  # a row is a column of the factor
    n = len(columns)
    players = list(range(n + n % 2))  # with a bye if odd
    tolerance = max(n, 1) * np.finfo(float).eps
    for _ in range(_SWEEPS):
        largest = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(players[:half], reversed(players[half:]), strict=True) if max(a, b) < n]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            a, b = columns[p], columns[q]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            norm = np.sqrt(aa * bb)
            size = np.divide(np.abs(ab), norm, out=np.zeros_like(ab), where=norm > 0)
            largest = max(largest, float(size.max()))
            turn = size > tolerance / n
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            sign = np.where(zeta >= 0, 1.0, -1.0)
            t = np.where(turn, sign / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            columns[p], columns[q] = c[:, None] * (a - t[:, None] * b), c[:, None] * (t[:, None] * a + b)
        if largest <= tolerance:
            break
    return columns.T


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above 0, falling, and unit eigenvectors as columns, of a symmetric matrix without negative ones."""
    factor, order = pivoted_cholesky(matrix)
    rotated = jacobi(factor)
    values = (rotated * rotated).sum(0)
    place = np.argsort(-values, kind="stable")
    vectors = np.zeros((len(matrix), len(values)))
    vectors[order] = rotated[:, place] / np.sqrt(values[place])
    return values[place], vectors


@dataclass
class Whitening:
    """What a fit gives: ``values`` and ``vectors`` (columns) of the first components, and the trace of the covariance."""

    found: Sums
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Vectors less their mean; the whole part is taken off exactly."""
        base, n = np.array(self.found.base), self.found.n
        part = np.array([(s - n * b) / n for s, b in zip(self.found.sums, self.found.base, strict=True)])
        return (x - base).astype(np.float64) - part

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each vector the sum of the squares of ``n x - sums``, in whole numbers of any size."""
        n, width = self.found.n, len(self.found.base)
        rest = [s - n * b for s, b in zip(self.found.sums, self.found.base, strict=True)]
        y = x - np.array(self.found.base)
        if n * (self.found.reach + 1) < 2**31 and width * (n * (self.found.reach + 1)) ** 2 < 2**63:
            far = n * y - np.array(rest)
            return (far * far).sum(axis=1).tolist()
        return [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Fit to all rows of ``vectors(vec_id, x)``, which have ``width`` components each."""
    found = sums(vectors, width)
    matrix = covariance(vectors, found) if found.n and width else np.zeros((width, width))
    values, columns = eigen(matrix)
    return Whitening(found, values[:components], columns[:, :components], float(np.trace(matrix)))


def identity_error(vectors: DataFrame, made: Whitening) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity, over all rows; their products are of centred
    vectors, and the mean that rounding leaves is taken off too."""
    width, k = len(made.found.base), len(made.values)
    if not k or not made.found.n:
        return 0.0
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(made)  # of the size of the dimensions squared

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((k + 1, k))
        for _, x in _blocks(batches, width):
            w = own.centred(x) @ own.scaled
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        numbers = pa.ListArray.from_arrays(pa.array(np.arange(k + 2, dtype=np.int32) * k), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), numbers], names=["row", "numbers"])

    rows = _summed(vectors.select("x").mapInArrow(multiply, "row int, numbers array<double>"))
    total = np.array([rows[i] for i in range(k + 1)]) / made.found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def transform(vectors: DataFrame, made: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened``: exact deviation (null beyond 38 digits) and the value of each component."""
    width, k = len(made.found.base), len(made.values)
    shared = vectors.sparkSession.sparkContext.broadcast(made)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, x in _blocks(batches, width):
            w = own.centred(x) @ own.scaled
            far = [_EXACT.create_decimal(d) if d < 10**38 else None for d in own.deviations(x)]
            edges = pa.array(np.arange(len(w) + 1, dtype=np.int32) * k)
            columns = [part.column("vec_id"), pa.array(far, _WIDE), pa.ListArray.from_arrays(edges, pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(
    rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> tuple[DataFrame, Whitening, float]:
    """``vec_id, deviation, whitened`` for ``rows(vec_id, vector)``, the fit, and the error of the identity.

    Vectors that are null or hold a null or non-finite component are left out, and so are those of another length than the most
    frequent one, of which no covariance exists. Repeated rows and null ids count and stay. The covariance has rank r;
    there are no components beyond r, so ``whitened`` may be shorter than ``components``; one vector, or equal ones, have none. An
    empty table gives no rows. A component times ``scale`` beyond 2**61 stops there. Other columns are not looked at.
    """
    vectors = whole_vectors(rows, vector, scale, shift)
    width = common_width(vectors)
    vectors = vectors.where(F.size("x") == width)
    made = fit(vectors, width, components)
    return transform(vectors, made), made, identity_error(vectors, made)


def by_component(found: DataFrame, made: Whitening, error: float, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component, from 1: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Every vector has as many components as it has dimensions, ``components`` at most. Those beyond the rank have an ``explained``
    of 0 (null if the trace is 0) and no ``whitened``. ``deviation`` is null if it exceeds 64 bits.
    """
    count = min(components, len(made.found.base))
    shares = [float(v / made.trace) for v in made.values] + [0.0 if made.trace > 0 else None] * (count - len(made.values))
    known: Column = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    padded = F.transform(F.sequence(F.lit(1), F.lit(max(count, 1))), lambda c: F.get("whitened", c - 1))
    at = F.posexplode(F.arrays_zip(padded.alias("whitened"), known.alias("explained"))).alias("at", "own")
    return found.where(F.lit(count > 0)).select("vec_id", "deviation", at).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(made.found.n).cast("long").alias("n"),
        F.expr("try_cast(deviation as long)").alias("deviation"),
        F.col("own.whitened").alias("whitened"),
        F.col("own.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
