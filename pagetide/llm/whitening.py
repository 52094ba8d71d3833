"""Whitening of embeddings by spectrum slicing.

Components become whole numbers, so sums and the covariance are exact: one pass adds the
vectors up, a second one adds products of centred vectors (centred at the whole number next to
the mean; the rest of the mean is taken off exactly). The covariance, a matrix of the vectors'
length, goes to the driver. There the count of negative pivots of an LDL' factorisation of
V - sI tells how many eigenvalues lie below s (Sylvester's law of inertia). Bisection on these
counts isolates each leading eigenvalue in an interval of its own, inverse iteration from the
middle of the interval finds its direction, Rayleigh quotient iteration converges cubically,
and two last counts beside the value certify its number.

Defined results: see `vectors` for rows that take part; a repeated row counts as often as it
occurs and gets its own rows; a null id is an id; an empty table gives an empty result. A
direction without variance cannot be whitened: components with an eigenvalue of at most
10**-11 of the trace are left out, so one vector, or equal ones, give no rows. Of equal
eigenvalues any orthonormal axes are components. The fit costs the cube of the vectors'
length on the driver, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm.common import table, written
from pagetide.llm.vectors import scaled, usable

LEAST = 1e-11  # of the trace: eigenvalues up to it are rounding
EXACT = 1 << 53  # whole numbers below it are exact in doubles
_ALPHA = (1 + 17**0.5) / 8  # pivots of one row or two: the choice of Bunch and Parlett
_LONG = pa.decimal128(38, 0)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


def below(matrix: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, counted on the pivots of its LDL' form."""
    a = matrix.copy()
    count, k, n = 0, 0, len(a)
    while k < n:
        rest = np.abs(a[k:, k:])
        diagonal = rest.diagonal().copy()
        np.fill_diagonal(rest, 0.0)
        p = int(diagonal.argmax())
        r, s = sorted(divmod(int(rest.argmax()), n - k))  # rounding may leave either of two equal entries larger
        if max(diagonal[p], rest[r, s]) == 0.0:
            break  # what is left is zero
        if diagonal[p] >= _ALPHA * rest[r, s]:
            _swap(a, k, k + p)
            count += bool(a[k, k] < 0)
            width = 1
        else:  # such a block has one eigenvalue of either sign
            _swap(a, k, k + r)
            _swap(a, k + 1, k + s)
            count += 1
            width = 2
        side = a[k + width :, k : k + width]
        a[k + width :, k + width :] -= side @ np.linalg.solve(a[k : k + width, k : k + width], side.T)
        k += width
    return count


class Slices:
    """Counts of eigenvalues at shifts, kept in order, so that one bisection helps the next."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.size = len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max())
        self.least = 4 * np.finfo(float).eps * self.norm
        self.counts: dict[float, int] = {-self.norm - self.least: self.size, self.norm + self.least: 0}

    def above(self, shift: float) -> int:
        """Eigenvalues at `shift` or above it."""
        if shift not in self.counts:
            self.counts[shift] = self.size - below(self.matrix - shift * np.eye(self.size))
        return self.counts[shift]

    def around(self, number: int) -> tuple[float, float]:
        """The tightest interval so far that holds the eigenvalue of this number, from the largest."""
        low = max(s for s, n in self.counts.items() if n >= number)
        return low, min(s for s, n in self.counts.items() if n < number and s > low)

    def halve(self, number: int) -> None:
        low, high = self.around(number)
        self.above((low + high) / 2)

    def isolated(self, number: int) -> tuple[float, float]:
        """An interval with this eigenvalue alone, or one as narrow as rounding."""
        while True:
            low, high = self.around(number)
            if (self.counts[low] == number and self.counts[high] == number - 1) or high - low <= self.least:
                return low, high
            self.above((low + high) / 2)


def _unit(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):  # once more for what rounding left
        for axis in found:
            vector = vector - (axis @ vector) * axis
        vector = vector / np.linalg.norm(vector)
    return vector


def _solved(matrix: np.ndarray, shift: float, vector: np.ndarray, nudge: float) -> np.ndarray:
    identity = np.eye(len(matrix))
    while True:
        try:
            answer = np.linalg.solve(matrix - shift * identity, vector)
            if np.isfinite(answer).all():
                return answer
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge  # the shift was an eigenvalue to the last bit


def leading(matrix: np.ndarray, most: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above `least`, falling, `most` at most, and their axes as rows."""
    slices = Slices(matrix)
    noise = 8 * len(matrix) * np.finfo(float).eps * max(slices.norm, np.finfo(float).tiny)
    random = np.random.default_rng(0)
    values: list[float] = []
    axes: list[np.ndarray] = []
    while len(axes) < min(most, len(matrix)):
        number = len(axes) + 1
        if slices.above(least) < number:
            break
        value, axis = _ended(matrix, slices, number, axes, random, noise)
        if slices.above(value + noise) >= number or slices.above(value - noise) < number:
            raise ArithmeticError(f"eigenvalue {number} is not where the counts have it")
        values.append(value)
        axes.append(axis)
    return np.array(values), np.array(axes).reshape(-1, len(matrix))


def _ended(matrix, slices: Slices, number: int, found, random, noise: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration that ends in the interval of this eigenvalue."""
    while True:
        low, high = slices.isolated(number)
        axis = _unit(random.standard_normal(len(matrix)), found)
        for _ in range(3):
            axis = _unit(_solved(matrix, (low + high) / 2, axis, slices.least), found)
        for _ in range(20):
            value = float(axis @ matrix @ axis)
            if np.linalg.norm(matrix @ axis - value * axis) <= noise:
                break
            axis = _unit(_solved(matrix, value, axis, slices.least), found)
        value = float(axis @ matrix @ axis)
        if low - noise <= value <= high + noise and np.linalg.norm(matrix @ axis - value * axis) <= noise:
            return value, axis
        if high - low <= slices.least:
            raise ArithmeticError(f"no eigenvector was found for eigenvalue {number}")
        slices.halve(number)  # a tighter interval draws the start nearer to its own axis
        slices.halve(number)


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: a centre (whole numbers and the sums over what is beside it), axes, values."""

    n: int
    centre: list[int]  # per dimension
    rest: list[int]  # per dimension: sum of (x - centre)
    trace: float
    values: np.ndarray
    axes: np.ndarray

    @cached_property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _added(rows: DataFrame, add, name: str) -> list:
    """Sums per (i, j), over all partial sums that `add` makes of a task's matrices."""
    partial = rows.mapInArrow(add, "i int, j int, n long, total decimal(38,0)")
    return partial.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def _records(entries: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    i, j, n, total = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64()), pa.array(list(map(Decimal, total)), _LONG)],
        ["i", "j", "n", "total"],
    )


def products(x: np.ndarray) -> np.ndarray:
    """x'x of whole numbers without rounding, as Python's integers."""
    largest = int(np.abs(x).max(initial=0))
    whole = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    step = EXACT // max(1, largest * largest)  # so many rows add up without rounding
    if not step:
        exact = x.astype(object)
        return exact.T @ exact
    for k in range(0, len(x), step):
        part = x[k : k + step].astype(np.float64)
        whole += (part.T @ part).astype(np.int64).astype(object)
    return whole


def fit(vectors: DataFrame, width: int, components: int = 8) -> Whitening | None:
    """The axes of (vector), all rows of one width; None for no rows."""

    def sums(batches):
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            x = scaled(batch.column(0), width)
            n += len(x)
            for k in range(0, len(x), 4096):  # so many numbers below 2**50 add up in a long
                total += x[k : k + 4096].sum(axis=0).astype(object)
        if n:
            yield _records([(i, 0, n, int(total[i])) for i in range(width)])

    rows = vectors.select("vector")
    first = {r.i: r for r in _added(rows, sums, "sums")} if width else {}  # a row for each dimension
    if not first:
        return None
    n = first[0].n
    totals = [int(first[i].total) for i in range(width)]
    centre = [total // n for total in totals]
    middle = np.array(centre, dtype=np.int64)

    def crossed(batches):
        whole = np.zeros((width, width), dtype=object)
        n = 0
        for batch in batches:
            x = scaled(batch.column(0), width) - middle
            n += len(x)
            whole += products(x)
        if n:
            yield _records([(i, j, n, int(whole[i, j])) for i in range(width) for j in range(i + 1)])

    rest = [total - n * c for total, c in zip(totals, centre, strict=True)]
    covariance = np.zeros((width, width))
    trace = 0
    for r in _added(rows, crossed, "products"):  # width * (width + 1) / 2 rows
        exact = n * int(r.total) - rest[r.i] * rest[r.j]
        covariance[r.i, r.j] = covariance[r.j, r.i] = exact / (n * n)  # rounded once
        trace += exact if r.i == r.j else 0
    spread = trace / (n * n)
    values, axes = leading(covariance, components, LEAST * spread) if spread else (np.zeros(0), np.zeros((0, width)))
    turn = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return Whitening(n, centre, rest, spread, values, axes * turn[:, None])


def deviations(x: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Per row the sum of (n * x - rest)**2, exactly."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, rest.tolist()))
    if x.shape[1] * largest * largest < 1 << 63:
        return ((n * x - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    return ((n * x.astype(object) - rest) ** 2).sum(axis=1).tolist()


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of (id, vector): coordinates of unit variance, by component."""
    width = len(model.centre)
    middle, rest = np.array(model.centre, dtype=np.int64), np.array(model.rest, dtype=object)
    shift = np.array([r / model.n for r in model.rest])
    scale = model.axes.T / np.sqrt(model.values)

    def work(batches):
        for batch in batches:
            x = scaled(batch.column(1), width) - middle
            white = (x - shift) @ scale
            ends = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
            exact = pa.array([Decimal(d) for d in deviations(x, model.n, rest)], _LONG)
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], ["id", "deviation", "whitened"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(work, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest entry of |covariance - identity| of the whitened rows, centred first."""
    if not k:
        return 0.0
    means = whitened.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
    centred = [F.col("whitened")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = whitened.agg(*(F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def whiten(
    rows: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each component.

    `deviation` is a decimal of 38 digits: it holds n**2 times the squared distance to the mean.
    """
    narrow = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    vectors, width = usable(narrow)
    model = fit(vectors, width, components)
    kind = narrow.schema["id"].dataType.simpleString()
    if model is None or not len(model.values):
        empty = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    projected = written(project(vectors, model), "whitened")
    error = identity_error(projected, len(model.values))
    shares = F.array(*map(F.lit, model.explained))
    return projected.select("id", "deviation", F.posexplode("whitened").alias("at", "white")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The offset of the contract moves every x and the mean alike, so no result depends on it.

    A deviation that a long cannot hold is null.
    """
    found = whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).withColumnRenamed("id", "vec_id")


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
