"""Whitening of embeddings by spectrum slicing.

Sums and the centred covariance come from two passes of Spark over all vectors;
what reaches the driver is one matrix of the vectors' length.  There the number of positive pivots
of an LDL^T factorisation of (covariance - shift) counts the eigenvalues above
the shift.  Bisection by these counts isolates each of the leading eigenvalues,
Rayleigh quotient iteration converges to it cubically, and two more counts, just
above and just below, certify its number.  A last pass measures the covariance of
the whitened rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import matrix, of_one_length, whole_entries

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues below this share of the largest are not told from zero: their directions can't be whitened.
LEAST_SHARE = 1e-11
#: Threshold of a diagonal pivot against its column (Bunch and Kaufman).
PIVOT = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of the factorised ``a - shift``."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        pair = False
        if len(m) > 1:
            below = np.abs(m[1:, 0])
            r = int(below.argmax()) + 1
            most, own = below[r - 1], abs(m[0, 0])
            if own < PIVOT * most:
                other = np.abs(m[:, r])
                other[r] = 0.0
                rest = other.max()
                if own * rest < PIVOT * most * most:
                    pair = abs(m[r, r]) < PIVOT * rest
                    to = 1 if pair else 0
                    if r != to:
                        m[[to, r]] = m[[r, to]]
                        m[:, [to, r]] = m[:, [r, to]]
        if pair:  # such a pivot has one positive and one negative eigenvalue
            above += 1
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(m[:2, :2], m[:2, 2:])
        else:
            pivot = m[0, 0]
            above += bool(pivot > 0)
            # A column without any entry is an eigenvalue at the shift itself.
            m = m[1:, 1:] - np.outer(m[1:, 0], m[1:, 0] / pivot) if pivot else m[1:, 1:]
    return above


def _solved(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    try:
        z = np.linalg.solve(a - shift * np.eye(len(a)), v)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        z = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), v)
    return z


def _rayleigh(a: np.ndarray, shift: float, v: np.ndarray, nudge: float, steps: int = 12) -> tuple[float, np.ndarray]:
    value = shift
    for _ in range(steps):
        z = _solved(a, value, v, nudge)
        v = z / np.linalg.norm(z)
        value = float(v @ a @ v)
        if np.linalg.norm(a @ v - value * v) <= nudge:
            break
    return value, v


def leading_eigenpairs(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Eigenvalues that agree to double precision share an interval; any
    orthonormal vectors of their common space stand for them.
    """
    d = len(a)
    wanted = min(wanted, d)
    radius = np.abs(a).sum(1).max() if d else 0.0
    if not wanted or radius == 0.0:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    nudge = 4 * d * np.finfo(float).eps * radius
    counts: dict[float, int] = {}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = count_above(a, x)
        return counts[x]

    values, vectors = [], np.zeros((d, 0))
    random = np.random.default_rng(11)
    floor, top = -2 * radius, 2 * radius
    counts[floor], counts[top] = d, 0
    while len(values) < wanted:
        k = len(values)
        # The shortest known interval that holds number k + 1 and none before it.
        high = min(x for x, n in counts.items() if n <= k)
        low = max(x for x, n in counts.items() if n > k)
        while above(low) - above(high) > 1 and high - low > nudge:
            middle = (low + high) / 2
            if above(middle) > k:
                low = middle
            else:
                high = middle
        together = above(low) - above(high)
        if together == 1:
            v = random.standard_normal(d)
            v -= vectors @ (vectors.T @ v)
            value, v = _rayleigh(a, (low + high) / 2, v / np.linalg.norm(v), nudge)
            certain = low <= value <= high and above(value + 2 * nudge) == k and above(value - 2 * nudge) == k + 1
            if not certain and high - low > 4 * nudge:  # it went to a neighbour: halve and start again
                middle = (low + high) / 2
                above(middle)
                continue
            found, own = v[:, None], [value]
        else:
            block = random.standard_normal((d, together))
            for _ in range(3):
                block -= vectors @ (vectors.T @ block)
                block = np.linalg.qr(_solved(a, (low + high) / 2, block, nudge))[0]
            found, own = block, [float(v @ a @ v) for v in block.T]
        # Neighbours of nearly the same eigenvalue stay orthogonal.
        for v, value in zip(found.T, own):
            v = v - vectors @ (vectors.T @ v)
            vectors = np.column_stack((vectors, v / np.linalg.norm(v)))
            values.append(value)
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(wanted)])
    return np.array(values)[order], vectors * signs


@dataclass(frozen=True)
class Whitening:
    """Fitted map of vectors; ``sums`` are of the integer entries without OFFSET."""

    n: int
    length: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return entries - self.mean

    def whitened(self, entries: np.ndarray) -> np.ndarray:
        return self.centred(entries) @ (self.vectors / np.sqrt(self.eigenvalues))

    def deviations(self, entries: np.ndarray) -> list[int | None]:
        """Sums of squares of n * entry - sum, exact; None beyond a long.

        Products wrap around at 64 bits, hence a sum that fits is exact.
        """
        wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], dtype=np.int64)
        off = np.array([self.n], dtype=np.int64) * entries.astype(np.int64) - wrapped
        exact = (off * off).sum(1)
        about = np.square(self.centred(entries)).sum(1) * float(self.n) ** 2
        return [int(e) if b < 2.0**63 * (1 - 1e-9) else None for e, b in zip(exact, about)]


def _entries(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """Integer entries of the vectors, without OFFSET, as doubles (exact)."""
    return np.floor(SCALE * matrix(batch.column("_vector"), length))


def _sums(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = _entries(batch, length)
            for at in range(0, len(entries), 1024):  # partial sums stay exact
                some = entries[at:at + 1024]
                total = [sum(map(int, c)) for c in some.T] if np.abs(some).max() >= 2.0**50 else some.sum(0).astype(np.int64)
                high, low = zip(*(divmod(int(t), 1 << 32) for t in total))
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array(range(length), pa.int32()), "n": pa.array([len(some)] * length, pa.int64()),
                    "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()),
                })

    return run


def _grams(length: int, made: Callable[[np.ndarray], np.ndarray]):
    """Products of the columns of ``made(entries)``, summed up within the task: one row per column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = made(_entries(batch, length))
            total = total + x.T @ x
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))
            })

    return run


def _gram(rows: DataFrame, length: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The tasks' products added up by Spark; only the sum, a square of the length, reaches the driver."""
    parts = rows.mapInArrow(_grams(length, made), "dim int, row array<double>")
    cells = parts.select("dim", F.posexplode("row").alias("other", "cell")).groupBy("dim", "other").agg(F.sum("cell").alias("cell"))
    got = cells.toPandas()
    size = int(got["dim"].max()) + 1
    out = np.zeros((size, size))
    out[got["dim"], got["other"]] = got["cell"]
    return (out + out.T) / 2


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean, covariance and leading components of all usable vectors; None without any.

    See ``whiten`` for what is usable.  Components are those whose eigenvalue is
    told from zero, at most ``components``.
    """
    rows, length = of_one_length(_usable(vectors, column), "_vector")
    if not length:
        return None
    sums = rows.mapInArrow(_sums(length), "dim int, n long, high long, low long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    got = sorted(sums.collect())
    n, total = got[0]["n"], [(r["high"] << 32) + r["low"] for r in got]
    start = Whitening(n, length, total, 0.0, np.zeros(0), np.zeros((length, 0)))
    covariance = _gram(rows, length, start.centred) / n
    values, axes = leading_eigenpairs(covariance, components)
    told = values > max(LEAST_SHARE * (values[0] if len(values) else 0.0), 0.0)
    return Whitening(n, length, total, float(np.trace(covariance)), values[told], axes[:, told])


def identity_error(vectors: DataFrame, fitted: Whitening, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity (0 without components)."""
    k = len(fitted.eigenvalues)
    if not k:
        return 0.0
    rows = _usable(vectors, column).where(F.size("_vector") == fitted.length)

    def with_one(entries: np.ndarray) -> np.ndarray:
        return np.column_stack((fitted.whitened(entries), np.ones(len(entries))))

    gram = _gram(rows, fitted.length, with_one) / fitted.n
    return float(np.abs(gram[:k, :k] - np.outer(gram[:k, k], gram[:k, k]) - np.eye(k)).max())


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    rows = vectors.select("vec_id", F.col(column).alias("_vector"))
    return rows.where(whole_entries("_vector", SCALE))


def whiten(vectors: DataFrame, fitted: Whitening, column: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened (array<double>, a number per component) of every usable row.

    A vector is usable if it is not null or empty, holds no null, NaN or
    infinite entry and none whose 64-fold exceeds 2^62, and has the length that most vectors have.
    Repeated rows count and are returned one by one; a null vec_id stays null;
    other columns are ignored.  ``deviation`` is null where it exceeds a long.
    """
    rows = _usable(vectors, column).where(F.size("_vector") == fitted.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = _entries(batch, fitted.length)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").cast(pa.int64()),
                "deviation": pa.array(fitted.deviations(entries), pa.int64()),
                "whitened": pa.array(list(fitted.whitened(entries)), pa.list_(pa.float64())),
            })

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
)


def op11_spectrum_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 32 whitened components of all embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    fitted = fit_whitening(vectors)
    if fitted is None or not len(fitted.eigenvalues):
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(vectors, fitted)
    values = F.array(*[F.lit(float(e)) for e in fitted.eigenvalues])
    rows = whiten(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    eigenvalue = F.element_at(values, F.col("_at") + 1)
    return rows.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        (eigenvalue / fitted.trace).alias("explained"), F.lit(error).alias("identity_error"), eigenvalue.alias("eigenvalue"),
    )
