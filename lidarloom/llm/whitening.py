"""Operator 11: whitening of embeddings by a two-pass covariance.

Vectors are quantised to whole numbers in Spark. The fit list holds every distinct quantised vector once; it is written
down and read by three passes, each one mergeable state a task, merged by ``treeAggregate``:

1. the number of vectors and the sums per dimension, exact whole numbers of any size;
2. the outer products of vectors centred by that exact mean, one matrix product (GEMM) a batch;
3. the covariance of the whitened fit list, against the identity, as a check.

Only matrices of dimension x dimension reach the driver, where LAPACK's symmetric solver finds the components. The
projection is broadcast, and every row is whitened where it lies. A vector that a third of all rows share is one row of
the fit list, since ``distinct`` combines on the map side.

Rows are dropped whose vector is null or holds null, NaN, infinite or over-large entries (those whose scaled value
has 2^62 or more). Vectors must have one length: rows of any other length than the commonest of the fit list (the
longest of several) are dropped as well. Repeated rows and null ids are kept as they are. An empty table gives no rows,
vectors of fewer than four dimensions fewer components. A direction without spread (an eigenvalue of rounding size) has
a null ``whitened`` and an ``explained`` of 0, or null if nothing spreads at all, and is left out of
``identity_error``, which is null without any other direction. ``deviation`` is null where it doesn't fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.llm.common import materialize

#: Steps of the grid a unit, and components that are returned.
SCALE, COMPONENTS = 256, 4
LARGE = 2.0**62


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows with finite vectors, ``floor(scale * c)`` for each entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGE)
    e = F.col("embedding")
    return vectors.select("vec_id", "embedding").where(e.isNotNull()).where(F.forall(e, finite)).select("vec_id", F.transform(e, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The column ``x`` of a batch as rows x ``dim``."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Moments:
    """Number, mean and summed products of centred rows; two of them merge by their means' difference."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        off = rows - mean
        return cls(len(rows), mean, off.T @ off)

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + off * (other.n / n), self.products + other.products + np.outer(off, off) * (self.n * other.n / n))


def gathered(fit: DataFrame, start: Callable[[], object], step: Callable[[object, pa.RecordBatch], object], merge: Callable[[object, object], object]) -> object:
    """One state from all batches of ``fit``: each task folds its own, ``treeAggregate`` merges them."""
    import pickle

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for b in batches:
            if b.num_rows:
                state = step(state, b)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    return fit.mapInArrow(work, "state binary").rdd.treeAggregate(start(), lambda a, r: merge(a, pickle.loads(r["state"])), merge)


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums. Entries are cut into 32 high and 32 low bits, so that no partial sum of a
    task overflows; the halves meet as Python's whole numbers."""

    def step(state: tuple, b: pa.RecordBatch) -> tuple:
        x = matrix(b, dim)
        high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
        return state[0] + len(x), [s + (int(h) << 32) + int(v) for s, h, v in zip(state[1], high, low, strict=True)]

    return gathered(fit, lambda: (0, [0] * dim), step, lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]))


@dataclass
class Whitening:
    """What ``fit`` has found; ``transform`` applies it. ``mean`` is ``whole + rest / n`` in each dimension."""

    dim: int
    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    @property
    def spread(self) -> np.ndarray:
        """Which of the components have an eigenvalue above rounding."""
        return self.values > self.trace * self.dim * np.finfo(float).eps

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(np.where(self.spread, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2."""
        off = x - self.whole
        top = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0)))) * self.n + int(self.rest.max(initial=0))
        if top * top * self.dim < 2**63:
            off = off * self.n - self.rest
            return (off * off).sum(1).tolist()
        exact = ((off.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Every row of ``rows(vec_id, x)`` with every component."""
        spark = rows.sparkSession
        sent, k = spark.sparkContext.broadcast(self), len(self.values)
        schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            explained = np.maximum(own.values, 0) / own.trace if own.trace > 0 else np.full(k, np.nan)
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b, own.dim)
                n = len(x)
                ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(n), k)))
                deviation = pa.array(own.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
                whitened = (own.centred(x) @ own.projection).ravel()
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, own.n)), deviation, pa.array(whitened, from_pandas=True), pa.array(np.tile(explained, n), from_pandas=True), pa.array([own.identity_error] * (n * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return rows.where(F.size("x") == self.dim).mapInArrow(work, schema)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows(x)``, None without any."""
    listed = materialize(rows.select("x").distinct())
    sizes = listed.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None or not sizes["dim"]:
        return None
    dim = sizes["dim"]
    listed = listed.where(F.size("x") == dim)
    n, sums = exact_sums(listed, dim)
    found = Whitening(dim, n, np.array([s // n for s in sums]), np.array([s % n for s in sums]), np.zeros(0), np.zeros((dim, 0)), 0.0)

    def outer(total: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        off = found.centred(matrix(b, dim))
        return total + off.T @ off

    products = gathered(listed, lambda: np.zeros((dim, dim)), outer, lambda a, b: a + b) / n
    values, vectors = np.linalg.eigh(products)
    first = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, first]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(first))])  # the largest entry is positive
    found.values, found.components, found.trace = values[first], vectors * signs, float(np.trace(products))
    if found.spread.any():
        projection = found.projection[:, found.spread]
        k = projection.shape[1]
        m = gathered(listed, lambda: Moments(0, np.zeros(k), np.zeros((k, k))), lambda s, b: s + Moments.of(found.centred(matrix(b, dim)) @ projection), lambda a, b: a + b)
        found.identity_error = float(np.abs(m.products / m.n - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors(vec_id, embedding)``."""
    rows = quantised(vectors, scale)
    found = fit(rows, components)
    if found is None:
        return rows.limit(0).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    return found.transform(rows)
