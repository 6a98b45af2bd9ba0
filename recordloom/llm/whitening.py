"""Embedding whitening from an exact integer scatter matrix.

Vectors are put on a grid of whole numbers.  Each distinct one is counted once: a shift near the mean
is subtracted, and sums and cross-products are accumulated without bound, so that n * X'X - SS' (which no
shift changes) is exact however large n is.  Only then is it divided and decomposed in floating point.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; so are those of
another length than most of the rest (of equally frequent lengths the longest counts), as they have
no place in one covariance; entries beyond a long are cut to it; components without variance (an
eigenvalue below 1e-12 of the largest) are not given, so that equal or too few vectors have fewer
than asked, or none; a `deviation` beyond a long is null in the digest, beyond 38 digits also in the
operator; null and repeated ids get rows of their own; an empty table gives an empty result.
"""

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import vectors as vx
from recordloom.llm.store import settle

LEAST_SHARE = 1e-12
#: Rows that one product handles.
BLOCK = 4_096


def summed(distinct: DataFrame, dim: int, shift: np.ndarray | None) -> dict[tuple, int]:
    """Exact sums over the vectors: of 1 at (-1, -1), of entries at (i, -1), and with a shift of their products at (i, j <= i), both less the shift."""
    below = [(i, j) for i in range(dim) for j in range(i + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                x = vx.matrix(b.column(0).slice(i, BLOCK), dim)
                n += len(x)
                if shift is None:
                    s += x.sum(0) if len(x) * vx.reach(x) < 2.0**62 else vx.whole(x).sum(0)
                    continue
                far = vx.reach(x) + vx.reach(shift) >= 2.0**40 if shift.dtype != object else True
                y = vx.whole(x) - vx.whole(shift) if far else x - shift
                s += y.sum(0)
                p += vx.product(y.T, y)
        names, values = [(-1, -1), *((i, -1) for i in range(dim))], [n, *s]
        if shift is not None:
            names, values = names + below, values + [p[i, j] for i, j in below]
        yield vx.digit_batch(vx.digits(values, names), ["i", "j"])

    return vx.totals(distinct.select("x").mapInArrow(run, vx.digit_schema(["i", "j"])), ["i", "j"])


def scatter(n: int, dim: int, got: dict[tuple, int]) -> np.ndarray:
    """n * X'X - SS' in whole numbers."""
    out = np.zeros((dim, dim), object)
    for i in range(dim):
        for j in range(i + 1):
            out[i, j] = out[j, i] = n * got[i, j] - got[i, -1] * got[j, -1]
    return out


class Whitening:
    """What a vector needs to be whitened: counts, sums, unit components (columns) and eigenvalues."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray, values: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.axes, self.values, self.trace = n, sums, axes, values, trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n * vx.reach(x) + max(map(abs, self.sums)) < 2.0**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * vx.whole(x) - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        moved = self.centred(x)
        exact = moved / self.n if moved.dtype != object else np.array([[v / self.n for v in row] for row in moved], np.float64)
        return exact @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S) squared, exactly."""
        moved, kind = self.centred(x), pa.decimal128(38, 0)
        if moved.dtype != object and moved.shape[1] * vx.reach(moved) ** 2 < 2.0**62:
            return pa.array((moved**2).sum(1)).cast(pa.decimal128(19, 0)).cast(kind)
        sums = (vx.whole(moved) ** 2).sum(1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in sums], kind)


def fit(rows: DataFrame, dim: int, components: int) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of (id, x), and these."""
    distinct = settle(rows.select("x").distinct())
    first = summed(distinct, dim, None)
    n = first.get((-1, -1), 0)
    if not n:
        return None, distinct
    sums = [first[i, -1] for i in range(dim)]
    shift = np.array([s // n for s in sums], np.int64)
    exact = scatter(n, dim, summed(distinct, dim, shift))
    v = np.array([[e / (n * n) for e in row] for row in exact], np.float64)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    keep = int((values[:components] > max(values[0], 0) * LEAST_SHARE).sum())
    return Whitening(n, sums, axes[:, :keep].copy(), values[:keep].copy(), sum(exact[i, i] for i in range(dim)) / (n * n)), distinct


def whiten(vectors: DataFrame, components: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`key`, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    spark = vectors.sparkSession
    rows = vx.gridded(vectors, key, column)
    empty = spark.createDataFrame([], f"`{key}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None or not sizes["dim"]:
        return empty
    dim = sizes["dim"]
    rows = rows.where(F.size("x") == dim)
    model, distinct = fit(rows, dim, components)
    if model is None or not len(model.values):
        return empty
    shared, k = spark.sparkContext.broadcast(model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                x = vx.matrix(b.column(1), dim)
                w = pa.FixedSizeListArray.from_arrays(pa.array(shared.value.whitened(x).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), shared.value.deviation(x), w], ["id", "deviation", "w"])

    made = "id long, deviation decimal(38,0), w array<double>"
    fitted = distinct.select(F.lit(0).cast("long").alias("id"), "x").mapInArrow(run, made)
    # centred co-moments, merged in the JVM
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = fitted.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    out = rows.mapInArrow(run, made).select("id", "deviation", F.posexplode("w").alias("p", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values]), F.col("p") + 1)
    return out.select(F.col("id").alias(key), (F.col("p") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def whitening_digest(vectors: DataFrame, components: int = 4) -> DataFrame:
    """`whiten` with `deviation` as a long."""
    return whiten(vectors, components).withColumn("deviation", F.col("deviation").try_cast("long"))
