"""Integer vectors: the grid that operators 11 and 13 put floating-point vectors on, and exact sums over it."""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers below this are exact as doubles, and so are sums and products that stay below it.
EXACT = float(1 << 53)
#: Sums travel as digits of this many bits, so that adding them up as longs never overflows.
DIGIT = 32


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def gridded(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, x): floor(256 * c) of each entry c as double, for the finite vectors.

    What exceeds a long is cut to the largest or smallest long.
    """
    v = F.col(f"`{column}`")
    return vectors.where(finite(v)).select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * 256)).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column of lists of `dim` longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def reach(x: np.ndarray) -> float:
    """The largest absolute value, as a double that is not below it."""
    return max(float(x.max()), -float(x.min())) * (1 + 1e-15) if x.size else 0.0


def whole(x: np.ndarray) -> np.ndarray:
    """The same whole numbers without bound."""
    return x.astype(object)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact `a @ b`: in doubles where no partial sum can be inexact, else in whole numbers without bound."""
    if a.dtype != object and b.dtype != object and a.shape[1] * reach(a) * reach(b) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return whole(a) @ whole(b)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of the rows of `a` to those of `b`; whole numbers without bound if a long may not hold them."""
    if a.dtype == object or b.dtype == object or 4.0 * a.shape[1] * max(reach(a), reach(b)) ** 2 >= EXACT:
        a, b = whole(a), whole(b)
    return (a * a).sum(1)[:, None] - 2 * product(a, b.T) + (b * b).sum(1)[None, :]


def digits(values: Iterable[int], names: Iterable[tuple]) -> list[tuple]:
    """(*name, digit, value) rows of whole numbers without bound; only the last digit has a sign."""
    out = []
    for v, name in zip(values, names, strict=True):
        k, v = 0, int(v)
        while not -(1 << DIGIT) < v < 1 << DIGIT:
            out.append((*name, k, v & ((1 << DIGIT) - 1)))
            v >>= DIGIT
            k += 1
        out.append((*name, k, v))
    return out


def totals(parts: DataFrame, names: list[str]) -> dict[tuple, int]:
    """The exact sum of each name's digits; the caller knows that there are few names."""
    found: dict[tuple, int] = {}
    for r in parts.groupBy(*names, "digit").agg(F.sum("value").alias("value")).collect():
        name = tuple(r[n] for n in names)
        found[name] = found.get(name, 0) + (r["value"] << (DIGIT * r["digit"]))
    return found


def digit_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of `digits` as Arrow; names are ints."""
    columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 2)
    kinds = [*[pa.int32()] * (len(names) + 1), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, "digit", "value"])


def digit_schema(names: list[str]) -> str:
    return ", ".join([*(f"{n} int" for n in names), "digit int", "value long"])
