"""Apply a vectorised function to the whole texts of a table."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.store import arrow_rows, unused


def _schema(df: DataFrame, keep: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]


def add_columns(df: DataFrame, text: str | Column, keep: list[str], out: dict[str, str], fn: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """`keep` columns of every row and the columns `out` (name -> type) that `fn` computes.

    `fn` gets the UTF-8 bytes of some rows and where each row starts, and returns a value a row for
    each output, as arrays.  The output names must not be among the kept ones.
    """
    arrow_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column(b.num_columns - 1))
            for start, end, part, begins in tk.chunks(data, at):
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(part, begins)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in b.columns[:-1]), *made], [*keep, *out])

    column = F.col(text) if isinstance(text, str) else text
    return df.select(*[F.col(f"`{c}`") for c in keep], column.alias(unused(df, "text_in")[0])).mapInArrow(run, ", ".join([*_schema(df, keep), *(f"`{k}` {v}" for k, v in out.items())]))


def emit_rows(df: DataFrame, key: str | list[str], out: dict[str, str], fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list]]) -> DataFrame:
    """Any number of rows for each text: `fn` returns the row index of each, then the columns; the key columns come first."""
    arrow_rows(df.sparkSession)
    keys = [key] if isinstance(key, str) else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column(len(keys)))
            for start, _, part, begins in tk.chunks(data, at):
                rows, columns = fn(part, begins)
                mine = pa.array(rows + start)
                yield pa.RecordBatch.from_arrays([*(c.take(mine) for c in b.columns[:-1]), *(pa.array(c) for c in columns)], [*keys, *out])

    return df.select(*[F.col(f"`{c}`") for c in keys], F.col("text").alias(unused(df, "text_in")[0])).mapInArrow(run, ", ".join([*_schema(df, keys), *(f"`{k}` {v}" for k, v in out.items())]))
