"""Python work on whole sheets without one call for each: sorted partitions are streamed, and every call gets as many complete sheets as some batches hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of complete groups that wait for a call at least.
ROWS = 1 << 15


def clustered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every group of keys in one place, sorted by keys and order: a window asks for both, so rows that lie so already are neither moved nor sorted again."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places of rows whose keys differ from the row before."""
    out = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table.column(k).combine_chunks()
        c = c.fill_null("\0null") if pa.types.is_string(c.type) else c
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def by_sheet(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame | Iterable[pd.DataFrame]], schema: str, order: list[str]) -> DataFrame:
    """f takes rows of complete groups (several groups at once, ordered by keys and order) and returns rows of the schema, or some frames of them.

    Memory: some batches and the largest group.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def called(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        out = f(pa.concat_tables(held).to_pandas(integer_object_nulls=True))
        for pdf in [out] if isinstance(out, pd.DataFrame) else out:
            yield from pa.Table.from_pandas(pdf[kinds.names], kinds, preserve_index=False).to_batches(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # ends with a group that may go on
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).drop_columns("_n")
            new = _changes(table, keys)
            first = [table.column(k)[0].as_py() for k in keys]
            start = 0 if last is not None and first != last else int(new[0]) if len(new) else None  # where a new group begins
            end = int(new[-1]) if len(new) else start
            if start is not None and rows + end >= ROWS:
                done = [*held, table.slice(0, end)] if end else held
                if done:
                    yield from called(done)
                held, rows = [], 0
                table = table.slice(end)
            held.append(table)
            rows += table.num_rows
            last = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
        if held:
            yield from called(held)

    return clustered(df, keys, order).mapInArrow(run, schema)


def numbered(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A number for each row's group, from 0 in their order; groups lie together."""
    new = np.zeros(len(pdf), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of all pairs with left[i] == right[j]; right is sorted."""
    low, high = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    n = high - low
    i = np.repeat(np.arange(len(left)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0 to n - 1 the smallest member of the component by the edges a, b: roots take the least root that they touch, paths are halved."""
    p = np.arange(n)
    while True:
        x, y = p[a], p[b]
        open_ = x != y
        if not open_.any():
            return p
        a, b = a[open_], b[open_]
        x, y = x[open_], y[open_]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up on the decimal text of the value (none is negative)."""
    from decimal import ROUND_HALF_UP, Decimal

    y = x * 10**digits
    low = np.floor(y)
    out = low + (y - low >= 0.5)
    for k in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6).tolist():
        out[k] = int(Decimal(repr(float(x[k]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out / 10**digits
