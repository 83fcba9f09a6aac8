"""Running a function over Arrow batches of a few rows at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows and characters that are turned into Python objects at once, and characters for a byte of a packed text.
ROWS, CHARS, PACKED = 256, 2_000_000, 3


def kept(df: DataFrame, added: list[str], drop: tuple[str, ...] = ()) -> list[str]:
    """Columns of df that stay: all but `drop` and those that an added column replaces (names ignore case)."""
    gone = {c.lower() for c in (*added, *drop)}
    return [c for c in df.columns if c.lower() not in gone]


#: Rows of an Arrow batch that Spark sends to Python, where the session has its default of 10,000.
BATCH_ROWS = "1000"


def small_batches(spark) -> None:
    """Texts are long, so fewer of them go to a Python worker at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, BATCH_ROWS)


def release() -> None:
    """Gives memory that a task no longer needs back to the system; the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _size(column: pa.Array) -> np.ndarray | None:
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return size if pa.types.is_string(kind) or pa.types.is_large_string(kind) else size * PACKED
    return None


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Short batches, of `rows` rows and about CHARS characters (or one row) at most; none for empty ones."""
    for batch in batches:
        sizes = [s for c in batch.columns if (s := _size(c)) is not None]
        upto = np.cumsum(np.sum(sizes, axis=0)) if sizes else np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + CHARS, "right"))))
            yield batch.slice(at, end - at)
            at = end
    del batches
    release()


def with_columns(df: DataFrame, text: str, added: T.StructType, make: Callable[[], Callable], drop_text: bool = True) -> DataFrame:
    """df with columns that a function of the text gives.

    make() runs once in each task and returns a function from a list of texts (or None) to one list for
    each added column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    keep = kept(df, added.names, (text,) if drop_text else ())
    out = T.StructType([df.schema[c] for c in keep] + list(added))
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        values = make()
        for part in slices(batches):
            columns = values(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep] + [pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=out.names
            )

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)
