"""Arrow batches in and out of Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.session import ship_package


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package present in the workers, which give back their memory when a task ends."""
    ship_package(df.sparkSession)

    def task(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(source)
        release()

    return df.mapInArrow(task, schema)


def release() -> None:
    """Return free memory to the system. Workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def put(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, in place of those of the same name."""
    kept = [name for name in batch.schema.names if name not in added]
    return pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + list(added.values()), kept + list(added))


def extended(df: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    """The schema that ``put`` gives."""
    fields = [f for f in df.schema.fields if f.name not in added]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in added.items()])
