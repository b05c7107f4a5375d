"""Arrow batches of bounded size for the operators' Python stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Input text of one slice, in bytes; a single longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows that Spark packs into one Arrow batch at most: texts of some KB make batches of some MB on both sides.
BATCH_ROWS = 2048


def bound_batches(df: DataFrame) -> None:
    """Lower the session's rows and bytes of an Arrow batch, whose defaults let executors hold tens of MB of texts outside their heap for each task, and workers as much."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows, "10000")) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if not 0 < int(conf.get(size, str(SLICE_BYTES + 1)).removesuffix("b")) <= SLICE_BYTES:
        conf.set(size, str(SLICE_BYTES))


def release() -> None:
    """Give memory that the worker holds but doesn't use back to the system: workers are reused by other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds more than ``most`` bytes unless it is one row."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(rows, batch.num_rows - at)
            while step > 1 and batch.slice(at, step).nbytes > most:
                step //= 2
            yield batch.slice(at, step)
            at += step


def _arrow(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := columns[f.name], pa.Array | pa.ChunkedArray) else pa.array(x, type=f.type) for f in target], schema=target)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with slices of bounded size; ``fn`` returns columns, each a list, numpy or Arrow array."""
    target = to_arrow_schema(schema)
    bound_batches(df)

    def run(batches):
        for part in slices(batches, most):
            if (out := fn(part)) is not None:
                yield _arrow(out, target)
        release()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: T.StructType, most: int = SLICE_BYTES, weight: Callable[[tuple], int] = lambda row: 64) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns a partition's slices into rows, which leave in batches of about ``most`` bytes."""
    target = to_arrow_schema(schema)
    bound_batches(df)

    def run(batches):
        held, size = [], 0
        for row in fn(slices(batches, most)):
            held.append(row)
            size += weight(row)
            if size >= most or len(held) >= 8192:
                yield _arrow(dict(zip(schema.names, zip(*held))), target)
                held, size = [], 0
        if held:
            yield _arrow(dict(zip(schema.names, zip(*held))), target)
        release()

    return df.mapInArrow(run, schema)
