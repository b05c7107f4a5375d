"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to 4 bits each: size on a logarithmic scale, source and language by the rank of their value among
all values in sorted order, so that neighbouring values share a cell and none is put beside an unlike one. Rows are
sorted by their index on the Hilbert curve through that cube, ties by the text's checksum and then by id, and the order is cut into
runs of equal row counts. Rows near each other in every dimension share a shard, so a file's minima and maxima are close in all of
them and a reader can skip files by any. Equal texts with equal metadata lie next to each other and are split where a shard ends only.

The order is built with a range shuffle of small rows (no texts): each range counts its rows, the counts give offsets,
and a row's rank is its place in its range plus the offset. A metadata value that a third of all rows share is split by
checksum and id over as many ranges as it needs. Law: ``rows``; counts differ by one at most.

Defined results: a null text counts as empty, null metadata as the empty text; a null id sorts first; rows with
equal ids and texts are interchangeable; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import materialize
from .batches import map_rows

BITS, SHARDS = 4, 16
#: Ranges of the shuffle: each holds a few MB of small rows even for many rows.
ROWS_IN_RANGE = 500_000


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of each column of ``axes`` (dimensions x points, values below 2**bits).

    Axes are turned into the transposed index by undoing excess rotations from the top bit down, then Gray-encoding.
    """
    x = axes.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve(axes: list) -> F.Column:
    """The Hilbert index of long columns as a column."""

    @F.pandas_udf(T.LongType())
    def run(*columns):
        import pandas as pd

        return pd.Series(hilbert_index(np.stack([c.to_numpy(dtype=np.int64) for c in columns])))

    return run(*axes)


TOP = (1 << BITS) - 1


def size_axis(size: F.Column) -> F.Column:
    """log2 of the size, from 8 bytes on."""
    return F.least(F.greatest(F.floor(F.log2(size.cast("double"))) - 3, F.lit(0)), F.lit(TOP)).cast("long")


def label_cells(df: DataFrame, label: str) -> DataFrame:
    """label and cell of each distinct value: its rank among all of them, scaled to the cube."""
    values = ranked(df.select(label).distinct(), [label])
    return values.select(label, F.expr(f"rank * {TOP + 1} div _total").cast("long").alias("cell"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank``, a gapless number from 0 in the given order, without bringing all rows to one task."""
    rows = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_IN_RANGE + 1)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_place", T.LongType())])
    names, start = df.columns, {"at": 0, "task": None}

    def run(part: pa.RecordBatch) -> dict:
        from pyspark import TaskContext

        task = TaskContext.get()
        if start["task"] != task.taskAttemptId():
            start.update(at=0, task=task.taskAttemptId())
        at = start["at"]
        start["at"] += part.num_rows
        return {n: part.column(n) for n in names} | {"_range": np.full(part.num_rows, task.partitionId(), dtype=np.int32), "_place": np.arange(at, at + part.num_rows)}

    placed = materialize(map_rows(placed, run, schema), "places")
    # One row for each range, whose number is fixed above: small enough to sum on the driver.
    counts = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for k, n in counts:
        offsets.append((k, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_range int, _offset long")
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_offset") + F.col("_place")).withColumn("_total", F.lit(total)).drop("_range", "_place", "_offset")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS) -> DataFrame:
    """id, size, text_crc32, curve index, law, shard and slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    named = [f"_label{k}" for k in range(len(labels))]
    small = df.select(F.col(id_col).alias("_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(labels, named)])
    small = materialize(small, "small")
    cells = small
    for n in named:
        # Distinct values are few as a rule: Spark broadcasts them by their measured size, else AQE splits a hot value.
        cells = cells.join(materialize(label_cells(small, n), "cells").select(F.col(n), F.col("cell").alias(f"{n}_cell")), n)
    cells = cells.withColumn("curve", curve([size_axis(F.col("size")), *[F.col(f"{n}_cell") for n in named]]))
    out = ranked(cells.select("_id", "size", "text_crc32", "curve"), ["curve", "text_crc32", "_id", "size"]).withColumnRenamed("_id", id_col)
    exact = F.expr(f"cast(rank * {shards} div _total as int)")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return out.withColumn("law", F.lit("rows")).withColumn("shard", exact).withColumn("slot", F.col("rank") - first).drop("_total", "rank")


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows as one folder of Parquet files for each shard, sorted along the curve. Each row is written once: rows with equal
    ids and texts that lie on both sides of a limit all go to the first shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    places = assigned.groupBy(F.col(id_col).alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size")).agg(F.min("shard").alias("shard"), F.min("curve").alias("_curve"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.crc32(text) == F.col("_crc")) & (F.octet_length(text) + 1 == F.col("_size"))
    rows = df.join(places, same)
    rows.repartition("shard").sortWithinPartitions("shard", "_curve", "_crc", "_id").select(*df.columns, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
