"""Cutting lineage through storage that every executor shares.

A materialised frame is a Parquet table below ``spark.checkpoint.dir``, so losing an executor never
loses its rows. ``localCheckpoint`` is not used; a folder of this machine (``LOCAL_DIR``) only where the session names none and all its tasks run here, as in tests.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and all its tasks run on this machine, as in tests.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``. A cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return (named or LOCAL_DIR).rstrip("/")


_live: dict[str, list[str]] = {}
#: Rows of a file of a table of a few columns, and from which such a table is cut at all; the fewest files.
FILE_ROWS, SMALL_ROWS, LEAST_FILES = 500_000, 25_000, 4


def files_for(spark: SparkSession, rows: int, most: int = FILE_ROWS) -> int:
    """How many files so many rows make: some for each core, unless they are very few, and no more than ``most`` rows in one."""
    cores = spark.sparkContext.defaultParallelism
    return max(LEAST_FILES, min(2 * cores, rows // (most * SMALL_ROWS // FILE_ROWS)), -(-rows // most))


def materialize(df: DataFrame, label: str = "stage", rows: int | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that scans the written rows.

    ``rows`` is about how many rows of a few columns there are at most: where that is little, partitions are written
    together, so that a small table isn't a thousand files. The schema is passed to the reader, so an empty frame reads back
    with its columns.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(files_for(spark, rows))
    path = f"{shared_dir(spark)}/siteloom-{label}-{uuid.uuid4().hex}"
    _live.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    live = _live.get(spark.sparkContext.applicationId, [])
    for file in df.inputFiles()[:1]:
        for path in [p for p in live if f"/{p.rsplit('/', 1)[-1]}/" in file]:
            discard(spark, path)
            live.remove(path)


def written(spark: SparkSession) -> list[str]:
    """The tables that this session has materialised and not yet dropped, oldest first."""
    return list(_live.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Delete tables of ``written``, all by default: those behind results that have been written or are no longer needed."""
    live = _live.get(spark.sparkContext.applicationId, [])
    for path in [p for p in live if tables is None or p in tables]:
        discard(spark, path)
        live.remove(path)


def reserve(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared storage, which ``release`` deletes like a written table."""
    path = f"{shared_dir(spark)}/siteloom-{label}-{uuid.uuid4().hex}"
    _live.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path
