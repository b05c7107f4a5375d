"""Structured Streaming: pages in, child tables and progress out; events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import urls as U
from ..sources.html import child, parse_pages

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def read_pages(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Captured pages as they arrive; the number of files in a batch is the back-pressure."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)


def new_pages(stream: DataFrame, url: str = "url") -> DataFrame:
    """Each URL once, by its normalised hash: exact, in the state store, so no URL is taken for seen by mistake."""
    return stream.withColumn("url_hash", U.url_hash(U.normalize(F.col(url)))).dropDuplicates(["url_hash"])


def write_tables(stream: DataFrame, out: str, checkpoint: str, tables: tuple[str, ...] = ("links", "headings", "images")):
    """Parse each batch once and write one table for each relation; a batch that is retried replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_pages(batch).persist()
        try:
            parsed.select("page_id", "url", "page.title", "page.h1", "page.word_count", "page.content_hash").write.mode("overwrite").parquet(f"{out}/features/batch={number}")
            for name in tables:
                child(parsed, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            parsed.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and their value by tumbling window and kind; rows later than ``late`` are left out when streaming."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_t", window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), kind, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("_t", gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


def progress(stream: DataFrame) -> DataFrame:
    """Running totals of a crawl: pages, errors and mean response time."""
    return stream.groupBy().agg(F.count("*").alias("pages"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.avg("response_time_ms"), 1).alias("avg_ms"))
