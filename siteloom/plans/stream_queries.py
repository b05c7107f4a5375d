"""Streams over files made of the given tables, run to their end, with twins over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..streaming import control, frontier
from .core_queries import _PARTS, table
from .materialize import reserve
from .registry import register


@register(
    "frontier_stream",
    f"""WITH {_PARTS}, h AS (SELECT authority AS host, url, page_id, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM u), o AS (SELECT host, url, min({{'d': depth, 'id': page_id}}) AS p FROM h GROUP BY ALL)
SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY p.d, p.id) AS INTEGER) AS place, url, CAST(p.d AS INTEGER) AS depth FROM o QUALIFY place <= 3""",
)
def frontier_stream(spark, sf_dir):
    """The first URLs that each host hands out: found in one batch and asked for in the next."""
    url, where = F.col("url"), reserve(spark, "frontier")
    pages = table(spark, sf_dir, "pages").select(U.authority(url).alias("host"), F.lit("found").alias("kind"), "url", U.folder_depth(url).cast("int").alias("depth"), F.col("page_id").alias("id"), F.lit(None).cast("int").alias("n"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    asks = pages.select("host").distinct().select("host", F.lit("ask").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("id"), F.lit(3).alias("n"), F.lit("2024-01-01 00:01:00").cast("timestamp").alias("at"))
    for number, rows in enumerate((pages, asks)):
        rows.write.parquet(f"{where}/in/{number}")
        query = frontier.run(frontier.read_commands(spark, f"{where}/in", 10_000), f"{where}/out", f"{where}/state", 600, "10 minutes")
        query.awaitTermination()
    return spark.read.schema(frontier.EVENTS).parquet(f"{where}/out").where("event = 'claimed'").select("host", "place", "url", "depth")


@register("crawl_progress", "SELECT count(*) AS crawled, count(*) FILTER (event_type = 'error') AS errors, round(avg(value * 10), 1) AS avg_ms FROM events")
def crawl_progress(spark, sf_dir):
    """Metrics of the batches of a stream over the events, stopped and started again half-way; a listener kept them."""
    where = reserve(spark, "progress")
    events = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), (F.col("value") * 10).alias("response_time_ms"), "event_id")
    listener = control.Progress(spark, f"{where}/metrics")
    spark.streams.addListener(listener)
    try:
        for half in (0, 1):
            events.where(F.col("event_id") % 2 == half).repartition(2).write.parquet(f"{where}/in/{half}")
            stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
            query = control.observed(stream).writeStream.format("noop").queryName("events").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            for p in query.recentProgress:  # events of the listener may still be on their way
                listener.keep(p)
    finally:
        spark.streams.removeListener(listener)
    return control.totals(spark, f"{where}/metrics").select("crawled", "errors", "avg_ms")
