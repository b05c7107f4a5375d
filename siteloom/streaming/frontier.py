"""The URL frontier as a stateful stream: commands in, claims out, one state for each host.

Commands are rows of ``COMMANDS``: ``found`` puts a URL in the queue unless the host has seen it, ``ask`` hands out up to ``n`` URLs by depth and id, ``done`` and ``failed`` end a claim. A claim is a lease: if no end of it
arrives in time, a timer puts the URL back and the next ``ask`` hands it out again. State lives in RocksDB below the query's checkpoint, so it may exceed memory and survives a restart.

The queue is a map from depth and block of ids to the pending URLs of that block, so that a claim reads the first blocks only and an insertion one block, however long the queue is. In a batch of one host finds come first, then ends, then
asks, each in the order of its fields; of several finds of a URL the one with the smallest depth and id counts.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_schema = lambda **fields: T.StructType([T.StructField(k, v) for k, v in fields.items()])
COMMANDS = _schema(host=_S, kind=_S, url=_S, depth=_I, id=_L, n=_I, at=T.TimestampType())
EVENTS = _schema(host=_S, event=_S, url=_S, depth=_I, id=_L, until=_L, place=_I)
#: Ids that share a block of the queue.
BLOCK_IDS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PENDING, CLAIMED = "pending", "claimed"


class Frontier(StatefulProcessor):
    def __init__(self, lease_ms: int, event_time: bool):
        self.lease_ms, self.event_time = lease_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "url string", "status string, depth int, id long")
        self.queue = handle.getMapState("queue", "depth int, block long", "urls array<struct<id:bigint,url:string>>")
        self.leases = handle.getMapState("leases", "url string", "until long")

    def close(self) -> None:
        pass

    # The queue

    def _put(self, found: dict[tuple[int, int], list]) -> None:
        """Add (id, url) pairs to blocks, each read and written once."""
        for key, urls in found.items():
            old = self.queue.getValue(key)[0] if self.queue.containsKey(key) else []
            self.queue.updateValue(key, (sorted([tuple(u) for u in old] + urls),))

    def _drop(self, url: str, depth: int, number: int) -> None:
        key = (depth, number // BLOCK_IDS)
        if self.queue.containsKey(key):
            rest = [tuple(u) for u in self.queue.getValue(key)[0] if u[1] != url]
            if rest:
                self.queue.updateValue(key, (rest,))
            else:
                self.queue.removeKey(key)

    def _take(self, n: int) -> list[tuple[int, int, str]]:
        out = []
        for key in sorted(tuple(k) for k in self.queue.keys()):
            if len(out) >= n:
                break
            urls = [tuple(u) for u in self.queue.getValue(key)[0]]
            some, rest = urls[: n - len(out)], urls[n - len(out) :]
            out += [(key[0], number, url) for number, url in some]
            if rest:
                self.queue.updateValue(key, (rest,))
            else:
                self.queue.removeKey(key)
        return out

    # Commands and timers

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found, ends, asks = {}, [], []
        for r in rows:
            if r.kind == "found" and r.url is not None:
                place = (r.depth if r.depth is not None else 0, r.id if r.id is not None else 0)
                found[r.url] = min(place, found.get(r.url, place))
            elif r.kind in ("done", "failed") and r.url is not None:
                ends.append((r.url, r.kind))
            elif r.kind == "ask":
                asks.append((r.at, r.id or 0, r.n or 0))
        blocks: dict[tuple[int, int], list] = {}
        for url, (depth, number) in found.items():
            if not self.seen.containsKey((url,)):
                self.seen.updateValue((url,), (PENDING, depth, number))
                blocks.setdefault((depth, number // BLOCK_IDS), []).append((number, url))
        self._put(blocks)
        for url, kind in sorted(ends):
            if self.seen.containsKey((url,)):
                status, depth, number = self.seen.getValue((url,))
                if status == PENDING:  # its lease ran out before
                    self._drop(url, depth, number)
                if self.leases.containsKey((url,)):
                    self.leases.removeKey((url,))
                self.seen.updateValue((url,), (kind, depth, number))
        place = 0
        for at, _, n in sorted(asks, key=lambda a: (a[0] is None, a[0] and a[0].timestamp(), a[1])):
            now = int(at.timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            until = now + self.lease_ms
            if self.event_time and until <= timerValues.getCurrentWatermarkInMs():
                until = timerValues.getCurrentWatermarkInMs() + 1
            taken = self._take(n)
            if taken:
                self.handle.registerTimer(until)
            for depth, number, url in taken:
                self.seen.updateValue((url,), (CLAIMED, depth, number))
                self.leases.updateValue((url,), (until,))
                place += 1
                yield Row(host=key[0], event="claimed", url=url, depth=depth, id=number, until=until, place=place)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Return what was claimed and not ended until the timer's time. Only open claims are looked through."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        lost = sorted((k[0], v[0]) for k, v in self.leases.iterator() if v[0] <= now)
        blocks: dict[tuple[int, int], list] = {}
        for url, until in lost:
            _, depth, number = self.seen.getValue((url,))
            self.leases.removeKey((url,))
            self.seen.updateValue((url,), (PENDING, depth, number))
            blocks.setdefault((depth, number // BLOCK_IDS), []).append((number, url))
            yield Row(host=key[0], event="returned", url=url, depth=depth, id=number, until=until, place=0)
        self._put(blocks)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, as these operators need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def claims(commands: DataFrame, lease_seconds: float = 300.0, late: str | None = None) -> DataFrame:
    """Claims and returned URLs of a stream of commands.

    With ``late``, time is the commands' own (``at``, with that watermark), so that a replay gives the same leases, and commands that come later than that are left out; else it is the clock.
    Start the query inside ``rocksdb``.
    """
    timed = commands.withWatermark("at", late) if late else commands
    processor = Frontier(int(lease_seconds * 1000), late is not None)
    return timed.groupBy("host").transformWithState(statefulProcessor=processor, outputStructType=EVENTS, outputMode="Append", timeMode="EventTime" if late else "ProcessingTime")


def read_commands(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def run(commands: DataFrame, out: str, checkpoint: str, lease_seconds: float = 300.0, late: str | None = None, **trigger):
    """Start the frontier with its claims as Parquet below ``out``: over all that is there if time is the commands' own, else until it is stopped, as timers of the clock have no end."""
    with rocksdb(commands.sparkSession):
        return claims(commands, lease_seconds, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(**(trigger or ({"availableNow": True} if late else {"processingTime": "1 second"}))).start()
