"""The frontier as a stream: order like the batch frontier, leases that run out, restarts, repeated and late commands."""

import time
from datetime import datetime, timedelta

from siteloom.operators import store
from siteloom.streaming import frontier

T0 = datetime(2024, 1, 1)


class Crawl:
    """Commands as files, each batch a run of the query, so that every batch is a restart."""

    def __init__(self, spark, path, lease=60):
        self.spark, self.path, self.lease, self.made = spark, str(path), lease, 0
        (path / "in").mkdir()

    def __call__(self, *rows):
        self.made += 1
        full = [(r.get("host", "h"), r["kind"], r.get("url"), r.get("depth"), r.get("id"), r.get("n"), T0 + timedelta(seconds=r.get("at", self.made))) for r in rows]
        self.spark.createDataFrame(full, frontier.COMMANDS).coalesce(1).write.parquet(f"{self.path}/in/{self.made}")
        before = {tuple(r) for r in self.events()}
        q = frontier.run(frontier.read_commands(self.spark, f"{self.path}/in", 1), f"{self.path}/out", f"{self.path}/state", self.lease, "0 seconds")
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r for r in self.events() if tuple(r) not in before), key=lambda r: (r.event, r.host, r.place, r.url))

    def events(self):
        try:
            return self.spark.read.schema(frontier.EVENTS).parquet(f"{self.path}/out").collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []


def found(url, depth, number, **over):
    return {"kind": "found", "url": url, "depth": depth, "id": number} | over


def test_order_equals_batch_frontier(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frontier, "BLOCK_IDS", 4)  # many blocks
    rows = [(f"h{k % 3}", f"https://h{k % 3}/{k * 7 % 50}", k * 5 % 4, 1000 - k) for k in range(90)]
    crawl = Crawl(spark, tmp_path)
    crawl(*[found(u, d, i, host=h) for h, u, d, i in rows[:60]])
    got = crawl(*[found(u, d, i, host=h) for h, u, d, i in rows[60:]], *[{"kind": "ask", "host": h, "n": 12} for h in ("h0", "h1", "h2")])
    old = spark.createDataFrame([(*r, "pending") for r in rows[:60]], "host string, url string, depth int, id long, status string")
    new = spark.createDataFrame([(*r, "pending") for r in rows[60:]], old.schema)
    once = store.insert_new(old.limit(0), old)
    both = once.unionByName(store.insert_new(once, new))
    for h in ("h0", "h1", "h2"):
        expected = [r.url for r in store.next_batch(both.where(f"host = '{h}'"), 12).collect()]
        assert [r.url for r in got if r.host == h and r.event == "claimed"] == expected and len(expected) == 12


def test_leases_and_restarts(spark, tmp_path):
    """What was claimed isn't handed out again, unless its lease runs out; what ended never is, even if it ends late; seen URLs stay seen over restarts."""
    crawl = Crawl(spark, tmp_path, lease=60)
    assert crawl(found("a", 0, 1), found("b", 0, 2), found("c", 1, 3), found("d", 1, 4), found(None, 0, 9)) == []
    assert [r.url for r in crawl({"kind": "ask", "n": 2, "at": 10})] == ["a", "b"]
    assert [r.url for r in crawl({"kind": "done", "url": "a", "at": 11}, found("a", 0, 1, at=11), found("b", 0, 2, at=11), {"kind": "ask", "n": 1, "at": 12})] == ["c"]
    # The watermark passes b's and c's leases: both come back, a doesn't.
    back = crawl({"kind": "found", "url": "e", "depth": 5, "id": 5, "at": 100})
    back += crawl({"kind": "ask", "n": 0, "at": 101})
    assert sorted(r.url for r in back if r.event == "returned") == ["b", "c"]
    # c ends late: it leaves the queue. b is handed out again, before d.
    assert [r.url for r in crawl({"kind": "failed", "url": "c", "at": 102}, {"kind": "ask", "n": 9, "at": 103})] == ["b", "d", "e"]
    assert crawl({"kind": "ask", "n": 9, "at": 104}, {"kind": "done", "url": "nowhere", "at": 104}) == []


def test_leases_by_the_clock(spark, tmp_path):
    """Without event time the clock ends leases, while no command comes."""
    spark.createDataFrame([("h", "found", "a", 0, 1, None, T0), ("h", "ask", None, None, None, 1, T0)], frontier.COMMANDS).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    q = frontier.run(frontier.read_commands(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), 0.5)
    try:
        until = time.time() + 90
        events = []
        while time.time() < until and "returned" not in events:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                events = [r.event for r in spark.read.schema(frontier.EVENTS).parquet(str(tmp_path / "out")).collect()]
    finally:
        q.stop()
    assert sorted(events) == ["claimed", "returned"]
