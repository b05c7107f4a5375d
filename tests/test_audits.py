"""Whole audits in a store, scheduled runs, the command line, and streams that are stopped and started again."""

from datetime import datetime

from pyspark.sql import functions as F

from siteloom import cli
from siteloom.operators import audits, exports, store
from siteloom.streaming import ingest

BODY = "<html lang='en'><head><title>{t}</title></head><body><h1>{t}</h1><p>Words of the page.</p><a href='/b'>next</a></body></html>"


def pages(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    return str(path)


def test_scheduled_runs(spark, tmp_path, capsys):
    """The first run is the baseline; a page that went and one that came are told; a repeated audit replaces itself."""
    first = pages(spark, tmp_path / "1", [(1, "https://shop.test/", BODY.format(t="Home of the shop")), (2, "https://shop.test/b", BODY.format(t="Second page of the shop"))])
    second = pages(spark, tmp_path / "2", [(1, "https://shop.test/", BODY.format(t="Home of the new shop")), (3, "https://shop.test/c", BODY.format(t="Third"))])
    where = str(tmp_path / "store")
    one = audits.run_and_compare(spark, first, where, "shop.test", "a1", datetime(2024, 1, 1))
    assert (one["baseline"], one["alert"], one["pages"]) == (None, None, 2) and one["issues"]["critical"] > 0
    assert audits.run_audit(spark, first, where, "shop.test", "a1", datetime(2024, 1, 1)) == {k: v for k, v in one.items() if k not in ("baseline", "alert")}
    two = audits.run_and_compare(spark, second, where, "shop.test", "a2", datetime(2024, 1, 2))
    assert two["baseline"] == "a1" and two["alert"]["removed"] == 1 and two["alert"]["status"] in ("WARN", "FAIL")
    s = store.Store(spark, where)
    assert {(r.url, r.change) for r in audits.compare_audits(s, "a1", "a2").collect()} == {("https://shop.test/b", "removed"), ("https://shop.test/c", "added"), ("https://shop.test/", "title"), ("https://shop.test/", "h1")}
    page = audits.report(s, "a2", "shop.test")
    assert page.startswith("<!DOCTYPE html>") and "<h2>Issues</h2>" in page and "missing_meta_description" in page
    assert cli.main(["compare", where, "a1", "a2", "--out", str(tmp_path / "diff"), "--format", "json"]) == 0 and spark.read.json(str(tmp_path / "diff")).count() == 4
    assert cli.main(["report", where, "shop.test", "a1", "--out", str(tmp_path / "r.html")]) == 0 and (tmp_path / "r.html").read_text().count("<table>") == 5
    assert cli.main(["delete", where, "a1"]) == 0 and s.scan("pages").select("audit_id").distinct().count() == 1
    assert cli.main(["list"]) == 0 and "issue_summary" in capsys.readouterr().out


def test_gexf(spark):
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([("a&b", 2), ("c", 0)], "url string, inlinks long")
    lines = exports.gexf(nodes, spark.createDataFrame([("c", "a&b")], "source_url string, target_url string"))
    root = ElementTree.fromstring("\n".join(r.value for r in lines.collect()).encode())
    space = {"g": "http://gexf.net/1.3"}
    assert [n.get("id") for n in root.findall(".//g:node", space)] == ["a&b", "c"] and root.find(".//g:edge", space).get("target") == "a&b"


def test_stream_resumes(spark, tmp_path):
    """A stopped crawl goes on where it was: pages seen before stay seen, and what was written stays."""
    def put(name, rows):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(ingest.PAGES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
        q = ingest.write_tables(ingest.new_pages(stream), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out" / "features")).select("url").collect()

    put("1", [(1, "https://e.test/a", BODY.format(t="A"))])
    assert [r.url for r in run()] == ["https://e.test/a"]
    put("2", [(2, "https://e.test/a/", BODY.format(t="A again")), (3, "https://e.test/b", BODY.format(t="B"))])
    assert sorted(r.url for r in run()) == ["https://e.test/a", "https://e.test/b"]
    assert sorted(r.url for r in run()) == ["https://e.test/a", "https://e.test/b"]


def test_streamed_windows_equal_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = str(tmp_path / "in")
    events.repartition(4).write.parquet(parts)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    q = ingest.windowed_counts(stream, late="400 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s1")).start()
    q.awaitTermination(120)
    rows = lambda d: sorted(map(tuple, d.select("window_start", "event_type", "n", F.round("total", 2)).collect()))
    assert rows(spark.table("windows")) == rows(ingest.windowed_counts(events))
    stream = spark.readStream.schema(events.schema).parquet(parts)
    q = ingest.sessions(stream, late="400 days").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s2")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, ingest.sessions(events).collect()))


def test_frontier_by_levels(spark):
    """A crawl of a small site level by level: claim, find, insert, mark; every page is claimed once."""
    site = {"/": ["/a", "/b"], "/a": ["/b", "/c"], "/b": ["/"], "/c": []}
    frontier = spark.createDataFrame([("/", 0, 0, "pending")], "url string, id long, depth long, status string")
    seen = []
    while True:
        batch, frontier = store.claim(frontier, 2)
        taken = batch.collect()
        if not taken:
            break
        seen += [r.url for r in taken]
        found = [(u, 100 * len(seen) + k, r.depth + 1, "pending") for r in taken for k, u in enumerate(site[r.url])]
        done = spark.createDataFrame([(r.url, "done") for r in taken], "url string, status string")
        frontier = store.with_status(frontier, done)
        if found:
            frontier = frontier.unionByName(store.insert_new(frontier, spark.createDataFrame(found, frontier.schema)))
        frontier = spark.createDataFrame(frontier.collect(), frontier.schema)  # the site is four pages
    assert sorted(seen) == sorted(site) and {r.url: r.depth for r in frontier.collect()} == {"/": 0, "/a": 1, "/b": 1, "/c": 2}
    assert store.count_rows(frontier, status="done").first().n == 4
