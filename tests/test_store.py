"""The store, exports that read back, and the remaining readers."""

from siteloom.operators import exports, store
from siteloom.plans.fixtures import tables
from siteloom.sources import html as H, text_files as S


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "audit_id string, page_id long, url string")
    s.append("pages", rows)
    assert s.scan("pages", "a").count() == 2 and s.scan("pages", "a", page_id=2, url=None).first().url == "y"
    s.replace("pages", spark.createDataFrame([("a", 9, "n")], "audit_id string, page_id long, url string"))
    assert {(r.audit_id, r.page_id) for r in s.scan("pages").collect()} == {("a", 9), ("b", 1)}
    s.delete_audit("pages", "b")
    assert s.scan("pages", "b").count() == 0


def test_frontier(spark):
    found = spark.createDataFrame([(f"u{k}", k % 3, k) for k in range(30)] + [("u1", 0, 99)], "url string, depth int, id long")
    empty = found.limit(0)
    added = store.insert_new(empty, found)
    assert added.count() == 30 and added.where("url = 'u1'").first().depth == 0
    assert store.insert_new(added, found).count() == 0
    from pyspark.sql import functions as F

    pending = added.withColumn("status", F.lit("pending"))
    batch = store.next_batch(pending, 5)
    assert [r.depth for r in batch.collect()] == [0] * 5
    marked = store.with_status(pending, batch.select("url", F.lit("done").alias("status")))
    assert marked.where("status = 'done'").count() == 5 and marked.count() == 30


def test_sitemap_round_trip(spark, tmp_path):
    out = exports.sitemap_xml(tables(spark)["fx_pages"])
    exports.write(out, str(tmp_path / "sitemap"), "xml")
    back = S.read_sitemaps(spark, str(tmp_path / "sitemap"))
    assert {(r.url, r.priority) for r in back.collect()} == {(r["loc"], r.priority) for r in out.collect()}


def test_csv(spark, tmp_path):
    links = exports.links_csv(tables(spark)["fx_links"])
    exports.write(links, str(tmp_path / "links"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "links")).count() == links.count()


def test_custom_search(spark):
    d = spark.createDataFrame([(1, "u", "<p>Big Sale now</p>"), (2, "u", None)], "page_id long, url string, html string")
    rules = [{"name": "a", "pattern": "sale"}, {"name": "b", "pattern": "s[a", "regex": True}, {"name": "c", "pattern": "sale", "mode": "does_not_contain"}, {"name": "d", "pattern": "sale", "case_sensitive": True}]
    got = {(r.page_id, r.search_name): (r.matched, r.n_matches) for r in H.custom_search(d, rules).collect()}
    assert got[1, "a"] == (True, 1) and got[1, "b"] == (False, 0) and got[1, "c"] == (False, 1) and got[2, "c"] == (True, 0) and got[1, "d"] == (False, 0)


def test_metrics(spark):
    d = spark.createDataFrame([("u", '{"lighthouseResult": {"audits": {"largest-contentful-paint": {"numericValue": 2500.44}}, "categories": {"performance": {"score": 0.9}}}}'), ("v", "no json")], "url string, value string")
    r = {x.url: x for x in S.field_metrics(d).collect()}
    assert (r["u"].lcp_ms, r["u"].performance_score, r["u"].cls, r["v"].lcp_ms) == (2500.4, 90.0, None, None)
