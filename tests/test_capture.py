"""Captured pages to silver tables: depths and ranks against a plain search, ids of very large pages, responses, missing headers."""

import collections

import pytest
from pyspark.sql import functions as F

from siteloom.operators import audit, audits, capture, graph, rules, store

BASE = "https://shop.test"


def page(links, title="A page"):
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1>" + "".join(f'<a href="{h}">a link</a>' for h in links) + "</body></html>"


def site():
    """A start page, a chain of nine, a loop, a hub, an orphan that links into the site, links out and links to what was never captured."""
    pages = {"/": ["/c/1", "/hub", "/hub", "https://other.test/"], "/hub": ["/", "/hub", "/missing", "/loop/a"], "/loop/a": ["/loop/b"], "/loop/b": ["/loop/a", "/hub"], "/orphan": ["/c/5", "/privacy-policy"], "/privacy-policy": []}
    pages |= {f"/c/{k}": [f"/c/{k + 1}", "/privacy-policy"] for k in range(1, 9)} | {"/c/9": ["//shop.test/hub"]}
    return {BASE + u: [h if "://" in h else BASE + h[11:] if h.startswith("//") else BASE + h for h in hs] for u, hs in pages.items()}


def brute(pages, start):
    edges = {u: {h for h in hs if h in pages and h != u} for u, hs in pages.items()}
    depth, queue = {start: 0}, collections.deque([start])
    while queue:
        u = queue.popleft()
        for h in edges[u]:
            if h not in depth:
                depth[h] = depth[u] + 1
                queue.append(h)
    n = len(pages)
    rank = dict.fromkeys(pages, 1 / n)
    for _ in range(100):
        lost = sum(rank[u] for u in pages if not edges[u])
        new = {u: 0.15 / n + 0.85 * (sum(rank[s] / len(edges[s]) for s in pages if u in edges[s]) + lost / n) for u in pages}
        moved, rank = sum(abs(new[u] - rank[u]) for u in pages), new
        if moved < 1e-6:
            break
    low, high = min(rank.values()), max(rank.values())
    into = collections.Counter(h for hs in edges.values() for h in hs)
    return {u: (depth.get(u), round((rank[u] - low) / (high - low) * 100, 2), into[u], not into[u] and u != start) for u in pages}


def captured(spark, pages, first_id=10**12):
    rows = [(first_id + k, u, page([h.removeprefix(BASE) for h in hs], f"Page {k}")) for k, (u, hs) in enumerate(sorted(pages.items()))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_link_graph_equals_search(spark):
    pages = site()
    parsed = capture.parse(captured(spark, pages)).cache()
    found = capture.link_graph(parsed.select("page_id", "url"), capture.links_of(parsed))
    got = {r.url: (r.crawl_depth, r.internal_pagerank, r.unique_inlinks, r.is_orphan) for r in found.collect()}
    expected = brute(pages, BASE + "/")
    assert {u: (v[0], *v[2:]) for u, v in got.items()} == {u: (v[0], *v[2:]) for u, v in expected.items()}
    assert all(abs(got[u][1] - expected[u][1]) <= 0.02 for u in pages)
    # From another start page, and from one that was not captured (then from the root).
    other = capture.link_graph(parsed.select("page_id", "url"), capture.links_of(parsed), BASE + "/c/5")
    assert {r.url: r.crawl_depth for r in other.collect()} == {u: v[0] for u, v in brute(pages, BASE + "/c/5").items()}
    absent = capture.link_graph(parsed.select("page_id", "url"), capture.links_of(parsed), BASE + "/nowhere")
    assert {r.url: r.crawl_depth for r in absent.collect()} == {u: v[0] for u, v in expected.items()}


def test_audit_stores_depth_and_rank(spark, tmp_path):
    captured(spark, site()).write.parquet(str(tmp_path / "in" / "pages.parquet"))
    gone = spark.createDataFrame([(BASE + "/c/9", 404, {"Server": "x"}), (BASE + "/c/8", 200, {"Strict-Transport-Security": "max-age=5"}), (BASE + "/c/8", 200, {"Strict-Transport-Security": "max-age=5"})], "url string, status_code int, headers map<string,string>")
    gone.write.parquet(str(tmp_path / "in" / "responses.parquet"))
    audits.run_audit(spark, str(tmp_path / "in"), str(tmp_path / "store"), "shop.test", "a")
    s = store.Store(spark, str(tmp_path / "store"))
    rows = {r.url: r for r in s.scan("pages", "a").collect()}
    expected = brute(site(), BASE + "/")
    assert len(rows) == len(expected) and {u: r.crawl_depth for u, r in rows.items()} == {u: v[0] for u, v in expected.items()}
    assert rows[BASE + "/c/9"].status_code == 404 and rows[BASE + "/c/1"].status_code == 200 and rows[BASE + "/c/1"].headers is None
    issues = {(r.issue_type, r.url.removeprefix(BASE)) for r in s.scan("issues", "a").where("url is not null").collect()}
    assert {("deep_crawl_depth", f"/c/{k}") for k in (6, 7, 8, 9)} <= issues and ("deep_crawl_depth", "/c/5") not in issues
    assert ("orphan_page", "/orphan") in issues and ("orphan_page", "/c/1") not in issues
    assert expected[BASE + "/privacy-policy"][1] > 60 and ("equity_trap", "/privacy-policy") in issues
    assert ("4xx_error", "/c/9") in issues
    # Only what was captured can be missing.
    assert {u for t, u in issues if t == "missing_hsts"} == {"/c/9"} and {u for t, u in issues if t == "hsts_short_max_age"} == {"/c/8"}


@pytest.mark.parametrize("first", [0, 21_474_837, 10**12, (1 << 43) - 1, 1 << 60, -5])
def test_ids_of_elements(spark, first):
    """No overflow and no equal ids, whatever the page ids and however many elements a page has."""
    links = spark.range(first, first + 3).withColumnRenamed("id", "page").crossJoin(spark.createDataFrame([(0,), (1,), (99,), (100,), (100_000,), (1 << 20,), (1 << 30,)], "position int"))
    ids = [r[0] for r in links.select(capture.element_id(F.col("page"), F.col("position"))).collect()]
    assert len(set(ids)) == 21
    tags = "".join(f'<link rel="next" href="/{k}">' for k in range(120))
    parsed = capture.parse(spark.createDataFrame([(first, BASE + "/", f"<html><head>{tags}</head></html>")], "page_id long, url string, html string"))
    assert capture.tables(parsed)["fx_pagination"].select("tag_id").distinct().count() == 120


def test_no_pages(spark):
    t = capture.tables(capture.parse(spark.createDataFrame([], "page_id long, url string, html string")))
    assert all(df.count() == 0 for df in t.values()) and rules.issues(audit.prepare_pages(t), rules.PAGE_RULES).count() == 0


def test_url_dictionary(spark):
    urls = spark.createDataFrame([(f"https://h{k % 37}.test/{k % 500}",) for k in range(3000)] + [(None,)], "url string")
    ids = {r.url: r.id for r in graph.url_dictionary(urls).collect()}
    assert sorted(ids.values()) == list(range(len(ids))) and list(ids) and sorted(ids) == sorted(ids, key=ids.get)
