"""Operators on small inputs with known results."""

from pyspark.sql import functions as F

from siteloom.operators import compare, graph, similarity, views
from siteloom.sources import html as H, text_files as S
from siteloom.streaming import ingest

PAGE = """<html lang="pt"><head><title>Rope and sail | Harbour shop</title><meta name="description" content="Sails, rope and paint for small boats.">
<meta name="keywords" content="rope,sail"><meta name="robots" content="noarchive"><meta name="viewport" content="initial-scale=1"><meta property="og:title" content="Boats"><meta name="twitter:card" content="summary">
<style>@media print { a { color: black } }</style><link rel="canonical" href="https://boats.test/rope"><link rel="alternate" hreflang="fr" href="https://boats.test/fr/corde"><link rel="prev" href="?p=1"><link rel="stylesheet" href="/s.css"><link rel="amphtml" href="/amp/rope">
<script type="application/ld+json">{"@type": ["Offer", "Product"]}</script><script type="application/ld+json">{broken</script><script src="/a.js" async></script></head>
<body><h1>Rope</h1><h2>Long</h2><h3>Short</h3><p>Sold by the metre &amp; cut. Ask us!</p><h2>Old</h2><a href="/care" rel="nofollow noopener">Care</a><a href="https://yard.test" target="_blank"><b>The</b> yard</a>
<img src="/i/knot.webp?x=1" width="3" height="4" loading="lazy"><img data-src="/i/late.png" alt=""><form action="/find" role="search"><input name="q"></form><form action="/in" method="POST"><input type="password"></form>
<iframe src="https://film.test/9" title="Film" loading="lazy"></iframe><div itemscope itemtype="https://schema.org/Offer"><span itemprop="price" content="9">9</span></div></body>"""


def test_html(spark):
    parsed = H.parse_pages(spark.createDataFrame([(1, "https://boats.test/rope", PAGE), (2, "u", None), (3, "u", "<p>cut <b>off")], "page_id long, url string, html string"))
    p = {r.page_id: r.page for r in parsed.collect()}
    assert (p[1].title, p[1].h1, p[1].h1_count, p[1].h2_count, p[1].canonical_url, p[1].language) == ("Rope and sail | Harbour shop", "Rope", 1, 2, "https://boats.test/rope", "pt")
    assert (p[1].meta_description, p[1].meta_keywords, p[1].meta_robots, p[1].viewport) == ("Sails, rope and paint for small boats.", "rope,sail", "noarchive", "initial-scale=1")
    assert (p[1].amp_url, p[1].has_media_query, p[1].og, p[1].twitter) == ("/amp/rope", True, {"og:title": "Boats"}, {"twitter:card": "summary"})
    assert [(x.href, x.nofollow, x.text) for x in p[1].links] == [("/care", True, "Care"), ("https://yard.test", False, "The yard")]
    assert [(x.src, x.alt, x.format, x.has_dimensions, x.is_lazy_loaded) for x in p[1].images] == [("/i/knot.webp?x=1", None, "webp", True, True), ("/i/late.png", "", "png", False, False)]
    assert [(x.schema_type, x.is_valid) for x in p[1].structured_data] == [("Offer", True), (None, False)]
    assert [(x.url, x.resource_type, x.is_render_blocking) for x in p[1].resources] == [("/s.css", "css", True), ("/a.js", "js", False)]
    assert [(x.action, x.method, x.has_password, x.is_search) for x in p[1].forms] == [("/find", "get", False, True), ("/in", "post", True, False)]
    assert (p[1].hreflang[0].lang_code, p[1].pagination[0].rel_type, p[1].iframes[0].title) == ("fr", "prev", "Film")
    assert [(x.format, x.name, x.value) for x in p[1].properties] == [("microdata", "https://schema.org/Offer", ""), ("microdata", "price", "9")]
    assert (p[2].word_count, p[2].title, p[3].body_text) == (0, None, "cut off")
    assert [(r.position, r.level, r.text) for r in H.child(parsed, "headings").where("page_id = 1").orderBy("position").collect()] == [(0, 1, "Rope"), (1, 2, "Long"), (2, 3, "Short"), (3, 2, "Old")]
    assert H.properties_of(parsed, "og").collect()[0].content == "Boats"


def test_css_selectors(spark):
    """Tags, classes, ids, attributes, children, descendants and commas; text, markup and attributes; the first five; what is none finds nothing."""
    html = "<div id=a class='x y'><p>one <b>two</b></p><p class=y lang=en-GB>three</p></div><ul>" + "".join(f"<li data-k='{k}'>i{k}" for k in range(7)) + "</ul><img class=y src=/i.png>"
    rules = [("tag", "p", "text"), ("child", "div > p.y", "text"), ("deep", "#a b", "html"), ("list", "li", "text"), ("some", "[data-k='3'], [lang|=en]", "text"), ("src", "img[src^=/i]", "attribute"), ("bad", "p:hover", "text"), ("none", "ul > p", "text")]
    d = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = H.custom_extract(d, [{"name": n, "expression": e, "extract_type": k, "attribute_name": "src"} for n, e, k in rules]).orderBy("page_id").collect()
    assert [got[0][n] for n, *_ in rules] == ["onetwo | three", "three", "<b>two</b>", "i0i1i2i3i4i5i6 | i1i2i3i4i5i6 | i2i3i4i5i6 | i3i4i5i6 | i4i5i6", "three | i3i4i5i6", "/i.png", "", ""]
    assert all(got[1][n] == "" for n, *_ in rules)


def test_link_headers(spark):
    d = spark.createDataFrame([({"Link": '<https://a/c>; rel="canonical", <https://a/2>; rel=next'},), ({"link": '<https://a/1>; rel="prev"'},), ({},), (None,)], "headers map<string,string>")
    assert [tuple(r)[1:] for r in H.header_links(d).collect()] == [("https://a/c", "https://a/2", None), (None, None, "https://a/1"), (None, None, None), (None, None, None)]


def test_robots(spark):
    texts = spark.createDataFrame([("example.com", "User-agent: *\nDisallow: /private/\nAllow: /private/public/\nCrawl-delay: 1\nSitemap: https://example.com/sitemap.xml")], "host string, text string")
    rules = S.parse_robots(texts)
    paths = spark.createDataFrame([("example.com", p) for p in ("/private/secret", "/private/public/page", "/")], "host string, path string")
    assert {r.path: r.allowed for r in S.robots_verdicts(rules, paths, "anybot").collect()} == {"/private/secret": False, "/private/public/page": True, "/": True}
    assert rules.where("directive in ('crawl-delay', 'sitemap')").count() == 2


def test_pagerank_and_depth(spark):
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node long")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0), (2, 2), (3, 2), (0, 9), (0, 1)], "s long, t long")
    r = {x.node: x for x in graph.pagerank(nodes, links).collect()}
    assert abs(sum(x["rank"] for x in r.values()) - 1) < 1e-6 and r[2].score == 100.0 and min(x.score for x in r.values()) == 0.0
    d = {x.node: x.depth for x in graph.click_depth(nodes, links, nodes.where("node = 0")).collect()}
    assert d == {0: 0, 1: 1, 2: 1, 3: None, 4: None}
    assert graph.pagerank(nodes.limit(0), links).count() == 0
    free = {x.node: x.depth for x in graph.click_depth(nodes, links, nodes.where("node > 99"), unreached=99).collect()}
    assert free == {2: 0, 0: 1, 1: 2, 3: 99, 4: 99}


def test_depth_of_a_long_chain(spark):
    nodes = spark.range(56).select(F.col("id").alias("node"))
    links = nodes.where("node < 54").select(F.col("node").alias("s"), (F.col("node") + 1).alias("t"))
    d = {x.node: x.depth for x in graph.click_depth(nodes, links, nodes.where("node = 0")).collect()}
    assert d == {k: k for k in range(55)} | {55: None}


def test_simhash_pairs_equal_brute_force(spark):
    """For every number of blocks; copies are one node with a count; closest partners against all pairs."""
    rows = [(k, f"{(0x123456789ABCDEF0 ^ (1 << (k * 7 % 64)) ^ (k % 9)):016x}") for k in range(60)] + [(100, "0" * 16), (101, None), (102, f"{0x123456789ABCDEF0:016x}"), (103, f"{0x123456789ABCDEF0:016x}"), (104, f"{0xFEDCBA9876543210:016x}"), (105, f"{0xFEDCBA9876543210:016x}")]
    d = spark.createDataFrame(rows, "doc_id long, simhash string")
    known: dict[str, list[int]] = {}
    for k, h in rows:
        if h and int(h, 16):
            known.setdefault(h, []).append(k)
    nodes = sorted((min(ids), h, len(ids)) for h, ids in known.items())
    expected = {(a, b, n, i, j) for x, (a, g, i) in enumerate(nodes) for b, h, j in nodes[x + 1 :] if (n := bin(int(g, 16) ^ int(h, 16)).count("1")) <= 6}
    for agree in (None, 1, 3):
        pairs = similarity.simhash_pairs(d, agree=agree)
        got = [(r.a, r.b, r.distance, r.copies_a, r.copies_b) for r in pairs.collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert similarity.blocks_for(1) == 1 and similarity.blocks_for(10**6) == 3 and similarity.blocks_for(10**12) == 6
    best = {r.doc_id: (r.closest, r.similarity, r.partners) for r in similarity.closest(d, pairs).collect()}
    assert best[104] == (105, 1.0, 1) and best[105] == (104, 1.0, 1) and 100 not in best
    for k, h in rows[:60]:
        near = [(bin(int(h, 16) ^ int(g, 16)).count("1"), j) for j, g in rows if j != k and g and int(g, 16)]
        near = [x for x in near if x[0] <= 6]
        assert (best[k][2] if k in best else 0) == len(near) and (not near or best[k][1] == round(1 - min(near)[0] / 64, 3))


def test_ngrams_and_hashes_of_edge_rows(spark):
    """Null and empty texts, repeated rows, ties by first place, words that are no plain letters."""
    from siteloom.functions import text as X
    from siteloom.operators import keywords

    d = spark.createDataFrame([(1, None), (2, ""), (3, "The boat, the BOAT and a sail; sail 9boat é"), (3, "boat"), (None, "sail rope")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.ngram_size, r["rank"], r.keyword, r.frequency, r.first_position, r.density) for r in keywords.top_ngrams(d).collect())
    assert got == [(0, 1, 1, "sail", 1, 0, 50.0), (0, 1, 2, "rope", 1, 1, 50.0), (0, 2, 1, "sail rope", 1, 0, 50.0), (3, 1, 1, "boat", 1, 0, 100.0), (3, 1, 1, "boat", 2, 0, 50.0), (3, 1, 2, "sail", 2, 2, 50.0),
        (3, 2, 1, "boat boat", 1, 0, 25.0), (3, 2, 2, "boat sail", 1, 1, 25.0), (3, 2, 3, "sail sail", 1, 2, 25.0), (3, 3, 1, "boat boat sail", 1, 0, 25.0), (3, 3, 2, "boat sail sail", 1, 1, 25.0)]
    assert sorted((r.doc_id or 0, r.simhash == "0" * 16) for r in X.simhash(d, "doc_id", "text").collect()) == [(0, False), (1, True), (2, True), (3, False), (3, False)]
    assert [X.word_syllables(w) for w in ("the", "sailed", "wanted", "little", "table-cloth", "pfft", "Rope")] == [1, 1, 2, 2, 3, 1, 1]
    assert keywords.top_ngrams(d.limit(0)).count() == 0


def test_diff_of_equal_snapshots_is_empty(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("url"), F.col("c_name").alias("title"))
    assert compare.diff(c, c, fields=("title",)).count() == 0


def test_sort_and_paging(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(["b", None, "10", "2", "A", "—"])], "url long, title string")
    assert [r.title for r in d.orderBy(*views.mixed_order("title")).collect()][:4] == ["2", "10", "A", "b"]
    assert [r.row_index for r in views.page_of(d, "url", page=2, page_size=2).orderBy("url").collect()] == [3, 4]
    assert d.where(views.matches("(", [F.col("title")])).count() == 0
    assert d.where(views.matches("(?P<n>b)(?P=n)?", [F.col("title")])).count() == 0  # no pattern of the JVM: plain text


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "https://e.com/a?utm_source=x", PAGE), (2, "https://e.com/a", PAGE), (3, "https://e.com/b", "<h1>B</h1>")], "page_id long, url string, html string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.write_tables(ingest.new_pages(ingest.read_pages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "features")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "headings")).where("text = 'B'").count() == 1


def test_log_lines(spark):
    line = '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /a?x=1 HTTP/1.0" 404 2326 "http://r" "Mozilla Googlebot/2.1"'
    v = S.parse_log(spark.createDataFrame([(line,), ("bad",), (None,)], "value string"))
    r = v.first()
    assert v.count() == 1 and (r.path, r.status, r.bytes, r.bot, str(r.time)) == ("/a?x=1", 404, 2326, "Googlebot Desktop", "2000-10-10 20:55:36")
