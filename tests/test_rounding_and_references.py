"""Values that SQL and Spark rounded or decoded differently on larger tables."""

import json

from pyspark.sql import functions as F

from siteloom.functions import fields as P
from siteloom.operators import graph
from siteloom.sources import html as H, xpath


def test_sizes_round_halves_to_even(spark):
    sizes = [0, 1023, 1024, 1664, 2176, 2688, 1029, 1048575, 1048576, 1048576 + 131072, 3 * 1048576 + 655360, 1 << 40]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long")
    text = lambda n: f"{n / 1048576:.2f} Mb" if n >= 1048576 else f"{n / 1024:.2f} Kb" if n >= 1024 else f"{n} B"
    assert {r.n: r.t for r in rows.select("n", P.format_size(F.col("n")).alias("t")).collect()} == {n: text(n) for n in sizes}


def test_references_without_a_semicolon_stay():
    page = '<title>a&amp;&amp</title><h1>b&amp;&copy &#65; &#65 &nosuch; &lt</h1><a href="/x?a=1&amp;b=2&amp">t</a><script type="application/ld+json">{"a": "x & y &amp z"}</script>'
    found = H.parse(page)
    assert found["title"] == "a&&amp" and found["h1"] == "b&&copy A &#65 &nosuch; &lt" and found["links"][0]["href"] == "/x?a=1&b=2&amp"
    assert json.loads(found["structured_data"][0]["data_json"]) == {"a": "x & y &amp z"}
    tree = xpath.Tree(page)
    assert xpath.evaluate(xpath.compiled("//h1"), tree) == ["b&&copy A &#65 &nosuch; &lt"] and xpath.evaluate(xpath.compiled("//a/@href"), tree) == ["/x?a=1&b=2&amp"]


def test_css_keeps_references_without_a_semicolon(spark):
    rows = spark.createDataFrame([('<article><h1>a&amp;&amp</h1></article>',)], "html string")
    assert H.custom_extract(rows, [{"name": "h", "expression": "article > h1"}]).first().h == "a&&amp"


def test_scores_are_rounded_once(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    links = spark.range(400).select((F.col("id") % 40).alias("s"), (F.col("id") * F.col("id") % 37).alias("t"))
    full = {r.node: r.score for r in graph.pagerank(nodes, links, digits=12).collect()}
    one = {r.node: r.score for r in graph.pagerank(nodes, links, digits=1).collect()}
    two = {r.node: r.score for r in graph.pagerank(nodes, links).collect()}
    assert all(abs(one[n] - full[n]) <= 0.05 + 1e-9 and abs(two[n] - full[n]) <= 0.005 + 1e-9 for n in full)


def test_pagerank_equals_plain_rounds(spark):
    """Blocks of rounds give the ranks of the same number of plain rounds, nodes without outgoing edges included."""
    nodes = spark.range(60).select(F.col("id").alias("node"))
    pairs = sorted({(k % 53, k * k % 59) for k in range(300)})
    links = spark.createDataFrame(pairs, "s long, t long")
    edges = {(s, t) for s, t in pairs if s != t}
    out = {s: sum(a == s for a, _ in edges) for s in range(60)}
    history = [[1 / 60] * 60]
    for _ in range(100):
        r = history[-1]
        lost = sum(r[k] for k in range(60) if not out[k])
        history.append([0.15 / 60 + 0.85 * (sum(r[s] / out[s] for s, t in edges if t == k) + lost / 60) for k in range(60)])
    stop = next(k for k in range(1, 101) if sum(abs(a - b) for a, b in zip(history[k], history[k - 1])) < 1e-6)
    for rounds, tolerance, expected in ((1, None, 1), (8, None, 8), (11, None, 11), (100, 1e-6, stop)):
        got = {r.node: r["rank"] for r in graph.pagerank(nodes, links, rounds=rounds, tolerance=tolerance).collect()}
        assert all(abs(got[k] - history[expected][k]) < 1e-15 for k in range(60))
