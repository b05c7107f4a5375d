"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from siteloom.functions import text as X, urls as U


@pytest.mark.parametrize(
    "raw,base,expected",
    [
        ("/about/", "https://EXAMPLE.com/page", "https://example.com/about"),
        ("contact/?utm_source=google&utm_medium=cpc&ref=xyz#section", "https://example.com/", "https://example.com/contact?ref=xyz"),
        ("/products/shoes/?fbclid=12345", "https://example.com/", "https://example.com/products/shoes"),
        ("https://example.com/", "https://example.com/", "https://example.com/"),
        ("/blog/post-1/", "https://example.com", "https://example.com/blog/post-1"),
        ("page.html?utm_source=google&id=42#reviews", "https://example.com/section/", "https://example.com/section/page.html?id=42"),
        ("https://EXAMPLE.COM/about/?fbclid=XYZ&ref=abc", "https://example.com", "https://example.com/about?ref=abc"),
        ("/products/item?gclid=123", "https://example.com/catalog/", "https://example.com/products/item"),
    ],
)
def test_normalize(spark, raw, base, expected):
    row = spark.createDataFrame([(raw, base)], "u string, b string").select(U.normalize(F.col("u"), F.col("b")).alias("x")).first()
    assert row.x == expected


def test_normalize_twice(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select(U.normalize(F.col("url")).alias("x"))
    assert d.where(U.normalize(F.col("x")) != F.col("x")).count() == 0


def test_simhash_golden(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog and explores search engine optimization techniques."), (2, ""), (3, "The quick brown fox jumps over the lazy dog"), (4, "The fast brown fox jumps over the lazy dog"), (5, "Complete different content about finance and stock markets and investment options")]
    h = {r["k"]: r["simhash"] for r in X.simhash(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert h[1] == "2fd478f4cd0967de" and h[2] == "0" * 16
    apart = lambda a, b: bin(int(h[a], 16) ^ int(h[b], 16)).count("1")
    assert apart(3, 4) < apart(3, 5)


@pytest.mark.parametrize("url,internal,crawl", [("https://example.com/about", True, True), ("https://google.com/about", False, False), ("https://example.com/blocked", True, False), ("https://example.com/allowed-special", True, True), ("https://example.com/wp-admin/post.php", True, False), ("https://example.com/file.pdf", True, False), ("https://example.com/a/a/a/a/a/b", True, False), (None, None, False)])
def test_scope(spark, url, internal, crawl):
    d = spark.createDataFrame([(url, 1)], "u string, d int")
    r = d.select(U.is_internal(F.col("u"), "example.com", allowed=("blog.example.com",)).alias("i"), U.should_crawl(F.col("u"), F.col("d"), "example.com", allowed=("blog.example.com",), block=("https://example.com/blocked",), allow=("https://example.com/allowed-special",), max_depth=5).alias("c")).first()
    assert (r.i, r.c) == (internal, crawl)


def test_text(spark):
    r = spark.createDataFrame([("Hello, World. Two words! a@b.com and x@y.png",)], "t string").select(X.word_count(F.col("t")).alias("w"), X.emails(F.col("t")).alias("e"), X.pixel_width(F.lit("iW")).alias("p"), X.syllables(F.lit("table")).alias("s"), X.syllables(F.lit("jumped")).alias("j"), X.short_label(F.lit("x" * 40)).alias("l"), X.preview(F.array(*[F.lit(c) for c in "abcdef"])).alias("v"), X.ngrams(F.array(F.lit("a")), 2).alias("n")).first()
    assert (r.w, r.e, r.p, r.s, r.j, len(r.l), r.v, r.n) == (7, ["a@b.com"], 26, 2, 1, 36, "a, b, c, d and 2 more", [])
