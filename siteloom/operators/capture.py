"""Captured pages to the audit's silver tables: one parse of the markup, what fetches told, and the link graph.

``tables`` takes the parsed pages and, where there is one, a table of responses (``schemas.RESPONSES``: status, headers, times, redirects by URL). What no response tells is
null, or has the value of a plain successful fetch where every rule needs one (status, content type); headers that were not captured are null, so no rule takes them for missing ones.
Depth is the fewest links from the start page of a host, null for pages to which no link leads; rank is that of PageRank over the captured pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import urls as U
from ..plans.materialize import materialize
from ..sources import html as H
from . import graph
from .schemas import RESPONSES, TABLES

PARSED = ("title", "meta_description", "meta_robots", "viewport", "canonical_url", "language", "h1", "word_count", "content_hash", "dom_size", "og", "twitter", "links", "images", "headings", "structured_data", "resources", "hreflang", "pagination")
#: Bits of an element's position in an id made of page and position.
POSITION_BITS = 20


def parse(pages: DataFrame) -> DataFrame:
    """The parsed pages of (page_id, url, html)."""
    return H.parse_pages(pages.withColumn("html_size", F.length("html").cast("long")), keep=("page_id", "url", "html_size"), columns=PARSED)


def absolute(base, href):
    """A link's target: as it is, or below the page's origin or folder."""
    origin = F.concat(U.scheme(base), F.lit("://"), U.authority(base))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(U.scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, F.regexp_replace(U.path(base), "[^/]*$", ""), href))


def element_id(page, position):
    """An id in the order of pages and positions; a hash of both where either is too large for it."""
    fits = page.between(0, (1 << (63 - POSITION_BITS)) - 1) & (position < 1 << POSITION_BITS)
    return F.when(fits, F.shiftleft(page, POSITION_BITS) + position).otherwise(F.xxhash64(page, position))


def links_of(parsed: DataFrame) -> DataFrame:
    url = F.col("url")
    host = lambda c: F.lower(U.authority(c))
    links = H.child(parsed, "links").withColumn("target_url", absolute(url, F.col("href")))
    return links.select(
        element_id(F.col("page_id"), F.col("position")).alias("link_id"), F.col("page_id").alias("source_page_id"), url.alias("source_url"), "target_url", F.col("text").alias("anchor_text"),
        (host(F.col("target_url")) == host(url)).alias("is_internal"), "nofollow", "rel", F.lit(False).alias("target_blocked"),
    )


def start_pages(pages: DataFrame) -> DataFrame:
    """The start page of each host: its root if that was captured, else the page with the smallest id."""
    order = F.struct((~U.path(F.col("url")).isin("", "/")).alias("deep"), "page_id")
    return pages.groupBy(F.lower(U.authority(F.col("url"))).alias("host")).agg(F.min_by("url", order).alias("url")).select("url")


def link_graph(pages: DataFrame, links: DataFrame, start: str | None = None) -> DataFrame:
    """url, crawl_depth, internal_pagerank (0 to 100), rank, unique_inlinks and is_orphan of each captured URL.

    ``pages`` has page_id and url, ``links`` source_url, target_url and is_internal. URLs are numbered once; edges, levels and ranks hold numbers only.
    """
    ids = materialize(graph.url_dictionary(pages), "ids")
    number = lambda column, to: ids.select(F.col("url").alias(column), F.col("id").alias(to))
    found = links.where("is_internal").select("source_url", "target_url").distinct()
    edges = materialize(found.join(number("source_url", "s"), "source_url").join(number("target_url", "t"), "target_url").select("s", "t").where("s <> t"), "edges")
    nodes = ids.select(F.col("id").alias("node"))
    seeds = pages.where(F.col("url") == start).select("url").distinct() if start else pages.limit(0).select("url")
    if not start or seeds.isEmpty():
        seeds = start_pages(pages)
    seeds = materialize(seeds.join(ids, "url").select(F.col("id").alias("node")), "seeds")
    table = graph.EdgeTable(nodes, edges)
    depth = graph.click_depth(nodes, edges, seeds, table=table).select(F.col("node").alias("id"), F.col("depth").alias("crawl_depth"))
    ranks = graph.pagerank(nodes, edges, table=table).select(F.col("node").alias("id"), "rank", F.col("score").alias("internal_pagerank"))
    table.drop()
    into = edges.groupBy(F.col("t").alias("id")).agg(F.count("*").alias("unique_inlinks"))
    out = ids.join(depth, "id", "left").join(ranks, "id", "left").join(into, "id", "left").join(seeds.select(F.col("node").alias("id"), F.lit(True).alias("is_start")), "id", "left")
    return out.select("url", "crawl_depth", "internal_pagerank", "rank", F.coalesce("unique_inlinks", F.lit(0)).alias("unique_inlinks"), (F.col("unique_inlinks").isNull() & F.col("is_start").isNull()).alias("is_orphan"))


def told(responses: DataFrame | None, spark) -> DataFrame:
    """One response for each URL with all columns of ``RESPONSES``."""
    empty = spark.createDataFrame([], RESPONSES)
    if responses is None:
        return empty
    kinds = {f.name: f.dataType for f in empty.schema}
    full = responses.select(*[(F.col(n) if n in responses.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    rest = [n for n in kinds if n != "url"]
    # Several fetches of a URL are one: maps have no order, so their text decides between equals.
    return full.groupBy("url").agg(F.max_by(F.struct(*rest), F.struct("status_code", F.to_json(F.struct(*rest)))).alias("r")).select("url", "r.*")


def tables(parsed: DataFrame, responses: DataFrame | None = None, start: str | None = None, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of ``schemas.TABLES`` for parsed pages. The link graph is computed and written here unless it is given as ``found``; the others are lazy."""
    spark = parsed.sparkSession
    url, p = F.col("url"), lambda n: F.col(f"page.{n}")
    out = {"fx_links": links_of(parsed)}
    if found is None:
        found = materialize(link_graph(parsed.select("page_id", "url"), out["fx_links"], start), "graph")
    fetched = told(responses, spark)
    values = {
        "status_code": F.coalesce("_r.status_code", F.lit(200)), "content_type": F.coalesce("_r.content_type", F.lit("text/html; charset=utf-8")), "title": p("title"), "meta_description": p("meta_description"), "h1": p("h1"), "canonical": p("canonical_url"),
        "is_indexable": ~F.coalesce(F.lower(p("meta_robots")).contains("noindex"), F.lit(False)) & (F.coalesce("_r.status_code", F.lit(200)) == 200), "word_count": p("word_count"), "viewport": p("viewport"), "lang": p("language"),
        "og_title": p("og")["og:title"], "og_description": p("og")["og:description"], "og_image": p("og")["og:image"], "og_type": p("og")["og:type"], "twitter_card": p("twitter")["twitter:card"],
        "content_hash": p("content_hash"), "dom_size": p("dom_size"), "robots_blocked": F.coalesce("_r.robots_blocked", F.lit(False)), "page_id": F.col("page_id"), "url": url, "html_size": F.col("html_size"),
        "crawl_depth": F.col("_g.crawl_depth"), "internal_pagerank": F.col("_g.internal_pagerank"),
    }
    values |= {n: F.col(f"_r.{n}") for n in fetched.columns if n not in values}
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], TABLES["fx_pages"]).schema}
    joined = parsed.join(fetched.select("url", F.struct(*fetched.columns).alias("_r")), "url", "left").join(found.select("url", F.struct("crawl_depth", "internal_pagerank").alias("_g")), "url", "left")
    out["fx_pages"] = joined.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    child = lambda n: H.child(parsed, n)
    out["fx_images"] = child("images").select("page_id", "url", absolute(url, F.col("src")).alias("src"), F.col("alt").alias("alt_text"), "format", F.lit(None).cast("long").alias("file_size"), "has_dimensions", "is_lazy_loaded", F.lit(False).alias("is_broken"))
    out["fx_headings"] = child("headings").select("page_id", "position", "tag", "text")
    out["fx_resources"] = H.child(parsed, "resources", keep=("page_id",)).select("page_id", "url", "resource_type", "is_render_blocking")
    out["fx_hreflang"] = child("hreflang").select("page_id", "url", "lang_code", absolute(url, F.col("target_url")).alias("target_url"))
    out["fx_pagination"] = child("pagination").select(element_id(F.col("page_id"), F.col("position")).alias("tag_id"), "page_id", "url", "rel_type", absolute(url, F.col("target_url")).alias("target_url"))
    out["fx_structured"] = child("structured_data").select("page_id", "url", "data_json")
    out["fx_sitemap"] = parsed.select("url", F.concat(U.scheme(url), F.lit("://"), U.authority(url), F.lit("/sitemap.xml")).alias("sitemap_url"))
    out["fx_status"] = spark.createDataFrame([], TABLES["fx_status"])
    return out
