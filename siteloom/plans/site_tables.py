"""The audit's silver tables from the captured pages of a folder, and the same by patterns in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import capture
from ..operators.schemas import TABLES
from . import graph_sql
from .materialize import materialize, written

_kept: dict[tuple, tuple[list[str], object]] = {}


def _once(spark: SparkSession, key: tuple, make):
    """What ``make`` returns, made once for a session and key while all tables that it wrote live."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept or not set(_kept[key][0]) <= set(written(spark)):
        before = set(written(spark))
        made = make()
        _kept[key] = ([t for t in written(spark) if t not in before], made)
    return _kept[key][1]


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed pages, written once."""
    return _once(spark, ("parsed", sf_dir), lambda: materialize(capture.parse(spark.read.parquet(f"{sf_dir}/pages.parquet")), "parsed"))


def site_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of ``schemas.TABLES`` for the captured pages."""
    parsed = parsed_pages(spark, sf_dir)
    return _once(spark, ("tables", sf_dir), lambda: capture.tables(parsed))


def _decoded(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _words(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_ABSOLUTE = "CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} WHEN {h} LIKE '/%' THEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || {h} END"
_EMPTY = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


def site_sql(*names: str) -> str:
    """CTE definitions of the same tables over the view ``pages``; what its markup never holds is an empty table."""
    title = _words(_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    h1 = _words(_decoded("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))
    text = "regexp_replace(regexp_replace(html, '(?is)<(title|style|script)[^>]*>.*?</(title|style|script)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    body = _words(_decoded(text))
    links = f"""SELECT page_id * 1048576 + i - 1 AS link_id, page_id AS source_page_id, url AS source_url, {_ABSOLUTE.format(h="h")} AS target_url, {_words(_decoded("regexp_replace(a, '<[^>]*>', '', 'g')"))} AS anchor_text, h LIKE '/%' AS is_internal, false AS nofollow, '' AS rel, false AS target_blocked
  FROM (SELECT page_id, url, unnest(hs) AS h0, unnest(anchors) AS a, generate_subscripts(hs, 1) AS i, {_decoded("h0")} AS h FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a href="([^"]*)"', 1) AS hs, regexp_extract_all(html, '(?is)<a href="[^"]*"[^>]*>(.*?)</a>', 1) AS anchors FROM pages))"""
    known = {
        "fx_pages": f"""SELECT page_id, url, 200 AS status_code, 'text/html; charset=utf-8' AS content_type, nullif({title}, '') AS title, NULL::VARCHAR AS meta_description, {h1} AS h1, NULL::VARCHAR AS canonical, true AS is_indexable,
  g.depth AS crawl_depth, CAST(len(list_filter(string_split({body}, ' '), lambda w: w <> '')) AS INTEGER) AS word_count, CAST(length(html) AS BIGINT) AS html_size,
  NULL::DOUBLE AS response_time_ms, NULL::VARCHAR AS redirect_url, NULL::VARCHAR AS redirect_type, NULL::STRUCT(url VARCHAR, status INTEGER)[] AS redirect_chain, NULL::VARCHAR AS viewport, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
  NULL::VARCHAR AS og_title, NULL::VARCHAR AS og_description, NULL::VARCHAR AS og_image, NULL::VARCHAR AS og_type, NULL::VARCHAR AS twitter_card, md5({body}) AS content_hash, NULL::VARCHAR AS raw_hash, NULL::VARCHAR AS rendered_hash,
  CAST(len(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS INTEGER) AS dom_size, g.score AS internal_pagerank, false AS robots_blocked, NULL::DOUBLE AS lcp_ms, NULL::DOUBLE AS cls, NULL::DOUBLE AS fcp_ms, NULL::MAP(VARCHAR, VARCHAR) AS headers FROM pages LEFT JOIN ({graph_sql.captured('pages', f"({links})")}) g USING (url)""",
        "fx_links": links,
        "fx_headings": f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, tag, {_words(_decoded("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text FROM (SELECT page_id, unnest(tags) AS tag, unnest(texts) AS t, generate_subscripts(tags, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(h[1-6])[^>]*>', 1) AS tags, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS texts FROM pages))""",
        "fx_sitemap": "SELECT url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || '/sitemap.xml' AS sitemap_url FROM pages",
    }
    out = []
    for name in names:
        if name not in known:
            fields = [f.strip().split(" ", 1) for f in TABLES[name].split(", ")]
            known[name] = "SELECT " + ", ".join(f"NULL::{_EMPTY[t]} AS {f}" for f, t in fields) + " WHERE false"
        out.append(f"{name} AS MATERIALIZED ({known[name]})")
    return ",\n".join(out)
