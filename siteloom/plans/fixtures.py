"""Crawl tables for the audit's queries, in Spark and as SQL: a page and more for each supplier of the given tables, and rows with one case or more for each rule.

The captured pages of the given tables hold no headers, redirects or tags, so these are derived from the suppliers: a row of the supplier table makes a page, its links, images, headings, tags,
structured data, responses and sitemap entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.schemas import TABLES

_PAGE = dict(
    page_id=0, url="", status_code=200, content_type="text/html; charset=utf-8", title="A title that is neither short nor long", meta_description="A description of this page that is long enough for a result page to show it whole.", h1="A heading", canonical=None, is_indexable=True,
    crawl_depth=1, word_count=400, html_size=12000, response_time_ms=200.0, redirect_url=None, redirect_type=None, redirect_chain=None, viewport="width=device-width, initial-scale=1", lang="en",
    og_title="t", og_description="d", og_image="i", og_type="website", twitter_card="summary", content_hash=None, raw_hash=None, rendered_hash=None, dom_size=300, internal_pagerank=20.0, robots_blocked=False, lcp_ms=1200.0, cls=0.01, fcp_ms=900.0, headers=None,
)
_GOOD = {"Strict-Transport-Security": "max-age=31536000; includeSubDomains", "Content-Security-Policy": "default-src 'self'", "X-Content-Type-Options": "nosniff", "X-Frame-Options": "DENY", "Referrer-Policy": "same-origin"}
_BAD = {"Strict-Transport-Security": "max-age=60", "Content-Security-Policy": "script-src 'unsafe-inline' 'unsafe-eval'", "X-Content-Type-Options": "none", "X-Frame-Options": "ALLOWALL", "Referrer-Policy": "unsafe-url"}
E1 = "https://example.com"


def _page(k: int, path: str, **over) -> dict:
    return _PAGE | {"page_id": k, "url": path if "://" in path else E1 + path, "content_hash": f"h{k}", "title": f"A title that is neither short nor long {k}", "meta_description": _PAGE["meta_description"] + f" {k}", "h1": f"A heading {k}", "headers": _GOOD} | over


PAGES = [
    _page(1, "/", crawl_depth=0, canonical=E1 + "/"),
    _page(2, "/about", canonical=E1 + "/about", title="Short", h1="short", viewport="width=500, maximum-scale=1"),
    _page(3, "/Old_Page", status_code=301, redirect_url=E1 + "/about", redirect_chain=[("http://example.com/Old_Page", 301), (E1 + "/about", 200)], is_indexable=False, response_time_ms=1500.0),
    _page(4, "/missing", status_code=404, is_indexable=False, redirect_url=E1 + "/gone", crawl_depth=5),
    _page(5, "/broken", status_code=503, title=None, meta_description=" ", h1="", crawl_depth=7, response_time_ms=4000.0, headers=_BAD, viewport=None, lang=None),
    _page(6, "/a/b/c/d/e/f?x=1&y=2&z=3", title="Same title for two pages, long enough", canonical=E1 + "/missing", headers={}, og_title=None, og_description=None, og_image=None, og_type=None, twitter_card=None),
    _page(7, "/dup", title="Same title for two pages, long enough", meta_description="short", content_hash="h6", word_count=40, og_title="x" * 100, twitter_card="large"),
    _page(8, "http://example.com/plain", word_count=150, h1="H" * 80, title="T" * 70, meta_description="M" * 170, html_size=6000000, dom_size=2000, lcp_ms=3000.0, cls=0.3, fcp_ms=2000.0),
    _page(9, "/loop", status_code=310, redirect_type="Redirect Loop / Too Many Redirects", is_indexable=None, crawl_depth=None),
    _page(10, "/self/", status_code=302, redirect_url=E1 + "/Self", redirect_chain=[(E1 + "/self", 302), (E1 + "/x", 302), ("http://other.com/y", 301), (E1 + "/self/", 200)], is_indexable=False, html_size=4000000),
    _page(11, "/privacy", internal_pagerank=80.0, canonical=E1 + "/privacy?p=1", is_indexable=False, raw_hash="a", rendered_hash="b"),
    _page(12, "/caf%C3%A9 menu", internal_pagerank=5.0, robots_blocked=True, canonical=E1 + "/about", content_type="application/pdf", word_count=None),
    _page(13, "/" + "long-" * 25, status_code=204, crawl_depth=4),
    _page(14, "/list?page=2", canonical=E1 + "/list", is_indexable=False),
    _page(15, "/list", redirect_chain=[(E1 + "/u", 307), (E1 + "/v", 308)]),
]


def _link(k, source, target, anchor="a useful anchor", internal=True, nofollow=False, rel=None, blocked=False) -> dict:
    by_id = {p["page_id"]: p["url"] for p in PAGES}
    return dict(link_id=k, source_page_id=source, source_url=by_id[source], target_url=target if "://" in target else E1 + target, anchor_text=anchor, is_internal=internal, nofollow=nofollow, rel=rel, target_blocked=blocked)


LINKS = [
    _link(1, 1, "/about"), _link(2, 1, "/dup", "here"), _link(3, 1, "/missing", ""), _link(4, 1, "/Old_Page/", nofollow=True), _link(5, 1, "/a/b/c/d/e/f?x=1&y=2&z=3"), _link(6, 1, "/caf%C3%A9 menu", blocked=True),
    _link(7, 2, "/"), _link(8, 2, "/Old_Page"), _link(9, 3, "/"), _link(10, 7, "/", "x" * 120), _link(11, 7, "/about", "Read More"), _link(12, 7, "/not-crawled"),
    _link(13, 1, "http://outside.org/a", internal=False, rel="nofollow"), _link(14, 1, "https://outside.org/b", internal=False, rel="noopener"), _link(15, 2, "https://outside.org/dead", " ", internal=False),
    _link(16, 2, "/privacy"), _link(17, 2, "/dup"), _link(18, 14, "/list"), _link(19, 15, "/list?page=2"), _link(20, 6, "/broken"), _link(21, 2, "/loop"), _link(22, 1, "/about", "about again"), _link(23, 1, "/"),
]
IMAGES = [
    dict(page_id=k, url=E1 + u, src=s, alt_text=a, format=f, file_size=z, has_dimensions=d, is_lazy_loaded=l, is_broken=b)
    for k, u, s, a, f, z, d, l, b in [
        (1, "/", E1 + "/img/hero.webp", "Hero", "webp", 50000, True, True, False), (1, "/", E1 + "/IMG_0042.jpg?v=1", None, "jpg", 300000, False, False, False),
        (2, "/about", E1 + "/12345.png", "", "PNG", 150000, True, False, True), (2, "/about", E1 + "/chart.svg", "x" * 130, "svg", None, None, None, None),
    ]
]
HEADINGS = [dict(page_id=p, position=i, tag=t, text=x) for p, i, t, x in [(1, 0, "h1", "A heading 1"), (1, 1, "h2", "Two"), (1, 2, "h3", "Three"), (2, 0, "h1", "short"), (2, 1, "h1", "Second"), (2, 2, "h3", "Skips"), (7, 0, "h2", "No first"), *[(8, k, "h2" if k else "h1", f"n{k}") for k in range(32)]]]
RESOURCES = [dict(page_id=p, url=u, resource_type=t, is_render_blocking=b) for p, u, t, b in [(1, E1 + "/a.css", "css", True), (1, "http://example.com/b.js", "js", False), *[(2, f"{E1}/{k}.js", "js", k < 7) for k in range(60)]]]
HREFLANG = [
    dict(page_id=p, url=E1 + u, lang_code=c, target_url=t if "://" in t else E1 + t)
    for p, u, c, t in [(1, "/", "en", "/"), (1, "/", "es", "/about"), (1, "/", "x-default", "/"), (2, "/about", "en", "/"), (2, "/about", "EN-us", "/missing"), (7, "/dup", "fr-FR", "/Old_Page"), (14, "/list?page=2", "de", "https://other.org/x")]
]
PAGINATION = [
    dict(tag_id=i, page_id=p, url=E1 + u, rel_type=r, target_url=E1 + t)
    for i, (p, u, r, t) in enumerate([(14, "/list?page=2", "prev", "/list"), (14, "/list?page=2", "next", "/list"), (15, "/list", "next", "/list/"), (1, "/", "next", "/missing"), (2, "/about", "next", "/Old_Page"), (7, "/dup", "prev", "/nowhere")])
]
SITEMAP = [dict(url=u if "://" in u else E1 + u, sitemap_url=E1 + s) for u, s in [("/", "/sitemap.xml"), ("/about/", "/sitemap.xml"), ("/missing", "/sitemap.xml"), ("/Old_Page", "/sitemap2.xml"), ("/privacy", "/sitemap2.xml"), ("/list", "/sitemap2.xml"), ("/self/", "/sitemap2.xml"), ("/nowhere", "/sitemap2.xml"), ("http://example.com/plain", "/sitemap2.xml")]]
STRUCTURED = [
    dict(page_id=p, url=E1 + u, data_json=j)
    for p, u, j in [
        (1, "/", '{"@context": "https://schema.org", "@type": "Organization", "name": "E"}'), (2, "/about", '{"@type": "Article", "headline": "x"}'), (2, "/about", "{not json"), (7, "/dup", '[{"@context": "https://schema.org", "@type": "Product", "offers": "1"}]'),
        (8, "/plain", '{"@context": "https://schema.org", "@type": "BreadcrumbList"}'), (15, "/list", '{"@context": "https://schema.org"}'), (15, "/list", '{"@context": "https://schema.org", "@type": "LocalBusiness"}'),
    ]
]
STATUS = [dict(url="https://outside.org/dead", status_code=404), dict(url="https://outside.org/b", status_code=200), dict(url=E1 + "/not-crawled", status_code=500)]

ROWS = {"fx_pages": PAGES, "fx_links": LINKS, "fx_images": IMAGES, "fx_headings": HEADINGS, "fx_resources": RESOURCES, "fx_hreflang": HREFLANG, "fx_pagination": PAGINATION, "fx_sitemap": SITEMAP, "fx_structured": STRUCTURED, "fx_status": STATUS}
SCHEMAS = {name: (ROWS[name], schema) for name, schema in TABLES.items()}


_K, _ABOUT = "s_suppkey", "All the parts that ' || s_name || ' supplies, with prices, stock and times of delivery for each nation"
_TEXT = f"CAST({_K} AS STRING)"
_HERE = f"CASE WHEN {_K} % 13 = 5 THEN 'http' ELSE 'https' END || '://example.com/s/' || {_TEXT} || CASE WHEN {_K} % 9 = 4 THEN '/' ELSE '' END"


def _at(shift: str) -> str:
    return f"'{E1}/s/' || CAST({_K} {shift} AS STRING)"


#: Columns of the rows that a supplier makes; CHAIN and MAP stand for what the two engines write differently. Columns that aren't named are null.
DERIVED = {
    "fx_pages": [
        dict(
            page_id=f"1000 + {_K}", url=_HERE, status_code=f"CASE {_K} % 12 WHEN 3 THEN 404 WHEN 7 THEN 503 WHEN 5 THEN 301 ELSE 200 END", content_type=f"CASE WHEN {_K} % 11 = 10 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END",
            title=f"CASE {_K} % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Short' WHEN 2 THEN 'The same title for many suppliers, long enough' ELSE s_name || ' and the parts it supplies' END",
            meta_description=f"CASE {_K} % 6 WHEN 0 THEN NULL WHEN 1 THEN 'short' ELSE '{_ABOUT}' END", h1=f"CASE WHEN {_K} % 8 <> 0 THEN s_name END", canonical=f"CASE {_K} % 5 WHEN 0 THEN NULL WHEN 1 THEN {_at('+ 1')} ELSE {_HERE} END",
            is_indexable=f"{_K} % 7 <> 2", crawl_depth=f"CASE WHEN {_K} % 15 <> 14 THEN 1 + {_K} % 7 END", word_count=f"{_K} * 37 % 900", html_size=f"CASE WHEN {_K} % 20 = 19 THEN 6000000 + {_K} ELSE 5000 + {_K} * 1013 END", response_time_ms=f"{_K} * 131 % 4000",
            redirect_url=f"CASE WHEN {_K} % 12 = 5 THEN {_at('+ 2')} END", redirect_chain=f"CASE WHEN {_K} % 12 = 5 THEN CHAIN({_HERE};301;{_at('+ 2')};200) END", viewport=f"CASE WHEN {_K} % 4 <> 0 THEN 'width=device-width, initial-scale=1' END", lang=f"CASE WHEN {_K} % 9 <> 0 THEN 'en' END",
            og_title=f"CASE WHEN {_K} % 3 <> 0 THEN s_name END", og_description=f"CASE WHEN {_K} % 3 = 1 THEN '{_ABOUT}' END", og_image=f"CASE WHEN {_K} % 3 <> 0 THEN '/img/' || {_TEXT} || '.jpg' END", og_type=f"CASE WHEN {_K} % 4 = 1 THEN 'website' END", twitter_card=f"CASE WHEN {_K} % 2 = 0 THEN 'summary' END",
            content_hash=f"'c' || CAST({_K} % 40 AS STRING)", raw_hash=f"'r' || {_TEXT}", rendered_hash=f"'r' || CAST({_K} - {_K} % 2 AS STRING)", dom_size=f"{_K} * 53 % 2500", internal_pagerank=f"{_K} * 17 % 100", robots_blocked=f"{_K} % 16 = 9", lcp_ms=f"{_K} * 97 % 5000", cls=f"{_K} % 32 * 0.0078125", fcp_ms=f"{_K} * 61 % 4000",
            headers=f"CASE {_K} % 3 WHEN 0 THEN MAP('Strict-Transport-Security';'max-age=60';'X-Frame-Options';'DENY') WHEN 1 THEN MAP('Content-Security-Policy';'default-src *';'X-Content-Type-Options';'nosniff') END",
        ),
    ],
    "fx_links": [
        dict(link_id=f"100000 + 4 * {_K}", source_page_id=f"1000 + {_K}", source_url=_HERE, target_url=_at("+ 1"), anchor_text=f"CASE {_K} % 4 WHEN 0 THEN 'read more' WHEN 1 THEN '' ELSE 'the next supplier' END", is_internal="true", nofollow=f"{_K} % 6 = 0", rel=f"CASE WHEN {_K} % 6 = 0 THEN 'nofollow' END", target_blocked=f"{_K} % 14 = 3"),
        dict(link_id=f"100001 + 4 * {_K}", source_page_id=f"1000 + {_K}", source_url=_HERE, target_url=f"'{E1}/'", anchor_text="'Home of the shop'", is_internal="true", nofollow="false", target_blocked="false"),
        dict(link_id=f"100002 + 4 * {_K}", source_page_id=f"1000 + {_K}", source_url=_HERE, target_url=f"'https://other.org/p/' || {_TEXT}", anchor_text="s_name", is_internal="false", nofollow="false", rel="'noopener'", target_blocked="false"),
    ],
    "fx_images": [dict(page_id=f"1000 + {_K}", url=_HERE, src=f"'{E1}/img/' || {_TEXT} || '.jpg'", alt_text=f"CASE WHEN {_K} % 3 <> 0 THEN s_name END", format="'jpg'", file_size=f"{_K} * 3000", has_dimensions=f"{_K} % 2 = 0", is_lazy_loaded=f"{_K} % 5 = 0", is_broken=f"{_K} % 10 = 9")],
    "fx_headings": [dict(page_id=f"1000 + {_K}", position="0", tag="'h1'", text="s_name"), dict(page_id=f"1000 + {_K}", position="1", tag=f"CASE {_K} % 4 WHEN 0 THEN 'h3' WHEN 1 THEN 'h1' ELSE 'h2' END", text="'Parts'")],
    "fx_resources": [dict(page_id=f"1000 + {_K}", url=f"'{E1}/s.css'", resource_type="'css'", is_render_blocking="true"), dict(page_id=f"1000 + {_K}", url=f"CASE WHEN {_K} % 8 = 1 THEN 'http' ELSE 'https' END || '://cdn.test/' || {_TEXT} || '.js'", resource_type="'js'", is_render_blocking=f"{_K} % 3 = 0")],
    "fx_hreflang": [dict(page_id=f"1000 + {_K}", url=_HERE, lang_code="'en'", target_url=_HERE), dict(page_id=f"1000 + {_K}", url=_HERE, lang_code=f"CASE WHEN {_K} % 5 = 0 THEN 'deutsch' ELSE 'de' END", target_url=f"CASE WHEN {_K} % 2 = 0 THEN {_at('+ 1')} ELSE {_at('- 1')} END")],
    "fx_pagination": [dict(tag_id=f"1000 + 2 * {_K}", page_id=f"1000 + {_K}", url=_HERE, rel_type="'next'", target_url=_at("+ 1")), dict(tag_id=f"1001 + 2 * {_K}", page_id=f"1000 + {_K}", url=_HERE, rel_type="'prev'", target_url=_at("- 1"))],
    "fx_sitemap": [dict(url=f"CASE WHEN {_K} % 4 <> 3 THEN {_HERE} ELSE {_at('+ 1000000')} END", sitemap_url=f"'{E1}/sitemap-suppliers.xml'")],
    "fx_structured": [dict(page_id=f"1000 + {_K}", url=_HERE, data_json=f"""CASE {_K} % 4 WHEN 0 THEN '{{"@context": "https://schema.org", "@type": "Organization", "name": "' || s_name || '"}}' WHEN 1 THEN '{{"@type": "Product"}}' WHEN 2 THEN '{{broken' ELSE '[{{"@context": "https://schema.org", "@type": "Article", "headline": "h"}}]' END""")],
    "fx_status": [dict(url=f"'https://other.org/p/' || {_TEXT}", status_code=f"CASE WHEN {_K} % 5 = 0 THEN 404 ELSE 200 END")],
}


def _expression(text: str, chain: str, hop: str, pairs: str, between: str) -> str:
    import re

    def chained(m) -> str:
        a, s, b, t = m[1].split(";")
        return chain.format(", ".join(hop.format(u, c) for u, c in ((a, s), (b, t))))

    def mapped(m) -> str:
        parts = m[1].split(";")
        return pairs.format(", ".join(f"{k}{between}{v}" for k, v in zip(parts[::2], parts[1::2])))

    return re.sub(r"MAP\(([^()]*)\)", mapped, re.sub(r"CHAIN\((.*)\)(?= END$)", chained, text))


def tables(spark: SparkSession, sf_dir: str | None = None) -> dict[str, DataFrame]:
    """The tables; without a folder only the rows with a case for each rule."""
    from pyspark.sql import types as T

    out = {}
    for name, (rows, schema) in SCHEMAS.items():
        shape = T._parse_datatype_string(schema)
        out[name] = spark.createDataFrame([tuple(r[f.name] for f in shape.fields) for r in rows], shape)
        for made in DERIVED[name] if sf_dir else ():
            of = lambda e: _expression(e, "array({})", "named_struct('url', {}, 'status', {})", "map({})", ", ")
            more = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*[f"CAST({of(made[f.name]) if f.name in made else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in shape.fields])
            out[name] = out[name].unionByName(more)
    return out


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, dict):
        return "MAP {" + ", ".join(f"{_value(k)}: {_value(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join("{'url': " + _value(u) + ", 'status': " + _value(s) + "}" for u, s in v) + "]"
    return repr(v)


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "array<struct<url:string,status:int>>": "STRUCT(url VARCHAR, status INTEGER)[]", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}


def values_sql(*names: str) -> str:
    """CTE definitions of the same tables."""
    import re

    out = []
    for name in names:
        rows, schema = SCHEMAS[name]
        fields = [f.strip().split(" ", 1) for f in re.split(r", (?=[a-z_0-9]+ [a-z])", schema)]
        columns = [f for f, _ in fields]
        casts = ", ".join(f"CAST({f} AS {_TYPES.get(t, t.upper())}) AS {f}" for f, t in fields)
        body = ", ".join("(" + ", ".join(_value(r[c]) for c in columns) + ")" for r in rows)
        of = lambda e: _expression(e, "[{}]", "{{'url': {}, 'status': {}}}", "MAP {{{}}}", ": ")
        more = "".join(f" UNION ALL SELECT {', '.join(f'CAST({of(made.get(f, 'NULL'))} AS {_TYPES.get(t, t.upper())}) AS {f}' for f, t in fields)} FROM supplier" for made in DERIVED[name])
        out.append(f"{name} AS MATERIALIZED (SELECT {casts} FROM (VALUES {body}) v({', '.join(columns)}){more})")
    return ",\n".join(out)
