"""Columns of an audit's silver tables, as Spark DDL."""

TABLES = {
    "fx_pages": (
        "page_id bigint, url string, status_code int, content_type string, title string, meta_description string, h1 string, canonical string, is_indexable boolean, crawl_depth int, word_count int, html_size bigint, response_time_ms double, "
        "redirect_url string, redirect_type string, redirect_chain array<struct<url:string,status:int>>, viewport string, lang string, og_title string, og_description string, og_image string, og_type string, twitter_card string, content_hash string, "
        "raw_hash string, rendered_hash string, dom_size int, internal_pagerank double, robots_blocked boolean, lcp_ms double, cls double, fcp_ms double, headers map<string,string>"
    ),
    "fx_links": "link_id bigint, source_page_id bigint, source_url string, target_url string, anchor_text string, is_internal boolean, nofollow boolean, rel string, target_blocked boolean",
    "fx_images": "page_id bigint, url string, src string, alt_text string, format string, file_size bigint, has_dimensions boolean, is_lazy_loaded boolean, is_broken boolean",
    "fx_headings": "page_id bigint, position int, tag string, text string",
    "fx_resources": "page_id bigint, url string, resource_type string, is_render_blocking boolean",
    "fx_hreflang": "page_id bigint, url string, lang_code string, target_url string",
    "fx_pagination": "tag_id bigint, page_id bigint, url string, rel_type string, target_url string",
    "fx_sitemap": "url string, sitemap_url string",
    "fx_structured": "page_id bigint, url string, data_json string",
    "fx_status": "url string, status_code int",
}
#: What a fetch tells about a page beside its markup; all columns but the URL may be null or absent.
RESPONSES = "url string, status_code int, content_type string, response_time_ms double, redirect_url string, redirect_type string, redirect_chain array<struct<url:string,status:int>>, headers map<string,string>, lcp_ms double, cls double, fcp_ms double, robots_blocked boolean"
