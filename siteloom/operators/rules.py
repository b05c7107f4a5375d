"""Issue rules as declarations, evaluated in one scan of their relation.

A rule is a predicate and an element expression in SQL. All rules of a relation become one array of structs that is
compacted and exploded, so a hundred rules cost one pass and no join. Predicates that need another relation read
columns that ``operators.audit`` joins in first.

Predicates use what Spark and other SQL engines share; ``LIKE_RE(x, 'pattern')`` stands for a regular expression search.
A null predicate is false.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F


class Rule(NamedTuple):
    pack: str
    issue_type: str
    severity: str
    when: str
    element: str = "''"


def pack(name: str, *rules: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(name, *r) for r in rules)


C, W, I = "critical", "warning", "info"

#: Over prepared pages (``operators.audit.prepare_pages``): page-local rules and those on joined flags.
PAGE_RULES = (
    *pack(
        "technical",
        ("4xx_error", C, "status_code BETWEEN 400 AND 499", "CAST(status_code AS STRING)"),
        ("5xx_error", C, "status_code >= 500", "CAST(status_code AS STRING)"),
        ("3xx_redirect", I, "status_code BETWEEN 300 AND 399", "coalesce(redirect_url, '')"),
        ("non_200_status", W, "status_code < 300 AND status_code <> 200", "CAST(status_code AS STRING)"),
        ("redirect_loop_exceeded", C, "loop_exceeded"),
        ("self_redirect", C, "NOT loop_exceeded AND redirect_url <> '' AND lower(rtrim_slash(redirect_url)) = lower(rtrim_slash(url))", "redirect_url"),
        ("redirect_loop", C, "NOT loop_exceeded AND chain_repeats"),
        ("long_redirect_chain", C, "NOT loop_exceeded AND chain_length > 3", "chain_text"),
        ("redirect_chain", W, "NOT loop_exceeded AND chain_length IN (2, 3)", "chain_text"),
        ("redirect_domain_change", I, "NOT loop_exceeded AND chain_length > 0 AND chain_final_host <> chain_first_host", "chain_text"),
        ("redirect_protocol_downgrade", W, "NOT loop_exceeded AND chain_downgrade", "chain_text"),
        ("mixed_redirect_chain", W, "NOT loop_exceeded AND chain_mixed", "chain_text"),
        ("redirect_broken_destination", C, "NOT loop_exceeded AND status_code >= 400 AND (chain_length > 0 OR redirect_url <> '')", "coalesce(redirect_url, '')"),
        ("very_slow_response", C, "response_time_ms > 3000"),
        ("slow_response", W, "response_time_ms > 1000 AND response_time_ms <= 3000"),
        ("missing_canonical", W, "canonical = ''"),
        ("different_canonical", I, "canonical <> '' AND canonical <> url", "canonical"),
        ("canonical_non_indexable", C, "canonical <> '' AND canonical <> url AND canonical_found AND NOT canonical_indexable", "canonical"),
        ("canonical_non_200", C, "canonical <> '' AND canonical <> url AND canonical_found AND canonical_status <> 200", "canonical"),
        ("page_noindex", I, "NOT indexable AND NOT in_sitemap"),
        ("noindex_in_sitemap", W, "NOT indexable AND in_sitemap"),
        ("noindex_internal_links", W, "NOT indexable AND has_inlinks"),
        ("long_url", W, "length(url) > 115", "url"),
        ("uppercase_url", W, "LIKE_RE(url_path, '[\\p{Lu}]')", "url_path"),
        ("underscore_in_url", I, "url_path LIKE '%\\_%' ESCAPE '\\'", "url_path"),
        ("special_chars_url", W, "LIKE_RE(url_path_decoded, '[^\\x00-\\x7f]|[ %$&+,;=?]')", "url_path"),
        ("excessive_url_params", W, "param_count > 2"),
        ("excessive_path_depth", I, "folder_depth > 5"),
        ("deep_crawl_depth", C, "crawl_depth > 5"),
        ("high_crawl_depth", W, "crawl_depth IN (4, 5)"),
        ("orphan_page", W, "coalesce(crawl_depth, -1) <> 0 AND (crawl_depth IS NULL OR NOT has_inlinks)"),
        ("robots_blocked_linked", W, "robots_blocked AND has_inlinks"),
    ),
    *pack(
        "onpage",
        ("missing_title", C, "title = ''"),
        ("title_too_short", W, "title <> '' AND length(title) < 30", "title"),
        ("title_too_long", W, "length(title) > 60", "title"),
        ("missing_meta_description", W, "meta_description = ''"),
        ("meta_description_too_short", W, "meta_description <> '' AND length(meta_description) < 70", "meta_description"),
        ("meta_description_too_long", W, "length(meta_description) > 160", "meta_description"),
        ("missing_h1", C, "h1 = ''"),
        ("h1_too_long", W, "length(h1) > 70", "h1"),
        ("h1_identical_to_title", I, "h1 <> '' AND lower(h1) = lower(title)", "h1"),
        ("no_headings", W, "heading_count = 0"),
        ("too_many_headings", I, "heading_count > 30"),
        ("multiple_h1_tags", W, "h1_count > 1"),
        ("heading_hierarchy_violation", W, "heading_skip"),
        ("very_thin_content", C, "word_count < 100"),
        ("thin_content", W, "word_count BETWEEN 100 AND 299"),
        ("low_text_to_html_ratio", I, "html_size > 0 AND word_count * 6.0 / html_size < 0.1"),
        ("duplicate_title", W, "title_group > 1", "title"),
        ("duplicate_meta_description", W, "meta_group > 1", "meta_description"),
        ("duplicate_h1", I, "h1_group > 1", "h1"),
        ("duplicate_content", C, "content_group > 1"),
    ),
    *pack(
        "links",
        ("no_internal_links", W, "internal_outlinks = 0"),
        ("few_internal_links", I, "internal_outlinks = 1"),
        ("excessive_crawl_depth", W, "crawl_depth > 4"),
        ("orphan_page", C, "inlinks = 0 AND coalesce(crawl_depth, -1) <> 0"),
        ("few_incoming_links", I, "inlinks IN (1, 2)"),
        ("empty_anchor_text", W, "empty_anchors > 0", "CAST(empty_anchors AS STRING)"),
        ("generic_anchor_text", W, "generic_anchors > 0", "CAST(generic_anchors AS STRING)"),
    ),
    *pack(
        "pagerank",
        ("equity_trap", W, "internal_pagerank > 60 AND LIKE_RE(lower(url), 'privacy|terms|cookie|legal|login|disclaimer')"),
        ("low_internal_authority", I, "crawl_depth = 1 AND internal_pagerank < 15 AND unique_inlinks < 3"),
    ),
    *pack(
        "performance",
        ("high_response_time", C, "response_time_ms > 3000"),
        ("slow_response_time", W, "response_time_ms > 1000 AND response_time_ms <= 3000"),
        ("massive_page_size", C, "html_size > 5242880"),
        ("large_page_size", W, "html_size > 3145728 AND html_size <= 5242880"),
        ("too_many_resources", W, "resource_count > 50"),
        ("excessive_render_blocking", C, "blocking_count > 5"),
        ("large_dom_size", W, "dom_size > 1500"),
        ("cwv_poor_lcp", W, "lcp_ms > 2500"),
        ("cwv_poor_cls", W, "cls > 0.1"),
        ("cwv_slow_fcp", I, "fcp_ms > 1800"),
    ),
    *pack(
        "security",
        ("http_page", C, "url_scheme = 'http'", "url"),
        ("missing_hsts", W, "url_scheme = 'https' AND hsts = ''"),
        ("missing_hsts_header", W, "is_html AND url_scheme = 'https' AND hsts = ''"),
        ("hsts_short_max_age", W, "is_html AND hsts <> '' AND hsts_max_age < 31536000", "hsts"),
        ("hsts_missing_includesubdomains", I, "is_html AND hsts <> '' AND lower(hsts) NOT LIKE '%includesubdomains%'", "hsts"),
        ("csp_unsafe_inline", W, "is_html AND csp LIKE '%''unsafe-inline''%'"),
        ("csp_unsafe_eval", W, "is_html AND csp LIKE '%''unsafe-eval''%'"),
        ("missing_csp_header", W, "is_html AND csp = ''"),
        ("invalid_x_content_type_options", W, "is_html AND xcto <> '' AND lower(trim(xcto)) <> 'nosniff'", "xcto"),
        ("missing_x_content_type_options", W, "is_html AND xcto = ''"),
        ("weak_x_frame_options", W, "is_html AND xfo <> '' AND upper(trim(xfo)) NOT IN ('DENY', 'SAMEORIGIN')", "xfo"),
        ("missing_x_frame_options", W, "is_html AND xfo = '' AND csp NOT LIKE '%frame-ancestors%'"),
        ("unsafe_referrer_policy", W, "is_html AND lower(trim(referrer)) IN ('unsafe-url', 'no-referrer-when-downgrade')", "referrer"),
        ("missing_referrer_policy", I, "is_html AND referrer = ''"),
        ("mixed_content", C, "url_scheme = 'https' AND insecure_assets > 0", "CAST(insecure_assets AS STRING)"),
    ),
    *pack(
        "social",
        ("missing_og_title", W, "is_html AND og_title = ''"),
        ("long_og_title", I, "is_html AND length(og_title) > 95", "og_title"),
        ("missing_og_description", I, "is_html AND og_description = ''"),
        ("missing_og_image", W, "is_html AND og_image = ''"),
        ("missing_og_type", I, "is_html AND og_type = ''"),
        ("missing_twitter_card", I, "is_html AND twitter_card = ''"),
        ("invalid_twitter_card", W, "is_html AND twitter_card <> '' AND lower(twitter_card) NOT IN ('summary', 'summary_large_image', 'app', 'player')", "twitter_card"),
    ),
    *pack(
        "mobile",
        ("missing_viewport", C, "viewport = '' AND any_viewport"),
        ("invalid_viewport_width", W, "viewport <> '' AND lower(viewport) NOT LIKE '%width=device-width%'", "viewport"),
        ("viewport_zoom_disabled", W, "lower(viewport) LIKE '%user-scalable=no%' OR lower(viewport) LIKE '%maximum-scale=1%'", "viewport"),
    ),
    *pack("sitewide", ("thin_content", W, "indexable AND word_count < 50")),
    *pack("js", ("js_modified_indexability", W, "raw_hash <> '' AND rendered_hash <> '' AND raw_hash <> rendered_hash AND NOT indexable")),
    *pack("structured_data", ("no_structured_data", I, "is_html AND schema_blocks = 0")),
    *pack("sitemaps", ("pages_missing_from_sitemap", W, "indexable AND status_code = 200 AND is_html AND NOT in_sitemap")),
    *pack("keywords", ("no_keywords", I, "title = '' AND meta_description = '' AND h1 = ''")),
    *pack(
        "accessibility",
        ("html-has-lang", "serious", "is_html AND lang = ''"),
        ("meta-viewport-scalable", "moderate", "is_html AND (lower(viewport) LIKE '%user-scalable=no%' OR lower(viewport) LIKE '%maximum-scale=1%')", "viewport"),
    ),
)

GENERIC_ANCHORS = ("click here", "here", "read more", "more", "link", "this", "learn more", "this page", "continue", "go")

#: Over links joined to the status of their target.
LINK_RULES = pack(
    "links",
    ("broken_internal_link", C, "is_internal AND (target_status >= 400 OR target_status = 0)", "target_url"),
    ("redirected_internal_link", W, "is_internal AND target_status IN (301, 302, 307, 308)", "target_url"),
    ("nofollow_internal_link", I, "is_internal AND nofollow", "target_url"),
    ("long_anchor_text", I, "is_internal AND length(anchor_text) > 100", "anchor_text"),
    ("broken_external_link", C, "NOT is_internal AND (target_status >= 400 OR target_status = 0)", "target_url"),
    ("unsafe_external_link", W, "NOT is_internal AND target_url LIKE 'http://%' AND coalesce(rel, '') NOT LIKE '%noopener%'", "target_url"),
    ("link-name", "serious", "trim(anchor_text) = ''", "target_url"),
    ("internally_linked_url_blocked_by_robots", W, "is_internal AND target_blocked", "target_url"),
)

IMAGE_RULES = pack(
    "images",
    ("missing_alt", W, "alt_text IS NULL", "src"),
    ("empty_alt", I, "alt_text = ''", "src"),
    ("long_alt", I, "length(alt_text) > 125", "src"),
    ("missing_dimensions", W, "NOT has_dimensions", "src"),
    ("broken_image", C, "is_broken", "src"),
    ("not_lazy_loaded", I, "NOT is_lazy_loaded", "src"),
    ("non_descriptive_filename", I, "LIKE_RE(lower(file_stem), '^(img_|dsc_|screenshot_)|^[0-9]+$')", "src"),
    ("old_image_format", I, "lower(format) IN ('jpg', 'jpeg', 'png', 'gif', 'bmp')", "src"),
    ("oversized_image", C, "file_size > 204800", "src"),
    ("large_image", W, "file_size > 102400 AND file_size <= 204800", "src"),
)

HREFLANG_RULES = pack(
    "technical",
    ("hreflang_invalid_code", W, "NOT LIKE_RE(lang_code, '^([a-z]{2}(-[a-zA-Z]{2})?|x-default)$')", "lang_code"),
    ("hreflang_broken_target", C, "target_status >= 400", "target_url"),
    ("hreflang_redirected_target", W, "target_status IN (301, 302, 307, 308)", "target_url"),
    ("hreflang_no_return_tag", C, "target_url <> url AND lower(lang_code) <> 'x-default' AND NOT has_return", "target_url"),
)
HREFLANG_SOURCE_RULES = pack("technical", ("hreflang_missing_self_reference", W, "NOT has_self"), ("hreflang_missing_x_default", I, "tag_count > 1 AND NOT has_default"))

PAGINATION_RULES = pack(
    "pagination",
    ("pagination_self_referencing", C, "is_self", "target_url"),
    ("pagination_broken_target", C, "NOT is_self AND target_status >= 400", "target_url"),
    ("pagination_redirect_target", W, "NOT is_self AND target_status BETWEEN 300 AND 399", "target_url"),
    ("pagination_circular_loop", C, "rel_type = 'next' AND next_is_prev", "target_url"),
    ("paginated_canonical_to_first_page", C, "rel_type = 'prev' AND canonical_to_prev", "target_url"),
    ("paginated_page_noindex", W, "first_tag AND NOT indexable", "url"),
)

SITEMAP_RULES = pack(
    "sitemaps",
    ("sitemap_url_broken", C, "target_status >= 400", "url"),
    ("sitemap_url_redirect", W, "target_status BETWEEN 300 AND 399", "url"),
    ("sitemap_url_noindex", W, "found AND NOT indexable", "url"),
    ("sitemap_orphan_url", W, "found AND inlinks = 0 AND crawl_depth > 0", "url"),
)

SCHEMA_RULES = pack(
    "structured_data",
    ("invalid_json_ld", C, "NOT is_valid"),
    ("schema_missing_context", W, "is_valid AND NOT has_context"),
    ("schema_missing_type", W, "is_valid AND schema_type = ''"),
    ("schema_missing_property", W, "is_valid AND LIKE_RE(lower(schema_type), 'article|blogposting') AND NOT has_headline", "'headline'"),
    ("schema_missing_property", W, "is_valid AND LIKE_RE(lower(schema_type), 'article|blogposting') AND NOT has_date", "'datePublished'"),
    ("schema_missing_property", W, "is_valid AND lower(schema_type) = 'product' AND NOT has_name", "'name'"),
    ("schema_missing_property", I, "is_valid AND lower(schema_type) = 'product' AND NOT has_offers", "'offers'"),
    ("schema_missing_property", W, "is_valid AND lower(schema_type) = 'breadcrumblist' AND NOT has_items", "'itemListElement'"),
    ("schema_missing_property", W, "is_valid AND lower(schema_type) IN ('organization', 'localbusiness') AND NOT has_name", "'name'"),
)

RESOURCE_RULES = pack("performance", ("render_blocking_resource", W, "is_render_blocking AND blocking_count <= 5", "url"))


def to_spark(text: str) -> str:
    """The shared dialect in Spark SQL; backslashes of patterns are doubled for its string literals."""
    import re

    text = re.sub(r"rtrim_slash\(([a-z_]+)\)", r"trim(TRAILING '/' FROM \1)", text)
    return text.replace("\\", "\\\\").replace("LIKE_RE(", "regexp_like(")


def issues(df: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each rule that fires on each row, from a single pass."""
    fired = [F.when(F.expr(to_spark(r.when)), F.struct(F.lit(r.pack).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.issue_type).alias("issue_type"), F.expr(to_spark(r.element)).alias("element"))) for r in rules]
    return df.select(*keep, F.explode(F.array_compact(F.array(*fired))).alias("_i")).select(*keep, "_i.*")


def to_duckdb(rules: tuple[Rule, ...], relation: str, keep: tuple[str, ...] = ("page_id", "url")) -> str:
    """The same rules as one SELECT for each: the plain form that the single pass is compared with."""
    import re

    def text(x: str) -> str:
        x = re.sub(r"rtrim_slash\(([a-z_]+)\)", r"rtrim(\1, '/')", x)
        return x.replace("LIKE_RE(", "regexp_matches(").replace("AS STRING", "AS VARCHAR")

    return "\nUNION ALL ".join(f"SELECT {', '.join(keep)}, '{r.pack}' AS category, '{r.severity}' AS severity, '{r.issue_type}' AS issue_type, {text(r.element)} AS element FROM {relation} WHERE {text(r.when)}" for r in rules)
