"""Queries over the audit rules, with plain SQL twins: preparation by subqueries, one SELECT for each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, rules
from .fixtures import tables, values_sql
from .registry import register

_KEY = "rtrim({c}, '/')"

PREP_PAGES = r"""
base AS (
  SELECT p.* REPLACE (trim(coalesce(title, '')) AS title, trim(coalesce(meta_description, '')) AS meta_description, trim(coalesce(h1, '')) AS h1, trim(coalesce(canonical, '')) AS canonical,
    trim(coalesce(viewport, '')) AS viewport, trim(coalesce(lang, '')) AS lang, trim(coalesce(og_title, '')) AS og_title, trim(coalesce(og_description, '')) AS og_description, trim(coalesce(og_image, '')) AS og_image,
    trim(coalesce(og_type, '')) AS og_type, trim(coalesce(twitter_card, '')) AS twitter_card, trim(coalesce(content_hash, '')) AS content_hash, trim(coalesce(raw_hash, '')) AS raw_hash, trim(coalesce(rendered_hash, '')) AS rendered_hash,
    coalesce(robots_blocked, false) AS robots_blocked),
    coalesce(is_indexable, false) AS indexable, lower(coalesce(content_type, '')) LIKE '%html%' AS is_html, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS url_scheme,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS url_path, string_split(regexp_extract(url, '\?(.*)$', 1), '&') AS parts,
    CASE WHEN headers IS NOT NULL THEN coalesce(headers['Strict-Transport-Security'], '') END AS hsts, lower(CASE WHEN headers IS NOT NULL THEN coalesce(headers['Content-Security-Policy'], '') END) AS csp, CASE WHEN headers IS NOT NULL THEN coalesce(headers['X-Content-Type-Options'], '') END AS xcto,
    CASE WHEN headers IS NOT NULL THEN coalesce(headers['X-Frame-Options'], '') END AS xfo, CASE WHEN headers IS NOT NULL THEN coalesce(headers['Referrer-Policy'], '') END AS referrer, coalesce(len(redirect_chain), 0) AS chain_length,
    coalesce(status_code, 0) = 310 OR coalesce(redirect_type LIKE '%Loop%', false) AS loop_exceeded
  FROM fx_pages p
), hops AS (
  SELECT page_id, i, redirect_chain[i].url AS u, redirect_chain[i].status AS s FROM (SELECT page_id, redirect_chain, unnest(range(1, 1 + len(redirect_chain))) AS i FROM fx_pages)
), hopstats AS (
  SELECT page_id, count(DISTINCT lower(rtrim(u, '/'))) < count(*) AS chain_repeats, string_agg(u || ' (' || s || ')', ' -> ' ORDER BY i) AS chain_text,
    regexp_extract(arg_min(u, i), '//([^/?#]*)', 1) AS chain_first_host, regexp_extract(arg_max(u, i), '//([^/?#]*)', 1) AS chain_final_host,
    coalesce(min(i) FILTER (s IN (302, 303, 307)) < max(i) FILTER (s IN (301, 308)), false) AS chain_mixed
  FROM hops GROUP BY page_id
), down AS (SELECT DISTINCT a.page_id, true AS chain_downgrade FROM hops a JOIN hops b ON a.page_id = b.page_id AND b.i = a.i + 1 WHERE a.u LIKE 'https://%' AND b.u LIKE 'http://%'
), hl AS (SELECT page_id, CAST(substr(tag, 2) AS INTEGER) AS l, coalesce(lag(CAST(substr(tag, 2) AS INTEGER)) OVER (PARTITION BY page_id ORDER BY position), 0) AS b FROM fx_headings
), hs AS (SELECT page_id, count(*) AS heading_count, count(*) FILTER (l = 1) AS h1_count, bool_or(l > b + 1) AS heading_skip FROM hl GROUP BY page_id
), known AS (SELECT url, arg_max(status_code, page_id) AS canonical_status, arg_max(coalesce(is_indexable, false), page_id) AS canonical_indexable FROM fx_pages GROUP BY url
), prepared AS (
  SELECT b.*, coalesce(chain_repeats, false) AS chain_repeats, chain_text, coalesce(chain_first_host, '') AS chain_first_host, coalesce(chain_final_host, '') AS chain_final_host, coalesce(chain_mixed, false) AS chain_mixed, coalesce(chain_downgrade, false) AS chain_downgrade,
    (SELECT count(DISTINCT split_part(x, '=', 1)) FROM unnest(b.parts) t(x) WHERE x LIKE '_%=_%') AS param_count,
    len(list_filter(string_split(url_path, '/'), lambda x: x <> '')) AS folder_depth, url_decode(url_path) AS url_path_decoded,
    coalesce(TRY_CAST(nullif(regexp_extract(lower(hsts), 'max-age=([0-9]+)', 1), '') AS BIGINT), 0) AS hsts_max_age,
    EXISTS (SELECT 1 FROM fx_links l WHERE l.is_internal AND rtrim(l.target_url, '/') = rtrim(b.url, '/')) AS has_inlinks,
    EXISTS (SELECT 1 FROM fx_sitemap s WHERE rtrim(s.url, '/') = rtrim(b.url, '/')) AS in_sitemap,
    k.url IS NOT NULL AS canonical_found, k.canonical_status, k.canonical_indexable,
    coalesce(heading_count, 0) AS heading_count, coalesce(h1_count, 0) AS h1_count, coalesce(heading_skip, false) AS heading_skip,
    (SELECT count(*) FROM fx_links l WHERE l.is_internal AND l.source_page_id = b.page_id) AS internal_outlinks,
    (SELECT count(*) FROM fx_links l WHERE l.is_internal AND l.source_page_id = b.page_id AND trim(coalesce(anchor_text, '')) = '') AS empty_anchors,
    (SELECT count(*) FROM fx_links l WHERE l.is_internal AND l.source_page_id = b.page_id AND lower(trim(coalesce(anchor_text, ''))) IN ('click here', 'here', 'read more', 'more', 'link', 'this', 'learn more', 'this page', 'continue', 'go')) AS generic_anchors,
    (SELECT count(*) FROM fx_links l WHERE l.is_internal AND l.target_url = b.url) AS inlinks, (SELECT count(DISTINCT source_page_id) FROM fx_links l WHERE l.is_internal AND l.target_url = b.url) AS unique_inlinks,
    (SELECT count(*) FROM fx_resources r WHERE r.page_id = b.page_id) AS resource_count, (SELECT count(*) FROM fx_resources r WHERE r.page_id = b.page_id AND is_render_blocking) AS blocking_count,
    (SELECT count(*) FROM fx_resources r WHERE r.page_id = b.page_id AND r.url LIKE 'http://%') AS insecure_assets, (SELECT count(*) FROM fx_structured s WHERE s.page_id = b.page_id) AS schema_blocks,
    (SELECT count(*) FROM base x WHERE x.title = b.title AND b.title <> '') AS title_group, (SELECT count(*) FROM base x WHERE x.meta_description = b.meta_description AND b.meta_description <> '') AS meta_group,
    (SELECT count(*) FROM base x WHERE x.h1 = b.h1 AND b.h1 <> '') AS h1_group, (SELECT count(*) FROM base x WHERE x.content_hash = b.content_hash AND b.content_hash <> '') AS content_group,
    (SELECT bool_or(viewport <> '') FROM base) AS any_viewport
  FROM base b LEFT JOIN hopstats USING (page_id) LEFT JOIN down USING (page_id) LEFT JOIN hs USING (page_id) LEFT JOIN known k ON k.url = b.canonical
)"""
ALL = ("fx_pages", "fx_links", "fx_headings", "fx_resources", "fx_sitemap", "fx_structured")


def _pack_query(name: str):
    chosen = tuple(r for r in rules.PAGE_RULES if r.pack == name)
    sql = f"WITH {values_sql(*ALL)},{PREP_PAGES}\n{rules.to_duckdb(chosen, 'prepared')}"

    @register(f"rules_{name}", sql)
    def run(spark, sf_dir):
        return rules.issues(audit.prepare_pages(tables(spark, sf_dir)), chosen)

    return run


for _name in dict.fromkeys(r.pack for r in rules.PAGE_RULES):
    _pack_query(_name)


LINK_TARGETS = f"""prepared AS (
  SELECT source_page_id AS page_id, source_url AS url, target_url, anchor_text, is_internal, nofollow, rel, target_blocked,
    coalesce((SELECT arg_max(status_code, page_id) FROM fx_pages p WHERE p.url = l.target_url), (SELECT max(status_code) FROM fx_status s WHERE s.url = l.target_url), 200) AS target_status
  FROM fx_links l
) {rules.to_duckdb(rules.LINK_RULES, "prepared")}"""


@register("rules_link_targets", f"WITH {values_sql('fx_pages', 'fx_links', 'fx_status')},\n{LINK_TARGETS}")
def rules_link_targets(spark, sf_dir):
    return rules.issues(audit.prepare_links(tables(spark, sf_dir)), rules.LINK_RULES)


@register("rules_images", f"WITH {values_sql('fx_images')}, prepared AS (SELECT *, regexp_replace(regexp_extract(split_part(src, '?', 1), '([^/]*)$', 1), '\\.[^.]*$', '') AS file_stem FROM fx_images) {rules.to_duckdb(rules.IMAGE_RULES, 'prepared')}")
def rules_images(spark, sf_dir):
    return rules.issues(audit.prepare_images(tables(spark, sf_dir)), rules.IMAGE_RULES)


@register(
    "rules_hreflang",
    f"""WITH {values_sql("fx_pages", "fx_hreflang")},
prepared AS (
  SELECT h.*, (SELECT arg_max(status_code, page_id) FROM fx_pages p WHERE p.url = h.target_url) AS target_status,
    EXISTS (SELECT 1 FROM fx_hreflang b WHERE b.url = h.target_url AND b.target_url = h.url) AS has_return FROM fx_hreflang h
), sources AS (SELECT page_id, url, bool_or(url = target_url) AS has_self, count(*) AS tag_count, bool_or(lower(lang_code) = 'x-default') AS has_default FROM fx_hreflang GROUP BY ALL)
{rules.to_duckdb(rules.HREFLANG_RULES, "prepared")} UNION ALL {rules.to_duckdb(rules.HREFLANG_SOURCE_RULES, "sources")}""",
)
def rules_hreflang(spark, sf_dir):
    rows, sources = audit.prepare_hreflang(tables(spark, sf_dir))
    return rules.issues(rows, rules.HREFLANG_RULES).unionByName(rules.issues(sources, rules.HREFLANG_SOURCE_RULES))


@register(
    "rules_pagination",
    f"""WITH {values_sql("fx_pages", "fx_pagination")},
t AS (SELECT *, rtrim(url, '/') AS s, rtrim(target_url, '/') AS t, tag_id = min(tag_id) OVER (PARTITION BY rtrim(url, '/')) AS first_tag FROM fx_pagination),
prepared AS (
  SELECT t.page_id, t.url, rel_type, target_url, first_tag, s = t.t AS is_self,
    (SELECT arg_max(status_code, page_id) FROM fx_pages p WHERE rtrim(p.url, '/') = t.t) AS target_status,
    coalesce((SELECT arg_max(coalesce(is_indexable, false), page_id) FROM fx_pages p WHERE rtrim(p.url, '/') = t.s), true) AS indexable,
    coalesce((SELECT max(x.t) FROM t x WHERE x.s = t.s AND rel_type = 'next') = (SELECT max(x.t) FROM t x WHERE x.s = t.s AND rel_type = 'prev'), false) AS next_is_prev,
    coalesce((SELECT rtrim(arg_max(coalesce(canonical, ''), page_id), '/') FROM fx_pages p WHERE rtrim(p.url, '/') = t.s) = (SELECT max(x.t) FROM t x WHERE x.s = t.s AND rel_type = 'prev')
      AND (SELECT rtrim(arg_max(coalesce(canonical, ''), page_id), '/') FROM fx_pages p WHERE rtrim(p.url, '/') = t.s) <> t.s, false) AS canonical_to_prev
  FROM t
) {rules.to_duckdb(rules.PAGINATION_RULES, "prepared")}""",
)
def rules_pagination(spark, sf_dir):
    return rules.issues(audit.prepare_pagination(tables(spark, sf_dir)), rules.PAGINATION_RULES)


SITEMAP_ENTRIES = f"""p AS (SELECT url, arg_max(status_code, page_id) AS status, arg_max(coalesce(is_indexable, false), page_id) AS indexable, max(page_id) AS id, arg_max(crawl_depth, page_id) AS depth,
        (SELECT count(*) FROM fx_links l WHERE l.is_internal AND l.target_url = fx_pages.url) AS inlinks FROM fx_pages GROUP BY url),
m AS (SELECT s.url, coalesce((SELECT id FROM p WHERE p.url = s.url), (SELECT max(id) FROM p WHERE rtrim(p.url, '/') = rtrim(s.url, '/'))) AS page_id FROM fx_sitemap s),
prepared AS (SELECT m.page_id, m.url, p.id IS NOT NULL AS found, p.status AS target_status, coalesce(p.indexable, false) AS indexable, coalesce(p.inlinks, 0) AS inlinks, p.depth AS crawl_depth FROM m LEFT JOIN p ON p.id = m.page_id)
{rules.to_duckdb(rules.SITEMAP_RULES, "prepared")}"""


@register("rules_sitemap_entries", f"WITH {values_sql('fx_pages', 'fx_links', 'fx_sitemap')},\n{SITEMAP_ENTRIES}")
def rules_sitemap_entries(spark, sf_dir):
    return rules.issues(audit.prepare_sitemap(tables(spark, sf_dir)), rules.SITEMAP_RULES)


@register(
    "rules_schema_blocks",
    f"""WITH {values_sql("fx_structured")},
j AS (SELECT page_id, url, CASE WHEN json_valid(data_json) THEN CASE WHEN data_json LIKE '[%' THEN json_extract(data_json, '$[0]') ELSE CAST(data_json AS JSON) END END AS v FROM fx_structured),
prepared AS (SELECT page_id, url, v IS NOT NULL AS is_valid, coalesce(json_exists(v, '$."@context"'), false) AS has_context, coalesce(json_extract_string(v, '$."@type"'), '') AS schema_type, coalesce(json_exists(v, '$.headline'), false) AS has_headline,
  coalesce(json_exists(v, '$.datePublished'), false) AS has_date, coalesce(json_exists(v, '$.name'), false) AS has_name, coalesce(json_exists(v, '$.offers'), false) AS has_offers, coalesce(json_exists(v, '$.itemListElement'), false) AS has_items FROM j)
{rules.to_duckdb(rules.SCHEMA_RULES, "prepared")}""",
)
def rules_schema_blocks(spark, sf_dir):
    return rules.issues(audit.prepare_schema(tables(spark, sf_dir)), rules.SCHEMA_RULES)


@register("rules_render_blocking", f"WITH {values_sql('fx_resources')}, prepared AS (SELECT *, count(*) FILTER (is_render_blocking) OVER (PARTITION BY page_id) AS blocking_count FROM fx_resources) {rules.to_duckdb(rules.RESOURCE_RULES, 'prepared')}")
def rules_render_blocking(spark, sf_dir):
    return rules.issues(audit.prepare_resources(tables(spark, sf_dir)), rules.RESOURCE_RULES)


@register(
    "site_checks",
    f"""WITH {values_sql(*ALL, "fx_status")},
f AS (SELECT page_id, status_code, coalesce(len(redirect_chain), 0) AS n, url LIKE 'https://%' AS s, regexp_extract(url, '//([^/?#]*)', 1) LIKE 'www.%' AS w, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  trim(coalesce(viewport, '')) <> '' AS v, coalesce(is_indexable, false) AS i, coalesce(word_count, 0) AS words, response_time_ms AS rt, lower(coalesce(content_type, '')) LIKE '%html%' AS h FROM fx_pages),
a AS (SELECT count(*) AS pages, count(*) FILTER (status_code >= 500) AS n5, count(*) FILTER (n > 1) AS chains, bool_or(s) AND bool_or(NOT s) AS mixed, bool_or(w) AND bool_or(NOT w) AS www,
  bool_or(path LIKE '%/' AND path <> '/') AND bool_or(path NOT LIKE '%/' AND path <> '/') AS slash, count(*) FILTER (NOT s) AS http, bool_or(v) AS v, count(*) FILTER (words < 300) AS thin, floor(sum(words) / count(*)) AS avg_words,
  round(avg(nullif(rt, 0)), 2) AS avg_rt, count(*) FILTER (i) AS indexable FROM f)
SELECT 'site_wide_5xx' AS issue_type, 'critical' AS severity, CAST(n5 AS VARCHAR) AS element FROM a WHERE n5 > 0
UNION ALL SELECT 'site_wide_redirect_chains', 'warning', CAST(chains AS VARCHAR) FROM a WHERE chains > 0
UNION ALL SELECT 'mixed_http_https', 'warning', '' FROM a WHERE mixed
UNION ALL SELECT 'www_inconsistency', 'warning', '' FROM a WHERE www
UNION ALL SELECT 'trailing_slash_inconsistency', 'warning', '' FROM a WHERE slash
UNION ALL SELECT CASE WHEN http > 0 THEN 'site_wide_http' ELSE 'site_wide_https' END, CASE WHEN http > 0 THEN 'critical' ELSE 'info' END, CAST(http AS VARCHAR) FROM a
UNION ALL SELECT 'site_wide_missing_viewport', 'critical', '' FROM a WHERE NOT v
UNION ALL SELECT 'average_word_count', 'info', CAST(CAST(avg_words AS BIGINT) AS VARCHAR) FROM a
UNION ALL SELECT 'thin_content_summary', 'info', CAST(thin AS VARCHAR) FROM a WHERE thin > 0
UNION ALL SELECT 'indexable_counts', 'info', indexable || '/' || pages FROM a""",
)
def site_checks(spark, sf_dir):
    from ..operators.aggregates import site_checks as checks

    return checks(tables(spark, sf_dir)["fx_pages"])


@register(
    "security_header_coverage",
    f"""WITH {values_sql("fx_pages")}, h AS (SELECT headers FROM fx_pages WHERE lower(content_type) LIKE '%html%'),
c AS (SELECT round(100.0 * avg(CASE WHEN coalesce(headers['Strict-Transport-Security'], '') <> '' THEN 1 ELSE 0 END), 1) AS hsts_pct, round(100.0 * avg(CASE WHEN coalesce(headers['Content-Security-Policy'], '') <> '' THEN 1 ELSE 0 END), 1) AS csp_pct,
 round(100.0 * avg(CASE WHEN coalesce(headers['X-Content-Type-Options'], '') <> '' THEN 1 ELSE 0 END), 1) AS xcto_pct, round(100.0 * avg(CASE WHEN coalesce(headers['X-Frame-Options'], '') <> '' THEN 1 ELSE 0 END), 1) AS xfo_pct,
 round(100.0 * avg(CASE WHEN coalesce(headers['Referrer-Policy'], '') <> '' THEN 1 ELSE 0 END), 1) AS referrer_pct FROM h)
SELECT *, round(.25 * hsts_pct + .25 * csp_pct + .2 * xcto_pct + .15 * xfo_pct + .15 * referrer_pct, 1) AS score,
 CASE WHEN round(.25 * hsts_pct + .25 * csp_pct + .2 * xcto_pct + .15 * xfo_pct + .15 * referrer_pct, 1) >= 80 THEN 'info' WHEN round(.25 * hsts_pct + .25 * csp_pct + .2 * xcto_pct + .15 * xfo_pct + .15 * referrer_pct, 1) >= 50 THEN 'warning' ELSE 'critical' END AS severity FROM c""",
)
def security_header_coverage(spark, sf_dir):
    from ..operators.aggregates import header_coverage

    return header_coverage(tables(spark, sf_dir)["fx_pages"])
