"""The issues table, its list page, derived issues and site-level findings, with DuckDB twins composed of those of the packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, issues, rules
from ..sources import html as H
from . import audit_queries, core_queries, crawl_queries, site_queries  # noqa: F401  (their twins are parts of those below)
from .core_queries import page_features, table
from .fixtures import tables, values_sql
from .registry import register, twin
from .site_tables import site_sql, site_tables

DOMAIN = "example.com"
_PARTS = ("fx_pages", "fx_links", "fx_images", "fx_headings", "fx_structured")
_DERIVABLE = """h AS (SELECT page_id, count(*) AS h1_count FROM fx_headings WHERE lower(tag) = 'h1' GROUP BY page_id), i AS (SELECT rtrim(target_url, '/') AS k, count(*) AS inlinks FROM fx_links GROUP BY 1),
derivable AS (SELECT p.page_id, p.url, status_code, coalesce(content_type, '') = '' OR lower(content_type) LIKE '%text/html%' AS is_html, trim(coalesce(title, '')) AS title, trim(coalesce(meta_description, '')) AS meta_description, trim(coalesce(h1, '')) AS h1, trim(coalesce(canonical, '')) AS canonical,
  CASE WHEN trim(coalesce(canonical, '')) = '' THEN 'Missing' WHEN rtrim(canonical, '/') = rtrim(url, '/') THEN 'Self-Referential' ELSE 'Canonicalised' END AS canonical_status, coalesce(h1_count, 0) AS h1_count, response_time_ms,
  CASE WHEN coalesce(len(redirect_chain), 0) > 0 THEN len(redirect_chain) WHEN coalesce(redirect_url, '') <> '' THEN 1 ELSE 0 END AS redirect_length, coalesce(inlinks, 0) = 0 AND coalesce(crawl_depth, -1) <> 0 AS is_orphan, '' AS robots
  FROM fx_pages p LEFT JOIN h USING (page_id) LEFT JOIN i ON i.k = rtrim(p.url, '/'))"""


@register("derived_issues", f"WITH {values_sql(*_PARTS)}, {_DERIVABLE} {rules.to_duckdb(issues.DERIVED_RULES, 'derivable')}")
def derived_issues(spark, sf_dir):
    return issues.derived_issues(tables(spark, sf_dir), DOMAIN)


@register("crawl_derived_issues", f"WITH {site_sql(*_PARTS)}, {_DERIVABLE} {rules.to_duckdb(issues.DERIVED_RULES, 'derivable')}")
def crawl_derived_issues(spark, sf_dir):
    return issues.derived_issues(site_tables(spark, sf_dir), DOMAIN)


_CATALOGUE = ", ".join(f"('{c}', '{n}', '{a}')" for c, n, a, _ in issues.CATALOGUE)


@register(
    "catalogued_issues",
    f"""WITH c(issue_type, issue_name, area) AS (VALUES {_CATALOGUE}), i AS (SELECT * FROM ({twin("derived_issues")}) UNION ALL SELECT * FROM ({twin("rules_technical")}))
SELECT page_id, issue_type, coalesce(issue_name, array_to_string(list_transform(string_split(issue_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS issue_name, coalesce(area, 'Technical SEO') AS area, count(*) AS n FROM i LEFT JOIN c USING (issue_type) GROUP BY ALL""",
)
def catalogued_issues(spark, sf_dir):
    t = tables(spark, sf_dir)
    technical = rules.issues(audit.prepare_pages(t), tuple(r for r in rules.PAGE_RULES if r.pack == "technical"))
    both = issues.derived_issues(t, DOMAIN).unionByName(technical)
    return issues.catalogued(both).groupBy("page_id", "issue_type", "issue_name", "area").agg(F.count("*").alias("n"))


def _histogram(column: str, relation: str) -> str:
    return f"(SELECT string_agg(v || ': ' || n, ', ' ORDER BY v) FROM (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {relation} WHERE {column} IS NOT NULL GROUP BY 1))"


_SCHEMA_TYPES = "(SELECT json_extract_string(CASE WHEN json_valid(data_json) THEN CASE WHEN data_json LIKE '[%' THEN json_extract(data_json, '$[0]') ELSE CAST(data_json AS JSON) END END, '$.\"@type\"') AS t FROM fx_structured)"
_SITE_LEVEL = f"""SELECT 'sitewide' AS category, 'depth_distribution' AS issue_type, 'info' AS severity, {_histogram("crawl_depth", "fx_pages")} AS element UNION ALL SELECT 'sitewide', 'status_distribution', 'info', {_histogram("status_code", "fx_pages")}
UNION ALL SELECT 'sitewide', 'content_type_distribution', 'info', {_histogram("split_part(lower(coalesce(content_type, 'unknown')), ';', 1)", "fx_pages")}
UNION ALL SELECT 'sitewide', 'avg_page_load_time', 'info', CAST(round(avg(nullif(response_time_ms, 0)), 1) AS VARCHAR) FROM fx_pages HAVING avg(nullif(response_time_ms, 0)) IS NOT NULL
UNION ALL SELECT 'sitewide', 'no_social_links', 'info', '' WHERE NOT EXISTS (SELECT 1 FROM fx_links WHERE NOT is_internal AND regexp_matches(lower(regexp_extract(target_url, '//([^/?#]*)', 1)), 'facebook[.]com|twitter[.]com|instagram[.]com|linkedin[.]com|youtube[.]com'))
UNION ALL SELECT 'performance', 'largest_pages', 'info', string_agg(url, ', ' ORDER BY html_size DESC, url) FROM (SELECT * FROM fx_pages WHERE html_size > 0 ORDER BY html_size DESC, url LIMIT 5) HAVING count(*) > 0
UNION ALL SELECT 'performance', 'slowest_pages', 'warning', string_agg(url, ', ' ORDER BY response_time_ms DESC, url) FROM (SELECT * FROM fx_pages WHERE response_time_ms > 0 ORDER BY response_time_ms DESC, url LIMIT 5) HAVING count(*) > 0
UNION ALL SELECT 'security', 'site_wide_missing_hsts', 'warning', CAST(count(*) AS VARCHAR) FROM fx_pages WHERE url LIKE 'https://%' AND headers IS NOT NULL AND coalesce(headers['Strict-Transport-Security'], '') = '' HAVING count(*) > 0
UNION ALL SELECT 'structured_data', 'schema_distribution', 'info', {_histogram("t", f"{_SCHEMA_TYPES} WHERE t <> '' AND t").replace("WHERE t <> '' AND t WHERE", "WHERE t <> '' AND")} WHERE EXISTS (SELECT 1 FROM {_SCHEMA_TYPES} WHERE t <> '')"""
_COVERED = f"UNION ALL SELECT 'security', 'security_headers_summary', severity, CAST(score AS VARCHAR) FROM ({twin('security_header_coverage')})"


@register("site_level_issues", f"WITH {values_sql('fx_pages', 'fx_links', 'fx_structured')} {_SITE_LEVEL} {_COVERED}")
def site_level_issues(spark, sf_dir):
    return issues.site_level(tables(spark, sf_dir))


_RELATION_TWINS = ("rules_link_targets", "rules_images", "rules_hreflang", "rules_pagination", "rules_sitemap_entries", "rules_schema_blocks", "rules_render_blocking", "derived_issues")
_PAGES = f"WITH {values_sql(*audit_queries.ALL)},{audit_queries.PREP_PAGES} {rules.to_duckdb(rules.PAGE_RULES, 'prepared')}"
_ALL_ISSUES = (
    "\nUNION ALL ".join(f"SELECT page_id, url, category, severity, issue_type, element FROM ({part})" for part in (_PAGES, *map(twin, _RELATION_TWINS)))
    + "\nUNION ALL "
    + "\nUNION ALL ".join(f"SELECT NULL, NULL, {'category' if n != 'site_checks' else chr(39) + 'sitewide' + chr(39)}, severity, issue_type, element FROM ({twin(n)})" for n in ("site_checks", "site_findings", "link_totals", "site_level_issues"))
)


@register("issues", _ALL_ISSUES)
def all_issues(spark, sf_dir):
    return issues.all_issues(tables(spark, sf_dir), DOMAIN)


#: The list page reads the issues of the captured pages.
_CRAWLED = f"i AS ({twin('crawl_page_rules')})"


def crawled_issues(spark, sf_dir):
    return rules.issues(audit.prepare_pages(site_tables(spark, sf_dir)), rules.PAGE_RULES)


@register("issues_by_severity", f"WITH {_CRAWLED} SELECT 'sitewide' AS category, 'issues_summary' AS issue_type, 'info' AS severity, 'critical: ' || count(*) FILTER (severity = 'critical') || ', warning: ' || count(*) FILTER (severity = 'warning') || ', info: ' || count(*) FILTER (severity = 'info') AS element FROM i")
def issues_by_severity(spark, sf_dir):
    return issues.issues_summary(crawled_issues(spark, sf_dir))


_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"


@register("issue_groups", f"WITH {_CRAWLED} SELECT issue_type, arg_min(severity, ({_RANK}, severity)) AS severity, min(category) AS category, count(*) AS n, array_to_string(list_transform(string_split(issue_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM i GROUP BY issue_type")
def issue_groups(spark, sf_dir):
    return issues.issue_groups(crawled_issues(spark, sf_dir))


@register("issue_list", f"WITH {_CRAWLED} SELECT url, issue_type, element, CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity IN ('warning', 'medium') THEN 'medium' ELSE 'low' END AS priority FROM i WHERE category = 'onpage' AND severity = 'warning' AND issue_type LIKE '%title%' AND (lower(coalesce(url, '')) LIKE '%.net%' OR lower(issue_type) LIKE '%.net%' OR lower(element) LIKE '%.net%')")
def issue_list(spark, sf_dir):
    d = issues.filter_issues(crawled_issues(spark, sf_dir), "onpage", "warning", "title", " .NET ")
    return d.orderBy(*issues.ISSUE_SORTS["severity"](), "element").select("url", "issue_type", "element", issues.report_priority(F.col("severity")).alias("priority"))


_TARGETS = "l AS (SELECT source_url AS url, target_url, anchor_text, is_internal, nofollow, coalesce((SELECT arg_max(status_code, page_id) FROM fx_pages p WHERE p.url = target_url), (SELECT max(status_code) FROM fx_status s WHERE s.url = target_url), 200) AS target_status FROM fx_links)"


@register("link_list", f"WITH {values_sql('fx_pages', 'fx_links', 'fx_status')}, {_TARGETS} SELECT 'broken' AS list, url, target_url FROM l WHERE is_internal AND (target_status >= 400 OR target_status = 0) UNION ALL SELECT 'redirects', url, target_url FROM l WHERE is_internal AND target_status IN (301, 302, 307, 308) UNION ALL SELECT '200', url, target_url FROM l WHERE is_internal AND target_status = 200 AND (lower(target_url) LIKE '%about%' OR lower(url) LIKE '%about%' OR lower(anchor_text) LIKE '%about%') UNION ALL SELECT 'nofollow', url, target_url FROM l WHERE is_internal AND nofollow")
def link_list(spark, sf_dir):
    links, out = audit.prepare_links(tables(spark, sf_dir)), None
    for status in ("broken", "redirects", "200", "nofollow"):
        d = issues.filter_links(links, status, "About" if status == "200" else None).select(F.lit(status).alias("list"), "url", "target_url")
        out = d if out is None else out.unionByName(d)
    return out


@register("link_stats", f"WITH {values_sql('fx_pages', 'fx_links', 'fx_status')}, {_TARGETS} SELECT count(*) AS links, count(*) FILTER (target_status >= 400 OR target_status = 0) AS broken, count(*) FILTER (target_status IN (301, 302, 307, 308)) AS redirects, count(*) FILTER (nofollow) AS nofollow, count(DISTINCT target_url) AS targets FROM l WHERE is_internal")
def link_stats(spark, sf_dir):
    return issues.link_stats(audit.prepare_links(tables(spark, sf_dir)))


@register("search_issues", "SELECT page_id, url, 'technical' AS category, 'warning' AS severity, 'custom_search_match' AS issue_type FROM pages WHERE html LIKE '%class=\"ad\"%' AND html LIKE '%an%' UNION ALL SELECT page_id, url, 'technical', 'warning', 'custom_search_match' FROM pages WHERE html NOT LIKE '%The%'")
def search_issues(spark, sf_dir):
    """Custom searches with case and without, for presence and absence."""
    found = H.custom_search(table(spark, sf_dir, "pages"), [{"name": "ads", "pattern": 'class="ad".*an', "regex": True, "case_sensitive": True}, {"name": "no The", "pattern": "The", "case_sensitive": True, "mode": "not_contains"}])
    both = found.where("search_name = 'no The'").unionByName(H.custom_search(table(spark, sf_dir, "pages").where(F.col("html").contains("an")), [{"name": "ads", "pattern": 'class="ad"', "case_sensitive": True}]))
    return issues.search_issues(both).drop("element")


@register("click_issues", "WITH s AS (SELECT url, 400 + page_id AS impressions, (page_id % 7) / 100.0 AS ctr, page_id % 40 AS position FROM pages UNION ALL SELECT 'http://elsewhere.org/', 900, 0.001, 3) SELECT p.page_id, url, 'onpage' AS category, 'warning' AS severity, 'gsc_low_ctr_opportunity' AS issue_type, CAST(impressions AS VARCHAR) AS element FROM s LEFT JOIN (SELECT url, max(page_id) AS page_id FROM pages GROUP BY url) p USING (url) WHERE impressions > 500 AND ctr < 0.02 AND position <= 15")
def click_issues(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    rows = pages.select("url", (400 + k).alias("impressions"), ((k % 7) / 100.0).alias("ctr"), (k % 40).alias("position"))
    return issues.click_issues(rows.unionByName(spark.createDataFrame([("http://elsewhere.org/", 900, 0.001, 3)], "url string, impressions long, ctr double, position long")), pages)


@register("keyword_level_issues", f"WITH t AS ({twin('page_targets')}), n AS (SELECT target, count(*) AS n FROM t GROUP BY target HAVING count(*) > 1) SELECT 'keywords' AS category, 'keyword_cannibalization' AS issue_type, 'warning' AS severity, target || ' (' || n || ')' AS element FROM n UNION ALL SELECT 'keywords', 'site_wide_thin_content', 'info', CAST(count(*) AS VARCHAR) FROM pages WHERE page_id NOT IN (SELECT page_id FROM t) HAVING count(*) > 0")
def keyword_level_issues(spark, sf_dir):
    from ..operators import keywords

    pages = page_features(table(spark, sf_dir, "pages")).withColumn("words", F.concat_ws("  ", "title", "h1"))
    return issues.keyword_level(keywords.target_keywords(pages, "page_id", "words"), pages)


@register("not_found_pages", "SELECT 'sitewide' AS category, CASE WHEN lower(html) LIKE '%nginx%' OR lower(html) LIKE '%apache%' OR length(html) < 500 THEN 'default_404' ELSE 'custom_404' END AS issue_type, 'info' AS severity, CASE WHEN lower(html) LIKE '%nginx%' OR lower(html) LIKE '%apache%' OR length(html) < 500 THEN url ELSE '' END AS element FROM pages UNION ALL SELECT 'sitewide', 'default_404', 'info', 'u'")
def not_found_pages(spark, sf_dir):
    probes = table(spark, sf_dir, "pages").select("url", F.lit(404).alias("status_code"), F.col("html").alias("body"))
    return issues.not_found_page(probes.unionByName(spark.createDataFrame([("u", 404, "<center>nginx</center>" * 40), ("v", 200, "")], "url string, status_code int, body string")))


_SITE_TESTS = f"""i AS (SELECT issue_type FROM ({_PAGES}) UNION ALL SELECT issue_type FROM ({twin("rules_sitemap_entries")})), s AS (SELECT * FROM fx_pages ORDER BY coalesce(crawl_depth, 99), page_id LIMIT 1), {_TARGETS},
c AS (SELECT (SELECT trim(coalesce(title, '')) <> '' AND trim(coalesce(meta_description, '')) <> '' FROM s) AS shown, (SELECT coalesce(headers['Strict-Transport-Security'], '') <> '' FROM s) AS hsts, (SELECT count(*) FROM i WHERE issue_type LIKE '%robots%') AS robots, (SELECT count(*) FROM i WHERE issue_type LIKE '%sitemap%') AS sitemaps,
  (SELECT count(*) FROM i WHERE issue_type LIKE '%canonical%') AS canonicals, (SELECT count(*) FROM i WHERE issue_type = 'orphan_page') AS orphans, (SELECT count(*) FROM fx_headings WHERE tag = 'h1') AS h1s, (SELECT count(*) FROM fx_headings WHERE tag = 'h2') AS h2s, (SELECT count(*) FROM fx_images WHERE trim(coalesce(alt_text, '')) = '') AS no_alt,
  (SELECT count(*) FROM fx_images WHERE NOT coalesce(has_dimensions, false)) AS loose, (SELECT count(*) FROM fx_pages) AS pages, (SELECT count(*) FROM fx_pages WHERE NOT coalesce(is_indexable, false)) AS noindex, (SELECT bool_or(url LIKE '%//www.%') AND bool_or(url NOT LIKE '%//www.%') FROM fx_pages) AS mixed_hosts,
  (SELECT count(*) FROM l WHERE target_status >= 400 OR target_status = 0) AS broken, (SELECT count(DISTINCT t) FROM {_SCHEMA_TYPES} WHERE t <> '') AS types, (SELECT count(*) FROM fx_resources r JOIN fx_pages p USING (page_id) WHERE r.url LIKE 'http://%' AND p.url LIKE 'https://%') AS insecure),
tests AS (SELECT unnest([
  {{'category': 'seo', 'test': 'google_preview', 'status': CASE WHEN shown THEN 'passed' ELSE 'warning' END}}, {{'category': 'seo', 'test': 'headings', 'status': CASE WHEN h1s = 0 THEN 'failed' WHEN h1s > 1 OR h2s > 20 THEN 'warning' ELSE 'passed' END}}, {{'category': 'seo', 'test': 'robots_txt', 'status': CASE WHEN robots = 0 THEN 'passed' ELSE 'warning' END}},
  {{'category': 'seo', 'test': 'sitemap', 'status': CASE WHEN sitemaps = 0 THEN 'passed' ELSE 'warning' END}}, {{'category': 'seo', 'test': 'image_alt', 'status': CASE WHEN no_alt = 0 THEN 'passed' WHEN no_alt > 10 THEN 'failed' ELSE 'warning' END}}, {{'category': 'seo', 'test': 'image_size', 'status': CASE WHEN loose <= 5 THEN 'passed' ELSE 'warning' END}},
  {{'category': 'seo', 'test': 'canonical_tag', 'status': CASE WHEN canonicals = 0 THEN 'passed' ELSE 'warning' END}}, {{'category': 'seo', 'test': 'noindex', 'status': CASE WHEN noindex = 0 OR noindex < pages THEN 'passed' ELSE 'warning' END}}, {{'category': 'security', 'test': 'url_canonicalization', 'status': CASE WHEN mixed_hosts THEN 'warning' ELSE 'passed' END}},
  {{'category': 'security', 'test': 'mixed_content', 'status': CASE WHEN insecure = 0 THEN 'passed' ELSE 'failed' END}}, {{'category': 'security', 'test': 'hsts', 'status': CASE WHEN hsts THEN 'passed' ELSE 'warning' END}}, {{'category': 'links', 'test': 'broken_links', 'status': CASE WHEN broken = 0 THEN 'passed' ELSE 'failed' END}},
  {{'category': 'links', 'test': 'orphan_pages', 'status': CASE WHEN orphans = 0 THEN 'passed' ELSE 'warning' END}}, {{'category': 'advanced', 'test': 'structured_data', 'status': CASE WHEN types > 0 THEN 'passed' ELSE 'warning' END}}]) AS x FROM c)"""


@register("site_tests", f"WITH {values_sql('fx_pages', 'fx_links', 'fx_status', 'fx_headings', 'fx_images', 'fx_structured', 'fx_resources')}, {_SITE_TESTS} SELECT x.category AS category, x.test AS test, x.status AS status FROM tests")
def site_tests(spark, sf_dir):
    from ..operators import report

    t = tables(spark, sf_dir)
    found = rules.issues(audit.prepare_pages(t), rules.PAGE_RULES).select("issue_type").unionByName(rules.issues(audit.prepare_sitemap(t), rules.SITEMAP_RULES).select("issue_type"))
    return report.site_tests(t, found)


@register("markup_tests", r"""WITH s AS (SELECT html FROM pages ORDER BY page_id LIMIT 1) SELECT 'mobile' AS category, 'media_queries' AS test, CASE WHEN html LIKE '%@media%' THEN 'passed' ELSE 'failed' END AS status FROM s UNION ALL SELECT 'security', 'plain_emails', CASE WHEN regexp_matches(html, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') THEN 'warning' ELSE 'passed' END FROM s
UNION ALL SELECT 'security', 'unsafe_links', CASE WHEN html LIKE '%_blank%' THEN 'failed' ELSE 'passed' END FROM s UNION ALL SELECT 'seo', 'common_keywords', 'passed' FROM s""")
def markup_tests(spark, sf_dir):
    from ..operators import report

    return report.markup_tests(table(spark, sf_dir, "pages"))


@register("second_scores", "SELECT s_suppkey, CAST(greatest(least(round(s_suppkey % 100 * 0.9::DOUBLE + s_nationkey * 1.2::DOUBLE), 95), 20) AS DOUBLE) AS score FROM supplier")
def second_scores(spark, sf_dir):
    from ..operators import report

    return table(spark, sf_dir, "supplier").select("s_suppkey", report.second_score(F.col("s_suppkey") % 100, F.col("s_nationkey")).cast("double").alias("score"))
