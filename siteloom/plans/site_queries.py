"""Site-level findings, keyword rules and the remaining comparisons, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import audit, compare, exports, report, site_rules, views
from .core_queries import table
from .fixtures import tables, values_sql
from .registry import register

_ALL = ("fx_pages", "fx_images", "fx_pagination", "fx_sitemap", "fx_structured")


@register(
    "site_findings",
    f"""WITH {values_sql(*_ALL)}, p AS (SELECT round(avg(nullif(response_time_ms, 0)), 1) AS rt, count(*) FILTER (crawl_depth > 3) AS deep, count(*) FILTER (lower(content_type) LIKE '%html%') AS html,
  count(*) FILTER (lower(content_type) LIKE '%html%' AND trim(coalesce(og_title, '')) <> '' AND trim(coalesce(og_description, '')) <> '' AND trim(coalesce(og_image, '')) <> '') AS og FROM fx_pages), o AS (SELECT round(100.0 * og / greatest(html, 1), 1)::DOUBLE AS pct FROM p),
m AS (SELECT count(DISTINCT page_id) AS marked FROM fx_structured)
SELECT 'performance' AS category, 'site_wide_avg_response_time' AS issue_type, 'info' AS severity, CAST(rt AS VARCHAR) AS element FROM p UNION ALL SELECT 'sitewide', 'pages_too_deep', 'warning', CAST(deep AS VARCHAR) FROM p WHERE deep > 0
UNION ALL SELECT 'social', 'social_meta_summary', CASE WHEN pct >= 80 THEN 'info' WHEN pct >= 40 THEN 'warning' ELSE 'critical' END, CAST(pct AS VARCHAR) FROM o
UNION ALL SELECT 'images', 'site_wide_missing_alt', 'warning', CAST(count(*) AS VARCHAR) FROM fx_images WHERE alt_text IS NULL HAVING count(*) > 0 UNION ALL SELECT 'images', 'site_wide_old_formats', 'info', CAST(count(*) AS VARCHAR) FROM fx_images WHERE lower(format) IN ('jpg', 'jpeg', 'png', 'gif', 'bmp') HAVING count(*) > 0
UNION ALL SELECT 'pagination', 'pagination_summary', 'info', count(*) || '/' || count(DISTINCT url) FROM fx_pagination HAVING count(*) > 0 UNION ALL SELECT 'structured_data', 'schema_coverage', 'info', CAST(round(100.0 * marked / greatest(html, 1), 1)::DOUBLE AS VARCHAR) FROM m, p WHERE marked > 0""",
)
def site_findings(spark, sf_dir):
    return site_rules.site_findings(tables(spark, sf_dir))


@register(
    "link_totals",
    f"""WITH {values_sql("fx_pages", "fx_links", "fx_status")}, l AS (SELECT *, coalesce((SELECT arg_max(status_code, page_id) FROM fx_pages p WHERE p.url = target_url), (SELECT max(status_code) FROM fx_status s WHERE s.url = target_url), 200) AS st FROM fx_links)
SELECT 'links' AS category, 'total_broken_internal_links' AS issue_type, 'critical' AS severity, CAST(count(*) AS VARCHAR) AS element FROM l WHERE is_internal AND (st >= 400 OR st = 0) UNION ALL SELECT 'links', 'total_broken_external_links', 'warning', CAST(count(*) AS VARCHAR) FROM l WHERE NOT is_internal AND (st >= 400 OR st = 0)
UNION ALL SELECT 'robots', 'site_wide_blocked_internal_urls', 'warning', CAST(count(DISTINCT target_url) AS VARCHAR) FROM l WHERE is_internal AND target_blocked""",
)
def link_totals(spark, sf_dir):
    return site_rules.link_totals(audit.prepare_links(tables(spark, sf_dir)))


@register(
    "duplicate_social_titles",
    f"WITH {values_sql('fx_pages')}, d AS (SELECT trim(og_title) AS og_title, url, count(*) OVER (PARTITION BY trim(og_title)) AS pages, row_number() OVER (PARTITION BY trim(og_title) ORDER BY url) AS n FROM fx_pages WHERE trim(coalesce(og_title, '')) <> '') SELECT og_title, max(pages) AS pages, string_agg(url, ', ' ORDER BY url) AS urls FROM d WHERE pages > 1 AND n <= 5 GROUP BY og_title",
)
def duplicate_social_titles(spark, sf_dir):
    return site_rules.duplicate_social_titles(tables(spark, sf_dir)["fx_pages"])


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


@register(
    "page_targets",
    rf"""WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h1 FROM pages),
w AS (SELECT page_id, list_filter(string_split_regex(lower(title || '  ' || h1), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN ({_STOP})) AS w FROM t),
c AS (SELECT page_id, x, count(*) AS n, min(i) AS i FROM (SELECT page_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) GROUP BY page_id, x) SELECT page_id, arg_min(x, (-n, i)) AS target, max(n) AS frequency FROM c GROUP BY page_id""",
)
def page_targets(spark, sf_dir):
    from ..operators import keywords
    from .core_queries import page_features

    return keywords.target_keywords(page_features(table(spark, sf_dir, "pages")).withColumn("words", F.concat_ws("  ", "title", "h1")), "page_id", "words")


@register(
    "keyword_rules",
    rf"""WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h1 FROM pages),
w AS (SELECT *, list_filter(string_split_regex(lower(title || '  ' || h1), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN ({_STOP})) AS w FROM t),
c AS (SELECT page_id, x, count(*) AS n, min(i) AS i FROM (SELECT page_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) GROUP BY page_id, x), k AS (SELECT page_id, arg_min(x, (-n, i)) AS target, max(n) AS n FROM c GROUP BY page_id), d AS (SELECT page_id, url, title, h1, target, round(100.0 * n / len(w), 2) AS density FROM w JOIN k USING (page_id))
SELECT page_id, url, target, 'keyword_stuffing' AS issue_type, 'warning' AS severity FROM d WHERE density > 3 UNION ALL SELECT page_id, url, target, 'target_keyword_not_in_title', 'warning' FROM d WHERE NOT contains(lower(title), target)
UNION ALL SELECT page_id, url, target, 'target_keyword_not_in_h1', 'warning' FROM d WHERE NOT contains(lower(h1), target) UNION ALL SELECT page_id, url, target, 'target_keyword_not_in_meta', 'warning' FROM d UNION ALL SELECT page_id, url, target, 'target_keyword_not_in_url', 'info' FROM d WHERE NOT contains(lower(url), target)""",
)
def keyword_rules(spark, sf_dir):
    from .core_queries import page_features

    return site_rules.keyword_issues(page_features(table(spark, sf_dir, "pages")).withColumn("meta_description", F.lit("")))


@register("heading_order", f"WITH {values_sql('fx_headings')}, h AS (SELECT *, CAST(substr(tag, 2) AS INTEGER) AS l, lag(CAST(substr(tag, 2) AS INTEGER)) OVER (PARTITION BY page_id ORDER BY position) AS b FROM fx_headings) SELECT page_id, position, 'heading-order' AS rule_id, 'moderate' AS impact, text FROM h WHERE l > b + 1")
def heading_order(spark, sf_dir):
    return site_rules.heading_order(tables(spark, sf_dir)["fx_headings"])


@register("rank_shifts", "SELECT s_suppkey AS url, round((s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE 1 END) - s_acctbal, 2) AS shift FROM supplier WHERE s_suppkey % 3 = 0")
def rank_shifts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    base = s.select(F.col("s_suppkey").alias("url"), F.col("s_acctbal").alias("internal_pagerank"))
    other = s.select(F.col("s_suppkey").alias("url"), (F.col("s_acctbal") + F.when(F.col("s_suppkey") % 3 == 0, 7).otherwise(1)).alias("internal_pagerank"))
    return compare.rank_shifts(base, other).select("url", "shift")


@register(
    "accessibility_totals",
    "SELECT user_id AS page_id, count(*) AS violations, count(*) FILTER (event_id % 4 = 0) AS critical, count(*) FILTER (event_id % 4 = 1) AS serious, count(*) FILTER (event_id % 2 = 0) AS wcag2a, count(*) FILTER (event_id % 2 = 1) AS wcag2aa, CAST(0 AS BIGINT) AS wcag21aa, count(*) AS \"best-practice\" FROM events GROUP BY user_id",
)
def accessibility_totals(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.when(k % 4 == 0, "critical").when(k % 4 == 1, "serious").otherwise("minor").alias("impact"), F.array(F.when(k % 2 == 0, "wcag2a").otherwise("wcag2aa"), F.lit("best-practice")).alias("wcag_tags"))
    return report.accessibility_totals(rows)


@register("graph_lines", f"WITH {values_sql('fx_pages', 'fx_links')} SELECT count(*) AS lines FROM (SELECT url FROM fx_pages UNION ALL SELECT DISTINCT source_url || ' ' || target_url FROM fx_links WHERE is_internal AND source_url IN (SELECT url FROM fx_pages) AND target_url IN (SELECT url FROM fx_pages))")
def graph_lines(spark, sf_dir):
    t = tables(spark, sf_dir)
    return exports.graph_json(*views.crawl_graph(t["fx_pages"], t["fx_links"], None, None)).agg(F.count("*").alias("lines"))


@register("running_progress", f"WITH {values_sql('fx_pages')} SELECT count(*) AS pages, count(*) FILTER (status_code >= 400) AS errors, round(avg(response_time_ms), 1) AS avg_ms FROM fx_pages")
def running_progress(spark, sf_dir):
    from ..streaming.ingest import progress

    return progress(tables(spark, sf_dir)["fx_pages"])
