"""The rules and views over the captured pages of the tables, with twins that extract by patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, audit, rules, views
from .audit_queries import ALL, LINK_TARGETS, PREP_PAGES, SITEMAP_ENTRIES
from .registry import register
from .site_tables import site_sql, site_tables


@register("crawl_page_rules", f"WITH {site_sql(*ALL)},{PREP_PAGES}\n{rules.to_duckdb(rules.PAGE_RULES, 'prepared')}")
def crawl_page_rules(spark, sf_dir):
    """All rules over all captured pages in one pass."""
    return rules.issues(audit.prepare_pages(site_tables(spark, sf_dir)), rules.PAGE_RULES)


@register("crawl_link_rules", f"WITH {site_sql('fx_pages', 'fx_links', 'fx_status')},\n{LINK_TARGETS}")
def crawl_link_rules(spark, sf_dir):
    return rules.issues(audit.prepare_links(site_tables(spark, sf_dir)), rules.LINK_RULES)


@register("crawl_sitemap_rules", f"WITH {site_sql('fx_pages', 'fx_links', 'fx_sitemap')},\n{SITEMAP_ENTRIES}")
def crawl_sitemap_rules(spark, sf_dir):
    return rules.issues(audit.prepare_sitemap(site_tables(spark, sf_dir)), rules.SITEMAP_RULES)


@register("crawl_links", f"WITH {site_sql('fx_links')} SELECT link_id, source_page_id, source_url, target_url, anchor_text, is_internal, nofollow, rel FROM fx_links")
def crawl_links(spark, sf_dir):
    return site_tables(spark, sf_dir)["fx_links"].drop("target_blocked")


@register("crawl_headings", f"WITH {site_sql('fx_headings')} SELECT * FROM fx_headings")
def crawl_headings(spark, sf_dir):
    return site_tables(spark, sf_dir)["fx_headings"]


@register("crawl_pages", f"WITH {site_sql('fx_pages')} SELECT page_id, url, title, h1, lang, word_count, html_size, content_hash, dom_size, crawl_depth FROM fx_pages")
def crawl_pages(spark, sf_dir):
    return site_tables(spark, sf_dir)["fx_pages"].select("page_id", "url", "title", "h1", "lang", "word_count", "html_size", "content_hash", "dom_size", "crawl_depth")


@register(
    "crawl_inlinks",
    f"""WITH {site_sql('fx_pages', 'fx_links')}, i AS (SELECT rtrim(target_url, '/') AS k, count(*) AS inlinks, count(DISTINCT source_url) AS unique_inlinks, arg_min(source_url, link_id) AS parent FROM fx_links GROUP BY 1),
o AS (SELECT source_page_id AS page_id, count(*) FILTER (is_internal) AS outlinks FROM fx_links GROUP BY 1)
SELECT p.page_id, coalesce(inlinks, 0) AS inlinks, coalesce(unique_inlinks, 0) AS unique_inlinks, coalesce(outlinks, 0) AS outlinks, coalesce(parent, CASE WHEN crawl_depth = 0 THEN url END) AS parent_url FROM fx_pages p LEFT JOIN i ON i.k = rtrim(p.url, '/') LEFT JOIN o USING (page_id)""",
)
def crawl_inlinks(spark, sf_dir):
    """Link columns of the master dataset over the captured pages."""
    return views.enrich(site_tables(spark, sf_dir), "example.com").where("page_id is not null").select("page_id", "inlinks", "unique_inlinks", "outlinks", "parent_url")


@register(
    "crawl_issue_summary",
    f"""WITH {site_sql(*ALL)},{PREP_PAGES}, i AS ({rules.to_duckdb(rules.PAGE_RULES, 'prepared')})
SELECT *, round(100.0 * urls / greatest((SELECT count(*) FROM fx_pages), 1), 1)::DOUBLE AS pct_of_total FROM (
  SELECT issue_type, arg_min(category, (r, category)) AS category, arg_min(severity, r) AS severity, min(r) AS priority, count(DISTINCT url) AS urls, count(*) AS n FROM (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 2 ELSE 6 END AS r FROM i) GROUP BY issue_type)""",
)
def crawl_issue_summary(spark, sf_dir):
    t = site_tables(spark, sf_dir)
    return aggregates.issue_summary(rules.issues(audit.prepare_pages(t), rules.PAGE_RULES), t["fx_pages"].agg(F.count("*").alias("pages")))
