"""One issues table of an audit: page rules, relation rules, site-level findings and derived issues, with a catalogue of fixes.

Columns are page_id, url, category, severity, issue_type and element; findings of the whole site have no page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from . import aggregates, audit, rules, site_rules, views
from .rules import Rule

COLUMNS = ("page_id", "url", "category", "severity", "issue_type", "element")

#: Names, areas and priorities of the catalogue by issue type.
CATALOGUE = (
    ("4xx_error", "4xx Client Error (Broken URL)", "Indexability & Response Codes", "critical"),
    ("5xx_error", "5xx Server Error", "Indexability & Response Codes", "critical"),
    ("orphan_page", "Orphan Page (0 Internal Inlinks)", "Site Architecture & Equity", "high"),
    ("missing_title", "Missing Page Title", "On-Page SEO", "critical"),
    ("title_too_long", "Page Title Over 60 Characters", "On-Page SEO", "warning"),
    ("title_too_short", "Page Title Under 30 Characters", "On-Page SEO", "notice"),
    ("missing_meta_desc", "Missing Meta Description", "On-Page SEO", "high"),
    ("meta_desc_too_long", "Meta Description Over 160 Characters", "On-Page SEO", "notice"),
    ("missing_h1", "Missing H1 Heading", "Content & Structure", "high"),
    ("multiple_h1", "Multiple H1 Headings", "Content & Structure", "warning"),
    ("canonical_mismatch", "Canonical Mismatch (Canonicalised URL)", "Canonicals & Indexability", "warning"),
    ("redirect_chain", "Multi-Hop Redirect Chain", "Indexability & Response Codes", "high"),
    ("slow_response", "Slow Response Time (> 1000ms)", "Performance & CWV", "warning"),
    ("noindex_tag", "Noindex Directive Detected", "Canonicals & Indexability", "warning"),
)
#: What to do, in own words.
ADVICE = {
    "4xx_error": "Redirect the address to its successor, or take the links to it away.",
    "5xx_error": "Read the server's logs and mend what fails.",
    "orphan_page": "Link to the page from one that readers reach.",
    "missing_title": "Give the page a title of its own.",
    "title_too_long": "Shorten the title so that result pages show all of it.",
    "title_too_short": "Say in the title what the page is about.",
    "missing_meta_desc": "Describe the page in one or two sentences.",
    "meta_desc_too_long": "Shorten the description so that result pages show all of it.",
    "missing_h1": "Put one main heading above the text.",
    "multiple_h1": "Keep one main heading and lower the others.",
    "canonical_mismatch": "Name the page itself as canonical, or check that the other one is meant.",
    "redirect_chain": "Link and redirect straight to the last address.",
    "slow_response": "Cache the page or speed up what makes it.",
    "noindex_tag": "Remove the directive if the page is meant to be found.",
}
OTHER_AREA, OTHER_ADVICE = "Technical SEO", "Follow the documentation of search engines for this finding."
#: The order of priorities.
PRIORITIES = {"critical": 0, "high": 1, "warning": 2, "medium": 3, "notice": 4, "low": 5, "info": 6}
_OK = "is_html AND status_code = 200"
#: Over ``derivable`` pages, with thresholds of their own.
DERIVED_RULES = tuple(
    Rule("derived", name, next(p for code, _, _, p in CATALOGUE if code == name), when, element)
    for name, when, element in (
        ("5xx_error", "status_code >= 500", "CAST(status_code AS STRING)"),
        ("4xx_error", "status_code BETWEEN 400 AND 499", "CAST(status_code AS STRING)"),
        ("redirect_chain", "status_code IN (301, 302, 307, 308) AND redirect_length > 1", "CAST(redirect_length AS STRING)"),
        ("orphan_page", "is_orphan", "''"),
        ("missing_title", f"{_OK} AND title = ''", "''"),
        ("title_too_long", f"{_OK} AND length(title) > 65", "CAST(length(title) AS STRING)"),
        ("title_too_short", f"{_OK} AND title <> '' AND length(title) < 25", "CAST(length(title) AS STRING)"),
        ("missing_meta_desc", f"{_OK} AND meta_description = ''", "''"),
        ("meta_desc_too_long", f"{_OK} AND length(meta_description) > 165", "CAST(length(meta_description) AS STRING)"),
        ("missing_h1", f"{_OK} AND h1 = ''", "''"),
        ("multiple_h1", f"{_OK} AND h1 <> '' AND h1_count > 1", "CAST(h1_count AS STRING)"),
        ("canonical_mismatch", f"{_OK} AND canonical <> '' AND canonical <> url AND canonical_status = 'Canonicalised'", "canonical"),
        ("noindex_tag", f"{_OK} AND robots LIKE '%noindex%'", "''"),
        ("slow_response", f"{_OK} AND response_time_ms > 1200", "''"),
    )
)


def derivable(t: dict[str, DataFrame], domain: str) -> DataFrame:
    """The columns that derived issues read, for crawled pages."""
    d = views.enrich(t, domain).where("page_id is not null")
    heads = t["fx_headings"].where("lower(tag) = 'h1'").groupBy("page_id").agg(F.count("*").alias("h1_count"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    robots = F.lower(F.coalesce("meta_robots", F.lit(""))) if "meta_robots" in d.columns else F.lit("")
    return d.join(heads, "page_id", "left").select(
        "page_id", "url", "status_code", ((kind == "") | kind.contains("text/html")).alias("is_html"), blank("title"), blank("meta_description"), blank("h1"), blank("canonical"), "canonical_status",
        F.coalesce("h1_count", F.lit(0)).alias("h1_count"), "response_time_ms", "redirect_length", ((F.col("inlinks") == 0) & (F.coalesce("crawl_depth", F.lit(-1)) != 0)).alias("is_orphan"), robots.alias("robots"),
    )


def derived_issues(t: dict[str, DataFrame], domain: str) -> DataFrame:
    return rules.issues(derivable(t, domain), DERIVED_RULES)


def catalogued(issues: DataFrame) -> DataFrame:
    """Issues with the catalogue's name, area and advice; the catalogue is a table of fixed size."""
    spark = issues.sparkSession
    entries = spark.createDataFrame([(code, name, area, ADVICE[code]) for code, name, area, _ in CATALOGUE], "issue_type string, issue_name string, area string, how_to_fix string")
    d = issues.join(F.broadcast(entries), "issue_type", "left")
    return d.withColumns({"issue_name": F.coalesce("issue_name", F.initcap(F.replace("issue_type", F.lit("_"), F.lit(" ")))), "area": F.coalesce("area", F.lit(OTHER_AREA)), "how_to_fix": F.coalesce("how_to_fix", F.lit(OTHER_ADVICE))})


def _placed(df: DataFrame) -> DataFrame:
    missing = {"page_id": F.lit(None).cast("bigint"), "url": F.lit(None).cast("string"), "category": F.lit("sitewide"), "element": F.lit("")}
    return df.select(*[F.col(c) if c in df.columns else missing[c].alias(c) for c in COLUMNS])


def histogram(df: DataFrame, value: Column) -> Column | DataFrame:
    """One row with the counts of each value as text, in order: ``a: 1, b: 2``."""
    counts = df.groupBy(value.cast("string").alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: F.concat(x["v"], F.lit(": "), x["n"].cast("string"))), ", ").alias("element"))


#: Hosts of social networks.
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com")


def site_level(t: dict[str, DataFrame]) -> DataFrame:
    """Findings of the whole site that no page carries: category, issue_type, severity, element.

    Distributions are over values of few kinds (depths, codes, types); the top lists are a report's five.
    """
    pages, links = t["fx_pages"], t["fx_links"]
    row = lambda df, category, kind, severity="info", element=None: df.select(F.lit(category).alias("category"), F.lit(kind).alias("issue_type"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (F.col("element") if element is None else element).cast("string").alias("element"))
    five = lambda c: pages.where(F.col(c) > 0).orderBy(F.desc(c), "url").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "url"))), lambda x: x["url"]), ", ").alias("element"), F.count("*").alias("n")).where("n > 0")
    covered = aggregates.header_coverage(pages).where("score is not null")
    hsts = pages.agg(F.count_if(F.col("url").startswith("https://") & (audit.header("strict-transport-security") == "")).alias("element")).where("element > 0")
    load = pages.agg(F.round(F.avg(F.nullif("response_time_ms", F.lit(0.0))), 1).alias("element")).where("element is not null")
    host = F.lower(U.authority(F.col("target_url")))
    social = links.where(~F.col("is_internal")).agg(F.coalesce(F.max(U.any_of(host.contains(h) for h in SOCIAL_HOSTS)), F.lit(False)).alias("any")).where("not any").select(F.lit("").alias("element"))
    kinds = F.split_part(F.lower(F.coalesce("content_type", F.lit("unknown"))), F.lit(";"), F.lit(1))
    schema = histogram(audit.prepare_schema(t).where("schema_type <> ''"), F.col("schema_type")).where("element <> ''")
    parts = [
        row(histogram(pages, F.col("crawl_depth")), "sitewide", "depth_distribution"), row(histogram(pages, F.col("status_code")), "sitewide", "status_distribution"), row(histogram(pages, kinds), "sitewide", "content_type_distribution"),
        row(load, "sitewide", "avg_page_load_time"), row(social, "sitewide", "no_social_links"), row(five("html_size"), "performance", "largest_pages"), row(five("response_time_ms"), "performance", "slowest_pages", "warning"),
        row(hsts, "security", "site_wide_missing_hsts", "warning"), row(covered, "security", "security_headers_summary", F.col("severity"), F.col("score")), row(schema, "structured_data", "schema_distribution"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keyword_level(targets: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Keywords that lead on several pages, with these pages' number, and how many pages have no keyword at all."""
    shared = targets.groupBy("target").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select(F.lit("keywords").alias("category"), F.lit("keyword_cannibalization").alias("issue_type"), F.lit("warning").alias("severity"), F.concat("target", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("element"))
    none = pages.select(key).join(targets.select(key), key, "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    return shared.unionByName(none.select(F.lit("keywords").alias("category"), F.lit("site_wide_thin_content").alias("issue_type"), F.lit("info").alias("severity"), F.col("n").cast("string").alias("element")))


def not_found_page(probes: DataFrame) -> DataFrame:
    """default_404 or custom_404 from the answer to an address that cannot exist: url, status_code, body."""
    low = F.lower(F.coalesce("body", F.lit("")))
    plain = low.contains("nginx") | low.contains("apache") | (F.length(low) < 500)
    return probes.where("status_code = 404").select(F.lit("sitewide").alias("category"), F.when(plain, "default_404").otherwise("custom_404").alias("issue_type"), F.lit("info").alias("severity"), F.when(plain, F.col("url")).otherwise("").alias("element"))


def search_issues(matches: DataFrame) -> DataFrame:
    """An issue for each matched custom search."""
    return matches.where("matched").select("page_id", "url", F.lit("technical").alias("category"), F.lit("warning").alias("severity"), F.lit("custom_search_match").alias("issue_type"), F.coalesce(F.nullif("snippet", F.lit("")), "url").alias("element"))


def click_issues(search: DataFrame, pages: DataFrame) -> DataFrame:
    """Addresses that are shown often and clicked rarely, with their page where it was crawled."""
    known = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    low = search.where("impressions > 500 and ctr < 0.02 and position <= 15").join(known, "url", "left")
    return low.select("page_id", "url", F.lit("onpage").alias("category"), F.lit("warning").alias("severity"), F.lit("gsc_low_ctr_opportunity").alias("issue_type"), F.col("impressions").cast("string").alias("element"))


def all_issues(t: dict[str, DataFrame], domain: str) -> DataFrame:
    """Every rule and finding over an audit's tables, once each."""
    tags, sources = audit.prepare_hreflang(t)
    links = audit.prepare_links(t)
    parts = [
        rules.issues(audit.prepare_pages(t), rules.PAGE_RULES), rules.issues(links, rules.LINK_RULES), rules.issues(audit.prepare_images(t), rules.IMAGE_RULES), rules.issues(tags, rules.HREFLANG_RULES), rules.issues(sources, rules.HREFLANG_SOURCE_RULES),
        rules.issues(audit.prepare_pagination(t), rules.PAGINATION_RULES), rules.issues(audit.prepare_sitemap(t), rules.SITEMAP_RULES), rules.issues(audit.prepare_schema(t), rules.SCHEMA_RULES), rules.issues(audit.prepare_resources(t), rules.RESOURCE_RULES),
        derived_issues(t, domain), aggregates.site_checks(t["fx_pages"]), site_rules.site_findings(t), site_rules.link_totals(links), site_level(t),
    ]
    out = _placed(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_placed(p))
    return out


def issues_summary(issues: DataFrame) -> DataFrame:
    """One finding with the number of issues of each severity."""
    n = lambda s: F.count_if(F.col("severity") == s).cast("string")
    return issues.agg(F.concat(F.lit("critical: "), n("critical"), F.lit(", warning: "), n("warning"), F.lit(", info: "), n("info")).alias("element")).select(F.lit("sitewide").alias("category"), F.lit("issues_summary").alias("issue_type"), F.lit("info").alias("severity"), "element")


def filter_issues(issues: DataFrame, category: str | None = None, severity: str | None = None, issue_type: str | None = None, q: str | None = None) -> DataFrame:
    """The list page's filters: equal category and severity, a part of the type, a text in any shown column."""
    low = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    if category not in (None, "", "all"):
        issues = issues.where(F.col("category") == category)
    if severity not in (None, "", "all"):
        issues = issues.where(F.col("severity") == severity)
    if issue_type not in (None, "", "all"):
        issues = issues.where(low("issue_type").contains(issue_type.lower()))
    if q and q.strip():
        shown = [c for c in ("url", "issue_type", "message", "recommendation", "element") if c in issues.columns]
        issues = issues.where(U.any_of(low(c).contains(q.strip().lower()) for c in shown))
    return issues


#: Orders of the issue list.
ISSUE_SORTS = {
    "severity": lambda: [F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "warning", 2).when(F.col("severity") == "info", 3).otherwise(4), F.asc("issue_type"), F.asc_nulls_first("url")],
    "type": lambda: [F.asc("issue_type"), F.asc_nulls_first("url")],
    "url": lambda: [F.asc_nulls_first("url"), F.asc("issue_type")],
}


def issue_groups(issues: DataFrame) -> DataFrame:
    """One row for each type: title, severity, category and count, the gravest and most frequent first."""
    g = issues.groupBy("issue_type").agg(F.min_by("severity", F.struct(ISSUE_SORTS["severity"]()[0], "severity")).alias("severity"), F.min("category").alias("category"), F.count("*").alias("n"))
    return g.withColumn("title", F.initcap(F.replace("issue_type", F.lit("_"), F.lit(" "))))


def report_priority(severity: Column) -> Column:
    """Severities in the words of a report."""
    return F.when(severity.isin("critical", "high"), "high").when(severity.isin("warning", "medium"), "medium").when(severity.isin("notice", "low"), "low").otherwise("informational")


def filter_links(links: DataFrame, status: str | None = None, q: str | None = None, target_status: str = "target_status") -> DataFrame:
    """Internal links by what their target answers (broken, redirects, 200) or nofollow, and a text in their addresses or anchor."""
    code = F.col(target_status)
    d = links.where("is_internal")
    tests = {"broken": (code >= 400) | (code == 0), "redirects": code.isin(301, 302, 307, 308), "200": code == 200, "nofollow": F.coalesce("nofollow", F.lit(False))}
    if status not in (None, "", "all"):
        d = d.where(tests.get(status, F.lit(True)))
    if q and q.strip():
        d = d.where(U.any_of(F.lower(F.coalesce(c, F.lit(""))).contains(q.strip().lower()) for c in ("target_url", "url", "anchor_text")))
    return d


def link_stats(links: DataFrame, target_status: str = "target_status") -> DataFrame:
    """Counts of the list page: broken, redirecting and nofollow internal links, and distinct targets."""
    code, d = F.col(target_status), links.where("is_internal")
    return d.agg(F.count("*").alias("links"), F.count_if((code >= 400) | (code == 0)).alias("broken"), F.count_if(code.isin(301, 302, 307, 308)).alias("redirects"), F.count_if("nofollow").alias("nofollow"), F.countDistinct("target_url").alias("targets"))
