"""Site-level findings: each relation is aggregated to one row, and the rows that fire are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import keywords
from .aggregates import share

OLD_FORMATS = ("jpg", "jpeg", "png", "gif", "bmp")
STUFFED, MAX_SITEMAP_URLS = 3.0, 50_000


def _fire(row: DataFrame, *found: tuple) -> DataFrame:
    """category, issue_type, severity and element of the findings (when, category, type, severity, element) of a frame of one row."""
    made = [F.when(F.coalesce(w, F.lit(False)), F.struct(F.lit(c).alias("category"), F.lit(t).alias("issue_type"), (s if isinstance(s, Column) else F.lit(s)).alias("severity"), e.cast("string").alias("element"))) for w, c, t, s, e in found]
    return row.select(F.explode(F.array_compact(F.array(*made))).alias("_i")).select("_i.*")


def _graded(pct: Column, good: float, fair: float) -> Column:
    return F.when(pct >= good, "info").when(pct >= fair, "warning").otherwise("critical")


def site_findings(t: dict[str, DataFrame]) -> DataFrame:
    """All site-level findings of an audit."""
    pages, always = t["fx_pages"], F.lit(True)
    html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    p = pages.agg(
        F.round(F.avg(F.nullif("response_time_ms", F.lit(0.0))), 1).alias("rt"), F.count_if(F.col("crawl_depth") > 3).alias("deep"), F.count_if(html).alias("html"),
        F.count_if(html & filled("og_title") & filled("og_description") & filled("og_image")).alias("og"), F.count_if(F.col("raw_hash") != F.col("rendered_hash")).alias("changed"),
    )
    out = _fire(
        p, (F.col("rt").isNotNull(), "performance", "site_wide_avg_response_time", "info", F.col("rt")), (F.col("deep") > 0, "sitewide", "pages_too_deep", "warning", F.col("deep")),
        (always, "social", "social_meta_summary", _graded(share(F.col("og"), F.col("html")), 80, 40), share(F.col("og"), F.col("html"))),
    )
    i = t["fx_images"].agg(F.count_if(F.col("alt_text").isNull()).alias("alt"), F.count_if(F.lower("format").isin(*OLD_FORMATS)).alias("old"))
    out = out.unionByName(_fire(i, (F.col("alt") > 0, "images", "site_wide_missing_alt", "warning", F.col("alt")), (F.col("old") > 0, "images", "site_wide_old_formats", "info", F.col("old"))))
    g = t["fx_pagination"].agg(F.count("*").alias("n"), F.countDistinct("url").alias("pages"))
    out = out.unionByName(_fire(g, (F.col("n") > 0, "pagination", "pagination_summary", "info", F.concat(F.col("n").cast("string"), F.lit("/"), F.col("pages").cast("string")))))
    s = t["fx_sitemap"].groupBy("sitemap_url").agg(F.count("*").alias("n")).agg(F.count("*").alias("files"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    out = out.unionByName(_fire(s, (F.col("files") == 0, "sitemaps", "no_sitemaps_found", "warning", F.lit("")), (F.col("most") > MAX_SITEMAP_URLS, "sitemaps", "sitemap_exceeds_url_limit", "critical", F.col("most"))))
    d = t["fx_structured"].agg(F.countDistinct("page_id").alias("marked")).crossJoin(p.select("html"))  # two single rows
    out = out.unionByName(_fire(d, (F.col("marked") > 0, "structured_data", "schema_coverage", "info", share(F.col("marked"), F.col("html"))), (F.col("marked") == 0, "structured_data", "no_schema_markup", "warning", F.lit(""))))
    return out


def link_totals(prepared_links: DataFrame) -> DataFrame:
    broken = (F.col("target_status") >= 400) | (F.col("target_status") == 0)
    a = prepared_links.agg(F.count_if(F.col("is_internal") & broken).alias("inside"), F.count_if(~F.col("is_internal") & broken).alias("outside"), F.countDistinct(F.when(F.col("is_internal") & F.col("target_blocked"), F.col("target_url"))).alias("blocked"))
    return _fire(a, (F.col("inside") > 0, "links", "total_broken_internal_links", "critical", F.col("inside")), (F.col("outside") > 0, "links", "total_broken_external_links", "warning", F.col("outside")), (F.col("blocked") > 0, "robots", "site_wide_blocked_internal_urls", "warning", F.col("blocked")))


def duplicate_social_titles(pages: DataFrame, shown: int = 5) -> DataFrame:
    """og_title, pages and the first URLs of titles that pages share: a report's sample, by URL order."""
    own = pages.where(F.trim(F.coalesce("og_title", F.lit(""))) != "").select(F.trim("og_title").alias("og_title"), "url")
    counts = own.groupBy("og_title").agg(F.count("*").alias("pages")).where("pages > 1")
    first = own.join(counts, "og_title").withColumn("_n", F.row_number().over(Window.partitionBy("og_title").orderBy("url"))).where(F.col("_n") <= shown)
    return first.groupBy("og_title").agg(F.max("pages").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: u), ", ").alias("urls"))


def keyword_issues(pages: DataFrame) -> DataFrame:
    """Rules on a page's most frequent word in title, description and first heading; one row of words for each page, no shuffle."""
    c = lambda n: F.coalesce(n, F.lit(""))
    d = pages.select("page_id", "url", c("title").alias("title"), c("meta_description").alias("meta"), c("h1").alias("h1")).withColumn("_w", keywords(F.concat_ws(" ", "title", "meta", "h1")))
    distinct = F.array_distinct("_w")
    counted = F.transform(distinct, lambda w, i: F.struct((-F.size(F.filter("_w", lambda x: x == w))).alias("n"), i.alias("i"), w.alias("w")))
    d = d.where(F.size("_w") > 0).withColumn("_t", F.array_min(counted)).withColumns({"target": F.col("_t.w"), "density": F.round(-100.0 * F.col("_t.n") / F.size("_w"), 2)})
    misses = lambda col: ~F.lower(col).contains(F.col("target"))
    one = lambda w, t, s: F.when(w, F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity")))
    found = F.array(
        one(F.col("density") > STUFFED, "keyword_stuffing", "warning"), one(misses("title"), "target_keyword_not_in_title", "warning"), one(misses("h1"), "target_keyword_not_in_h1", "warning"), one(misses("meta"), "target_keyword_not_in_meta", "warning"), one(misses("url"), "target_keyword_not_in_url", "info")
    )
    return d.select("page_id", "url", "target", F.explode(F.array_compact(found)).alias("_i")).select("page_id", "url", "target", "_i.*")


def heading_order(headings: DataFrame) -> DataFrame:
    """Every heading that skips a level below the one before it."""
    level = F.regexp_extract("tag", "([1-6])", 1).cast("int")
    d = headings.withColumn("level", level).withColumn("before", F.lag("level").over(Window.partitionBy("page_id").orderBy("position")))
    return d.where(F.col("level") > F.col("before") + 1).select("page_id", "position", F.lit("heading-order").alias("rule_id"), F.lit("moderate").alias("impact"), "text")
