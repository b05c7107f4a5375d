"""Report aggregates: tests, scores, loading metrics, objects and overviews from observed inputs only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from .aggregates import share


def overview(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of a site in one row: one aggregate of pages, one of targets."""
    code = F.coalesce("status_code", F.lit(200))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    a = pages.agg(
        F.count("*").alias("crawled"), F.count_if((code >= 200) & (code < 300)).alias("ok"), F.count_if((code >= 300) & (code < 400)).alias("redirects"), F.count_if((code >= 400) & (code < 500)).alias("client_errors"), F.count_if(code >= 500).alias("server_errors"),
        F.count_if(~F.coalesce("is_indexable", F.lit(False))).alias("noindex"), F.count_if(~blank("canonical") & (U.rstrip_slash(F.col("canonical")) != U.rstrip_slash(F.col("url")))).alias("canonicalised"),
        F.count_if(blank("title")).alias("missing_titles"), F.count_if(blank("meta_description")).alias("missing_descriptions"), F.count_if(blank("h1")).alias("missing_h1"), F.round(F.avg(F.nullif("response_time_ms", F.lit(0.0))), 1).alias("avg_response_ms"),
    )
    found = pages.select("url").unionByName(links.select(F.col("target_url").alias("url"))).distinct().agg(F.count("*").alias("discovered"))
    return a.crossJoin(found)  # two single rows


def page_tests(pages: DataFrame) -> DataFrame:
    """category, test and status (passed, warning or failed) of the seed page and the site."""
    code = F.coalesce("status_code", F.lit(0))
    title, meta = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("meta_description", F.lit("")))
    graded = lambda good, fair: F.when(good, "passed").when(fair, "warning").otherwise("failed")
    seed = pages.orderBy(F.coalesce("crawl_depth", F.lit(99)), "page_id").limit(1)
    tests = [
        ("seo", "title", graded(F.length(title).between(30, 60), title != "")), ("seo", "meta_description", graded(F.length(meta).between(70, 160), meta != "")), ("seo", "h1", graded(F.trim(F.coalesce("h1", F.lit(""))) != "", F.lit(False))),
        ("seo", "canonical", graded(F.trim(F.coalesce("canonical", F.lit(""))) != "", F.lit(True))), ("speed", "response_time", graded(F.col("response_time_ms") < 600, F.col("response_time_ms") < 1500)), ("speed", "page_size", graded(F.col("html_size") < 100_000, F.col("html_size") < 500_000)),
        ("mobile", "viewport", graded(F.coalesce("viewport", F.lit("")).contains("width=device-width"), F.coalesce("viewport", F.lit("")) != "")), ("security", "https", graded(F.col("url").startswith("https://"), F.lit(False))), ("links", "status", graded(code == 200, (code >= 300) & (code < 400))),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(t).alias("test"), s.alias("status")) for c, t, s in tests])
    return seed.select(F.explode(rows).alias("t")).select("t.*")


def site_tests(t: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """category, test and status of tests on the whole site: each input is one aggregate, all of them make one row."""
    from .audit import header, prepare_links, prepare_schema

    like = lambda part: F.count_if(F.lower("issue_type").contains(part))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    seed = t["fx_pages"].orderBy(F.coalesce("crawl_depth", F.lit(99)), "page_id").limit(1).select((~blank("title") & ~blank("meta_description")).alias("shown"), (header("strict-transport-security") != "").alias("hsts"))
    www = U.authority(F.col("url")).startswith("www.")
    inside, broken = F.col("is_internal"), (F.col("target_status") >= 400) | (F.col("target_status") == 0)
    secure = t["fx_pages"].where("startswith(url, 'https://')").select("page_id")
    facts = [
        seed, issues.agg(like("robots").alias("robots"), like("sitemap").alias("sitemaps"), like("canonical").alias("canonicals"), F.count_if(F.col("issue_type") == "orphan_page").alias("orphans")),
        t["fx_headings"].agg(F.count_if(F.lower("tag") == "h1").alias("h1s"), F.count_if(F.lower("tag") == "h2").alias("h2s")), t["fx_images"].agg(F.count_if(blank("alt_text")).alias("no_alt"), F.count_if(~F.coalesce("has_dimensions", F.lit(False))).alias("loose")),
        t["fx_pages"].agg(F.count("*").alias("pages"), F.count_if(~F.coalesce("is_indexable", F.lit(False))).alias("noindex"), (F.max(www) & F.max(~www)).alias("mixed_hosts")),
        prepare_links(t).agg(F.count_if(inside & broken).alias("broken_inside"), F.count_if(~inside & broken).alias("broken_outside")), prepare_schema(t).agg(F.countDistinct(F.nullif("schema_type", F.lit(""))).alias("types")),
        t["fx_resources"].where("startswith(url, 'http://')").join(secure, "page_id", "left_semi").agg(F.count("*").alias("insecure")),
    ]
    row = facts[0]
    for f in facts[1:]:
        row = row.crossJoin(f)  # single rows
    c = F.col
    ok = lambda good, otherwise="warning": F.when(good, "passed").otherwise(otherwise)
    tests = [
        ("seo", "google_preview", ok(c("shown"))), ("seo", "headings", F.when(c("h1s") == 0, "failed").when((c("h1s") > 1) | (c("h2s") > 20), "warning").otherwise("passed")), ("seo", "robots_txt", ok(c("robots") == 0)), ("seo", "sitemap", ok(c("sitemaps") == 0)),
        ("seo", "image_alt", F.when(c("no_alt") == 0, "passed").when(c("no_alt") > 10, "failed").otherwise("warning")), ("seo", "image_size", ok(c("loose") <= 5)), ("seo", "canonical_tag", ok(c("canonicals") == 0)), ("seo", "noindex", ok((c("noindex") == 0) | (c("noindex") < c("pages")))),
        ("security", "url_canonicalization", ok(~c("mixed_hosts"))), ("security", "mixed_content", ok(c("insecure") == 0, "failed")), ("security", "hsts", ok(c("hsts"))), ("links", "broken_links", ok(c("broken_inside") + c("broken_outside") == 0, "failed")), ("links", "orphan_pages", ok(c("orphans") == 0)),
        ("advanced", "structured_data", ok(c("types") > 0)),
    ]
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("category"), F.lit(b).alias("test"), s.alias("status")) for a, b, s in tests])).alias("t")).select("t.*")


def markup_tests(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tests on the markup of the seed page, the one with the smallest id: media queries, plain addresses, unsafe links, words."""
    from ..functions import fields as P, text as X
    from ..sources import html as H
    from . import keywords

    seed = pages.orderBy("page_id").limit(1)
    unsafe = H.unsafe_links(H.parse_pages(seed, columns=("links",))).agg(F.count("*").alias("unsafe"))
    words = keywords.top_ngrams(seed, "page_id", html, {1: 10}).agg(F.count("*").alias("words"))
    row = seed.select(P.has_media_query(F.col(html)).alias("media"), F.size(X.emails(F.col(html))).alias("emails")).crossJoin(unsafe).crossJoin(words)  # single rows
    ok = lambda good, otherwise="warning": F.when(good, "passed").otherwise(otherwise)
    tests = [("mobile", "media_queries", ok(F.col("media"), "failed")), ("security", "plain_emails", ok(F.col("emails") == 0)), ("security", "unsafe_links", ok(F.col("unsafe") == 0, "failed")), ("seo", "common_keywords", ok(F.col("words") > 0))]
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("category"), F.lit(b).alias("test"), s.alias("status")) for a, b, s in tests])).alias("t")).select("t.*")


def second_score(seo_score: Column, n_keywords: Column) -> Column:
    """A score from the first one and the number of leading keywords, within 20 and 95."""
    return F.greatest(F.least(F.round(seo_score * 0.9 + n_keywords * 1.2), F.lit(95.0)), F.lit(20.0))


def scores(tests: DataFrame) -> DataFrame:
    """Counts and score of each category, and of all as category ``all`` (weights 100 and 55, kept within 15 and 99)."""
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = tests.groupingSets([["category"], []], "category").agg(by("passed"), by("warning"), by("failed"))
    n = F.col("passed") + F.col("warning") + F.col("failed")
    one = F.least(F.greatest(F.round((F.col("passed") * 100 + F.col("warning") * 50) / n), F.lit(0.0)), F.lit(100.0))
    every = F.least(F.greatest(F.round((F.col("passed") * 100 + F.col("warning") * 55) / n), F.lit(15.0)), F.lit(99.0))
    return g.select(F.coalesce("category", F.lit("all")).alias("category"), "passed", "warning", "failed", F.when(F.col("category").isNull(), every).otherwise(one).alias("score"))


def _grade(value: Column, good: float, fair: float) -> Column:
    return F.when(value < good, "good").when(value < fair, "moderate").otherwise("poor")


def loading_metrics(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Estimated loading metrics for two devices from mean response time, seed size and images without dimensions."""
    mean = pages.agg((F.coalesce(F.avg(F.nullif("response_time_ms", F.lit(0.0))), F.lit(320.0)) / 1000).alias("rt"), F.coalesce(F.min_by(F.nullif("html_size", F.lit(0)), F.struct(F.coalesce("crawl_depth", F.lit(99)), "page_id")), F.lit(28000)).alias("size"))
    d = mean.crossJoin(images.agg(F.count_if(~F.coalesce("has_dimensions", F.lit(False))).alias("loose")))  # two single rows
    kb = F.col("size") / 1024
    d = d.withColumn("ttfb", F.round(F.greatest(F.col("rt"), F.lit(0.08)), 2))
    d = d.withColumn("fcp", F.round(F.greatest(F.col("ttfb") * 1.25 + F.least(kb / 200, F.lit(0.6)), F.lit(0.4)), 2))
    d = d.withColumn("lcp", F.round(F.greatest(F.col("fcp") + 0.65 + F.least(kb / 120, F.lit(1.2)), F.lit(0.8)), 2))
    d = d.withColumn("cls", F.round(0.02 + F.least(F.col("loose") * 0.012, F.lit(0.18)), 3))
    d = d.withColumn("score", F.greatest(F.least(F.round(100 - F.col("lcp") * 11 - F.col("cls") * 110 - F.col("fcp") * 5), F.lit(99.0)), F.lit(35.0)))
    phone = F.struct(
        F.lit("mobile").alias("device"), F.round(F.greatest(F.col("rt") + 0.11, F.lit(0.18)), 2).alias("ttfb"), F.round(F.greatest(F.col("fcp") * 1.55 + 0.25, F.lit(0.85)), 2).alias("fcp"), F.round(F.greatest(F.col("lcp") * 1.7 + 0.35, F.lit(1.3)), 2).alias("lcp"),
        F.round(F.least(F.col("cls") * 1.18, F.lit(0.28)), 3).alias("cls"), F.greatest(F.least(F.col("score") - 18, F.lit(95.0)), F.lit(25.0)).alias("score"),
    )
    desk = F.struct(F.lit("desktop").alias("device"), "ttfb", "fcp", "lcp", "cls", "score")
    d = d.select(F.explode(F.array(desk, phone)).alias("m")).select("m.*")
    return d.withColumns({"ttfb_status": _grade(F.col("ttfb"), 0.8, 1.8), "fcp_status": _grade(F.col("fcp"), 1.8, 3.0), "lcp_status": _grade(F.col("lcp"), 2.5, 4.0), "cls_status": _grade(F.col("cls"), 0.1, 0.25)})


def measured_metrics(metrics: DataFrame) -> DataFrame:
    """Means of measured loading metrics in seconds."""
    return metrics.agg(F.round(F.avg(F.nullif("lcp_ms", F.lit(0.0))) / 1000, 2).alias("lcp_s"), F.round(F.avg("cls"), 3).alias("cls"), F.round(F.avg(F.nullif("fcp_ms", F.lit(0.0))) / 1000, 2).alias("fcp_s"), F.count("*").alias("pages"))


def objects_by_domain(resources: DataFrame, top: int = 12) -> DataFrame:
    """Requests by domain with their share: a report's top list."""
    g = resources.groupBy(U.authority(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    total = resources.agg(F.count("*").alias("_all"))
    return g.crossJoin(F.broadcast(total)).select("domain", "n", share(F.col("n"), F.col("_all")).alias("pct")).orderBy(F.desc("n"), "domain").limit(top)


def slowest(pages: DataFrame, column: str = "response_time_ms", top: int = 5) -> DataFrame:
    return pages.where(F.col(column).isNotNull()).orderBy(F.desc(column), "url").limit(top).select("url", column)


def accessibility_totals(violations: DataFrame) -> DataFrame:
    """Violations of each page by impact and by guideline level."""
    level = lambda t: F.count_if(F.array_contains("wcag_tags", t)).alias(t)
    return violations.groupBy("page_id").agg(F.count("*").alias("violations"), F.count_if(F.col("impact") == "critical").alias("critical"), F.count_if(F.col("impact") == "serious").alias("serious"), level("wcag2a"), level("wcag2aa"), level("wcag21aa"), level("best-practice"))


def robots_file_checks(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings on each host's robots.txt: status, size, full block, unknown lines, missing sitemap, crawl delay."""
    has = lambda c, name: F.max(c).alias(name)
    full = (F.col("directive") == "disallow") & (F.col("value") == "/") & F.col("agent").isin("*", "googlebot")
    known = F.col("directive").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap", "host", "clean-param", "request-rate", "visit-time", "noindex")
    r = rules.groupBy("host").agg(has(full, "full"), has(~known, "syntax"), has(F.col("directive") == "sitemap", "sitemap"), has(F.col("directive") == "crawl-delay", "delay"))
    d = files.join(r, "host", "left")
    one = lambda when, t, s: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity")))
    ok = F.col("status") == 200
    out = [one(F.col("status").isNull(), "robots_txt_fetch_error", "warning"), one(F.col("status") == 404, "robots_txt_missing_or_error", "info"), one(F.col("status").isNotNull() & ~F.col("status").isin(200, 404), "robots_txt_missing_or_error", "warning"), one(ok & (F.octet_length("text") > 512000), "robots_txt_oversized", "critical"), one(ok & F.col("full"), "robots_txt_full_site_disallowed", "critical"), one(ok & F.col("syntax"), "robots_txt_syntax_errors", "warning"), one(ok & ~F.coalesce("sitemap", F.lit(False)), "robots_txt_missing_sitemap", "info"), one(ok & F.col("delay"), "robots_txt_crawl_delay_present", "info")]
    return d.select("host", F.explode(F.array_compact(F.array(*out))).alias("i")).select("host", "i.*")


def coverage(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Indexable pages in a sitemap and their share, and entries of each file."""
    key = U.rstrip_slash(F.col("url")).alias("_k")
    good = pages.where("status_code = 200 and coalesce(is_indexable, false)").select(key).distinct()
    inside = good.join(sitemap.select(key).distinct(), "_k", "left_semi").agg(F.count("*").alias("in_sitemap"))
    d = good.agg(F.count("*").alias("indexable")).crossJoin(inside)  # two single rows
    d = d.withColumn("pct", share(F.col("in_sitemap"), F.col("indexable")))
    return d.withColumn("severity", F.when(F.col("pct") >= 90, "info").when(F.col("pct") >= 70, "warning").otherwise("critical"))
