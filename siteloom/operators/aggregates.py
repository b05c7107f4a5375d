"""Site-wide aggregates: each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from .audit import header


def share(part: Column, total: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / F.greatest(total, F.lit(1)), digits)


def site_checks(pages: DataFrame) -> DataFrame:
    """Mixed schemes, hosts and slashes, server errors, chains and averages from one aggregate."""
    https = F.col("url").startswith("https://")
    www = U.authority(F.col("url")).startswith("www.")
    path = U.path(F.col("url"))
    slash, bare = path.endswith("/") & (path != "/"), ~path.endswith("/")
    words = F.coalesce("word_count", F.lit(0))
    a = pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("status_code") >= 500).alias("n5"), F.count_if(F.size("redirect_chain") > 1).alias("chains"), (F.max(https) & F.max(~https)).alias("mixed"), (F.max(www) & F.max(~www)).alias("www"),
        (F.max(slash) & F.max(bare)).alias("slash"), F.count_if(~https).alias("http"), F.max(F.trim(F.coalesce("viewport", F.lit(""))) != "").alias("v"), F.count_if(words < 300).alias("thin"), F.floor(F.sum(words) / F.count("*")).alias("avg_words"), F.count_if(F.coalesce("is_indexable", F.lit(False))).alias("indexable"),
    )
    rows = [
        ("site_wide_5xx", "critical", F.col("n5") > 0, F.col("n5").cast("string")), ("site_wide_redirect_chains", "warning", F.col("chains") > 0, F.col("chains").cast("string")), ("mixed_http_https", "warning", F.col("mixed"), F.lit("")),
        ("www_inconsistency", "warning", F.col("www"), F.lit("")), ("trailing_slash_inconsistency", "warning", F.col("slash"), F.lit("")), ("site_wide_http", "critical", F.col("http") > 0, F.col("http").cast("string")), ("site_wide_https", "info", F.col("http") == 0, F.lit("0")),
        ("site_wide_missing_viewport", "critical", ~F.col("v"), F.lit("")), ("average_word_count", "info", F.lit(True), F.col("avg_words").cast("string")), ("thin_content_summary", "info", F.col("thin") > 0, F.col("thin").cast("string")),
        ("indexable_counts", "info", F.lit(True), F.concat(F.col("indexable").cast("string"), F.lit("/"), F.col("pages").cast("string"))),
    ]
    out = F.array_compact(F.array(*[F.when(w, F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), e.alias("element"))) for t, s, w, e in rows]))
    return a.select(F.explode(out).alias("_i")).select("_i.*")


def header_coverage(pages: DataFrame) -> DataFrame:
    names = {"hsts_pct": ("strict-transport-security", 0.25), "csp_pct": ("content-security-policy", 0.25), "xcto_pct": ("x-content-type-options", 0.2), "xfo_pct": ("x-frame-options", 0.15), "referrer_pct": ("referrer-policy", 0.15)}
    html = pages.where(F.lower("content_type").contains("html"))
    a = html.agg(*[F.round(100.0 * F.avg(F.when(header(h) != "", 1).otherwise(0)), 1).alias(c) for c, (h, _) in names.items()])
    score = sum((F.col(c) * w for c, (_, w) in names.items()), F.lit(0.0))
    return a.withColumn("score", F.round(score, 1)).withColumn("severity", F.when(F.col("score") >= 80, "info").when(F.col("score") >= 50, "warning").otherwise("critical"))


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by severity, by category and in all, from one pass of grouping sets."""
    return issues.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("n"))


def issue_summary(issues: DataFrame, total_pages: DataFrame) -> DataFrame:
    """Distinct URLs and share of pages for each issue type, ranked by severity and count; ``total_pages`` has one row, ``pages``."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "warning", 2).when(F.col("severity") == "medium", 3).otherwise(6)
    grouped = issues.groupBy("issue_type").agg(F.min_by("category", F.struct(rank, "category")).alias("category"), F.min_by("severity", rank).alias("severity"), F.countDistinct("url").alias("urls"), F.count("*").alias("n"))
    return grouped.crossJoin(F.broadcast(total_pages)).select("issue_type", "category", "severity", rank.alias("priority"), "urls", "n", share(F.col("urls"), F.col("pages")).alias("pct_of_total"))


def health_v1(issues: DataFrame, pages: DataFrame) -> Column:
    """100 less 3 for each critical, 1 for each warning and 0.2 for each note by page, between 0 and 100."""
    c = issues.agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w"), F.count_if(F.col("severity") == "info").alias("i"))
    n = pages.agg(F.count("*").alias("pages"))
    score = 100 - (3 * F.col("c") + F.col("w") + 0.2 * F.col("i")) / F.greatest(F.col("pages"), F.lit(1))
    return c.crossJoin(n).select("c", "w", "i", "pages", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 1).alias("health_v1"), F.greatest(F.lit(0.0), 100 - 2.0 * F.col("c") - 0.5 * F.col("w")).alias("health_v2"))


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Counts and shares of a value; the total is one row, counted from file metadata where the source has it."""
    g = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return with_total(g, df.agg(F.count("*").alias("_total"))).select(name, "n", share(F.col("n"), F.col("_total")).alias("pct"))


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Every row beside a frame of one row."""
    return df.crossJoin(F.broadcast(total))


def response_bucket(ms: Column) -> Column:
    s = ms / 1000
    return F.when(s <= 0.5, "0-0.5s").when(s <= 1, "0.5-1s").when(s <= 2, "1-2s").when(s <= 5, "2-5s").otherwise(">5s")


def path_prefixes(url: Column, levels: int | None) -> Column:
    """The root and each path prefix of an address, down to ``levels``."""
    parts = U.segments(url)
    depth = F.size(parts) if levels is None else F.least(F.size(parts), F.lit(levels))
    below = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("/")), below)


def directory_tree(pages: DataFrame, url: str = "url", levels: int | None = 5) -> DataFrame:
    """Pages below each path prefix: a rollup over the segments of each URL."""
    return pages.select(F.explode(path_prefixes(F.col(url), levels)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("pages")).withColumn("level", F.size(F.filter(F.split("prefix", "/"), lambda s: s != "")))


def status_tree(pages: DataFrame, url: str = "url", levels: int | None = 5) -> DataFrame:
    """The same with how the pages below answer."""
    code = F.col("status_code")
    d = pages.select("status_code", F.explode(path_prefixes(F.col(url), levels)).alias("prefix"))
    return d.groupBy("prefix").agg(F.count("*").alias("pages"), F.count_if(code.between(200, 299)).alias("ok"), F.count_if(code.between(300, 399)).alias("redirects"), F.count_if(code >= 400).alias("errors"))


def duplicate_groups(pages: DataFrame, column: str, key: str = "url", shown: int = 100) -> DataFrame:
    """Values that several pages share, with their number and pages in order; a group shows its first ``shown`` pages by name, so that one that a
    third of all pages share is never held whole."""
    from pyspark.sql import Window

    own = pages.select(F.trim(F.coalesce(column, F.lit(""))).alias("value"), key).where("value <> ''")
    counts = own.groupBy("value").agg(F.count("*").alias("pages")).where("pages > 1")
    first = own.join(counts, "value").withColumn("_n", F.row_number().over(Window.partitionBy("value").orderBy(key))).where(F.col("_n") <= shown)
    return first.groupBy("value").agg(F.max("pages").alias("pages"), F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ", ").alias("members"))


def segment_urls(pages: DataFrame, url: str = "url", shown: int = 100) -> DataFrame:
    """First path segments with count, share and their first URLs in order."""
    from pyspark.sql import Window

    seg = F.concat(F.lit("/"), F.coalesce(F.try_element_at(U.segments(F.col(url)), F.lit(1)), F.lit("")))
    d = pages.select(seg.alias("segment"), url)
    first = d.withColumn("_n", F.row_number().over(Window.partitionBy("segment").orderBy(url))).where(F.col("_n") <= shown).groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list(url)), ", ").alias("urls"))
    return first_segments(pages, url).join(first, "segment")


def social_coverage(pages: DataFrame) -> DataFrame:
    """Shares of the HTML pages with complete Open Graph data, its parts and a card."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    html = pages.where(F.lower(F.coalesce("content_type", F.lit(""))).contains("html"))
    n = lambda c, name: share(F.count_if(c), F.count("*")).alias(name)
    return html.agg(F.count("*").alias("pages"), n(filled("og_title") & filled("og_description") & filled("og_image"), "complete_og_pct"), n(filled("og_title"), "og_title_pct"), n(filled("og_image"), "og_image_pct"), n(filled("og_description"), "og_desc_pct"), n(filled("twitter_card"), "twitter_card_pct"))


def sitemap_counts(sitemap: DataFrame) -> DataFrame:
    """Entries of each sitemap file, and whether there are more than a file may hold."""
    return sitemap.groupBy("sitemap_url").agg(F.count("*").alias("entries"), F.countDistinct("url").alias("urls")).withColumn("too_many", F.col("entries") > 50_000)


def schema_types(blocks: DataFrame) -> DataFrame:
    """Blocks and pages of each schema type; ``blocks`` are prepared ones."""
    return blocks.where("schema_type <> ''").groupBy("schema_type").agg(F.count("*").alias("blocks"), F.countDistinct("page_id").alias("pages"))


def crawl_stats(pages: DataFrame, started: str = "crawled_at") -> DataFrame:
    """Duration in seconds, pages, pages a second and mean response time of a crawl."""
    t = F.col(started).cast("timestamp")
    a = pages.agg(F.count("*").alias("pages"), F.greatest(F.timestamp_diff("SECOND", F.min(t), F.max(t)), F.lit(1)).alias("seconds"), F.round(F.avg(F.nullif("response_time_ms", F.lit(0.0))), 1).alias("avg_ms"))
    return a.withColumn("pages_per_second", F.round(F.col("pages") / F.col("seconds"), 2))


def object_kind(url: Column, kind: Column) -> Column:
    """javascript, css, font, image, html or other, by type or ending."""
    low, t = F.lower(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1))), F.lower(F.coalesce(kind, F.lit("")))
    ends = lambda *e: U.any_of(low.endswith(x) for x in e)
    fonts = ends(".woff", ".woff2", ".ttf", ".eot", ".otf") | low.contains("font")
    return F.when((t == "js") | ends(".js", ".mjs"), "javascript").when((t == "css") | ends(".css"), "css").when(fonts, "font").when(ends(".png", ".jpg", ".jpeg", ".webp", ".svg", ".gif", ".avif"), "image").when(ends(".html", ".htm"), "html").otherwise("other")


def objects_by_kind(resources: DataFrame, images: DataFrame) -> DataFrame:
    """Requests, known bytes and share by kind of object; sizes are those observed."""
    files = resources.select("url", object_kind(F.col("url"), F.col("resource_type")).alias("kind"), F.lit(None).cast("long").alias("size")).unionByName(images.select(F.col("src").alias("url"), F.lit("image").alias("kind"), F.col("file_size").alias("size")))
    g = files.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return with_total(g, files.agg(F.count("*").alias("_total"))).select("kind", "n", "bytes", share(F.col("n"), F.col("_total")).alias("pct"))


def first_segments(pages: DataFrame, url: str = "url") -> DataFrame:
    seg = F.coalesce(F.try_element_at(U.segments(F.col(url)), F.lit(1)), F.lit(""))
    return distribution(pages, F.concat(F.lit("/"), seg), "segment")
