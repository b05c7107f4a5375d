"""The master URL dataset, its tabs, filters, sorting and paging: one lazy plan for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U
from ..functions.text import is_pattern

MAX_PAGE_SIZE = 5000


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def redirect_kind(code: Column) -> Column:
    return F.when(code == 301, "Permanent (301)").when(code == 302, "Temporary (302)").when(code == 307, "Temporary (307)").when(code == 308, "Permanent (308)")


def indexability(df: DataFrame) -> DataFrame:
    """indexability and its reason, from status, canonical and robots columns."""
    code = F.coalesce(F.nullif("status_code", F.lit(0)), F.lit(200))
    canonical = F.trim(F.coalesce("canonical", F.lit("")))
    other = (canonical != "") & (U.rstrip_slash(canonical) != U.rstrip_slash(F.col("url")))
    ok = F.coalesce("is_indexable", F.lit(False))
    text = lambda t: F.concat(F.lit(f"{t} ("), code.cast("string"), F.lit(")"))
    reason = F.when((code >= 400) & (code < 500), text("Client Error")).when(code >= 500, text("Server Error")).when((code >= 300) & (code < 400), text("Redirect")).when(other, "Canonicalised").when(ok, "OK").otherwise("Blocked")
    return df.withColumn("indexability_status", reason).withColumn("indexability", F.when(F.col("indexability_status") == "OK", "Indexable").otherwise("Non-Indexable"))


def canonical_status(url: Column, canonical: Column, domain: str) -> Column:
    c = F.trim(F.coalesce(canonical, F.lit("")))
    host = U.authority(c)
    return F.when(c == "", "Missing").when(U.rstrip_slash(c) == U.rstrip_slash(url), "Self-Referential").when((host != "") & (host != U.authority(url)) & (host != domain), "Cross-Domain").otherwise("Canonicalised")


def redirect_summary(df: DataFrame) -> DataFrame:
    """Redirect length, type and final destination of an array of url and status."""
    n = F.coalesce(F.nullif(F.size("redirect_chain"), F.lit(-1)), F.lit(0))
    n = F.when(n > 0, n).when(F.coalesce("redirect_url", F.lit("")) != "", 1).otherwise(0)
    low = F.transform("redirect_chain", lambda c: F.lower(U.rstrip_slash(c["url"])))
    loop = F.coalesce(F.size(F.array_distinct(low)) < F.size(low), F.lit(False)) | (F.coalesce("status_code", F.lit(0)) == 310)
    kind = F.when(loop, "Loop Detected").when(n > 1, F.concat(F.lit("Chain ("), n.cast("string"), F.lit(" hops)"))).when(n == 1, "Simple (1 hop)").otherwise("None")
    return df.withColumn("redirect_length", n).withColumn("redirect_chain_type", kind).withColumn("redirect_final", F.coalesce(F.try_element_at("redirect_chain", F.lit(-1))["url"], F.nullif("redirect_url", F.lit("")), F.col("url")))


def enrich(t: dict[str, DataFrame], domain: str) -> DataFrame:
    """Pages with link, image and schema counts, first parent and derived columns; then assets and targets not crawled."""
    pages, links = t["fx_pages"], t["fx_links"]
    key = U.rstrip_slash(F.col("target_url"))
    into = links.groupBy(key.alias("_k")).agg(F.count("*").alias("inlinks"), F.countDistinct("source_url").alias("unique_inlinks"), F.min_by("source_url", "link_id").alias("first_parent"))
    out = links.groupBy(F.col("source_page_id").alias("page_id")).agg(F.count_if("is_internal").alias("outlinks"), F.count_if(~F.col("is_internal")).alias("external_outlinks"))
    images = t["fx_images"].groupBy("page_id").agg(F.count("*").alias("images"), F.count_if(F.col("alt_text").isNull()).alias("images_without_alt"))
    schema = t["fx_structured"].groupBy("page_id").agg(F.count("*").alias("schema_blocks"))
    d = pages.withColumn("_k", U.rstrip_slash(F.col("url"))).join(into, "_k", "left").join(out, "page_id", "left").join(images, "page_id", "left").join(schema, "page_id", "left").drop("_k")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("inlinks", "unique_inlinks", "outlinks", "external_outlinks", "images", "images_without_alt", "schema_blocks")})
    d = redirect_summary(indexability(d))
    host = U.authority(F.col("url"))
    d = d.withColumns({"kind": F.lit("page"), "url_type": F.when((host == "") | (host == domain), "Internal").otherwise("External"), "page_type": U.page_type(F.col("url"), F.coalesce("crawl_depth", F.lit(0))), "folder_depth": U.folder_depth(F.col("url")), "status_class": status_class(F.col("status_code")), "canonical_status": canonical_status(F.col("url"), F.col("canonical"), domain), "parent_url": F.coalesce("first_parent", F.when(F.col("crawl_depth") == 0, F.col("url")))})
    seen = pages.select(F.col("url").alias("_u"))
    assets = t["fx_images"].groupBy(F.col("src").alias("url")).agg(F.min("page_id").alias("_o"), F.min_by("url", "page_id").alias("parent_url")).withColumn("kind", F.lit("image"))
    targets = links.groupBy(F.col("target_url").alias("url")).agg(F.min("link_id").alias("_o"), F.min_by("source_url", "link_id").alias("parent_url")).withColumn("kind", F.lit("link"))
    extra = assets.unionByName(targets.join(assets, "url", "left_anti")).join(seen, F.col("url") == F.col("_u"), "left_anti")
    extra = extra.select("url", "kind", "parent_url", F.when(U.authority(F.col("url")).isin("", domain), "Internal").otherwise("External").alias("url_type"), U.asset_mime(F.col("url")).alias("content_type"))
    return d.unionByName(extra, allowMissingColumns=True)


def with_occurrences(df: DataFrame, column: str, out: str = "occurrences") -> DataFrame:
    """How many rows share a value: counted with partial aggregation and joined back; empty values count 0."""
    value = F.trim(F.coalesce(column, F.lit("")))
    sizes = df.select(value.alias("_v")).where("_v <> ''").groupBy("_v").agg(F.count("*").alias(out))
    return df.withColumn("_v", value).join(sizes, "_v", "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_v")


def is_html() -> Column:
    return F.lower(F.coalesce("content_type", F.lit(""))).contains("html")


def mime_kind(url: Column, content_type: Column) -> Column:
    """html, javascript, css, images, pdf or other, by type or ending."""
    low, kind = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    ends = lambda *e: U.any_of(low.endswith(x) for x in e)
    return (
        F.when(kind.contains("html"), "html").when(kind.contains("javascript") | ends(".js"), "javascript").when(kind.contains("css") | ends(".css"), "css")
        .when(kind.contains("image") | ends(".png", ".jpg", ".jpeg", ".webp", ".svg", ".gif"), "images").when(kind.contains("pdf") | ends(".pdf"), "pdf").otherwise("other")
    )


def filled(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) != ""


def _shared(column: str):
    """Pages of HTML, or with the value, with the number of rows that share it."""
    return lambda d, t: with_occurrences(d, column).where(is_html() | filled(column))


def _first_headings(d: DataFrame, t: dict) -> DataFrame:
    first = t["fx_headings"].where("lower(tag) = 'h2'").groupBy("page_id").agg(F.trim(F.min_by("text", "position")).alias("h2_1"))
    d = d.join(first, "page_id", "left").where(is_html() | F.col("h2_1").isNotNull()).withColumn("h2_1", F.coalesce("h2_1", F.lit("")))
    return d.withColumns({"h2_1_length": F.length("h2_1"), "occurrences": (F.col("h2_1") != "").cast("long")})


def _spread(d: DataFrame, rows: DataFrame, value: str, order: str, prefix: str) -> DataFrame:
    from .store import expand

    return d.join(expand(rows, "page_id", value, order, prefix), "page_id", "left")


def _inlink_shares(d: DataFrame, t: dict) -> DataFrame:
    total = d.agg(F.coalesce(F.sum("inlinks"), F.lit(0)).alias("_all"))
    return d.where(is_html()).crossJoin(F.broadcast(total)).withColumn("inlink_share", F.round(100.0 * F.coalesce("inlinks", F.lit(0)) / F.greatest("_all", F.lit(1)), 1)).drop("_all")  # one aggregated row


def _schema_types(d: DataFrame, t: dict) -> DataFrame:
    from .audit import prepare_schema

    rows = prepare_schema(t).groupBy("page_id").agg(F.array_sort(F.collect_set(F.nullif("schema_type", F.lit("")))).alias("_types"), F.count_if(~F.col("is_valid")).alias("sd_errors"), F.count_if(F.col("is_valid") & (F.col("schema_type") == "")).alias("sd_warnings"))
    d = d.join(rows, "page_id", "left").where(is_html() | F.col("_types").isNotNull())
    return d.withColumns({"sd_total_types": F.coalesce(F.size("_types"), F.lit(0)), "rich_result_features": F.coalesce(F.nullif(F.array_join("_types", ", "), F.lit("")), F.lit("—")), "sd_errors": F.coalesce("sd_errors", F.lit(0)), "sd_warnings": F.coalesce("sd_warnings", F.lit(0))}).drop("_types")


def _in_sitemap(d: DataFrame, t: dict) -> DataFrame:
    """Rows that a sitemap lists; all where no sitemap is known."""
    listed = t["fx_sitemap"].select(U.rstrip_slash(F.col("url")).alias("_k")).distinct().withColumn("_in", F.lit(True))
    some = t["fx_sitemap"].agg((F.count("*") > 0).alias("_some"))
    d = d.withColumn("_k", U.rstrip_slash(F.col("url"))).join(listed, "_k", "left").crossJoin(F.broadcast(some))  # one aggregated row
    return d.where("_in or not _some").drop("_k", "_in", "_some")


def _extracted(d: DataFrame, t: dict) -> DataFrame:
    """All rows with what the user's extraction rules found (a map in ``custom_extractions``) in one line."""
    found = F.col("custom_extractions") if "custom_extractions" in d.columns else F.create_map().cast("map<string,string>")
    lines = F.transform(F.filter(F.map_entries(found), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return d.withColumn("custom_extraction_summary", F.coalesce(F.nullif(F.array_join(lines, " | "), F.lit("")), F.lit("—")))


def _searched(d: DataFrame, t: dict) -> DataFrame:
    """All rows with the names of the searches that matched (``t['searches']``: page_id, search_name, matched, snippet)."""
    if "searches" not in t:
        return d.withColumns({"matched_rules": F.lit("No Matches"), "search_snippet": F.lit("—")})
    hits = t["searches"].groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("matched"), F.col("search_name")))), ", ").alias("matched_rules"), F.min(F.nullif("snippet", F.lit(""))).alias("search_snippet"))
    return d.join(hits, "page_id", "left").withColumns({"matched_rules": F.coalesce(F.nullif("matched_rules", F.lit("")), F.lit("No Matches")), "search_snippet": F.coalesce("search_snippet", F.lit("—"))})


def _violated(d: DataFrame, t: dict) -> DataFrame:
    if "violations" not in t:
        return d.where(is_html())
    n = t["violations"].groupBy("page_id").agg(F.count("*").alias("violations"))
    return d.join(n, "page_id", "left").where(is_html() | (F.col("violations") > 0))


def _html(d: DataFrame, t: dict) -> DataFrame:
    return d.where(is_html())


def _or_html(column: str):
    return lambda d, t: d.where(is_html() | filled(column)) if column in d.columns else d.where(is_html())


#: Tabs by key: what they keep and add, from the master dataset and the audit's tables. Any other key returns all rows.
TABS = {
    "all": lambda d, t: d,
    "internal": lambda d, t: _spread(d.where("url_type = 'Internal'"), t["fx_headings"], "text", "position", "heading") if "fx_headings" in t else d.where("url_type = 'Internal'"),
    "external": lambda d, t: d.where("url_type = 'External'"),
    "response_codes": lambda d, t: d,
    "page_titles": _shared("title"),
    "meta_description": _shared("meta_description"),
    "meta_keywords": lambda d, t: _shared("meta_keywords")(d if "meta_keywords" in d.columns else d.withColumn("meta_keywords", F.lit(None).cast("string")), t),
    "h1": lambda d, t: _shared("h1")(d, t).withColumn("h1_1_length", F.length(F.trim(F.coalesce("h1", F.lit(""))))),
    "h2": _first_headings,
    "content": _html,
    "images": lambda d, t: d.where(F.lower(F.coalesce("content_type", F.lit(""))).contains("image")),
    "canonicals": _shared("canonical"),
    "pagination": lambda d, t: d.join(t["fx_pagination"].select("page_id").distinct().withColumn("_tagged", F.lit(True)), "page_id", "left").where(is_html() | F.col("_tagged")).drop("_tagged"),
    "hreflang": lambda d, t: _spread(d.where(is_html()), t["fx_hreflang"], "target_url", "lang_code", "hreflang"),
    "javascript": _html,
    "links": _inlink_shares,
    "structured_data": _schema_types,
    "sitemaps": _in_sitemap,
    "pagespeed": _html,
    "mobile": _html,
    "accessibility": _violated,
    "amp": _or_html("amp_url"),
    "custom_extraction": _extracted,
    "custom_search": _searched,
    "orphans": lambda d, t: d.where("coalesce(unique_inlinks, 1) = 0"),
    "redirect_chains": lambda d, t: d.where((F.col("status_code").between(300, 399)) | filled("redirect_url") | (F.coalesce(F.size("redirect_chain"), F.lit(0)) > 0)),
}


def tab(enriched: DataFrame, name: str, t: dict[str, DataFrame] | None = None) -> DataFrame:
    return TABS.get((name or "").lower(), TABS["all"])(enriched, t or {})


def tab_counts(enriched: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """tab and n for every tab, in one pass: what a tab keeps is a flag of the row, and flags from other tables are joined once as page sets."""
    flag = lambda rows, name: rows.select("page_id").distinct().withColumn(name, F.lit(True))
    sets = {"_h2": t["fx_headings"].where("lower(tag) = 'h2'"), "_paged": t["fx_pagination"], "_data": t["fx_structured"]} | ({"_violated": t["violations"]} if "violations" in t else {})
    d = enriched
    for name, rows in sets.items():
        d = d.join(flag(rows, name), "page_id", "left")
    listed = t["fx_sitemap"].select(U.rstrip_slash(F.col("url")).alias("_k")).distinct().withColumn("_listed", F.lit(True))
    known = t["fx_sitemap"].agg((F.count("*") == 0).alias("_unlisted"))
    d = d.withColumn("_k", U.rstrip_slash(F.col("url"))).join(listed, "_k", "left").crossJoin(F.broadcast(known))  # one aggregated row
    or_html = lambda c: is_html() | filled(c) if c in enriched.columns else is_html()
    every, of = F.lit(True), {c: F.coalesce(c, F.lit(False)) for c in (*sets, "_listed")}
    keeps = dict.fromkeys(TABS, every) | dict.fromkeys(("content", "hreflang", "javascript", "links", "pagespeed", "mobile"), is_html())
    keeps |= {"internal": F.col("url_type") == "Internal", "external": F.col("url_type") == "External", "images": F.lower(F.coalesce("content_type", F.lit(""))).contains("image"), "sitemaps": of["_listed"] | F.col("_unlisted"), "orphans": F.coalesce("unique_inlinks", F.lit(1)) == 0}
    keeps |= {tab_: or_html(c) for tab_, c in (("page_titles", "title"), ("meta_description", "meta_description"), ("meta_keywords", "meta_keywords"), ("h1", "h1"), ("canonicals", "canonical"), ("amp", "amp_url"))}
    keeps |= {"h2": is_html() | of["_h2"], "pagination": is_html() | of["_paged"], "structured_data": is_html() | of["_data"], "accessibility": is_html() | of["_violated"] if "_violated" in of else is_html()}
    keeps["redirect_chains"] = F.col("status_code").between(300, 399) | filled("redirect_url") | (F.coalesce(F.size("redirect_chain"), F.lit(0)) > 0)
    counts = d.agg(*[F.count_if(F.coalesce(keep, F.lit(False))).alias(name) for name, keep in keeps.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("tab"), F.col(name).alias("n")) for name in keeps])).alias("c")).select("c.*")


def matches(pattern: str, columns: list[Column]) -> Column:
    """A search in any column: as an expression where the pattern is one, else as plain text, ignoring case."""
    if is_pattern(pattern):
        test = lambda c: c.rlike(f"(?i){pattern}")
    else:
        test = lambda c: F.lower(c).contains(pattern.lower())
    return U.any_of(F.coalesce(test(c.cast("string")), F.lit(False)) for c in columns)


def facets(df: DataFrame, status: str | None = None, indexable: str | None = None, page_type: str | None = None, depth: int | None = None, words: tuple[int | None, int | None] = (None, None), include: str | None = None, exclude: str | None = None, q: str | None = None, kind: str | None = None, issues: str | None = None) -> DataFrame:
    """Rows by status class, indexability, type, depth, word count and searches; every condition reaches the scan where it can."""
    if status:
        df = df.where(status_class(F.col("status_code")) == status)
    if indexable:
        df = df.where(F.col("indexability") == indexable)
    if page_type:
        df = df.where(F.col("page_type") == page_type)
    if kind:
        df = df.where(mime_kind(F.col("url"), F.col("content_type")) == kind)
    if issues in ("with_issues", "clean"):
        df = df.where((F.coalesce("issues_count", F.lit(0)) > 0) == (issues == "with_issues"))
    if depth is not None:
        df = df.where(F.col("crawl_depth") == depth)
    if words[0] is not None:
        df = df.where(F.col("word_count") >= words[0])
    if words[1] is not None:
        df = df.where(F.col("word_count") <= words[1])
    if include:
        df = df.where(matches(include, [F.col("url")]))
    if exclude:
        df = df.where(~matches(exclude, [F.col("url")]))
    if q:
        df = df.where(matches(q, [F.col(c) for c in ("url", "title", "h1") if c in df.columns]))
    return df


def mixed_order(column: str, descending: bool = False) -> list[Column]:
    """Nulls and dashes last, numbers before texts, texts ignoring case; all of it reversed when descending."""
    c = F.col(column).cast("string")
    empty = F.coalesce(c, F.lit("—")).isin("—", "")
    number = c.try_cast("double")
    keys = [empty, number.isNull(), number, F.lower(c)]
    return [k.desc() if descending else k.asc() for k in keys]


#: Named sorts; a name that isn't here is refused, so no expression of a caller reaches the plan.
SORTS = {
    "url": lambda: [F.asc("url")],
    "status": lambda: [F.asc("status_code"), F.asc("url")],
    "depth": lambda: [F.asc_nulls_last("crawl_depth"), F.asc("url")],
    "words": lambda: [F.desc("word_count"), F.asc("url")],
    "slowest": lambda: [F.desc("response_time_ms"), F.asc("url")],
    "largest": lambda: [F.desc("html_size"), F.asc("url")],
    "size": lambda: [F.desc("html_size"), F.asc("url")],
    "response_time": lambda: [F.desc("response_time_ms"), F.asc("url")],
    "issues": lambda: [F.desc("issues_count"), F.asc("url")],
    "indexability": lambda: [F.asc("indexability"), F.asc("url")],
    "page_type": lambda: [F.asc("page_type"), F.asc("url")],
    "inlinks": lambda: [F.desc("inlinks"), F.asc("url")],
    "outlinks": lambda: [F.desc("outlinks"), F.asc("url")],
    "title": lambda: [*mixed_order("title"), F.asc("url")],
    "errors": lambda: [F.when(F.col("status_code") >= 500, 0).when(F.col("status_code") >= 400, 1).when(F.col("status_code") >= 300, 2).otherwise(3), F.asc("url")],
}


def page_of(df: DataFrame, sort: str = "url", page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of rows with their number: sort, offset and limit, which Spark plans as a top-k."""
    if sort not in SORTS:
        raise ValueError(f"sort {sort!r} is not one of {sorted(SORTS)}")
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    first = (max(1, page) - 1) * size
    order = SORTS[sort]()
    return df.orderBy(*order).offset(first).limit(size).withColumn("row_index", F.row_number().over(Window.partitionBy().orderBy(*order)) + first)


#: Columns of the table's presets; ``all`` keeps every column.
PRESETS = {
    "all": None,
    "seo_basics": ("url", "status_code", "status", "indexability", "title", "meta_description", "h1", "canonical"),
    "technical": ("url", "status_code", "canonical_status", "canonical", "indexability_status", "robots_directive", "response_time_ms", "content_type"),
    "link_equity": ("url", "internal_pagerank", "inlinks", "unique_inlinks", "outlinks", "unique_outlinks", "crawl_depth"),
    "content": ("url", "word_count", "sentence_count", "avg_words_per_sentence", "title_length", "meta_description_length"),
}


def preset(df: DataFrame, name: str) -> DataFrame:
    """The preset's columns that the rows have, in its order; an unknown name keeps all."""
    columns = PRESETS.get(name)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


#: What status codes mean.
PHRASES = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}


def status_text(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair]), code), F.lit("Unknown"))


def lengths(df: DataFrame) -> DataFrame:
    """Text lengths, pixel widths, status text and words in a sentence beside the master columns."""
    from ..functions import text as X

    n = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    out = {"title_length": n("title"), "meta_description_length": n("meta_description"), "h1_length": n("h1"), "title_pixels": X.pixel_width(F.col("title")), "meta_description_pixels": X.pixel_width(F.col("meta_description"), 14), "status": status_text(F.col("status_code"))}
    if "sentence_count" in df.columns:
        out["avg_words_per_sentence"] = F.when(F.col("sentence_count") > 0, F.round(F.col("word_count") / F.col("sentence_count"), 1)).otherwise(0.0)
    return df.withColumns(out)


def link_score(df: DataFrame) -> DataFrame:
    """Out of 100 from the page's rank where there is one, else from the share of pages that link to it."""
    n = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("_pages"))
    rank = F.coalesce("internal_pagerank", F.lit(0.0))
    score = F.when(rank > 0, F.least(rank * 100, F.lit(100.0))).otherwise(F.least(100.0 * F.coalesce("unique_inlinks", F.lit(0)) / F.col("_pages"), F.lit(100.0)))
    return df.crossJoin(F.broadcast(n)).withColumn("link_score", F.round(score, 2)).drop("_pages")  # one aggregated row


def result_preview(df: DataFrame) -> DataFrame:
    """url, title and description as a result page shows them."""
    return df.select("url", F.coalesce(F.nullif("title", F.lit("")), F.lit("No title set")).alias("title"), F.coalesce(F.nullif("meta_description", F.lit("")), F.lit("No meta description set for this webpage.")).alias("description"))


def workspace_tree(enriched: DataFrame) -> DataFrame:
    """The summary's nodes with their rows and share: one aggregate, exploded."""
    d = enriched.withColumn("_kind", mime_kind(F.col("url"), F.col("content_type")))
    inside, n = F.col("url_type") == "Internal", F.count_if
    good = F.col("indexability") == "Indexable"
    kinds = ("html", "javascript", "css", "images", "pdf", "other")
    a = d.agg(F.count("*").alias("encountered"), n(F.col("page_id").isNotNull()).alias("crawled"), n(inside).alias("internal"), n(~inside).alias("external"), n(inside & F.coalesce(good, F.lit(False))).alias("internal_indexable"), n(inside & ~F.coalesce(good, F.lit(False))).alias("internal_non_indexable"), *[n(inside & (F.col("_kind") == k)).alias(f"internal_{k}") for k in kinds])
    part = lambda name, whole: F.struct(F.lit(name).alias("node"), F.col(name).alias("n"), F.round(100.0 * F.col(name) / F.greatest(whole, F.lit(1)), 1).alias("pct"))
    rows = [part(x, "encountered") for x in ("encountered", "crawled", "internal", "external")] + [part(x, "internal") for x in ("internal_indexable", "internal_non_indexable", *[f"internal_{k}" for k in kinds])]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sitemap_rows(enriched: DataFrame) -> DataFrame:
    """URL and priority of what belongs in a sitemap: 200, indexable, HTML, its own canonical."""
    own = F.trim(F.coalesce("canonical", F.lit("")))
    depth = F.coalesce("crawl_depth", F.lit(0))
    priority = F.when(depth == 0, 1.0).when(depth == 1, 0.8).when(depth == 2, 0.6).otherwise(0.4)
    keep = (F.col("status_code") == 200) & F.coalesce("is_indexable", F.lit(False)) & F.lower("content_type").contains("html") & ((own == "") | (U.rstrip_slash(own) == U.rstrip_slash(F.col("url"))))
    return enriched.where(keep).select("url", priority.alias("priority"))


def crawl_graph(pages: DataFrame, links: DataFrame, most_nodes: int | None = 100, most_edges: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """The seed and the pages with most inlinks, and the edges between them: a report's limits, in a defined order; without a limit all of them."""
    into = links.where("is_internal").groupBy(F.col("target_url").alias("url")).agg(F.count("*").alias("inlinks"))
    nodes = pages.join(into, "url", "left").select("page_id", "url", "crawl_depth", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))
    if most_nodes is not None:
        nodes = nodes.orderBy((F.coalesce("crawl_depth", F.lit(99)) != 0), F.desc("inlinks"), F.asc_nulls_last("crawl_depth"), "url").limit(most_nodes)
    ends = nodes.select("url")
    edges = links.where("is_internal").select("source_url", "target_url").distinct().join(ends.withColumnRenamed("url", "source_url"), "source_url", "left_semi").join(ends.withColumnRenamed("url", "target_url"), "target_url", "left_semi")
    return nodes, edges if most_edges is None else edges.orderBy("source_url", "target_url").limit(most_edges)
