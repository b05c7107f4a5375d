"""Prepared relations for the rules: joins and aggregates that flags need, each input scanned once.

Inputs are the audit's silver tables (``schemas`` lists their columns). Child tables are aggregated by page
before they are joined; lookups by URL use one row for each URL (the largest page_id, as later captures replace earlier).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import urls as U
from .rules import GENERIC_ANCHORS


def py_or(*columns) -> F.Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def latest(pages: DataFrame) -> DataFrame:
    """One row for each URL."""
    return pages.groupBy("url").agg(F.max_by("status_code", "page_id").alias("status"), F.max_by(F.coalesce("is_indexable", F.lit(False)), "page_id").alias("indexable"), F.max("page_id").alias("id"), F.max_by("crawl_depth", "page_id").alias("depth"))


def chain_columns(df: DataFrame) -> DataFrame:
    """Length, loop, hosts, downgrade and mixture of a redirect chain of url and status structs."""
    df = df.withColumn("_urls", F.coalesce(F.transform("redirect_chain", lambda c: c["url"]), F.array().cast("array<string>"))).withColumn("_codes", F.coalesce(F.transform("redirect_chain", lambda c: c["status"]), F.array().cast("array<int>")))
    low = F.transform("_urls", lambda u: F.lower(U.rstrip_slash(u)))
    steps = F.sequence(F.lit(1), F.greatest(F.size("_urls") - 1, F.lit(1)))
    any_step = lambda f: (F.size("_urls") > 1) & F.exists(steps, f)
    at = lambda name, i: F.try_element_at(F.col(name), i)
    temporary = F.array_position(F.transform("_codes", lambda c: c.isin(302, 303, 307)), True)
    permanent = F.exists("_codes", lambda c: c.isin(301, 308))
    after = F.exists(F.slice("_codes", F.greatest(temporary.cast("int"), F.lit(1)), F.greatest(F.size("_codes"), F.lit(1))), lambda c: c.isin(301, 308))
    return df.withColumns(
        {
            "chain_length": F.size("_urls"),
            "chain_repeats": F.size(F.array_distinct(low)) < F.size(low),
            "chain_text": F.array_join(F.transform("redirect_chain", lambda c: F.concat(c["url"], F.lit(" ("), c["status"].cast("string"), F.lit(")"))), " -> "),
            "chain_first_host": F.coalesce(U.authority(F.try_element_at("_urls", F.lit(1))), F.lit("")),
            "chain_final_host": F.coalesce(U.authority(F.try_element_at("_urls", F.lit(-1))), F.lit("")),
            "chain_downgrade": any_step(lambda i: at("_urls", i).startswith("https://") & at("_urls", i + 1).startswith("http://")),
            "chain_mixed": permanent & (temporary > 0) & after,
            "loop_exceeded": (F.coalesce("status_code", F.lit(0)) == 310) | F.coalesce(F.col("redirect_type").contains("Loop"), F.lit(False)),
        }
    ).drop("_urls", "_codes")


def header(name: str) -> F.Column:
    """A header's value, empty if the response had none, null if no headers were captured: a rule needs to know the difference."""
    return F.when(F.col("headers").isNotNull(), F.coalesce(F.try_element_at(F.transform_keys("headers", lambda k, v: F.lower(k)), F.lit(name)), F.lit("")))


def group_size(df: DataFrame, column: str, out: str) -> DataFrame:
    """How many pages share a non-empty value: counted with partial aggregation and joined back."""
    sizes = df.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias(out))
    return df.join(sizes, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def heading_stats(headings: DataFrame) -> DataFrame:
    """Counts, and whether a heading skips a level: the level before the first one is 0."""
    level = F.regexp_extract("tag", "([1-6])", 1).cast("int")
    before = F.lag("_l", 1, 0).over(Window.partitionBy("page_id").orderBy("position"))
    steps = headings.withColumn("_l", level).withColumn("_before", before)
    return steps.groupBy("page_id").agg(F.count("*").alias("heading_count"), F.count_if(F.col("_l") == 1).alias("h1_count"), F.max(F.col("_l") > F.col("_before") + 1).alias("heading_skip"))


def link_stats(links: DataFrame) -> DataFrame:
    anchor = F.lower(F.trim(F.coalesce("anchor_text", F.lit(""))))
    return links.where("is_internal").groupBy(F.col("source_page_id").alias("page_id")).agg(F.count("*").alias("internal_outlinks"), F.count_if(anchor == "").alias("empty_anchors"), F.count_if(anchor.isin(*GENERIC_ANCHORS)).alias("generic_anchors"), F.countDistinct("target_url").alias("unique_outlinks"))


def inlink_stats(links: DataFrame) -> DataFrame:
    return links.where("is_internal").groupBy(F.col("target_url").alias("url")).agg(F.count("*").alias("inlinks"), F.countDistinct("source_page_id").alias("unique_inlinks"))


def prepare_pages(t: dict[str, DataFrame]) -> DataFrame:
    pages, links = t["fx_pages"], t["fx_links"]
    key = lambda c: U.rstrip_slash(F.col(c))
    linked = links.where("is_internal").select(key("target_url").alias("_k")).distinct().withColumn("has_inlinks", F.lit(True))
    mapped = t["fx_sitemap"].select(key("url").alias("_k")).distinct().withColumn("in_sitemap", F.lit(True))
    known = latest(pages).select(F.col("url").alias("canonical"), F.col("status").alias("canonical_status"), F.col("indexable").alias("canonical_indexable"), F.lit(True).alias("canonical_found"))
    resources = t["fx_resources"].groupBy("page_id").agg(F.count("*").alias("resource_count"), F.count_if("is_render_blocking").alias("blocking_count"), F.count_if(F.col("url").startswith("http://")).alias("insecure_assets"))
    schema = t["fx_structured"].groupBy("page_id").agg(F.count("*").alias("schema_blocks"))
    d = pages.withColumn("_k", key("url"))
    d = d.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "meta_description", "h1", "canonical", "viewport", "lang", "og_title", "og_description", "og_image", "og_type", "twitter_card", "content_hash", "raw_hash", "rendered_hash")})
    d = d.withColumns(
        {
            "indexable": F.coalesce("is_indexable", F.lit(False)),
            "is_html": F.lower(F.coalesce("content_type", F.lit(""))).contains("html"),
            "url_scheme": U.scheme(F.col("url")),
            "url_path": U.path(F.col("url")),
            "url_path_decoded": F.coalesce(F.try_url_decode(F.replace(U.path(F.col("url")), F.lit("+"), F.lit("%2B"))), U.path(F.col("url"))),
            "param_count": F.size(F.array_distinct(F.transform(U.params(F.col("url")), lambda p: p["k"]))),
            "folder_depth": U.folder_depth(F.col("url")),
            "hsts": header("strict-transport-security"),
            "csp": F.lower(header("content-security-policy")),
            "xcto": header("x-content-type-options"),
            "xfo": header("x-frame-options"),
            "referrer": header("referrer-policy"),
        }
    )
    d = d.withColumn("hsts_max_age", F.coalesce(F.regexp_extract(F.lower("hsts"), r"max-age=(\d+)", 1).try_cast("bigint"), F.lit(0)))
    d = chain_columns(d)
    d = d.join(linked, "_k", "left").join(mapped, "_k", "left").join(known, "canonical", "left")
    d = d.join(heading_stats(t["fx_headings"]), "page_id", "left").join(link_stats(links), "page_id", "left").join(inlink_stats(links), "url", "left").join(resources, "page_id", "left").join(schema, "page_id", "left")
    for column, out in (("title", "title_group"), ("meta_description", "meta_group"), ("h1", "h1_group"), ("content_hash", "content_group")):
        d = group_size(d, column, out)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("heading_count", "h1_count", "internal_outlinks", "empty_anchors", "generic_anchors", "inlinks", "unique_inlinks", "resource_count", "blocking_count", "insecure_assets", "schema_blocks")}
    false = {c: F.coalesce(c, F.lit(False)) for c in ("has_inlinks", "in_sitemap", "canonical_found", "heading_skip", "robots_blocked")}
    some = pages.agg(F.max(F.trim(F.coalesce("viewport", F.lit(""))) != "").alias("any_viewport"))
    return d.withColumns(zero | false).crossJoin(F.broadcast(some)).drop("_k")  # one aggregated row


def prepare_links(t: dict[str, DataFrame]) -> DataFrame:
    known = latest(t["fx_pages"]).select(F.col("url").alias("target_url"), F.col("status").alias("page_status"))
    probed = t["fx_status"].groupBy(F.col("url").alias("target_url")).agg(F.max("status_code").alias("probe_status"))
    links = t["fx_links"].join(known, "target_url", "left").join(probed, "target_url", "left")
    return links.select(F.col("source_page_id").alias("page_id"), F.col("source_url").alias("url"), "target_url", "anchor_text", "is_internal", "nofollow", "rel", F.coalesce("page_status", "probe_status", F.lit(200)).alias("target_status"), F.coalesce("target_blocked", F.lit(False)).alias("target_blocked"))


def prepare_images(t: dict[str, DataFrame]) -> DataFrame:
    name = F.regexp_extract(F.split("src", r"\?")[0], r"([^/]*)$", 1)
    return t["fx_images"].withColumn("file_stem", F.regexp_replace(name, r"\.[^.]*$", ""))


def prepare_hreflang(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows with target status and return tag, and one row for each source page."""
    tags = t["fx_hreflang"]
    known = latest(t["fx_pages"]).select(F.col("url").alias("target_url"), F.col("status").alias("target_status"))
    back = tags.select(F.col("target_url").alias("url"), F.col("url").alias("target_url")).distinct().withColumn("has_return", F.lit(True))
    rows = tags.join(known, "target_url", "left").join(back, ["url", "target_url"], "left").withColumn("has_return", F.coalesce("has_return", F.lit(False)))
    sources = tags.groupBy("page_id", "url").agg(F.max(F.col("url") == F.col("target_url")).alias("has_self"), F.count("*").alias("tag_count"), F.max(F.lower("lang_code") == "x-default").alias("has_default"))
    return rows, sources


def prepare_pagination(t: dict[str, DataFrame]) -> DataFrame:
    key = lambda c: U.rstrip_slash(F.col(c) if isinstance(c, str) else c)
    pages = t["fx_pages"].groupBy(key("url").alias("_k")).agg(F.max_by("status_code", "page_id").alias("status"), F.max_by(F.coalesce("is_indexable", F.lit(False)), "page_id").alias("indexable"), F.max_by(F.coalesce("canonical", F.lit("")), "page_id").alias("canonical"))
    tags = t["fx_pagination"].withColumns({"_s": key("url"), "_t": key("target_url")})
    sides = tags.groupBy("_s").agg(F.max(F.when(F.col("rel_type") == "next", F.col("_t"))).alias("next_url"), F.max(F.when(F.col("rel_type") == "prev", F.col("_t"))).alias("prev_url"))
    first = F.row_number().over(Window.partitionBy("_s").orderBy("tag_id")) == 1
    d = tags.withColumn("first_tag", first).join(sides, "_s", "left")
    d = d.join(pages.select(F.col("_k").alias("_t"), F.col("status").alias("target_status")), "_t", "left").join(pages.select(F.col("_k").alias("_s"), "indexable", "canonical"), "_s", "left")
    return d.select("page_id", "url", "rel_type", "target_url", "first_tag", "target_status", F.coalesce("indexable", F.lit(True)).alias("indexable"), (F.col("_s") == F.col("_t")).alias("is_self"), F.coalesce(F.col("next_url") == F.col("prev_url"), F.lit(False)).alias("next_is_prev"), F.coalesce((key("canonical") == F.col("prev_url")) & (key("canonical") != F.col("_s")), F.lit(False)).alias("canonical_to_prev"))


def prepare_sitemap(t: dict[str, DataFrame]) -> DataFrame:
    """Entries with their page: an exact URL is preferred over one that differs by a trailing slash."""
    pages = latest(t["fx_pages"]).join(inlink_stats(t["fx_links"]).select("url", "inlinks"), "url", "left")
    row = F.struct("status", "indexable", "depth", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), "id")
    exact = pages.select("url", row.alias("_exact"))
    loose = pages.groupBy(U.rstrip_slash(F.col("url")).alias("_k")).agg(F.max_by(row, "id").alias("_loose"))
    d = t["fx_sitemap"].withColumn("_k", U.rstrip_slash(F.col("url"))).join(exact, "url", "left").join(loose, "_k", "left").withColumn("_p", F.coalesce("_exact", "_loose"))
    return d.select(F.col("_p.id").alias("page_id"), "url", "sitemap_url", F.col("_p").isNotNull().alias("found"), F.col("_p.status").alias("target_status"), F.coalesce("_p.indexable", F.lit(False)).alias("indexable"), F.coalesce("_p.inlinks", F.lit(0)).alias("inlinks"), F.col("_p.depth").alias("crawl_depth"))


def missing_from_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages that answer 200 and may be indexed but are in no sitemap, whatever slash their address ends with."""
    key = U.rstrip_slash(F.col("url")).alias("_k")
    good = pages.where("status_code = 200 and coalesce(is_indexable, false)").withColumn("_k", U.rstrip_slash(F.col("url")))
    return good.join(sitemap.select(key).distinct(), "_k", "left_anti").drop("_k")


def prepare_schema(t: dict[str, DataFrame]) -> DataFrame:
    """Flags of the first object of each JSON-LD block."""
    j = F.try_parse_json("data_json")
    has = lambda k: F.coalesce(F.try_variant_get(F.col("_v"), f"$['{k}']", "string").isNotNull() | F.try_variant_get(F.col("_v"), f"$[0]['{k}']", "string").isNotNull(), F.lit(False))
    text = lambda k: F.coalesce(F.try_variant_get(F.col("_v"), f"$['{k}']", "string"), F.try_variant_get(F.col("_v"), f"$[0]['{k}']", "string"), F.lit(""))
    d = t["fx_structured"].withColumn("_v", j)
    return d.select("page_id", "url", F.col("_v").isNotNull().alias("is_valid"), has("@context").alias("has_context"), text("@type").alias("schema_type"), has("headline").alias("has_headline"), has("datePublished").alias("has_date"), has("name").alias("has_name"), has("offers").alias("has_offers"), has("itemListElement").alias("has_items"))


def prepare_resources(t: dict[str, DataFrame]) -> DataFrame:
    blocking = t["fx_resources"].groupBy("page_id").agg(F.count_if("is_render_blocking").alias("blocking_count"))
    return t["fx_resources"].join(blocking, "page_id")
