"""Scalars, store operations and aggregates over the given tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as P, text as X
from ..operators import aggregates, audit, store
from ..sources import html as H, text_files as S
from .core_queries import _FEATURES, page_features, table
from .fixtures import tables, values_sql
from .registry import register

_SYLLABLES = "list_sum(list_transform(ws, lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[aeiouy]+')) - CASE WHEN regexp_replace(lower(w), '[^a-z]', '', 'g') LIKE '%e' AND regexp_replace(lower(w), '[^a-z]', '', 'g') NOT LIKE '%le' THEN 1 WHEN regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'ed$') AND NOT regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[td]ed$') THEN 1 ELSE 0 END) END))"


@register("estimated_syllables", f"WITH {_FEATURES}, s AS (SELECT page_id, html_size // 10 AS n, list_filter(string_split_regex(title || ' ' || h1, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM f) SELECT page_id, CAST(floor(n * CASE WHEN len(ws) > 0 THEN {_SYLLABLES} / len(ws) ELSE 1.5 END) AS BIGINT) AS syllables FROM s")
def estimated_syllables(spark, sf_dir):
    d = page_features(table(spark, sf_dir, "pages"))
    return d.select("page_id", X.estimate_syllables(F.floor(F.col("html_size") / 10), F.col("title"), F.col("h1")).alias("syllables"))


@register("durations", "WITH t AS (SELECT event_id, ts, greatest(1, event_id * 37 % 9000) AS sec FROM events) SELECT event_id, CASE WHEN sec >= 3600 THEN sec // 3600 || 'h ' || sec % 3600 // 60 || 'm ' || sec % 60 || 's' WHEN sec >= 60 THEN sec // 60 || 'm ' || sec % 60 || 's' ELSE sec || 's' END AS took, strftime(ts, '%b %d, %Y %H:%M:%S') AS at FROM t")
def durations(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    end = F.timestamp_add("SECOND", (F.col("event_id") * 37 % 9000).cast("int"), t)
    return table(spark, sf_dir, "events").select("event_id", P.duration_text(t, end).alias("took"), P.date_text(t).alias("at"))


@register("delivery_networks", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Cloudflare' WHEN 1 THEN 'Fastly' WHEN 2 THEN 'Amazon CloudFront' WHEN 3 THEN 'Akamai,BunnyCDN' ELSE 'Direct Origin (No CDN detected)' END AS networks, CASE page_id % 5 WHEN 0 THEN 'Cloudflare' WHEN 3 THEN 'Nginx' ELSE 'Standard Web Server' END AS server FROM pages")
def delivery_networks(spark, sf_dir):
    k = F.col("page_id") % 5
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    headers = F.when(k == 0, pair("Server", "cloudflare")).when(k == 1, pair("Via", "1.1 Fastly")).when(k == 2, pair("X-Amz-Cf-Id", "z")).when(k == 3, F.create_map(F.lit("Server"), F.lit("nginx"), F.lit("X-Akamai-Id"), F.lit("1")))
    html = F.when(k == 3, "<img src=//a.b-cdn.net/x>").otherwise("<p>")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(P.networks(headers, html), ",").alias("networks"), P.server(F.try_element_at(headers, F.lit("Server"))).alias("server"))


@register("console_lines", "SELECT user_id, count(*) FILTER (event_type = 'click') AS js_errors, count(*) FILTER (event_type = 'view') AS js_warnings, count(*) FILTER (event_type NOT IN ('click', 'view')) AS js_info, 0 AS js_debug FROM events GROUP BY user_id")
def console_lines(spark, sf_dir):
    level = F.when(F.col("event_type") == "click", "Error").when(F.col("event_type") == "view", "warn").otherwise("info")
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(level).alias("levels"))
    return d.select("user_id", *P.console_counts(F.col("levels")))


@register("page_flags", r"SELECT page_id, html LIKE '%@media%' OR regexp_matches(html, '(?i)<link[^>]*media=') AS media_query, (length(trim(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g'))) < 500 AND len(regexp_extract_all(html, '(?i)<script[^>]*src=')) > 3) OR regexp_matches(html, '(?i) id=.?(root|app|__next|vue-app)[^a-z]') AS needs_scripts FROM pages")
def page_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.has_media_query(F.col("html")).alias("media_query"), P.needs_scripts(F.col("html")).alias("needs_scripts"))


@register("script_shares", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 0 THEN round(100.0 * greatest(l_quantity - l_linenumber * 5, 0) / l_quantity, 1) ELSE 0 END AS DOUBLE) AS pct FROM lineitem")
def script_shares(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.script_share(F.col("l_linenumber") * 5, F.col("l_quantity")).cast("double").alias("pct"))


_HREFS = "regexp_extract_all(html, '(?is)<a href=\"([^\"]*)\"', 1)"


@register(
    "xpath_extract",
    rf"""SELECT page_id, trim(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) AS heading, array_to_string(list_slice(list_transform({_HREFS}, lambda h: replace(h, '&amp;', '&')), 1, 5), ' | ') AS links, coalesce(replace({_HREFS}[2], '&amp;', '&'), '') AS second,
array_to_string(list_slice(list_filter({_HREFS}, lambda h: h LIKE '%the%'), 1, 5), ' | ') AS of_the, CAST(len(regexp_extract_all(html, '(?i)<a[ >]')) AS VARCHAR) AS anchors, coalesce(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, CASE WHEN regexp_matches(html, '(?i)<article[ >]') THEN 'h1' ELSE '' END AS inside, '' AS none, '' AS bad FROM pages""",
)
def xpath_extract(spark, sf_dir):
    """XPath over the pages' markup as it is, unclosed elements included."""
    rules = {
        "heading": "//h1", "links": "//a/@href", "second": "(//nav//li/a)[2]/@href", "of_the": "//a[contains(@href, 'the')]/@href", "anchors": "count(//a)", "lang": "/html/@lang", "inside": "name(//article//*[self::h1][1])",
        "none": "//h1[false()] | //nosuch", "bad": "//a[",
    }
    out = H.custom_extract(table(spark, sf_dir, "pages"), [{"name": n, "type": "xpath", "expression": e} for n, e in rules.items()])
    return out.select("page_id", *[F.trim(n).alias(n) for n in rules])


@register("css_extract", r"SELECT page_id, trim(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) AS heading, array_to_string(list_slice(regexp_extract_all(html, '(?is)<li><a href=\"([^\"]*)\"', 1), 1, 5), ' | ') AS links, '' AS none FROM pages")
def css_extract(spark, sf_dir):
    rules = [{"name": "heading", "expression": "article > h1"}, {"name": "links", "expression": "nav li a[href^='/']", "extract_type": "attribute", "attribute_name": "href"}, {"name": "none", "expression": "div.missing, #nothing"}]
    return H.custom_extract(table(spark, sf_dir, "pages"), rules).select("page_id", F.regexp_replace("heading", " +$", "").alias("heading"), "links", "none")


@register("listed_extract", r"SELECT page_id, array_to_string(list_slice(regexp_extract_all(html, '(?is)<a href=\"([^\"]*)\"', 1), 1, 5), ', ') AS links, '' AS bad FROM pages")
def listed_extract(spark, sf_dir):
    """The older form: joined by commas; an expression that is none finds nothing."""
    rules = [{"name": "links", "type": "regex", "expression": '<a href="([^"]*)"'}, {"name": "bad", "type": "regex", "expression": "(?P<n>x)("}]
    return H.custom_extract(table(spark, sf_dir, "pages"), rules, between=", ").select("page_id", "links", "bad")


@register("audit_list", "SELECT o_orderkey AS audit_id, o_totalprice AS started_at FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def audit_list(spark, sf_dir):
    return store.list_audits(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_totalprice").alias("started_at")))


@register("audit_upsert", "SELECT c_custkey AS audit_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) AND c_nationkey % 2 = 1 THEN 'new' ELSE 'old ' || c_custkey END AS config, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'completed' ELSE 'running' END AS status FROM customer UNION ALL SELECT -1 - s_suppkey, 'new', 'completed' FROM supplier")
def audit_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("audit_id"), F.concat(F.lit("old "), F.col("c_custkey").cast("string")).alias("config"), F.lit("running").alias("status"))
    buyers = c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    new = buyers.select(F.col("c_custkey").alias("audit_id"), F.when(F.col("c_nationkey") % 2 == 1, "new").otherwise("{}").alias("config"), F.lit("completed").alias("status"))
    new = new.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("audit_id"), F.lit("new").alias("config"), F.lit("completed").alias("status")))
    return store.upsert_audit(old, new)


@register("frontier_counts", "SELECT 'F' AS status, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'O', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'all', count(*) FROM orders")
def frontier_counts(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    one = lambda s: store.count_rows(d, status=None if s == "all" else s).select(F.lit(s).alias("status"), "n")
    return one("F").unionByName(one("O")).unionByName(one("all"))


@register("frontier_claim", "WITH b AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey % 7, o_orderkey LIMIT 25) SELECT o_orderkey AS url, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM b) THEN 'processing' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status FROM orders")
def frontier_claim(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("depth"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return store.claim(f, 25)[1].select("url", "status")


@register("duplicate_titles", f"WITH {_FEATURES}, g AS (SELECT title AS value, page_id, count(*) OVER (PARTITION BY title) AS pages, row_number() OVER (PARTITION BY title ORDER BY page_id) AS n FROM f WHERE title <> '') SELECT value, pages, string_agg(CAST(page_id AS VARCHAR), ', ' ORDER BY CAST(page_id AS VARCHAR)) AS members FROM g WHERE pages > 1 AND n <= 100 GROUP BY value, pages")
def duplicate_titles(spark, sf_dir):
    return aggregates.duplicate_groups(page_features(table(spark, sf_dir, "pages")), "title", "page_id")


@register("segment_urls", "WITH s AS (SELECT url, '/' || coalesce(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], '') AS segment FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY url) AS k, count(*) OVER (PARTITION BY segment) AS n FROM s) SELECT segment, n, round(100.0 * n / (SELECT count(*) FROM pages), 1) AS pct, string_agg(url, ', ' ORDER BY url) AS urls FROM r WHERE k <= 100 GROUP BY segment, n")
def segment_urls(spark, sf_dir):
    return aggregates.segment_urls(table(spark, sf_dir, "pages"))


_SHARE = "round(100.0 * count(*) FILTER ({c}) / greatest(count(*), 1), 1)::DOUBLE AS {n}"
_HAS = "trim(coalesce({c}, '')) <> ''"


@register("social_coverage", f"WITH {values_sql('fx_pages')} SELECT count(*) AS pages, {_SHARE.format(c=' AND '.join(_HAS.format(c=c) for c in ('og_title', 'og_description', 'og_image')), n='complete_og_pct')}, {', '.join(_SHARE.format(c=_HAS.format(c=c), n=n) for c, n in (('og_title', 'og_title_pct'), ('og_image', 'og_image_pct'), ('og_description', 'og_desc_pct'), ('twitter_card', 'twitter_card_pct')))} FROM fx_pages WHERE lower(content_type) LIKE '%html%'")
def social_coverage(spark, sf_dir):
    return aggregates.social_coverage(tables(spark, sf_dir)["fx_pages"])


@register("sitemap_counts", "SELECT regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS sitemap_url, count(*) AS entries, count(DISTINCT url) AS urls, count(*) > 50000 AS too_many FROM pages GROUP BY 1")
def sitemap_counts(spark, sf_dir):
    return aggregates.sitemap_counts(table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1).alias("sitemap_url")))


@register("schema_types", f"WITH {values_sql('fx_structured')}, t AS (SELECT page_id, json_extract_string(CASE WHEN json_valid(data_json) THEN CASE WHEN data_json LIKE '[%' THEN json_extract(data_json, '$[0]') ELSE CAST(data_json AS JSON) END END, '$.\"@type\"') AS schema_type FROM fx_structured) SELECT schema_type, count(*) AS blocks, count(DISTINCT page_id) AS pages FROM t WHERE schema_type <> '' GROUP BY 1")
def schema_types(spark, sf_dir):
    return aggregates.schema_types(audit.prepare_schema(tables(spark, sf_dir)))


@register("crawl_stats", "SELECT count(*) AS pages, greatest(1, date_diff('second', min(ts), max(ts))) AS seconds, round(avg(nullif(value, 0)), 1) AS avg_ms, round(count(*) / greatest(1, date_diff('second', min(ts), max(ts))), 2) AS pages_per_second FROM events")
def crawl_stats(spark, sf_dir):
    return aggregates.crawl_stats(table(spark, sf_dir, "events").select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("crawled_at"), F.col("value").alias("response_time_ms")))


@register("objects_by_kind", f"WITH {values_sql('fx_resources', 'fx_images')}, o AS (SELECT CASE WHEN resource_type = 'js' THEN 'javascript' ELSE 'css' END AS kind, NULL AS size FROM fx_resources UNION ALL SELECT 'image', file_size FROM fx_images) SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, round(100.0 * count(*) / (SELECT count(*) FROM o), 1)::DOUBLE AS pct FROM o GROUP BY kind")
def objects_by_kind(spark, sf_dir):
    t = tables(spark, sf_dir)
    return aggregates.objects_by_kind(t["fx_resources"], t["fx_images"])


@register("unsafe_links", r"SELECT page_id, h AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages)")
def unsafe_links(spark, sf_dir):
    """Every link of the pages, opened in a new window."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<a href"), F.lit("<a target=_blank href")))
    return H.unsafe_links(H.parse_pages(pages, columns=("links",))).select("page_id", "href")


@register("mixed_content", "SELECT page_id, 'http://cdn.test/' || page_id || '.png' AS src, 'img' AS kind FROM pages WHERE url LIKE 'https://%' UNION ALL SELECT page_id, 'http://cdn.test/s.css', 'link' FROM pages WHERE url LIKE 'https://%'")
def mixed_content(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<link rel=stylesheet href=http://cdn.test/s.css><script src=https://cdn.test/a.js></script><img src='http://cdn.test/"), F.col("page_id").cast("string"), F.lit(".png'>"), "html"))
    return H.mixed_content(H.parse_pages(pages, columns=("images", "iframes", "resources"))).select("page_id", "src", "kind")


@register("index_entries", "SELECT s_suppkey AS url, 'n' || s_nationkey AS sitemap_url FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def index_entries(spark, sf_dir):
    """Three of five regional indexes below a root; entries of the other regions stay out."""
    n = table(spark, sf_dir, "nation")
    index = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sitemap_url"))
    root = spark.createDataFrame([("root", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "root")], "parent string, sitemap_url string")
    listed = root.unionByName(index.where("parent in ('r0', 'r1', 'r2')"))
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("url"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("sitemap_url"))
    return S.entries_of_index(listed, entries)


@register("first_values", "SELECT conv_id, arg_min(role, turn) AS role FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def first_values(spark, sf_dir):
    return store.first_by(table(spark, sf_dir, "conversations").where("role is not null"), "conv_id", "role", "turn")


_PATHS = "s AS (SELECT list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)"


@register("site_tree", f"WITH {_PATHS}, x AS (SELECT '/' AS prefix FROM s UNION ALL SELECT '/' || array_to_string(list_slice(p, 1, i), '/') FROM (SELECT p, unnest(range(1, 1 + len(p))) AS i FROM s)) SELECT prefix, count(*) AS pages, CAST(len(list_filter(string_split(prefix, '/'), lambda x: x <> '')) AS INTEGER) AS level FROM x GROUP BY prefix")
def site_tree(spark, sf_dir):
    """All levels of all paths."""
    return aggregates.directory_tree(table(spark, sf_dir, "pages"), levels=None)


@register("status_tree", f"WITH {_PATHS.replace('AS p FROM pages', 'AS p, 200 + 100 * (page_id % 4) AS code FROM pages')}, x AS (SELECT '/' AS prefix, code FROM s UNION ALL SELECT '/' || array_to_string(list_slice(p, 1, i), '/'), code FROM (SELECT p, code, unnest(range(1, 1 + least(2, len(p)))) AS i FROM s)) SELECT prefix, count(*) AS pages, count(*) FILTER (code = 200) AS ok, count(*) FILTER (code BETWEEN 300 AND 399) AS redirects, count(*) FILTER (code >= 400) AS errors FROM x GROUP BY prefix")
def status_tree(spark, sf_dir):
    """The directory tree with how its pages answer."""
    return aggregates.status_tree(table(spark, sf_dir, "pages").withColumn("status_code", (200 + 100 * (F.col("page_id") % 4)).cast("int")), levels=2)


@register("missing_from_sitemap", "SELECT page_id, url FROM pages WHERE rtrim(url, '/') NOT IN (SELECT rtrim(url, '/') FROM pages WHERE url LIKE 'https%')")
def missing_from_sitemap(spark, sf_dir):
    """Good pages that no sitemap lists: here one that lists the secure ones."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit(200).alias("status_code"), F.lit(True).alias("is_indexable"))
    return audit.missing_from_sitemap(pages, pages.where("startswith(url, 'https')").select("url")).select("page_id", "url")


@register("errors_first", "SELECT event_id, CAST(row_number() OVER (ORDER BY g, url) AS INTEGER) AS row_index FROM (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 9, '0') AS url, CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS g FROM events) ORDER BY g, url LIMIT 40")
def errors_first(spark, sf_dir):
    from ..operators import views

    k = F.col("event_id")
    d = table(spark, sf_dir, "events").select(k, F.lpad(k.cast("string"), 9, "0").alias("url"), (200 + 100 * (k % 4)).cast("int").alias("status_code"))
    return views.page_of(d, "errors", page_size=40).select("event_id", "row_index")


@register("mixed_sort", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY n IS NULL, n, lower(t), u) AS INTEGER) AS row_index FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 90 AS VARCHAR) ELSE p_name END AS t, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 90 END AS n, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS u FROM part) ORDER BY n IS NULL, n, lower(t), u LIMIT 30 OFFSET 30")
def mixed_sort(spark, sf_dir):
    """Numbers before texts, texts ignoring case."""
    from ..operators import views

    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, (k % 90).cast("string")).otherwise(F.col("p_name")).alias("title"), F.lpad(k.cast("string"), 9, "0").alias("url"))
    return views.page_of(d, "title", page=2, page_size=30).select("p_partkey", "row_index")
