"""Queries over stores, reports, fields and exports, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as P, text as X, urls as U
from ..operators import audit, exports, report, rules, store, views
from ..sources import text_files as S
from .core_queries import table
from .fixtures import tables, values_sql
from .registry import register

_TECH = ", ".join(f"('{c}', '{n}', [{', '.join(chr(39) + s.replace(chr(39), chr(39) * 2) + chr(39) for s in strings)}])" for c, n, strings in P.PAGE_TECHNOLOGIES)
_NONE = ", ".join(f"('{c}', '{n}')" for c, n in P.NONE_FOUND.items())


@register(
    "technologies",
    f"""WITH t(category, name, strings) AS (VALUES {_TECH}), x AS (SELECT category, name, unnest(strings) AS s FROM t), d(category, name) AS (VALUES {_NONE}),
f AS (SELECT DISTINCT page_id, category, name FROM pages JOIN x ON contains(lower(html), s)) SELECT page_id, category, name FROM f UNION ALL SELECT page_id, category, name FROM pages CROSS JOIN d WHERE (page_id, category) NOT IN (SELECT (page_id, category) FROM f)""",
)
def technologies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(P.technologies(F.col("html"))).alias("t")).select("page_id", "t.*")


#: What the server set for a customer, by the customer's number modulo 7: headers, one without a value, a list of objects, nothing.
_COOKIES = ["'sid=' || {k} || '; Path=/; Secure; HttpOnly; SameSite=Lax'", "'a=b=' || {k} || '; domain=e.com; expires=Wed, 01 Jan 2031'", "'novalue'", "'x='", """'[{{"name": "k", "value": "' || {k} || '", "path": "/z", "secure": true}}, {{"other": 1}}]'"""]


@register(
    "cookies",
    """WITH c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 7 AS m FROM customer) SELECT c_custkey, 'sid' AS name, k AS value, '' AS domain, '/' AS path, '' AS expires, true AS secure, true AS httponly, 'Lax' AS samesite FROM c WHERE m = 0
UNION ALL SELECT c_custkey, 'a', 'b=' || k, 'e.com', '/', 'Wed, 01 Jan 2031', false, false, '' FROM c WHERE m = 1 UNION ALL SELECT c_custkey, 'x', '', '', '/', '', false, false, '' FROM c WHERE m = 3
UNION ALL SELECT c_custkey, 'k', k, '', '/z', '', true, false, '' FROM c WHERE m = 4 UNION ALL SELECT c_custkey, '', '', '', '/', '', false, false, '' FROM c WHERE m = 4""",
)
def cookies(spark, sf_dir):
    cases = " ".join(f"WHEN {m} THEN {text.format(k='CAST(c_custkey AS STRING)')}" for m, text in enumerate(_COOKIES))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"CASE c_custkey % 7 {cases} END").alias("v"))
    return rows.select("c_custkey", F.explode(P.cookies(F.col("v"))).alias("c")).select("c_custkey", "c.*")


@register("sizes", "SELECT page_id, CASE WHEN length(html) >= 1048576 THEN printf('%.2f Mb', length(html) / 1048576.0) WHEN length(html) >= 1024 THEN printf('%.2f Kb', length(html) / 1024.0) ELSE length(html) || ' B' END AS size FROM pages")
def sizes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.format_size(F.length("html")).alias("size"))


@register("store_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey <> 0")
def store_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("new"))
    return store.upsert(old, new.unionByName(new.where("o_orderkey <> 0").withColumn("o_orderkey", -F.col("o_orderkey"))), ["o_orderkey"])


@register("frontier_insert", "SELECT o_custkey AS url, CAST(min(o_orderkey % 9) AS BIGINT) AS depth FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey")
def frontier_insert(spark, sf_dir):
    held = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("url"))
    return store.insert_new(held, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), (F.col("o_orderkey") % 9).alias("depth")))


@register("frontier_batch", "SELECT o_orderkey AS id, o_custkey % 7 AS depth FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey % 7, o_orderkey LIMIT 25")
def frontier_batch(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("depth"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return store.next_batch(f, 25).drop("status")


@register("previous_audit", "SELECT c_custkey AS audit_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 12 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")
def previous_audit(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("audit_id"), F.col("c_mktsegment").alias("domain"), F.when(F.col("c_nationkey") < 12, "completed").otherwise("failed").alias("status"), F.col("c_acctbal").alias("started_at"))
    return store.previous_audit(a, "BUILDING").select("audit_id")


@register("expanded_turns", "SELECT conv_id, max(CASE WHEN n = 1 THEN role END) AS \"role-1\", max(CASE WHEN n = 2 THEN role END) AS \"role-2\", max(CASE WHEN n = 3 THEN role END) AS \"role-3\" FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) GROUP BY conv_id")
def expanded_turns(spark, sf_dir):
    return store.expand(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "role", 3)


_BLANK = "trim(coalesce({c}, '')) = ''"


@register(
    "site_overview",
    f"""WITH {values_sql("fx_pages", "fx_links")}, a AS (SELECT count(*) AS crawled, count(*) FILTER (status_code BETWEEN 200 AND 299) AS ok, count(*) FILTER (status_code BETWEEN 300 AND 399) AS redirects, count(*) FILTER (status_code BETWEEN 400 AND 499) AS client_errors,
  count(*) FILTER (status_code >= 500) AS server_errors, count(*) FILTER (NOT coalesce(is_indexable, false)) AS noindex, count(*) FILTER (trim(coalesce(canonical, '')) <> '' AND rtrim(canonical, '/') <> rtrim(url, '/')) AS canonicalised, count(*) FILTER ({_BLANK.format(c="title")}) AS missing_titles,
  count(*) FILTER ({_BLANK.format(c="meta_description")}) AS missing_descriptions, count(*) FILTER ({_BLANK.format(c="h1")}) AS missing_h1, round(avg(nullif(response_time_ms, 0)), 1) AS avg_response_ms FROM fx_pages)
SELECT a.*, (SELECT count(*) FROM (SELECT url FROM fx_pages UNION SELECT target_url FROM fx_links)) AS discovered FROM a""",
)
def site_overview(spark, sf_dir):
    t = tables(spark, sf_dir)
    return report.overview(t["fx_pages"], t["fx_links"])


@register(
    "report_scores",
    f"""WITH {values_sql("fx_pages")}, s AS (SELECT * FROM fx_pages ORDER BY coalesce(crawl_depth, 99), page_id LIMIT 1), t AS (
  SELECT 'seo' AS category, CASE WHEN length(trim(title)) BETWEEN 30 AND 60 THEN 'passed' WHEN trim(title) <> '' THEN 'warning' ELSE 'failed' END AS status FROM s UNION ALL SELECT 'seo', CASE WHEN length(trim(meta_description)) BETWEEN 70 AND 160 THEN 'passed' WHEN trim(meta_description) <> '' THEN 'warning' ELSE 'failed' END FROM s
  UNION ALL SELECT 'seo', CASE WHEN trim(h1) <> '' THEN 'passed' ELSE 'failed' END FROM s UNION ALL SELECT 'seo', CASE WHEN trim(canonical) <> '' THEN 'passed' ELSE 'warning' END FROM s UNION ALL SELECT 'speed', CASE WHEN response_time_ms < 600 THEN 'passed' WHEN response_time_ms < 1500 THEN 'warning' ELSE 'failed' END FROM s
  UNION ALL SELECT 'speed', CASE WHEN html_size < 100000 THEN 'passed' WHEN html_size < 500000 THEN 'warning' ELSE 'failed' END FROM s UNION ALL SELECT 'mobile', CASE WHEN viewport LIKE '%width=device-width%' THEN 'passed' WHEN viewport <> '' THEN 'warning' ELSE 'failed' END FROM s
  UNION ALL SELECT 'security', CASE WHEN url LIKE 'https://%' THEN 'passed' ELSE 'failed' END FROM s UNION ALL SELECT 'links', CASE WHEN status_code = 200 THEN 'passed' WHEN status_code BETWEEN 300 AND 399 THEN 'warning' ELSE 'failed' END FROM s),
g AS (SELECT category, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'failed') AS failed FROM t GROUP BY GROUPING SETS ((category), ()))
SELECT coalesce(category, 'all') AS category, passed, warning, failed, CAST(CASE WHEN category IS NULL THEN least(greatest(round((passed * 100 + warning * 55) / (passed + warning + failed)), 15), 99) ELSE least(greatest(round((passed * 100 + warning * 50) / (passed + warning + failed)), 0), 100) END AS DOUBLE) AS score FROM g""",
)
def report_scores(spark, sf_dir):
    return report.scores(report.page_tests(tables(spark, sf_dir)["fx_pages"]))


@register(
    "loading_metrics",
    f"""WITH {values_sql("fx_pages", "fx_images")}, m AS (SELECT avg(nullif(response_time_ms, 0)) / 1000 AS rt, (SELECT html_size FROM fx_pages ORDER BY coalesce(crawl_depth, 99), page_id LIMIT 1) / 1024 AS kb, (SELECT count(*) FROM fx_images WHERE NOT coalesce(has_dimensions, false)) AS loose FROM fx_pages),
a AS (SELECT *, round(greatest(rt, 0.08), 2) AS ttfb FROM m), b AS (SELECT *, round(greatest(ttfb * 1.25 + least(kb / 200, 0.6), 0.4), 2) AS fcp FROM a), c AS (SELECT *, round(greatest(fcp + 0.65 + least(kb / 120, 1.2), 0.8), 2) AS lcp, round(0.02::DOUBLE + least(loose * 0.012::DOUBLE, 0.18), 3) AS cls FROM b),
d AS (SELECT *, greatest(least(round(100 - lcp * 11 - cls * 110 - fcp * 5), 99), 35) AS score FROM c),
e AS (SELECT 'desktop' AS device, ttfb, fcp, lcp, cls, score FROM d UNION ALL SELECT 'mobile', round(greatest(rt + 0.11, 0.18), 2), round(greatest(fcp * 1.55 + 0.25, 0.85), 2), round(greatest(lcp * 1.7 + 0.35, 1.3), 2), round(least(cls * 1.18, 0.28), 3), greatest(least(score - 18, 95), 25) FROM d)
SELECT *, CASE WHEN ttfb < 0.8 THEN 'good' WHEN ttfb < 1.8 THEN 'moderate' ELSE 'poor' END AS ttfb_status, CASE WHEN fcp < 1.8 THEN 'good' WHEN fcp < 3 THEN 'moderate' ELSE 'poor' END AS fcp_status, CASE WHEN lcp < 2.5 THEN 'good' WHEN lcp < 4 THEN 'moderate' ELSE 'poor' END AS lcp_status, CASE WHEN cls < 0.1 THEN 'good' WHEN cls < 0.25 THEN 'moderate' ELSE 'poor' END AS cls_status FROM e""",
)
def loading_metrics(spark, sf_dir):
    t = tables(spark, sf_dir)
    return report.loading_metrics(t["fx_pages"], t["fx_images"])


@register("measured_metrics", f"WITH {values_sql('fx_pages')} SELECT round(avg(nullif(lcp_ms, 0)) / 1000, 2) AS lcp_s, round(avg(cls), 3) AS cls, round(avg(nullif(fcp_ms, 0)) / 1000, 2) AS fcp_s, count(*) AS pages FROM fx_pages")
def measured_metrics(spark, sf_dir):
    return report.measured_metrics(tables(spark, sf_dir)["fx_pages"])


@register("objects_by_domain", f"WITH {values_sql('fx_resources')} SELECT regexp_extract(url, '//([^/?#]*)', 1) AS domain, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM fx_resources), 1) AS pct FROM fx_resources GROUP BY ALL ORDER BY n DESC, domain LIMIT 12")
def objects_by_domain(spark, sf_dir):
    return report.objects_by_domain(tables(spark, sf_dir)["fx_resources"])


@register("slowest_pages", f"WITH {values_sql('fx_pages')} SELECT url, response_time_ms FROM fx_pages WHERE response_time_ms IS NOT NULL ORDER BY response_time_ms DESC, url LIMIT 5")
def slowest_pages(spark, sf_dir):
    return report.slowest(tables(spark, sf_dir)["fx_pages"])


@register("sitemap_coverage", f"WITH {values_sql('fx_pages', 'fx_sitemap')}, g AS (SELECT DISTINCT rtrim(url, '/') AS k FROM fx_pages WHERE status_code = 200 AND coalesce(is_indexable, false)), c AS (SELECT count(*) AS indexable, count(*) FILTER (k IN (SELECT rtrim(url, '/') FROM fx_sitemap)) AS in_sitemap FROM g), p AS (SELECT *, round(100.0 * in_sitemap / indexable, 1)::DOUBLE AS pct FROM c) SELECT *, CASE WHEN pct >= 90 THEN 'info' WHEN pct >= 70 THEN 'warning' ELSE 'critical' END AS severity FROM p")
def sitemap_coverage(spark, sf_dir):
    t = tables(spark, sf_dir)
    return report.coverage(t["fx_pages"], t["fx_sitemap"])


#: Files by the supplier's number modulo 6: status and text. Of the last kind every 17th is oversized.
_FILES = [(200, "User-agent: *\nDisallow: /\nFoo: bar"), (404, ""), (None, None), (200, "User-agent: *\nCrawl-delay: 2\nDisallow: /x\nSitemap: s"), (500, ""), (200, "User-agent: *\nDisallow: /y\nSitemap: s\n# ")]


@register(
    "robots_file_checks",
    """WITH s AS (SELECT 's' || s_suppkey || '.com' AS host, s_suppkey % 6 AS m, s_suppkey AS k FROM supplier), f(m, issue_type, severity) AS (VALUES (0, 'robots_txt_full_site_disallowed', 'critical'), (0, 'robots_txt_syntax_errors', 'warning'), (0, 'robots_txt_missing_sitemap', 'info'),
  (1, 'robots_txt_missing_or_error', 'info'), (2, 'robots_txt_fetch_error', 'warning'), (3, 'robots_txt_crawl_delay_present', 'info'), (4, 'robots_txt_missing_or_error', 'warning'), (5, 'robots_txt_oversized', 'critical'))
SELECT host, issue_type, severity FROM s JOIN f USING (m) WHERE m <> 5 OR k % 102 = 5""",
)
def robots_file_checks(spark, sf_dir):
    k = F.col("s_suppkey")
    one = F.element_at(F.array(*[F.struct(F.lit(status).cast("int").alias("status"), F.lit(text).cast("string").alias("text")) for status, text in _FILES]), (k % 6 + 1).cast("int"))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit(".com")).alias("host"), one.alias("f"), k)
    files = files.select("host", "f.status", F.when(k % 102 == 5, F.concat("f.text", F.repeat(F.lit("x"), F.lit(512001)))).otherwise(F.col("f.text")).alias("text"))
    return report.robots_file_checks(files, S.parse_robots(files.where("status = 200")))


@register(
    "log_findings",
    """WITH v AS (SELECT '/' || event_type AS path, 200 + 100 * (event_id % 4) AS status, CASE WHEN event_id % 3 = 0 THEN 'Bingbot' END AS bot FROM events WHERE event_type <> 'view'), p AS (SELECT path, d FROM (VALUES ('/purchase', 1), ('/click', 4), ('/view', 2), ('/never', 1), ('/deep', 7)) t(path, d)),
b AS (SELECT * FROM v WHERE bot IS NOT NULL) SELECT 'crawl_budget_waste_errors' AS issue_type, 'critical' AS severity, path, count(*) AS hits FROM b WHERE status >= 400 GROUP BY path
UNION ALL SELECT 'orphan_urls_visited_by_bots', 'warning', path, count(*) FROM b WHERE path NOT IN (SELECT path FROM p) GROUP BY path UNION ALL SELECT 'unvisited_core_pages', 'info', path, 0 FROM p WHERE d <= 2 AND path NOT IN (SELECT path FROM b)""",
)
def log_findings(spark, sf_dir):
    visits = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.concat(F.lit("/"), "event_type").alias("path"), (200 + 100 * (F.col("event_id") % 4)).alias("status"), F.when(F.col("event_id") % 3 == 0, "Bingbot").alias("bot"))
    pages = spark.createDataFrame([("/purchase", 1), ("/click", 4), ("/view", 2), ("/never", 1), ("/deep", 7)], "path string, crawl_depth int")
    return S.log_findings(visits, pages)


@register("low_ctr", "SELECT 'u' || c_custkey AS url, CAST(c_custkey * 10 AS BIGINT) AS impressions FROM customer WHERE c_custkey * 10 > 500 AND (c_custkey % 5) / 100.0 < 0.02 AND c_custkey % 30 <= 15")
def low_ctr(spark, sf_dir):
    """Search rows read back from the JSON of a response for each nation."""
    k = F.col("c_custkey")
    row = F.struct(F.array(F.concat(F.lit("u"), k.cast("string"))).alias("keys"), F.lit(1.0).alias("clicks"), (k * 10.0).alias("impressions"), ((k % 5) / 100.0).alias("ctr"), (k % 30).cast("double").alias("position"))
    responses = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("value"))
    return S.low_ctr(S.search_rows(responses)).select("url", "impressions")


@register("export_images", f"WITH {values_sql('fx_images')} SELECT url, src, coalesce(alt_text, '') AS alt_text, CASE WHEN trim(coalesce(alt_text, '')) = '' THEN 'Missing' ELSE 'OK' END AS alt_status, format, file_size FROM fx_images")
def export_images(spark, sf_dir):
    return exports.images_csv(tables(spark, sf_dir)["fx_images"])


@register("export_redirects", f"WITH {values_sql('fx_pages')} SELECT url, status_code, CAST(len(redirect_chain) AS INTEGER) AS hops, array_to_string(list_transform(redirect_chain, lambda c: c.url || ' (' || c.status || ')'), ' -> ') AS chain, redirect_chain[len(redirect_chain)].url AS final_url FROM fx_pages WHERE len(redirect_chain) > 0")
def export_redirects(spark, sf_dir):
    return exports.redirects_csv(tables(spark, sf_dir)["fx_pages"])


@register("export_links", f"WITH {values_sql('fx_links')} SELECT source_url, target_url, anchor_text, is_internal, nofollow FROM fx_links")
def export_links(spark, sf_dir):
    return exports.links_csv(tables(spark, sf_dir)["fx_links"])


_MOBILE = tuple(r for r in rules.PAGE_RULES if r.pack == "mobile")


@register(
    "export_pages",
    f"""WITH {values_sql("fx_pages")}, v AS (SELECT page_id, trim(coalesce(viewport, '')) AS v FROM fx_pages), n AS (SELECT page_id, CAST(v = '' AS INT) + CAST(v <> '' AND lower(v) NOT LIKE '%width=device-width%' AS INT) + CAST(lower(v) LIKE '%user-scalable=no%' OR lower(v) LIKE '%maximum-scale=1%' AS INT) AS n FROM v)
SELECT page_id, url, status_code, title, word_count, CAST(n AS BIGINT) AS issue_count FROM fx_pages JOIN n USING (page_id)""",
)
def export_pages(spark, sf_dir):
    t = tables(spark, sf_dir)
    return exports.pages_csv(t["fx_pages"], rules.issues(audit.prepare_pages(t), _MOBILE))


@register("inspector_links", f"WITH {values_sql('fx_pages', 'fx_links')} SELECT 'in' AS side, source_url AS url, anchor_text FROM fx_links WHERE rtrim(target_url, '/') = 'https://example.com/about' UNION ALL SELECT 'out', target_url, anchor_text FROM fx_links WHERE source_page_id = 2")
def inspector_links(spark, sf_dir):
    return inspect(tables(spark, sf_dir), 2)


def inspect(t, page_id: int):
    """In- and outlinks of a page."""
    links = t["fx_links"]
    url = t["fx_pages"].where(F.col("page_id") == page_id).select(U.rstrip_slash(F.col("url")).alias("_k"))
    into = links.withColumn("_k", U.rstrip_slash(F.col("target_url"))).join(url, "_k", "left_semi").select(F.lit("in").alias("side"), F.col("source_url").alias("url"), "anchor_text")
    return into.unionByName(links.where(F.col("source_page_id") == page_id).select(F.lit("out").alias("side"), F.col("target_url").alias("url"), "anchor_text"))


@register("emails_in_pages", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'))) AS INTEGER) AS emails FROM documents")
def emails_in_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.emails(F.col("text"))).alias("emails"))


@register("status_classes", f"WITH {values_sql('fx_pages')} SELECT CASE WHEN status_code IS NULL THEN NULL ELSE (status_code // 100) || 'xx' END AS class, CASE status_code WHEN 301 THEN 'Permanent (301)' WHEN 302 THEN 'Temporary (302)' WHEN 307 THEN 'Temporary (307)' WHEN 308 THEN 'Permanent (308)' END AS kind, count(*) AS n FROM fx_pages GROUP BY ALL")
def status_classes(spark, sf_dir):
    c = F.col("status_code")
    return tables(spark, sf_dir)["fx_pages"].groupBy(views.status_class(c).alias("class"), views.redirect_kind(c).alias("kind")).agg(F.count("*").alias("n"))


