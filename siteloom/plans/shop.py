"""A captured site made of the given tables: regions, nations, lists of customers and customers as pages of markup, with responses.

Home links to regions, these to nations, these to every eighth list of their customers, lists to the next list and their customers; every page links to the privacy page. Customers without orders are in
no list, so no link leads to them. The twins know the links from the tables, the queries find them in the markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import audit, capture, rules
from . import graph_sql
from .materialize import materialize
from .registry import register
from .site_tables import _once

ROOT = "https://shop.example"
#: Customer numbers of a list, and lists between two that a nation links to.
NUMBERS, STRIDE = 200, 8


def _a(path, text="more"):
    return F.concat(F.lit('<a href="'), path, F.lit(f'">{text}</a>'))


def _page(page_id, path, title, body):
    privacy = F.lit('<a href="/privacy">Privacy</a>')
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1><br><p>"), body, privacy, F.lit("</body></html>"))
    return F.struct(page_id.cast("long").alias("page_id"), F.concat(F.lit(ROOT), path).alias("url"), html.alias("html"))


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and html."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    k, n, r = F.col("c_custkey"), F.col("n_nationkey"), F.col("n_regionkey")
    nations, customers = read("nation"), read("customer")
    last = customers.agg(F.floor(F.coalesce(F.max("c_custkey"), F.lit(0)) / NUMBERS).alias("last"))  # one row
    listed = customers.join(read("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    listed = listed.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.floor(k / NUMBERS).alias("list")).agg(F.array_join(F.array_sort(F.collect_list(_a(text("/customer/", k), "customer"))), " ").alias("members"))
    lists = nations.select("n_nationkey").crossJoin(F.broadcast(last)).select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("list"), "last").join(listed, ["n_nationkey", "list"], "left")
    at = F.col("list")
    following = F.when(at < F.col("last"), _a(text("/list/", n, "/", at + 1), "next")).otherwise("")
    pages = [
        nations.groupBy().agg(F.array_join(F.array_sort(F.collect_set(_a(text("/region/", r), "region"))), " ").alias("b")).select(_page(F.lit(0), F.lit("/"), F.lit("Home"), F.col("b")).alias("p")),
        spark.range(1).select(_page(F.lit(1), F.lit("/privacy"), F.lit("Privacy"), _a(F.lit("/"), "home")).alias("p")),
        nations.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(_a(text("/nation/", n), "nation"))), " ").alias("b")).select(_page(10 + r, text("/region/", r), text("Region ", r), F.col("b")).alias("p")),
        nations.crossJoin(F.broadcast(last)).select(_page(100 + n, text("/nation/", n), F.col("n_name"), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), "last", F.lit(STRIDE).cast("long")), lambda i: _a(text("/list/", n, "/", i), "list")), " ")).alias("p")),
        lists.select(_page(1_000_000 + 100 * at + n, text("/list/", n, "/", at), text("List ", at, " of nation ", n), F.concat(F.coalesce("members", F.lit("")), following)).alias("p")),
        customers.select(_page(1_000_000_000_000 + k, text("/customer/", k), F.col("c_name"), F.concat(_a(text("/nation/", F.col("c_nationkey")), "nation"), _a(F.lit("/cart"), "cart"))).alias("p")),
    ]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.select("p.*")


def shop_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fetching the customers' pages told: some are gone, some slow, some without headers, some moved."""
    k = F.col("c_custkey")
    url = F.concat(F.lit(f"{ROOT}/customer/"), k.cast("string"))
    hsts = F.when(k % 3 == 0, F.create_map(F.lit("Strict-Transport-Security"), F.lit("max-age=60"))).when(k % 3 == 1, F.create_map(F.lit("X-Frame-Options"), F.lit("DENY")))
    hop = lambda u, s: F.struct(u.alias("url"), F.lit(s).alias("status"))
    chain = F.when(k % 17 == 5, F.array(hop(F.concat(F.lit("http://shop.example/c/"), k.cast("string")), 302), hop(F.concat(F.lit(f"{ROOT}/c/"), k.cast("string")), 301), hop(url, 200)))
    status = F.when(k % 10 == 3, 404).when(k % 10 == 7, 503).otherwise(200)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(url.alias("url"), status.alias("status_code"), (k * 131 % 4000).cast("double").alias("response_time_ms"), chain.alias("redirect_chain"), hsts.alias("headers"))


def shop_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The audit's tables of the site, with its link graph as ``graph``; made once."""

    def make():
        # Small files of keys make large pages, so rows are dealt out before they are parsed: one file would be one task.
        made = shop_pages(spark, sf_dir).repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        parsed = materialize(capture.parse(made), "shop")
        found = materialize(capture.link_graph(parsed.select("page_id", "url"), capture.links_of(parsed), f"{ROOT}/"), "graph")
        return capture.tables(parsed, shop_responses(spark, sf_dir), found=found) | {"graph": found}

    return _once(spark, ("shop", sf_dir), make)


_SHOP = f"""m AS (SELECT coalesce(max(c_custkey), 0) // {NUMBERS} AS last FROM customer),
o AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
li AS (SELECT n_nationkey AS n, i, last FROM nation, m, generate_series(0, m.last) t(i)),
sp AS MATERIALIZED (
  SELECT 0 AS page_id, '{ROOT}/' AS url UNION ALL SELECT 1, '{ROOT}/privacy' UNION ALL SELECT DISTINCT 10 + n_regionkey, '{ROOT}/region/' || n_regionkey FROM nation UNION ALL SELECT 100 + n_nationkey, '{ROOT}/nation/' || n_nationkey FROM nation
  UNION ALL SELECT 1000000 + 100 * i + n, '{ROOT}/list/' || n || '/' || i FROM li UNION ALL SELECT 1000000000000 + c_custkey, '{ROOT}/customer/' || c_custkey FROM customer
), sl AS MATERIALIZED (
  SELECT *, true AS is_internal FROM (
  SELECT url AS source_url, '{ROOT}/privacy' AS target_url FROM sp UNION ALL SELECT DISTINCT '{ROOT}/', '{ROOT}/region/' || n_regionkey FROM nation UNION ALL SELECT '{ROOT}/privacy', '{ROOT}/'
  UNION ALL SELECT '{ROOT}/region/' || n_regionkey, '{ROOT}/nation/' || n_nationkey FROM nation UNION ALL SELECT '{ROOT}/nation/' || n, '{ROOT}/list/' || n || '/' || i FROM li WHERE i % {STRIDE} = 0
  UNION ALL SELECT '{ROOT}/list/' || n || '/' || i, '{ROOT}/list/' || n || '/' || (i + 1) FROM li WHERE i < last UNION ALL SELECT '{ROOT}/list/' || c_nationkey || '/' || (c_custkey // {NUMBERS}), '{ROOT}/customer/' || c_custkey FROM o
  UNION ALL SELECT '{ROOT}/customer/' || c_custkey, '{ROOT}/nation/' || c_nationkey FROM customer UNION ALL SELECT '{ROOT}/customer/' || c_custkey, '{ROOT}/cart' FROM customer)
), sg AS MATERIALIZED ({graph_sql.captured('sp', 'sl', rounds=48)})"""


@register("crawl_depths", f"WITH {_SHOP} SELECT url, depth AS crawl_depth, unique_inlinks, is_orphan FROM sg")
def crawl_depths(spark, sf_dir):
    """Fewest links from the start page, and pages that no other links to, by links found in the markup."""
    return shop_tables(spark, sf_dir)["graph"].select("url", "crawl_depth", "unique_inlinks", "is_orphan")


@register("crawl_ranks", f"WITH {_SHOP} SELECT page_id, round(score, 1) AS score FROM sp JOIN sg USING (url)")
def crawl_ranks(spark, sf_dir):
    """PageRank of captured pages, as an audit stores it."""
    return shop_tables(spark, sf_dir)["fx_pages"].select("page_id", F.round("internal_pagerank", 1).alias("score"))


_CHOSEN = tuple(r for r in rules.PAGE_RULES if r.pack == "pagerank" or r.pack in ("technical", "links") and r.issue_type in ("deep_crawl_depth", "high_crawl_depth", "orphan_page", "excessive_crawl_depth", "4xx_error", "5xx_error", "slow_response", "very_slow_response", "redirect_chain", "mixed_redirect_chain", "redirect_broken_destination", "few_incoming_links") or r.pack == "security" and "hsts" in r.issue_type)


@register(
    "crawl_graph_rules",
    f"""WITH {_SHOP}, r AS (SELECT '{ROOT}/customer/' || c_custkey AS url, c_custkey AS k FROM customer), hits AS (SELECT target_url AS url, count(*) AS inlinks FROM sl GROUP BY 1), prepared AS (
  SELECT sp.page_id, sp.url, sg.depth AS crawl_depth, sg.score AS internal_pagerank, coalesce(hits.inlinks, 0) AS inlinks, coalesce(sg.unique_inlinks, 0) + (sp.url = '{ROOT}/privacy')::INT AS unique_inlinks, coalesce(hits.inlinks, 0) > 0 AS has_inlinks,
    CASE k % 10 WHEN 3 THEN 404 WHEN 7 THEN 503 ELSE 200 END AS status_code, k * 131 % 4000 AS response_time_ms, NULL AS redirect_url, false AS loop_exceeded, true AS is_html, 'https' AS url_scheme,
    CASE k % 3 WHEN 0 THEN 'max-age=60' WHEN 1 THEN '' END AS hsts, CASE WHEN k % 3 = 0 THEN 60 ELSE 0 END AS hsts_max_age, CASE WHEN k % 17 = 5 THEN 3 ELSE 0 END AS chain_length, coalesce(k % 17 = 5, false) AS chain_mixed,
    'http://shop.example/c/' || k || ' (302) -> {ROOT}/c/' || k || ' (301) -> ' || sp.url || ' (200)' AS chain_text
  FROM sp JOIN sg USING (url) LEFT JOIN r ON r.url = sp.url LEFT JOIN hits ON hits.url = sp.url) {rules.to_duckdb(_CHOSEN, 'prepared')}""",
)
def crawl_graph_rules(spark, sf_dir):
    """Rules on depth, rank, orphans, status, time, redirects and HSTS, with all that they need taken from markup and responses."""
    return rules.issues(audit.prepare_pages(shop_tables(spark, sf_dir)), _CHOSEN)
