"""Access logs, robots.txt, sitemaps, URL lists and metric JSON as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Fixed value: the combined log format.
LOG_LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+[^"]*"\s+(\d{3})\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"'
LOG_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def bot_type(agent: Column) -> Column:
    a = F.lower(agent)
    mobile = a.rlike("googlebot.*mobile")
    return F.when(mobile, "Googlebot Smartphone").when(a.contains("googlebot"), "Googlebot Desktop").when(a.contains("bingbot"), "Bingbot").when(a.contains("yandexbot"), "YandexBot").when(a.contains("baiduspider"), "Baiduspider").when(a.contains("duckduckbot"), "DuckDuckBot")


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of the lines that match the format; others are left out. Works on streams alike."""
    at = lambda k: F.regexp_extract(column, LOG_LINE, k)
    return lines.where(F.col(column).rlike(LOG_LINE)).select(
        at(1).alias("ip"), F.try_to_timestamp(at(2), F.lit(LOG_TIME)).alias("time"), at(3).alias("method"), at(4).alias("path"), at(5).cast("int").alias("status"), at(6).try_cast("bigint").alias("bytes"), at(7).alias("referrer"), at(8).alias("agent"), bot_type(at(8)).alias("bot")
    )


def log_findings(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Bot visits that end in errors, bot visits to unknown paths, and shallow pages that bots never asked for."""
    bots = visits.where("bot is not null")
    known = pages.select("path").distinct()
    waste = bots.where("status >= 400").groupBy("path").agg(F.count("*").alias("hits")).select(F.lit("crawl_budget_waste_errors").alias("issue_type"), F.lit("critical").alias("severity"), "path", "hits")
    orphan = bots.join(known, "path", "left_anti").groupBy("path").agg(F.count("*").alias("hits")).select(F.lit("orphan_urls_visited_by_bots").alias("issue_type"), F.lit("warning").alias("severity"), "path", "hits")
    unseen = pages.where("crawl_depth <= 2").select("path").distinct().join(bots.select("path").distinct(), "path", "left_anti").select(F.lit("unvisited_core_pages").alias("issue_type"), F.lit("info").alias("severity"), "path", F.lit(0).cast("long").alias("hits"))
    return waste.unionByName(orphan).unionByName(unseen)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def parse_robots(texts: DataFrame, key: str = "host", text: str = "text") -> DataFrame:
    """key, line_no, agent, directive and value; a group of user-agent lines shares the rules below it."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    d = lines.select(key, "line_no", F.lower(F.trim(F.regexp_extract(bare, "^([^:]+):", 1))).alias("directive"), F.trim(F.regexp_extract(bare, "^[^:]+:(.*)$", 1)).alias("value"), bare.alias("bare")).where("bare <> ''")
    w = Window.partitionBy(key).orderBy("line_no")
    d = d.withColumn("_new", (F.col("directive") == "user-agent") & (F.coalesce(F.lag("directive").over(w), F.lit("")) != "user-agent"))
    d = d.withColumn("_group", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = d.where("directive = 'user-agent'").select(key, "_group", F.lower("value").alias("agent"))
    own = d.where("directive in ('allow', 'disallow', 'crawl-delay')").join(agents, [key, "_group"])
    free = d.where("directive not in ('allow', 'disallow', 'crawl-delay', 'user-agent')").withColumn("agent", F.lit("*"))
    return own.select(key, "line_no", "agent", "directive", "value").unionByName(free.select(key, "line_no", "agent", "directive", "value"))


def robots_verdicts(rules: DataFrame, paths: DataFrame, agent: str = "*", key: str = "host") -> DataFrame:
    """key, path and allowed: rules of the agent, else of ``*``; the longest prefix decides, allow wins ties.

    Paths are joined to the rules of their own host, which are few; there is no join of all paths with all rules.
    """
    own = rules.where((F.col("agent") == agent.lower()) & F.col("directive").isin("allow", "disallow"))
    named = own.select(key).distinct().withColumn("_named", F.lit(True)) if agent != "*" else None
    chosen = own
    if named is not None:
        other = rules.where((F.col("agent") == "*") & F.col("directive").isin("allow", "disallow")).join(named, key, "left_anti")
        chosen = own.unionByName(other)
    hit = paths.join(chosen, key).where((F.col("value") != "") & F.col("path").startswith(F.col("value")))
    best = hit.groupBy(key, "path").agg(F.max_by(F.col("directive") == "allow", F.struct(F.length("value"), F.col("directive") == "allow")).alias("allowed"))
    return paths.select(key, "path").distinct().join(best, [key, "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Entries of captured sitemap files; plain and gzip."""
    schema = "loc string, lastmod string, changefreq string, priority double"
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).select(F.trim("loc").alias("url"), F.input_file_name().alias("sitemap_file"), "lastmod", "changefreq", "priority")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("sitemap_url"), "lastmod")


def entries_of_index(index: DataFrame, entries: DataFrame, file: str = "sitemap_url") -> DataFrame:
    """The entries of the sitemaps that an index lists, of indexes below it too: ``index`` has parent and sitemap_url, ``entries`` ``file`` and url.

    Nested indexes are followed level by level until no new file is found, so loops end.
    """
    known = index.select(F.col("sitemap_url").alias(file)).distinct()
    while True:
        below = index.join(known.select(F.col(file).alias("parent")), "parent", "left_semi").select(F.col("sitemap_url").alias(file))
        more = known.union(below).distinct()
        if more.count() == known.count():
            break
        known = more
    return entries.join(known, file, "left_semi")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def search_rows(responses: DataFrame, column: str = "value") -> DataFrame:
    """url, clicks, impressions, ctr and position of search-console responses."""
    rows = F.from_json(column, "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>")
    return responses.select(F.explode(rows["rows"]).alias("r")).select(F.try_element_at("r.keys", F.lit(1)).alias("url"), F.col("r.clicks").cast("long").alias("clicks"), F.col("r.impressions").cast("long").alias("impressions"), "r.ctr", "r.position")


def low_ctr(search: DataFrame) -> DataFrame:
    return search.where("impressions > 500 and ctr < 0.02 and position <= 15")


def field_metrics(responses: DataFrame, key: str = "url", column: str = "value") -> DataFrame:
    """Loading metrics of a page-speed response."""
    v = F.try_parse_json(column)
    audit = lambda name: F.try_variant_get(v, f"$.lighthouseResult.audits['{name}'].numericValue", "double")
    return responses.select(
        key, F.round(audit("largest-contentful-paint"), 1).alias("lcp_ms"), F.round(audit("cumulative-layout-shift"), 3).alias("cls"), F.round(audit("first-contentful-paint"), 1).alias("fcp_ms"), F.round(audit("server-response-time"), 1).alias("ttfb_ms"),
        F.round(100 * F.try_variant_get(v, "$.lighthouseResult.categories.performance.score", "double"), 0).alias("performance_score"),
    )
