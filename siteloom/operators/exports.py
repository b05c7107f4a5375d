"""Exports: each is a projection written by Spark's writers, so large ones never pass the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .views import sitemap_rows

LINK_COLUMNS = ("source_url", "target_url", "anchor_text", "is_internal", "nofollow")


def links_csv(links: DataFrame) -> DataFrame:
    return links.select(*LINK_COLUMNS)


def images_csv(images: DataFrame) -> DataFrame:
    return images.select("url", "src", F.coalesce("alt_text", F.lit("")).alias("alt_text"), F.when(F.trim(F.coalesce("alt_text", F.lit(""))) == "", "Missing").otherwise("OK").alias("alt_status"), "format", "file_size")


def redirects_csv(pages: DataFrame) -> DataFrame:
    chain = F.array_join(F.transform("redirect_chain", lambda c: F.concat(c["url"], F.lit(" ("), c["status"].cast("string"), F.lit(")"))), " -> ")
    return pages.where(F.coalesce(F.size("redirect_chain"), F.lit(0)) > 0).select("url", "status_code", F.size("redirect_chain").alias("hops"), chain.alias("chain"), F.element_at("redirect_chain", -1)["url"].alias("final_url"))


def pages_csv(pages: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("page_id").agg(F.count("*").alias("issue_count"))
    return pages.join(counts, "page_id", "left").select("page_id", "url", "status_code", "title", "word_count", F.coalesce("issue_count", F.lit(0)).alias("issue_count"))


def urls_csv(enriched: DataFrame, issues: DataFrame) -> DataFrame:
    """The URL table's 28 columns under their printed names."""
    from .views import status_text

    counts = issues.where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("issues_count"))
    d = enriched.join(counts, "page_id", "left").withColumn("issues_count", F.coalesce("issues_count", F.lit(0)))
    have = lambda c, default=None: F.col(c) if c in d.columns else F.lit(default)
    mime = F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1)))
    columns = {
        "URL": have("url"), "URL Type": have("url_type"), "Status Code": have("status_code"), "Status": status_text(F.col("status_code")), "Content Type": have("content_type"), "MIME Type": mime, "Page Title": have("title"), "Meta Description": have("meta_description"),
        "H1": have("h1"), "Canonical": have("canonical"), "Robots Directive": have("robots_directive"), "Indexability": have("indexability"), "Word Count": have("word_count"), "Content Hash": have("content_hash"), "Crawl Depth": have("crawl_depth"), "Parent URL": have("parent_url"),
        "Internal Inlinks": have("inlinks"), "Internal Outlinks": have("outlinks"), "External Links": have("external_outlinks"), "Images": have("images"), "Schema Count": have("schema_blocks"), "Response Time (ms)": F.round(have("response_time_ms"), 2), "Page Size (Bytes)": have("html_size"),
        "Redirect Destination": have("redirect_url"), "Final URL": have("redirect_final"), "Language": have("lang"), "Page Type": have("page_type"), "Issues Count": have("issues_count"),
    }
    return d.select(*[c.cast("string").alias(n) if str(n) in ("Robots Directive",) else c.alias(n) for n, c in columns.items()])


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines of a GEXF graph: nodes by URL with their inlinks, edges between them."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="inlinks" type="integer"/></attributes><nodes>']
    fixed = spark.createDataFrame([(0, head[0]), (1, head[1]), (3, "</nodes><edges>"), (5, "</edges></graph></gexf>")], "part int, value string")
    node = F.concat(F.lit('<node id="'), escape(F.col("url")), F.lit('" label="'), escape(F.col("url")), F.lit('"><attvalues><attvalue for="0" value="'), F.col("inlinks").cast("string"), F.lit('"/></attvalues></node>'))
    edge = F.concat(F.lit('<edge source="'), escape(F.col("source_url")), F.lit('" target="'), escape(F.col("target_url")), F.lit('"/>'))
    rows = fixed.unionByName(nodes.select(F.lit(2).alias("part"), node.alias("value"))).unionByName(edges.select(F.lit(4).alias("part"), edge.alias("value")))
    return rows.orderBy("part", "value").select("value")


def html_report(title: str, sections: dict[str, DataFrame], most: int = 100) -> str:
    """A page with a table for each section: aggregates computed in Spark, of each the first ``most`` rows, written out here."""
    from html import escape

    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        out.append(f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows]
        out.append("</table>")
    return "\n".join([*out, "</body></html>"])


def sitemap_xml(pages: DataFrame) -> DataFrame:
    return sitemap_rows(pages).select(F.col("url").alias("loc"), "priority")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line for each node and edge."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "url", "inlinks")).alias("value"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "source_url", "target_url")).alias("value")))


def write(df: DataFrame, path: str, form: str = "csv") -> None:
    """csv with a header, json, parquet, text, or xml with url rows as in a sitemap."""
    w = df.write.mode("overwrite")
    if form == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif form == "xml":
        w.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    elif form in ("json", "parquet", "text"):
        w.format(form).save(path)
    else:
        raise ValueError(f"unknown format {form!r}")
