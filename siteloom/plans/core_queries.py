"""Queries over the given tables, each with a DuckDB twin written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X, urls as U
from ..operators import aggregates, compare, graph, keywords, similarity, views
from ..sources import html as H, text_files as S
from ..streaming import ingest
from . import graph_sql
from .fixtures import tables, values_sql
from .materialize import materialize
from .registry import register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pages: URL functions

_PARTS = r"""u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS authority,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages
)"""


@register("url_parts", f"WITH {_PARTS} SELECT page_id, scheme, authority, path, query, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS folder_depth, scheme || '://' || authority || rtrim(path, '/') AS pretty_url, substr(md5(url), 1, 16) AS url_hash FROM u")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.scheme(u).alias("scheme"), U.authority(u).alias("authority"), U.path(u).alias("path"), U.query(u).alias("query"), U.folder_depth(u).alias("folder_depth"), U.pretty(u).alias("pretty_url"), U.url_hash(u).alias("url_hash"))


@register(
    "url_normalized",
    f"""WITH {_PARTS}, q AS (SELECT page_id, string_agg(p, '&' ORDER BY i) AS clean FROM (SELECT page_id, unnest(string_split(query, '&')) AS p, generate_subscripts(string_split(query, '&'), 1) AS i FROM u)
  WHERE p LIKE '_%=_%' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid') GROUP BY page_id)
SELECT page_id, scheme || '://' || lower(authority) || CASE WHEN path = '/' THEN path ELSE rtrim(path, '/') END || CASE WHEN clean IS NULL THEN '' ELSE '?' || clean END AS normalized FROM u LEFT JOIN q USING (page_id)""",
)
def url_normalized(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normalized"))


@register(
    "url_classes",
    """SELECT page_id, CASE WHEN page_id = 0 THEN 'Home Page' WHEN regexp_matches(lower(url), '/product|/item|/p/|/dp/') THEN 'Product Page' WHEN regexp_matches(lower(url), '/category|/collections|/c/|/catalog') THEN 'Category Page'
  WHEN regexp_matches(lower(url), '/blog|/post|/article|/news') THEN 'Blog / Article' WHEN regexp_matches(lower(url), '/search|[?]q=|[?]s=') THEN 'Search Page' WHEN regexp_matches(lower(url), '/cart|/checkout|/basket|/order') THEN 'Cart / Checkout'
  WHEN regexp_matches(lower(url), '/account|/login|/register|/profile') THEN 'Account / Auth' WHEN regexp_matches(lower(url), '/about|/contact|/privacy|/terms|/help|/faq|/policy') THEN 'Informational / Utility' ELSE 'Content Page' END AS page_type,
  'text/html; charset=utf-8' AS mime, regexp_matches(regexp_extract(lower(url), '//([^/?#]*)', 1), '(^|[.])example[.]com$') AS internal FROM pages""",
)
def url_classes(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.page_type(u, F.col("page_id")).alias("page_type"), U.asset_mime(u).alias("mime"), U.is_internal(u, "example.com", subdomains=True).alias("internal"))


@register(
    "crawl_scope",
    f"""WITH {_PARTS} SELECT page_id, lower(authority) LIKE '%.example.net' AND page_id % 8 <= 5 AND NOT regexp_matches(url, '[?]page=') AND NOT regexp_matches(lower(path), '[.](pdf|zip|xml|js|css|json|txt)$') AS crawl FROM u""",
)
def crawl_scope(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.should_crawl(F.col("url"), (F.col("page_id") % 8).cast("int"), "example.net", subdomains=True, max_depth=5, exclude=(r"[?]page=",)).alias("crawl"))


# Pages: extraction

_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def page_features(pages: DataFrame) -> DataFrame:
    """Title and first heading by pattern alone, for rules that need no parser: nothing leaves the JVM."""
    strip = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    return pages.select("page_id", "url", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), strip(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"), F.length("html").cast("long").alias("html_size"))


def title_issues(features: DataFrame) -> DataFrame:
    sizes = features.where("title <> ''").groupBy("title").agg(F.count("*").alias("_n"))
    d = features.join(sizes, "title", "left")
    n = F.length("title")
    one = lambda t, s: F.struct(F.lit(t).alias("issue_type"), F.lit("onpage").alias("category"), F.lit(s).alias("severity"))
    fired = [F.when(n == 0, one("missing_title", "critical")), F.when((n > 0) & (n < 30), one("title_too_short", "warning")), F.when(n > 60, one("title_too_long", "warning")), F.when(F.col("_n") > 1, one("duplicate_title", "warning")), F.when(F.length("h1") > 70, one("h1_too_long", "warning")), F.when((F.col("h1") != "") & (F.lower("h1") == F.lower("title")), one("h1_identical_to_title", "info")), F.when(F.length("url") > 115, one("long_url", "warning"))]
    return d.select("page_id", "url", F.explode(F.array_compact(F.array(*fired))).alias("_i")).select("page_id", "url", "_i.*")


_FEATURES = rf"""f AS (SELECT page_id, url, trim({_TITLE}) AS title, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h1, length(html) AS html_size FROM pages),
i AS (SELECT page_id, url, 'missing_title' AS issue_type, 'critical' AS severity FROM f WHERE title = '' UNION ALL SELECT page_id, url, 'title_too_short', 'warning' FROM f WHERE title <> '' AND length(title) < 30
  UNION ALL SELECT page_id, url, 'title_too_long', 'warning' FROM f WHERE length(title) > 60 UNION ALL SELECT page_id, url, 'duplicate_title', 'warning' FROM f WHERE title <> '' AND title IN (SELECT title FROM f GROUP BY title HAVING count(*) > 1)
  UNION ALL SELECT page_id, url, 'h1_too_long', 'warning' FROM f WHERE length(h1) > 70 UNION ALL SELECT page_id, url, 'h1_identical_to_title', 'info' FROM f WHERE h1 <> '' AND lower(h1) = lower(title) UNION ALL SELECT page_id, url, 'long_url', 'warning' FROM f WHERE length(url) > 115)"""


@register(
    "issue_summary",
    f"WITH {_FEATURES} SELECT issue_type, 'onpage' AS category, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 2 ELSE 6 END AS priority, count(DISTINCT url) AS urls, count(*) AS n, round(100.0 * count(DISTINCT url) / greatest((SELECT count(*) FROM pages), 1), 1)::DOUBLE AS pct_of_total FROM i GROUP BY issue_type, severity",
)
def issue_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return aggregates.issue_summary(title_issues(page_features(pages)), pages.agg(F.count("*").alias("pages")))


@register("issue_counts", f"WITH {_FEATURES}, c AS (SELECT *, 'onpage' AS category FROM i) SELECT severity, category, count(*) AS n FROM c GROUP BY GROUPING SETS ((severity), (category), ())")
def issue_counts(spark, sf_dir):
    return aggregates.issue_counts(title_issues(page_features(table(spark, sf_dir, "pages"))))


@register(
    "health_scores",
    f"WITH {_FEATURES}, c AS (SELECT count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i, (SELECT count(*) FROM pages) AS pages FROM i) SELECT c, w, i, pages, CAST(round(least(greatest(100 - (3 * c + w + 0.2 * i) / greatest(pages, 1), 0), 100), 1) AS DOUBLE) AS health_v1, CAST(greatest(0.0, 100 - 2.0 * c - 0.5 * w) AS DOUBLE) AS health_v2 FROM c",
)
def health_scores(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return aggregates.health_v1(title_issues(page_features(pages)), pages)


@register("html_links", r"SELECT page_id, count(*) AS links, count(DISTINCT m) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS m FROM pages) GROUP BY page_id")
def html_links(spark, sf_dir):
    parsed = H.parse_pages(table(spark, sf_dir, "pages"), columns=("links",))
    return H.child(parsed, "links").groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("distinct_links"))


@register("html_features", r"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language, CAST(len(regexp_extract_all(html, '(?i)<h1[ >]')) AS INTEGER) AS h1_count, CAST(len(regexp_extract_all(html, '(?i)<h2[ >]')) AS INTEGER) AS h2_count, CAST(len(regexp_extract_all(html, '(?i)<img[ >]')) AS INTEGER) AS images FROM pages")
def html_features(spark, sf_dir):
    parsed = H.parse_pages(table(spark, sf_dir, "pages"), columns=("language", "h1_count", "h2_count", "images"))
    return parsed.select("page_id", "page.language", "page.h1_count", "page.h2_count", F.size("page.images").alias("images"))


@register("custom_extract", r"SELECT page_id, array_to_string(list_slice(regexp_extract_all(html, '(?is)<a href=\"([^\"]*)\"', 1), 1, 5), ' | ') AS links FROM pages")
def custom_extract(spark, sf_dir):
    return H.custom_extract(table(spark, sf_dir, "pages"), [{"name": "links", "type": "regex", "expression": '<a href="([^"]*)"'}]).select("page_id", "links")


@register("custom_search", "SELECT page_id, 'ads' AS search_name, lower(html) LIKE '%class=\"ad\"%' AS matched, CAST(len(regexp_extract_all(lower(html), 'class=\"ad\"')) AS BIGINT) AS n_matches FROM pages")
def custom_search(spark, sf_dir):
    return H.custom_search(table(spark, sf_dir, "pages"), [{"name": "ads", "pattern": 'class="ad"'}]).select("page_id", "search_name", "matched", "n_matches")


@register("segments", f"WITH {_PARTS}, s AS (SELECT '/' || coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[1], '') AS segment FROM u) SELECT segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM s GROUP BY segment")
def segments(spark, sf_dir):
    return aggregates.first_segments(table(spark, sf_dir, "pages"))


@register(
    "directory_tree",
    f"""WITH {_PARTS}, s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM u), x AS (SELECT '/' AS prefix FROM s UNION ALL SELECT '/' || array_to_string(list_slice(p, 1, i), '/') FROM (SELECT p, unnest(range(1, 1 + least(5, len(p)))) AS i FROM s))
SELECT prefix, count(*) AS pages, CAST(len(list_filter(string_split(prefix, '/'), lambda x: x <> '')) AS INTEGER) AS level FROM x GROUP BY prefix""",
)
def directory_tree(spark, sf_dir):
    return aggregates.directory_tree(table(spark, sf_dir, "pages"))


@register("depth_distribution", f"WITH {_PARTS}, d AS (SELECT CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM u) SELECT depth, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM d GROUP BY depth")
def depth_distribution(spark, sf_dir):
    return aggregates.distribution(table(spark, sf_dir, "pages"), U.folder_depth(F.col("url")), "depth")


@register("response_buckets", "WITH b AS (SELECT CASE WHEN value <= 0.5 * 100 THEN '0-0.5s' WHEN value <= 100 THEN '0.5-1s' WHEN value <= 200 THEN '1-2s' WHEN value <= 500 THEN '2-5s' ELSE '>5s' END AS bucket FROM events) SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM b GROUP BY bucket")
def response_buckets(spark, sf_dir):
    return aggregates.distribution(table(spark, sf_dir, "events"), aggregates.response_bucket(F.col("value") * 10), "bucket")


@register(
    "occurrences",
    rf"WITH t AS (SELECT page_id, trim({_TITLE}) AS title FROM pages) SELECT page_id, title, CASE WHEN title = '' THEN 0::BIGINT ELSE count(*) OVER (PARTITION BY title) END AS occurrences FROM t",
)
def occurrences(spark, sf_dir):
    return views.with_occurrences(page_features(table(spark, sf_dir, "pages")), "title").select("page_id", "title", "occurrences")


@register(
    "filtered_page",
    rf"""WITH t AS (SELECT page_id, url, trim({_TITLE}) AS title FROM pages), k AS (SELECT * FROM t WHERE regexp_matches(url, '(?i)/en/') AND NOT regexp_matches(url, '(?i)utm_') ORDER BY lower(title), url LIMIT 20 OFFSET 20)
SELECT page_id, url, title, CAST(row_number() OVER (ORDER BY lower(title), url) + 20 AS INTEGER) AS row_index FROM k""",
)
def filtered_page(spark, sf_dir):
    rows = views.facets(page_features(table(spark, sf_dir, "pages")).where("title not rlike '^[0-9.]+$'"), include="/en/", exclude="utm_")
    return views.page_of(rows.select("page_id", "url", "title"), sort="title", page=2, page_size=20)


# Documents: text functions

_LETTERS = r"list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{n},}}'))"


@register(
    "text_stats",
    r"""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS INTEGER) AS word_count, CAST(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length(trim(s)) > 3)) AS INTEGER) AS sentence_count,
  md5(array_to_string(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), ' ')) AS content_hash,
  array_to_string(list_filter(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')), lambda e: NOT regexp_matches(lower(e), '\.(png|jpg|jpeg|gif|svg|webp|css|js)$')).list_sort(), ',') AS emails FROM documents""",
)
def text_stats(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(t).alias("word_count"), X.sentence_count(t).alias("sentence_count"), X.content_hash(t).alias("content_hash"), F.array_join(F.array_sort(X.emails(t)), ",").alias("emails"))


@register(
    "pixel_widths",
    "WITH w(c, a, b) AS (VALUES "
    + ", ".join(f"({'chr(39)' if chr(32 + k) == chr(39) else chr(39) + chr(32 + k) + chr(39)}, {a}, {b})" for k, (a, b) in enumerate(zip(X.WIDTHS_20, X.WIDTHS_14)))
    + "), s AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) SELECT doc_id, CAST(sum(coalesce(w.a, 12)) AS BIGINT) AS width_20, CAST(sum(coalesce(w.b, 8)) AS BIGINT) AS width_14 FROM s LEFT JOIN w USING (c) GROUP BY doc_id",
)
def pixel_widths(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", X.pixel_width(text).cast("long").alias("width_20"), X.pixel_width(text, 14).cast("long").alias("width_14"))


_SYLLABLES = """s AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w FROM documents), y AS (SELECT doc_id, lower(w) AS w, regexp_replace(lower(w), '[^a-z]', '', 'g') AS b FROM s),
c AS (SELECT doc_id, CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(b, '[aeiouy]+')) - CASE WHEN b LIKE '%e' AND b NOT LIKE '%le' THEN 1 WHEN b LIKE '%ed' AND b NOT LIKE '%ted' AND b NOT LIKE '%ded' THEN 1 ELSE 0 END) END AS n FROM y)"""


@register(
    "readability",
    f"""WITH {_SYLLABLES}, a AS (SELECT doc_id, count(*) AS words, sum(n) AS syllables FROM c GROUP BY doc_id), t AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length(trim(s)) > 3)) AS sentences FROM documents),
f AS (SELECT doc_id, CAST(syllables AS BIGINT) AS syllables, CASE WHEN sentences > 0 THEN round(least(greatest(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words), 0), 100), 1) ELSE 0 END AS flesch FROM a JOIN t USING (doc_id))
SELECT *, CASE WHEN flesch >= 90 THEN 'Very Easy' WHEN flesch >= 80 THEN 'Easy' WHEN flesch >= 60 THEN 'Standard' WHEN flesch >= 30 THEN 'Difficult' ELSE 'Very Difficult' END AS label FROM f""",
)
def readability(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    counted = X.per_text(docs.select(F.struct("doc_id", X.word_count(F.col("text")).alias("words"), X.sentence_count(F.col("text")).alias("sentences")).alias("k"), "text"), "k", "text", X.text_syllables, T.LongType(), "syllables")
    d = counted.select("k.*", "syllables").where("words > 0")
    d = d.withColumn("flesch", X.flesch(F.col("words"), F.col("sentences"), F.col("syllables")))
    return d.select("doc_id", "syllables", "flesch", X.readability(F.col("flesch")).alias("label"))


_SIMHASH = f"""w AS (SELECT doc_id, unnest({_LETTERS.format(n=3)}) AS w FROM documents), v AS (SELECT doc_id, substr(md5(w), 1, 16) AS h, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT doc_id, i, sum(CASE WHEN (CAST('0x' || substr(h, CAST(i // 4 + 1 AS BIGINT), 1) AS INTEGER) >> CAST(3 - i % 4 AS INTEGER)) & 1 = 1 THEN n ELSE -n END) > 0 AS bit FROM v, range(64) r(i) GROUP BY doc_id, i),
x AS (SELECT doc_id, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM b GROUP BY doc_id),
sh AS (SELECT doc_id, CASE WHEN bits IS NULL THEN repeat('0', 16) ELSE array_to_string(list_transform(range(16), lambda k: lower(to_hex(CAST(CAST(substr(bits, CAST(4 * k + 1 AS BIGINT), 4) AS BIT) AS INTEGER)))), '') END AS simhash FROM documents LEFT JOIN x USING (doc_id))"""
_SIMHASH = _SIMHASH.replace("CAST('0x' || substr(h, CAST(i // 4 + 1 AS BIGINT), 1) AS INTEGER)", "(instr('0123456789abcdef', substr(h, CAST(i // 4 + 1 AS BIGINT), 1)) - 1)").replace(
    "lower(to_hex(CAST(CAST(substr(bits, CAST(4 * k + 1 AS BIGINT), 4) AS BIT) AS INTEGER)))",
    "substr('0123456789abcdef', 1 + 8 * CAST(substr(bits, CAST(4 * k + 1 AS BIGINT), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(4 * k + 2 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(4 * k + 3 AS BIGINT), 1) AS INTEGER) + CAST(substr(bits, CAST(4 * k + 4 AS BIGINT), 1) AS INTEGER), 1)",
)


@register("simhash", f"WITH {_SIMHASH} SELECT doc_id, simhash FROM sh")
def simhash(spark, sf_dir):
    return X.simhash(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


_HASHES = f"""{_SIMHASH}, z AS (SELECT simhash, min(doc_id) AS id, count(*) AS copies, CAST('0x' || simhash AS UBIGINT) AS h FROM sh WHERE simhash <> repeat('0', 16) GROUP BY simhash),
q AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, round(1 - bit_count(xor(a.h, b.h)) / 64, 3) AS similarity, a.copies AS copies_a, b.copies AS copies_b FROM z a JOIN z b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 6)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: pairs and partners read the hashes several times."""
    return materialize(X.simhash(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "hashes")


@register("simhash_pairs", f"WITH {_HASHES} SELECT * FROM q")
def simhash_pairs(spark, sf_dir):
    """Pairs between representatives of equal hashes; ``simhash_members`` has who they stand for."""
    return similarity.simhash_pairs(hashes(spark, sf_dir))


@register("simhash_members", f"WITH {_HASHES} SELECT doc_id, simhash, id AS representative, copies FROM sh JOIN z USING (simhash)")
def simhash_members(spark, sf_dir):
    return similarity.members(hashes(spark, sf_dir))


@register(
    "simhash_closest",
    f"""WITH {_HASHES}, ab AS (SELECT a, b, similarity, copies_b AS n FROM q UNION ALL SELECT b, a, similarity, copies_a FROM q), mem AS (SELECT doc_id, id, copies FROM sh JOIN z USING (simhash)),
nr AS (SELECT a AS id, max(similarity) AS similarity, sum(n) AS others, arg_min(b, (-similarity, b)) AS near FROM ab GROUP BY a), oth AS (SELECT id, min(doc_id) AS second FROM mem WHERE doc_id <> id GROUP BY id)
SELECT doc_id, CASE WHEN copies = 1 THEN near WHEN doc_id = mem.id THEN second ELSE mem.id END AS closest, CASE WHEN copies > 1 THEN 1.0::DOUBLE ELSE similarity END AS similarity, CAST(copies - 1 + coalesce(others, 0) AS BIGINT) AS partners
FROM mem LEFT JOIN nr USING (id) LEFT JOIN oth USING (id) WHERE copies > 1 OR near IS NOT NULL""",
)
def simhash_closest(spark, sf_dir):
    h = hashes(spark, sf_dir)
    return similarity.closest(h, similarity.simhash_pairs(h))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)
_GRAMS = f"""k AS (SELECT doc_id, list_filter({_LETTERS.format(n=2)}, lambda w: w NOT IN ({_STOP})) AS w FROM documents),
g AS (SELECT doc_id, n AS ngram_size, array_to_string(list_slice(w, i, i + n - 1), ' ') AS keyword, i FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k, (VALUES (1), (2), (3)) v(n))),
f AS (SELECT doc_id, ngram_size, keyword, count(*) AS frequency, min(i) AS first_position FROM g GROUP BY ALL)"""


@register(
    "top_ngrams",
    f"WITH {_GRAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ngram_size ORDER BY frequency DESC, first_position, keyword) AS rank FROM f) SELECT doc_id, ngram_size, keyword, frequency, CAST(rank AS INTEGER) AS rank, round(100.0 * frequency / len(w), 2) AS density FROM r JOIN k USING (doc_id) WHERE rank <= CASE ngram_size WHEN 3 THEN 5 ELSE 10 END",
)
def top_ngrams(spark, sf_dir):
    return keywords.top_ngrams(table(spark, sf_dir, "documents")).select("doc_id", "ngram_size", "keyword", "frequency", "rank", "density")


@register("cannibalised_keywords", f"WITH {_GRAMS}, t AS (SELECT doc_id, keyword AS target FROM f WHERE ngram_size = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first_position, keyword) = 1) SELECT target, count(*) AS pages, min(doc_id) AS first_page FROM t GROUP BY target HAVING count(*) > 1")
def cannibalised_keywords(spark, sf_dir):
    return keywords.cannibalised(keywords.target_keywords(table(spark, sf_dir, "documents")))


@register("global_keywords", f"WITH {_GRAMS} SELECT keyword, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS pages FROM f WHERE ngram_size = 1 GROUP BY keyword ORDER BY frequency DESC, keyword LIMIT 20")
def global_keywords(spark, sf_dir):
    grams = keywords.page_ngrams(table(spark, sf_dir, "documents"), sizes=(1,))
    return grams.groupBy("keyword").agg(F.sum("frequency").alias("frequency"), F.count("*").alias("pages")).orderBy(F.desc("frequency"), "keyword").limit(20)


@register("duplicate_content", r"WITH h AS (SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), ' ')) AS content_hash FROM documents) SELECT content_hash, count(*) AS pages, min(doc_id) AS first_doc FROM h GROUP BY content_hash HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_doc")).where("pages > 1")


# Link graph on the edge list of line items

_EDGES = "n AS (SELECT s_suppkey AS node FROM supplier UNION ALL SELECT -1 - n_nationkey FROM nation), l AS (SELECT l_suppkey AS s, (l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM supplier) + 1 AS t FROM lineitem UNION ALL SELECT s_suppkey, -1 - s_nationkey FROM supplier), e AS (SELECT DISTINCT s, t FROM l WHERE s <> t AND s IN (SELECT node FROM n) AND t IN (SELECT node FROM n))"


def supplier_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers link to suppliers by their line items and to their nation, which has no link of its own."""
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.agg(F.count("*").alias("n"))
    nodes = suppliers.select(F.col("s_suppkey").alias("node")).unionByName(table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("node")))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").crossJoin(F.broadcast(n))
    links = items.select(F.col("l_suppkey").alias("s"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.col("n") + 1).alias("t"))
    return nodes, links.unionByName(suppliers.select(F.col("s_suppkey").alias("s"), (-1 - F.col("s_nationkey")).cast("bigint").alias("t")))


def _pagerank_sql(rounds: int) -> str:
    return f"WITH {_EDGES}, {graph_sql.ranks(rounds)} SELECT node, round(1000 * r, 6) AS rank, round((r - (SELECT min(r) FROM f)) / (SELECT max(r) - min(r) FROM f) * 100, 1) AS score FROM f"


@register("pagerank", _pagerank_sql(24))
def pagerank(spark, sf_dir):
    nodes, links = supplier_graph(spark, sf_dir)
    return graph.pagerank(nodes, links, digits=1).select("node", F.round(1000 * F.col("rank"), 6).alias("rank"), "score")


@register("click_depth", f"WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT CAST(4 AS BIGINT), 0 UNION SELECT e.t, depth + 1 FROM w JOIN e ON e.s = w.node WHERE depth < 12) SELECT n.node, CAST(min(depth) AS INTEGER) AS depth FROM n LEFT JOIN w USING (node) GROUP BY n.node")
def click_depth(spark, sf_dir):
    nodes, links = supplier_graph(spark, sf_dir)
    return graph.click_depth(nodes, links, spark.range(4, 5).select(F.col("id").alias("node")))


@register("link_counts", f"WITH {_EDGES} SELECT n.node, (SELECT count(*) FROM l WHERE l.t = n.node) AS inlinks, (SELECT count(DISTINCT s) FROM l WHERE l.t = n.node) AS unique_inlinks, (SELECT count(DISTINCT t) FROM l WHERE l.s = n.node) AS unique_outlinks FROM n")
def link_counts(spark, sf_dir):
    nodes, links = supplier_graph(spark, sf_dir)
    into = links.groupBy(F.col("t").alias("node")).agg(F.count("*").alias("inlinks"), F.countDistinct("s").alias("unique_inlinks"))
    out = links.groupBy(F.col("s").alias("node")).agg(F.countDistinct("t").alias("unique_outlinks"))
    return nodes.join(into, "node", "left").join(out, "node", "left").na.fill(0)


@register("orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphans(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_HOPS = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("self", "self"), *[(f"n{k}", f"n{k + 1}") for k in range(14)]]
_HOPS_SQL = ", ".join(f"('{u}', '{t}')" for u, t in _HOPS)


@register(
    "redirect_chains",
    f"""WITH RECURSIVE h(url, target) AS (SELECT * FROM (VALUES {_HOPS_SQL}) UNION ALL SELECT 's' || s_suppkey, 's' || ((s_suppkey * 7 + 3) % 97) FROM supplier WHERE s_suppkey % 5 <> 0), w(url, path, is_loop) AS (SELECT url, [url, target], url = target FROM h UNION ALL
  SELECT w.url, list_append(path, h.target), list_contains(path, h.target) FROM w JOIN h ON h.url = path[len(path)] WHERE NOT is_loop AND len(path) < 10)
SELECT url, array_to_string(arg_max(path, len(path)), ' -> ') AS path, bool_or(is_loop) AS is_loop, CAST(max(len(path)) - 1 AS INTEGER) AS hops FROM w GROUP BY url""",
)
def redirect_chains(spark, sf_dir):
    k, name = F.col("s_suppkey"), lambda c: F.concat(F.lit("s"), c.cast("string"))
    hops = table(spark, sf_dir, "supplier").where(k % 5 != 0).select(name(k).alias("url"), name((k * 7 + 3) % 97).alias("target"))
    d = graph.redirect_chains(hops.unionByName(spark.createDataFrame(_HOPS, "url string, target string")))
    return d.select("url", F.array_join("path", " -> ").alias("path"), "is_loop", "hops")


# Snapshots

_BASE = "b AS (SELECT c_custkey AS k, c_name AS title, c_mktsegment AS h1, c_nationkey AS status_code FROM customer), o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN c_name || ' new' ELSE ' ' || c_name END AS title, c_mktsegment AS h1, c_nationkey + CASE WHEN c_custkey % 3 = 1 THEN 400 ELSE 0 END AS status_code FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT -1 - s_suppkey, s_name, '', s_nationkey FROM supplier)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers against those that have orders, some changed, and all suppliers as new pages."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    base = c.select(k.alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("h1"), F.col("c_nationkey").alias("status_code"))
    buyers = c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    changed = buyers.select(k.alias("url"), F.when(k % 11 == 0, F.concat("c_name", F.lit(" new"))).otherwise(F.concat(F.lit(" "), "c_name")).alias("title"), F.col("c_mktsegment").alias("h1"), (F.col("c_nationkey") + F.when(k % 3 == 1, 400).otherwise(0)).alias("status_code"))
    return base, changed.unionByName(table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("url"), F.col("s_name").alias("title"), F.lit("").alias("h1"), F.col("s_nationkey").alias("status_code")))


_DIFF = f"""{_BASE}, d AS (SELECT o.k AS url, 'added' AS change, '' AS before, '' AS after FROM o WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT b.k, 'removed', '', '' FROM b WHERE k NOT IN (SELECT k FROM o)
  UNION ALL SELECT b.k, 'title', trim(b.title), trim(o.title) FROM b JOIN o USING (k) WHERE trim(b.title) <> trim(o.title) UNION ALL SELECT b.k, 'status_code', CAST(b.status_code AS VARCHAR), CAST(o.status_code AS VARCHAR) FROM b JOIN o USING (k) WHERE b.status_code <> o.status_code)"""


@register("snapshot_diff", f"WITH {_DIFF} SELECT * FROM d")
def snapshot_diff(spark, sf_dir):
    return compare.diff(*snapshots(spark, sf_dir), fields=("status_code", "title", "h1"))


@register("regression_alert", f"WITH {_DIFF}, a AS (SELECT count(*) FILTER (change = 'status_code' AND CAST(after AS INTEGER) >= 400 AND CAST(before AS INTEGER) < 400) AS new_errors, count(*) FILTER (change = 'removed') AS removed, CAST(0 AS BIGINT) AS deindexed, -1.5::DOUBLE AS score_change FROM (SELECT change, CASE WHEN change = 'status_code' THEN before ELSE '0' END AS before, CASE WHEN change = 'status_code' THEN after ELSE '0' END AS after FROM d)) SELECT *, CASE WHEN new_errors > 0 THEN 'FAIL' WHEN removed > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM a")
def regression_alert(spark, sf_dir):
    return compare.regression_alert(compare.diff(*snapshots(spark, sf_dir), fields=("status_code", "title", "h1")), 90.0, 88.5)


# Logs, robots, events

_AGENTS = ("Mozilla/5.0 (compatible; Googlebot/2.1)", "Googlebot Mobile Safari", "bingbot/2.0", "Mozilla/5.0 Chrome", "DuckDuckBot/1.1")


@register(
    "access_log",
    r"""WITH l AS (SELECT event_id, '10.0.0.' || user_id || ' - - [10/Oct/2000:13:55:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ' +0000] "GET /' || event_type || ' HTTP/1.0" ' || (200 + 100 * (event_id % 4)) || ' ' || (event_id * 10) || ' "-" "' || ['"""
    + "', '".join(_AGENTS)
    + r"""'][1 + event_id % 5] || '"' AS v FROM events)
SELECT regexp_extract(v, '"GET ([^ ]+)', 1) AS path, CAST(regexp_extract(v, '" ([0-9]{3}) ', 1) AS INTEGER) AS status, CASE WHEN lower(v) LIKE '%googlebot%mobile%' THEN 'Googlebot Smartphone' WHEN lower(v) LIKE '%googlebot%' THEN 'Googlebot Desktop' WHEN lower(v) LIKE '%bingbot%' THEN 'Bingbot' WHEN lower(v) LIKE '%duckduckbot%' THEN 'DuckDuckBot' END AS bot,
  count(*) AS hits, CAST(sum(CAST(regexp_extract(v, '" [0-9]{3} ([0-9]+) ', 1) AS BIGINT)) AS BIGINT) AS bytes FROM l GROUP BY ALL""",
)
def access_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    agent = F.element_at(F.array(*[F.lit(a) for a in _AGENTS]), (k % 5 + 1).cast("int"))
    line = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" - - [10/Oct/2000:13:55:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.0" '), (200 + 100 * (k % 4)).cast("string"), F.lit(" "), (k * 10).cast("string"), F.lit(' "-" "'), agent, F.lit('"'))
    lines = e.select(F.explode(F.array(line, F.concat(F.lit("not a log line "), k.cast("string")))).alias("value"))
    return S.parse_log(lines).groupBy("path", "status", "bot").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"))


_ROBOTS = "User-agent: *\nDisallow: /private/\nAllow: /private/public/\nCrawl-delay: 1\n\nUser-agent: alpha\nUser-agent: beta\nDisallow: /fr/ # closed\nDisallow: /en/\nAllow: /en/\nSitemap: https://example.com/s.xml\n"


@register("robots_verdicts", rf"WITH {_PARTS} SELECT authority AS host, path, NOT (path LIKE '/fr/%') AS allowed FROM u GROUP BY ALL")
def robots_verdicts(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(U.authority(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    texts = paths.select("host").distinct().withColumn("text", F.lit(_ROBOTS))
    return S.robots_verdicts(S.parse_robots(texts), paths, agent="Beta")


@register("hourly_events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events"))


@register(
    "user_sessions",
    "WITH g AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 30 MINUTE AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
)
def user_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))


# The master dataset over the audit fixtures

_FX = ("fx_pages", "fx_links", "fx_images", "fx_structured")


@register(
    "enriched_pages",
    f"""WITH {values_sql(*_FX)}, p AS (SELECT *, coalesce(nullif(status_code, 0), 200) AS c, trim(coalesce(canonical, '')) AS k, coalesce(len(redirect_chain), 0) AS rn FROM fx_pages),
r AS (SELECT url, 'page' AS kind, CASE WHEN regexp_extract(url, '//([^/?#]*)', 1) = 'example.com' THEN 'Internal' ELSE 'External' END AS url_type,
  CASE WHEN c BETWEEN 400 AND 499 THEN 'Client Error (' || c || ')' WHEN c >= 500 THEN 'Server Error (' || c || ')' WHEN c BETWEEN 300 AND 399 THEN 'Redirect (' || c || ')' WHEN k <> '' AND rtrim(k, '/') <> rtrim(url, '/') THEN 'Canonicalised' WHEN coalesce(is_indexable, false) THEN 'OK' ELSE 'Blocked' END AS indexability_status,
  CASE WHEN k = '' THEN 'Missing' WHEN rtrim(k, '/') = rtrim(url, '/') THEN 'Self-Referential' ELSE 'Canonicalised' END AS canonical_status,
  (SELECT count(*) FROM fx_links l WHERE rtrim(l.target_url, '/') = rtrim(p.url, '/')) AS inlinks, (SELECT count(*) FROM fx_links l WHERE l.source_page_id = p.page_id AND is_internal) AS outlinks,
  coalesce((SELECT arg_min(source_url, link_id) FROM fx_links l WHERE rtrim(l.target_url, '/') = rtrim(p.url, '/')), CASE WHEN crawl_depth = 0 THEN url END) AS parent_url,
  CASE WHEN coalesce((SELECT count(DISTINCT lower(rtrim(x.url, '/'))) FROM unnest(redirect_chain) t(x)) < rn, false) OR status_code = 310 THEN 'Loop Detected' WHEN rn > 1 THEN 'Chain (' || rn || ' hops)' WHEN rn = 1 OR (rn = 0 AND coalesce(redirect_url, '') <> '') THEN 'Simple (1 hop)' ELSE 'None' END AS redirect_chain_type FROM p),
x AS (SELECT url, min(kind) AS kind, arg_min(parent, (kind, o)) AS parent_url FROM (SELECT src AS url, 'image' AS kind, url AS parent, page_id AS o FROM fx_images UNION ALL SELECT target_url, 'link', source_url, link_id FROM fx_links) GROUP BY url)
SELECT url, kind, url_type, indexability_status, canonical_status, inlinks, outlinks, parent_url, redirect_chain_type FROM r
UNION ALL SELECT url, kind, CASE WHEN regexp_extract(url, '//([^/?#]*)', 1) = 'example.com' THEN 'Internal' ELSE 'External' END, NULL, NULL, NULL, NULL, parent_url, NULL FROM x WHERE url NOT IN (SELECT url FROM fx_pages)""",
)
def enriched_pages(spark, sf_dir):
    d = views.enrich(tables(spark, sf_dir), "example.com")
    return d.select("url", "kind", "url_type", "indexability_status", "canonical_status", "inlinks", "outlinks", "parent_url", "redirect_chain_type")


_TAB_TABLES = ("fx_pages", "fx_links", "fx_images", "fx_headings", "fx_pagination", "fx_structured", "fx_sitemap")
_MIME = "CASE WHEN regexp_matches(split_part(lower({u}), '?', 1), '[.]png$') THEN 'image/png' WHEN regexp_matches(split_part(lower({u}), '?', 1), '[.]jpe?g$') THEN 'image/jpeg' WHEN lower({u}) LIKE '%.webp' THEN 'image/webp' WHEN lower({u}) LIKE '%.svg' THEN 'image/svg+xml' WHEN lower({u}) LIKE '%.js' THEN 'application/javascript' WHEN lower({u}) LIKE '%.css' THEN 'text/css' ELSE 'text/html; charset=utf-8' END"
#: Master rows: pages with their columns, then what was found but not crawled.
_MASTER = f"""x AS (SELECT src AS url FROM fx_images UNION SELECT target_url FROM fx_links),
e AS (SELECT page_id, url, status_code, lower(coalesce(content_type, '')) AS ct, title, meta_description, h1, canonical, redirect_url, coalesce(len(redirect_chain), 0) AS hops, CASE WHEN regexp_extract(url, '//([^/?#]*)', 1) IN ('', 'example.com') THEN 'Internal' ELSE 'External' END AS url_type,
  (SELECT count(DISTINCT source_url) FROM fx_links l WHERE rtrim(l.target_url, '/') = rtrim(p.url, '/')) AS unique_inlinks FROM fx_pages p
  UNION ALL SELECT NULL, url, NULL, lower({_MIME.format(u="url")}), NULL, NULL, NULL, NULL, NULL, 0, CASE WHEN regexp_extract(url, '//([^/?#]*)', 1) IN ('', 'example.com') THEN 'Internal' ELSE 'External' END, 1 FROM x WHERE url NOT IN (SELECT url FROM fx_pages))"""


def _tab(name: str, where: str) -> str:
    return f"SELECT '{name}' AS tab, count(*) AS n FROM e WHERE {where}"


_HTML = "ct LIKE '%html%'"
_TABS = " UNION ALL ".join(
    _tab(n, w)
    for n, w in {
        "all": "true", "internal": "url_type = 'Internal'", "external": "url_type = 'External'", "response_codes": "true", "page_titles": f"{_HTML} OR trim(coalesce(title, '')) <> ''", "meta_description": f"{_HTML} OR trim(coalesce(meta_description, '')) <> ''", "meta_keywords": _HTML, "h1": f"{_HTML} OR trim(coalesce(h1, '')) <> ''",
        "h2": f"{_HTML} OR page_id IN (SELECT page_id FROM fx_headings WHERE lower(tag) = 'h2')", "content": _HTML, "images": "ct LIKE '%image%'", "canonicals": f"{_HTML} OR trim(coalesce(canonical, '')) <> ''", "pagination": f"{_HTML} OR page_id IN (SELECT page_id FROM fx_pagination)", "hreflang": _HTML, "javascript": _HTML, "links": _HTML,
        "structured_data": f"{_HTML} OR page_id IN (SELECT page_id FROM fx_structured)", "sitemaps": "rtrim(url, '/') IN (SELECT rtrim(url, '/') FROM fx_sitemap)", "pagespeed": _HTML, "mobile": _HTML, "accessibility": _HTML, "amp": _HTML, "custom_extraction": "true", "custom_search": "true", "orphans": "unique_inlinks = 0",
        "redirect_chains": "status_code BETWEEN 300 AND 399 OR trim(coalesce(redirect_url, '')) <> '' OR hops > 0",
    }.items()
)


@register("tabs", f"WITH {values_sql(*_TAB_TABLES)}, {_MASTER} {_TABS}")
def tabs(spark, sf_dir):
    t = tables(spark, sf_dir)
    return views.tab_counts(views.enrich(t, "example.com"), t)


_KINDS = "CASE WHEN ct LIKE '%html%' THEN 'html' WHEN ct LIKE '%javascript%' OR lower(url) LIKE '%.js' THEN 'javascript' WHEN ct LIKE '%css%' OR lower(url) LIKE '%.css' THEN 'css' WHEN ct LIKE '%image%' THEN 'images' WHEN ct LIKE '%pdf%' OR lower(url) LIKE '%.pdf' THEN 'pdf' ELSE 'other' END"
_GOOD = "page_id IS NOT NULL AND coalesce(nullif(status_code, 0), 200) < 300 AND (trim(coalesce(canonical, '')) = '' OR rtrim(canonical, '/') = rtrim(url, '/')) AND page_id IN (SELECT page_id FROM fx_pages WHERE is_indexable)"


@register(
    "workspace_tree",
    f"""WITH {values_sql(*_TAB_TABLES)}, {_MASTER}, k AS (SELECT *, {_KINDS} AS kind, url_type = 'Internal' AS inside FROM e), a AS (SELECT count(*) AS c, count(*) FILTER (inside) AS i FROM k),
r AS (SELECT 'encountered' AS node, count(*) AS n, 1 AS g FROM k UNION ALL SELECT 'crawled', count(page_id), 1 FROM k UNION ALL SELECT 'internal', count(*) FILTER (inside), 1 FROM k UNION ALL SELECT 'external', count(*) FILTER (NOT inside), 1 FROM k
  UNION ALL SELECT 'internal_indexable', count(*) FILTER (inside AND {_GOOD}), 2 FROM k UNION ALL SELECT 'internal_non_indexable', count(*) FILTER (inside AND NOT ({_GOOD})), 2 FROM k UNION ALL SELECT 'internal_' || x, (SELECT count(*) FROM k WHERE inside AND kind = x), 2 FROM (VALUES ('html'), ('javascript'), ('css'), ('images'), ('pdf'), ('other')) v(x))
SELECT node, n, round(100.0 * n / greatest(CASE g WHEN 1 THEN c ELSE i END, 1), 1)::DOUBLE AS pct FROM r, a""",
)
def workspace_tree(spark, sf_dir):
    return views.workspace_tree(views.enrich(tables(spark, sf_dir), "example.com"))


@register(
    "link_scores",
    f"WITH {values_sql('fx_pages', 'fx_links')}, i AS (SELECT rtrim(target_url, '/') AS k, count(DISTINCT source_url) AS u FROM fx_links GROUP BY 1) SELECT page_id, CAST(round(CASE WHEN coalesce(internal_pagerank, 0) > 0 THEN least(internal_pagerank * 100, 100) ELSE least(100.0 * coalesce(u, 0) / (SELECT count(*) FROM fx_pages), 100) END, 2) AS DOUBLE) AS link_score FROM fx_pages LEFT JOIN i ON i.k = rtrim(url, '/')",
)
def link_scores(spark, sf_dir):
    pages = views.enrich(tables(spark, sf_dir), "example.com").where("page_id is not null")
    return views.link_score(pages).select("page_id", "link_score")


@register("result_previews", f"WITH {values_sql('fx_pages')} SELECT url, coalesce(nullif(title, ''), 'No title set') AS title, coalesce(nullif(meta_description, ''), 'No meta description set for this webpage.') AS description FROM fx_pages")
def result_previews(spark, sf_dir):
    return views.result_preview(tables(spark, sf_dir)["fx_pages"])


@register("page_lengths", f"WITH {_FEATURES} SELECT page_id, CAST(length(trim(title)) AS INTEGER) AS title_length, CAST(length(h1) AS INTEGER) AS h1_length, 'OK' AS status FROM f")
def page_lengths(spark, sf_dir):
    d = page_features(table(spark, sf_dir, "pages")).withColumns({"meta_description": F.lit(None).cast("string"), "status_code": F.lit(200)})
    return views.preset(views.lengths(d), "all").select("page_id", "title_length", "h1_length", "status")


@register("size_sorted_pages", f"WITH {_FEATURES} SELECT page_id, url, CAST(row_number() OVER (ORDER BY html_size DESC, url) AS INTEGER) AS row_index FROM f ORDER BY html_size DESC, url LIMIT 30")
def size_sorted_pages(spark, sf_dir):
    return views.page_of(page_features(table(spark, sf_dir, "pages")), sort="size", page_size=30).select("page_id", "url", "row_index")


@register("url_search", f"WITH {_FEATURES} SELECT page_id FROM f WHERE regexp_matches(url, '(?i)/de/.*[0-9]{{3}}') OR regexp_matches(title, '(?i)/de/.*[0-9]{{3}}') OR regexp_matches(h1, '(?i)/de/.*[0-9]{{3}}')")
def url_search(spark, sf_dir):
    return views.facets(page_features(table(spark, sf_dir, "pages")), q="/DE/.*[0-9]{3}").select("page_id")


@register(
    "export_urls",
    f"""WITH {values_sql(*_TAB_TABLES)}, {_MASTER} SELECT e.url AS "URL", url_type AS "URL Type", e.status_code AS "Status Code", trim(split_part(coalesce(p.content_type, {_MIME.format(u="e.url")}), ';', 1)) AS "MIME Type", p.lang AS "Language", p.html_size AS "Page Size (Bytes)" FROM e LEFT JOIN fx_pages p USING (page_id)""",
)
def export_urls(spark, sf_dir):
    from ..operators import exports

    t = tables(spark, sf_dir)
    full = exports.urls_csv(views.enrich(t, "example.com"), t["fx_links"].select(F.lit(None).cast("bigint").alias("page_id")))
    assert len(full.columns) == 28
    return full.select("URL", "URL Type", "Status Code", "MIME Type", "Language", "Page Size (Bytes)")


@register("sitemap_rows", f"WITH {values_sql('fx_pages')} SELECT url, CAST(CASE coalesce(crawl_depth, 0) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS priority FROM fx_pages WHERE status_code = 200 AND coalesce(is_indexable, false) AND lower(content_type) LIKE '%html%' AND (trim(coalesce(canonical, '')) = '' OR rtrim(trim(canonical), '/') = rtrim(url, '/'))")
def sitemap_rows(spark, sf_dir):
    return views.sitemap_rows(tables(spark, sf_dir)["fx_pages"])


@register("crawl_graph_edges", f"WITH {values_sql('fx_pages', 'fx_links')}, n AS (SELECT p.url FROM fx_pages p LEFT JOIN (SELECT target_url, count(*) AS c FROM fx_links WHERE is_internal GROUP BY 1) i ON i.target_url = p.url ORDER BY coalesce(crawl_depth, 99) <> 0, coalesce(c, 0) DESC, crawl_depth NULLS LAST, p.url LIMIT 6) SELECT DISTINCT source_url, target_url FROM fx_links WHERE is_internal AND source_url IN (SELECT url FROM n) AND target_url IN (SELECT url FROM n)")
def crawl_graph_edges(spark, sf_dir):
    t = tables(spark, sf_dir)
    return views.crawl_graph(t["fx_pages"], t["fx_links"], most_nodes=6)[1]


@register("upsert_latest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def upsert_latest(spark, sf_dir):
    """Latest row for each key, as an upsert leaves it: an aggregate instead of a sort."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_orderstatus", "o_orderkey").alias("o_orderstatus"))


@register("resource_totals", f"WITH {values_sql('fx_resources')} SELECT resource_type, count(*) AS n, count(*) FILTER (is_render_blocking) AS blocking, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM fx_resources GROUP BY resource_type")
def resource_totals(spark, sf_dir):
    g = tables(spark, sf_dir)["fx_resources"].groupBy("resource_type").agg(F.count("*").alias("n"), F.count_if("is_render_blocking").alias("blocking"))
    total = tables(spark, sf_dir)["fx_resources"].agg(F.count("*").alias("_total"))
    return aggregates.with_total(g, total).withColumn("pct", aggregates.share(F.col("n"), F.col("_total"))).drop("_total")


