"""URL scalars as Column expressions; only relative resolution needs Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

#: Query parameters that tracking adds.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
#: Page types by the first list of fragments that a lower-cased URL holds.
PAGE_TYPES = (
    ("Product Page", ("/product", "/item", "/p/", "/dp/")),
    ("Category Page", ("/category", "/collections", "/c/", "/catalog")),
    ("Blog / Article", ("/blog", "/post", "/article", "/news")),
    ("Search Page", ("/search", "?q=", "?s=")),
    ("Cart / Checkout", ("/cart", "/checkout", "/basket", "/order")),
    ("Account / Auth", ("/account", "/login", "/register", "/profile")),
    ("Informational / Utility", ("/about", "/contact", "/privacy", "/terms", "/help", "/faq", "/policy")),
)
#: Media types by the end of the lower-cased URL without its query.
MIMES = (
    ((".jpg", ".jpeg"), "image/jpeg"), ((".png",), "image/png"), ((".webp",), "image/webp"), ((".svg",), "image/svg+xml"), ((".gif",), "image/gif"),
    ((".css",), "text/css"), ((".js",), "application/javascript"), ((".pdf",), "application/pdf"), ((".xml",), "application/xml"), ((".json",), "application/json"),
    ((".woff", ".woff2", ".ttf"), "font/woff2"),
)
HTML_MIME = "text/html; charset=utf-8"
#: Fixed values of the crawl scope: paths of servers and content systems, delivery networks, action parameters, file extensions.
ADMIN_PATHS = ("/wp-admin", "/wp-login", "/wp-includes", "/wp-content/plugins", "/xmlrpc.php", "/wp-cron.php", "/readme.html", "/license.txt", "/admin", "/administrator", "/cpanel", "/whm", "/phpmyadmin", "/webmail", "/server-status", "/server-info", "/cgi-bin", "/.git", "/.env", "/.htaccess", "/.user.ini", "/web.config")
CDN_PATHS = ("/cdn-cgi/", "/cdn/", "/cdn-assets/", "/wp-content/uploads/cache/")
ACTIONS = ("action=login", "action=logout", "action=register", "add-to-cart=", "wc-ajax=", "wp_service_worker=")
CDN_HOSTS = ("cdn.", "assets.", "static.", "media.", "images.", "img.")
EXTENSIONS = tuple(
    "pdf zip gz tar bz2 7z rar exe dmg iso bin doc docx xls xlsx ppt pptx csv txt md markdown jpg jpeg png gif svg webp avif ico bmp tif tiff mp4 mp3 wav webm ogg avi mov wmv m4v css js json xml map woff woff2 ttf eot otf yaml yml rss atom".split()
)
MAX_SEGMENTS, MAX_REPEATS, MAX_PARAMS = 10, 3, 5


def any_of(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host with port and user, as the part between ``//`` and the next delimiter."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def rstrip_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def folder_depth(url: Column) -> Column:
    return F.size(segments(url))


def pretty(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url), rstrip_slash(path(url)))


def url_hash(url: Column) -> Column:
    """The first 16 hex digits of the MD5 digest: an unsigned 64-bit key without the overflow."""
    return F.substring(F.md5(url.cast("binary")), 1, 16)


def hash_bits(hex16: Column) -> Column:
    """A 16-digit hex hash as a signed 64-bit number with the same bits."""
    return F.conv(hex16, 16, -10).cast("bigint")


def params(url: Column) -> Column:
    """Parameters with a value, as structs of name and value in order."""
    pair = F.transform(F.split(query(url), "&"), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
    return F.filter(pair, lambda p: (p["v"] != "") & (p["k"] != ""))


def _form(text: Column) -> Column:
    """Form-encode what was encoded before, in one spelling."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_absolute(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking or blank parameters, no trailing slash except of the root."""
    kept = F.filter(params(url), lambda p: ~p["k"].isin(*TRACKING))
    clean = F.array_join(F.transform(kept, lambda p: F.concat(_form(p["k"]), F.lit("="), _form(p["v"]))), "&")
    where = path(url)
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), F.when(where == "/", where).otherwise(rstrip_slash(where)), F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(""))


@F.pandas_udf(T.StringType())
def resolve(url, base):  # noqa: ANN001, ANN201
    """Resolve references against their base; null stays null, what can't be resolved stays as it is."""
    import pandas as pd
    from urllib.parse import urljoin

    def one(u, b):
        if u is None:
            return None
        try:
            return urljoin(b or "", u)
        except ValueError:
            return u

    return pd.Series([one(u, b) for u, b in zip(url, base)], dtype=object)


def normalize(url: Column, base: Column | None = None) -> Column:
    """Normalise a reference; absolute URLs never leave the JVM when no base is given."""
    return normalize_absolute(url if base is None else resolve(url, base))


def asset_mime(url: Column) -> Column:
    bare = F.split(F.lower(url), r"\?")[0]
    out = None
    for ends, mime in MIMES:
        hit = any_of(bare.endswith(e) for e in ends)
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    return out.otherwise(HTML_MIME)


def page_type(url: Column, depth: Column) -> Column:
    low, out = F.lower(url), F.when(depth == 0, "Home Page")
    for name, parts in PAGE_TYPES:
        out = out.when(any_of(low.contains(p) for p in parts), name)
    return out.otherwise("Content Page")


def without_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def is_internal(url: Column, domain: str, subdomains: bool = False, allowed: tuple[str, ...] = ()) -> Column:
    own = without_www(F.lit(domain))
    host = without_www(authority(url))
    out = host == own
    if subdomains:
        out = out | host.endswith(F.concat(F.lit("."), own)) | own.endswith(F.concat(F.lit("."), host))
    for a in allowed:
        a = a.lower().removeprefix("www.")
        out = out | (host == a) | host.endswith(f".{a}")
    return out


def should_crawl(
    url: Column, depth: Column, domain: str, *, subdomains: bool = False, allowed: tuple[str, ...] = (), block: tuple[str, ...] = (), allow: tuple[str, ...] = (),
    max_depth: int | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (),
) -> Column:
    """Whether a URL is in the crawl's scope; allow-listed internal URLs pass every later filter."""
    where, bare = F.lower(path(url)), rstrip_slash(url)
    listed = lambda urls: any_of(bare == u.rstrip("/") for u in urls)
    bad = F.lit(False) if max_depth is None else depth > max_depth
    if include:
        bad = bad | ~any_of(url.rlike(p) for p in include)
    bad = bad | any_of(url.rlike(p) for p in exclude)
    bad = bad | any_of(where.startswith(p) | where.contains(p + "/") | where.endswith(p) for p in ADMIN_PATHS)
    bad = bad | any_of(where.contains(p) for p in CDN_PATHS) | any_of(F.lower(query(url)).contains(a) for a in ACTIONS)
    bad = bad | any_of(F.lower(authority(url)).startswith(h) for h in CDN_HOSTS)
    bad = bad | (where.contains(".") & F.element_at(F.split(where, r"\."), -1).isin(*EXTENSIONS)) | scheme(url).isin("mailto", "tel", "javascript")
    parts = segments(url)
    bad = bad | (F.size(parts) > MAX_SEGMENTS) | (F.size(F.array_distinct(parts)) < F.size(parts) - MAX_REPEATS)
    bad = bad | (F.size(F.array_distinct(F.transform(params(url), lambda p: p["k"]))) > MAX_PARAMS)
    return F.coalesce(is_internal(url, domain, subdomains, allowed) & ~listed(block) & (listed(allow) | ~bad), F.lit(False))


def encoded(url: Column) -> Column:
    return F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
