"""Technology, cookie, size and time fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .urls import any_of

#: A technology is present when the lower-cased page holds one of the strings. (category, name, strings)
PAGE_TECHNOLOGIES = (
    ("cms", "Shopify", ("cdn.shopify.com", "shopify.theme", "window.shopify", "myshopify.com")),
    ("cms", "WordPress", ("wp-content", "wp-includes", 'name="generator" content="wordpress')),
    ("cms", "WooCommerce", ("woocommerce", "wc-ajax")),
    ("cms", "Webflow", ("webflow", "data-wf-page")),
    ("cms", "Wix", ("wix.com", "_wix", "wix-warmup-data")),
    ("cms", "Squarespace", ("squarespace",)),
    ("cms", "Magento", ("magento", "mage/cookies")),
    ("cms", "Drupal", ("drupal",)),
    ("cms", "Ghost", ("ghost.org", "ghost-root")),
    ("cms", "PrestaShop", ("prestashop",)),
    ("framework", "Next.js", ("__next_data__", "_next/static")),
    ("framework", "React", ("__next_data__", "_next/static", "react")),
    ("framework", "Nuxt", ("__nuxt__",)),
    ("framework", "Vue.js", ("__nuxt__", "vue", "data-v-")),
    ("framework", "Angular", ("angular", "ng-version")),
    ("framework", "Svelte", ("svelte",)),
    ("framework", "Alpine.js", ("alpine", "x-data=")),
    ("framework", "jQuery", ("jquery",)),
    ("framework", "Tailwind CSS", ("tailwind",)),
    ("framework", "Bootstrap", ("bootstrap",)),
    ("analytics", "Google Analytics 4 (GA4)", ("gtag('config', 'g-", "googletagmanager.com/gtag/js?id=g-", "analytics.js")),
    ("analytics", "Universal Analytics (legacy)", ("ua-", "_gaq")),
    ("analytics", "Plausible Analytics", ("plausible",)),
    ("analytics", "Fathom Analytics", ("fathom",)),
    ("analytics", "Matomo", ("matomo", "piwik")),
    ("analytics", "Hotjar", ("hotjar",)),
    ("analytics", "Microsoft Clarity", ("clarity.ms",)),
    ("analytics", "Mixpanel", ("mixpanel",)),
    ("tag_manager", "Google Tag Manager", ("googletagmanager.com/gtm.js", "gtm-")),
    ("tag_manager", "Tealium", ("tealium",)),
    ("marketing_trackers", "Meta Pixel (Facebook)", ("connect.facebook.net", "fbq(")),
    ("marketing_trackers", "TikTok Pixel", ("analytics.tiktok.com", "ttq")),
    ("marketing_trackers", "Google Ads / DoubleClick", ("googleadservices.com", "gtag('config', 'aw-", "doubleclick.net")),
    ("marketing_trackers", "Klaviyo", ("static.klaviyo.com", "_learnq")),
    ("marketing_trackers", "Pinterest Tag", ("pintrk",)),
    ("marketing_trackers", "Twitter/X Pixel", ("static.ads-twitter.com", "twq(")),
    ("marketing_trackers", "Criteo", ("criteo",)),
)
#: Servers by the first string that the header holds.
SERVERS = (("cloudflare", "Cloudflare"), ("nginx", "Nginx"), ("apache", "Apache"), ("litespeed", "LiteSpeed"), ("openresty", "OpenResty"), ("caddy", "Caddy"), ("microsoft-iis", "Microsoft-IIS"))
#: What stands for a category without a hit.
NONE_FOUND = {"cms": "Custom / Headless", "framework": "HTML5 / Vanilla JS", "analytics": "None detected", "tag_manager": "None detected", "marketing_trackers": "None detected"}


def technologies(html: Column) -> Column:
    """array<struct<category, name>> of what a page shows, with the category's default where nothing shows."""
    low = F.lower(F.coalesce(html, F.lit("")))
    out = []
    for category, default in NONE_FOUND.items():
        found = [F.when(any_of(low.contains(s) for s in strings), F.lit(name)) for c, name, strings in PAGE_TECHNOLOGIES if c == category]
        if category == "tag_manager":
            found.append(F.when(low.contains("adobe") & low.contains("satellite"), "Adobe Experience Platform Launch"))
        names = F.array_compact(F.array(*found))
        names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))
        out.append(F.transform(names, lambda n: F.struct(F.lit(category).alias("category"), n.alias("name"))))  # noqa: B023
    return F.concat(*out)


def server(header: Column) -> Column:
    low, out = F.lower(F.coalesce(header, F.lit(""))), None
    for part, name in SERVERS:
        out = F.when(low.contains(part), name) if out is None else out.when(low.contains(part), name)
    return out.when(low != "", header).otherwise("Standard Web Server")


def format_size(size: Column) -> Column:
    """A size in units of 1,024 with two decimals; exact halves go to the even hundredth, as C and Python print them (``format_string`` rounds them up)."""

    def of(unit: int, name: str) -> Column:
        whole = size.cast("long")
        rest = F.pmod(whole, F.lit(unit)) * 100
        # Hundredths of the last unit, and twice what is left of one.
        part, twice = F.floor(rest / unit), F.pmod(rest, F.lit(unit)) * 2
        up = ((twice > unit) | ((twice == unit) & (part % 2 == 1))).cast("long")
        hundredths = F.floor(whole / unit) * 100 + part + up
        return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {name}"))

    return F.when(size >= 1048576, of(1048576, "Mb")).when(size >= 1024, of(1024, "Kb")).otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))


def seconds_text(ms: Column) -> Column:
    return F.format_string("%.2fs", F.when(ms > 0, ms / 1000.0).otherwise(0.0))


def set_cookie(text: Column) -> Column:
    """A Set-Cookie header as a struct; null without a name and value."""
    parts = F.transform(F.split(text, ";"), lambda p: F.trim(p))
    first, rest = parts[0], F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    of = lambda name: F.coalesce(F.try_element_at(F.transform(F.filter(rest, lambda p: F.lower(p).startswith(name + "=")), lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1)), F.lit(-1)), F.lit("/" if name == "path" else ""))
    flag = lambda name: F.exists(rest, lambda p: F.lower(p) == name)
    made = F.struct(F.regexp_extract(first, "^([^=]*)", 1).alias("name"), F.regexp_extract(first, "^[^=]*=(.*)$", 1).alias("value"), of("domain").alias("domain"), of("path").alias("path"), of("expires").alias("expires"), flag("secure").alias("secure"), flag("httponly").alias("httponly"), of("samesite").alias("samesite"))
    return F.when(text.contains("="), made)


_COOKIE = "array<struct<name:string,value:string,domain:string,path:string,expires:string,secure:boolean,httponly:boolean,samesite:string>>"


def cookies(text: Column) -> Column:
    """Cookies of a JSON list of objects, or of one Set-Cookie header."""
    listed = F.from_json(text, _COOKIE)
    filled = F.transform(listed, lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["value"], F.lit("")).alias("value"), F.coalesce(c["domain"], F.lit("")).alias("domain"), F.coalesce(c["path"], F.lit("/")).alias("path"), F.coalesce(c["expires"], F.lit("")).alias("expires"), F.coalesce(c["secure"], F.lit(False)).alias("secure"), F.coalesce(c["httponly"], F.lit(False)).alias("httponly"), F.coalesce(c["samesite"], F.lit("")).alias("samesite")))
    return F.when(F.ltrim(text).startswith("["), filled).otherwise(F.array_compact(F.array(set_cookie(text))))


def script_share(raw_words: Column, rendered_words: Column) -> Column:
    """Share of the rendered words that scripts added, in percent."""
    return F.when(rendered_words > 0, F.round(100.0 * F.greatest(rendered_words - raw_words, F.lit(0)) / rendered_words, 1)).otherwise(0.0)


#: Delivery networks by strings of the server header, header names, strings of any header, strings of the page.
NETWORKS = (
    ("Cloudflare", ("cloudflare",), ("cf-ray", "cf-cache-status"), (), ()), ("Fastly", ("fastly",), ("x-fastly-request-id",), ("fastly",), ()), ("Amazon CloudFront", (), ("x-amz-cf-id",), ("cloudfront",), ("cloudfront.net",)),
    ("Shopify CDN", (), (), (), ("cdn.shopify.com",)), ("Akamai", ("akamai",), (), ("x-akamai",), ()), ("BunnyCDN", (), (), (), ("bunnycdn", "b-cdn.net")),
)
NO_NETWORK = "Direct Origin (No CDN detected)"


def networks(headers: Column, html: Column) -> Column:
    """The delivery networks that a response shows, or that there is none."""
    low = F.lower(F.coalesce(html, F.lit("")))
    named = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    names, every = F.map_keys(named), F.lower(F.array_join(F.transform(F.map_entries(named), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), " "))
    who = F.lower(F.coalesce(F.try_element_at(named, F.lit("server")), F.lit("")))
    no = F.lit(False)
    found = [F.when(any_of([no, *[who.contains(s) for s in by_server], *[F.array_contains(names, h) for h in by_name], *[every.contains(s) for s in by_any], *[low.contains(s) for s in by_page]]), F.lit(name)) for name, by_server, by_name, by_any, by_page in NETWORKS]
    hits = F.array_compact(F.array(*found))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(NO_NETWORK)))


def duration_text(start: Column, end: Column) -> Column:
    """The time between two moments as ``2h 3m 4s``, without leading zeros; a second at least."""
    s = F.greatest(F.timestamp_diff("SECOND", start, end), F.lit(1))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    t = lambda c, u: F.concat(c.cast("string"), F.lit(u))
    return F.when(h > 0, F.concat_ws(" ", t(h, "h"), t(m, "m"), t(r, "s"))).when(m > 0, F.concat_ws(" ", t(m, "m"), t(r, "s"))).otherwise(t(r, "s"))


def date_text(moment: Column) -> Column:
    return F.date_format(moment, "MMM dd, yyyy HH:mm:ss")


def console_counts(levels: Column) -> list[Column]:
    """Numbers of errors, warnings, notes and debug lines of an array of console levels."""
    n = lambda name, *of: F.coalesce(F.size(F.filter(levels, lambda x: F.lower(x).isin(*of))), F.lit(0)).alias(name)
    return [n("js_errors", "error"), n("js_warnings", "warning", "warn"), n("js_info", "info"), n("js_debug", "debug", "verbose")]


def needs_scripts(html: Column) -> Column:
    """Whether a page seems empty without scripts: little text with many scripts, an application's root, or a plea to switch them on."""
    h = F.coalesce(html, F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), "<[^>]*>", ""))
    scripts = F.regexp_count(h, F.lit(r"(?i)<script\b[^>]*\bsrc\s*="))
    root = h.rlike(r"(?i)\bid\s*=\s*[\"']?(root|app|__next|vue-app)[\"'\s>]")
    return ((F.length(text) < 500) & (scripts > 3)) | root | F.lower(F.regexp_extract(h, r"(?is)<noscript\b[^>]*>(.*?)</noscript>", 1)).contains("javascript")


def has_media_query(html: Column) -> Column:
    h = F.coalesce(html, F.lit(""))
    return h.contains("@media") | h.rlike(r"(?i)<link\b[^>]*\bmedia\s*=")
