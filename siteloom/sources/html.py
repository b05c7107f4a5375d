"""HTML pages to features and child relations: one parse of each page in Arrow batches, exploded by Spark."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import is_pattern
from . import xpath
from .references import Markup

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = _struct(tag=S, href=S, rel=S, hreflang=S, target=S, text=S, nofollow=B)
IMAGE = _struct(src=S, alt=S, width=S, height=S, format=S, is_lazy_loaded=B, has_dimensions=B)
HEADING = _struct(tag=S, level=I, text=S)
DATA = _struct(format=S, schema_type=S, data_json=S, is_valid=B)
RESOURCE = _struct(url=S, resource_type=S, is_render_blocking=B)
FORM = _struct(action=S, method=S, form_id=S, has_password=B, is_search=B)
FRAME = _struct(src=S, title=S, loading=S)
LANGUAGE = _struct(lang_code=S, target_url=S)
PAGINATION = _struct(rel_type=S, target_url=S)
PROPERTY = _struct(format=S, name=S, value=S)
PAGE = _struct(
    title=S, meta_description=S, meta_keywords=S, meta_robots=S, viewport=S, canonical_url=S, language=S, amp_url=S, mobile_url=S, h1=S, h1_count=I, h2_count=I,
    word_count=I, sentence_count=I, text_length=I, content_hash=S, body_text=S, dom_size=I, has_media_query=B, og=T.MapType(S, S), twitter=T.MapType(S, S),
    links=T.ArrayType(LINK), images=T.ArrayType(IMAGE), headings=T.ArrayType(HEADING), structured_data=T.ArrayType(DATA), resources=T.ArrayType(RESOURCE), forms=T.ArrayType(FORM),
    iframes=T.ArrayType(FRAME), hreflang=T.ArrayType(LANGUAGE), pagination=T.ArrayType(PAGINATION), properties=T.ArrayType(PROPERTY),
)
CHILDREN = ("links", "images", "headings", "structured_data", "resources", "forms", "iframes", "hreflang", "pagination", "properties")
SILENT = frozenset(("script", "style", "template", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CUT = 200


class PageParser(Markup):
    """Collects what the relations need in document order."""

    def __init__(self):
        super().__init__()
        self.page = {f.name: None for f in PAGE.fields} | {c: [] for c in CHILDREN} | {"og": {}, "twitter": {}, "dom_size": 0, "has_media_query": False}
        self.text: list[str] = []
        self.silent, self.capture, self.form = 0, [], None
        self.script: list[str] | None = None
        self.style: list[str] | None = None
        self.title: list[str] | None = None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        a = {k: self.plain(v) for k, v in reversed(attrs)}
        p = self.page
        p["dom_size"] += 1
        if tag in SILENT:
            self.silent += tag != "noscript"
        if tag == "html":
            p["language"] = p["language"] or a.get("lang")
        elif tag == "title" and p["title"] is None:
            self.title = []
        elif tag == "meta":
            name, content = (a.get("name") or "").lower(), a.get("content")
            for key, field in (("description", "meta_description"), ("keywords", "meta_keywords"), ("robots", "meta_robots"), ("viewport", "viewport")):
                if name == key and p[field] is None and content is not None:
                    p[field] = content.strip()
            prop = (a.get("property") or name).lower()
            if prop.startswith("og:"):
                p["og"].setdefault(prop, content)
            if prop.startswith("twitter:"):
                p["twitter"].setdefault(prop, content)
            if (a.get("http-equiv") or "").lower() == "content-language":
                p["language"] = p["language"] or content
        elif tag == "link":
            rel, href = (a.get("rel") or "").lower().split(), a.get("href")
            if href:
                if "canonical" in rel and p["canonical_url"] is None:
                    p["canonical_url"] = href.strip()
                if "alternate" in rel and a.get("hreflang"):
                    p["hreflang"].append({"lang_code": a["hreflang"], "target_url": href})
                elif "alternate" in rel and a.get("media") and p["mobile_url"] is None:
                    p["mobile_url"] = href
                if "amphtml" in rel and p["amp_url"] is None:
                    p["amp_url"] = href
                for kind in ("next", "prev"):
                    if kind in rel:
                        p["pagination"].append({"rel_type": kind, "target_url": href})
                if "stylesheet" in rel:
                    p["resources"].append({"url": href, "resource_type": "css", "is_render_blocking": a.get("media", "all") in ("", "all", "screen")})
        elif tag == "script":
            kind = (a.get("type") or "").lower()
            if kind == "application/ld+json":
                self.script = []
            elif a.get("src"):
                p["resources"].append({"url": a["src"], "resource_type": "js", "is_render_blocking": "async" not in a and "defer" not in a and kind != "module"})
        elif tag == "style":
            self.style = []
        elif tag in ("a", "area") and a.get("href") is not None:
            rel = a.get("rel") or ""
            link = {"tag": tag, "href": a["href"], "rel": rel, "hreflang": a.get("hreflang"), "target": a.get("target"), "text": "", "nofollow": "nofollow" in rel.lower().split()}
            p["links"].append(link)
            if tag == "a":
                self.capture.append(("a", [], link))
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or ""
            bare = src.split("?")[0].rsplit("/", 1)[-1]
            p["images"].append({"src": src, "alt": a.get("alt"), "width": a.get("width"), "height": a.get("height"), "format": bare.rsplit(".", 1)[-1].lower() if "." in bare else "", "is_lazy_loaded": (a.get("loading") or "").lower() == "lazy", "has_dimensions": bool(a.get("width") and a.get("height"))})
        elif re.fullmatch("h[1-6]", tag):
            heading = {"tag": tag, "level": int(tag[1]), "text": ""}
            p["headings"].append(heading)
            self.capture.append((tag, [], heading))
        elif tag == "form":
            self.form = {"action": a.get("action") or "", "method": (a.get("method") or "get").lower(), "form_id": a.get("id"), "has_password": False, "is_search": (a.get("role") or "") == "search"}
            p["forms"].append(self.form)
        elif tag == "input" and self.form is not None:
            kind = (a.get("type") or "").lower()
            self.form["has_password"] |= kind == "password"
            self.form["is_search"] |= kind == "search" or (a.get("name") or "").lower() in ("q", "s", "search", "query")
        elif tag == "iframe":
            p["iframes"].append({"src": a.get("src") or "", "title": a.get("title"), "loading": a.get("loading")})
        for key, form in (("itemprop", "microdata"), ("itemtype", "microdata"), ("property", "rdfa"), ("typeof", "rdfa")):
            if a.get(key) and not (tag == "meta" and key == "property"):
                p["properties"].append({"format": form, "name": a[key], "value": (a.get("content") or a.get("href") or "")[:CUT]})

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - (tag != "noscript"))
        if tag == "title" and self.title is not None:
            self.page["title"], self.title = " ".join("".join(self.title).split()), None
        elif tag == "script" and self.script is not None:
            self._data("".join(self.script))
            self.script = None
        elif tag == "style" and self.style is not None:
            self.page["has_media_query"] |= "@media" in "".join(self.style)
            self.style = None
        elif tag == "form":
            self.form = None
        for k in range(len(self.capture) - 1, -1, -1):
            if self.capture[k][0] == tag:
                self._close(self.capture.pop(k))
                break

    def handle_data(self, data):
        data = self.plain(data)
        if self.title is not None:
            self.title.append(data)
        elif self.script is not None:
            self.script.append(data)
        elif self.style is not None:
            self.style.append(data)
        elif not self.silent:
            self.text.append(data)
            for _, parts, _ in self.capture:
                parts.append(data)

    def _close(self, captured):
        captured[2]["text"] = " ".join("".join(captured[1]).split())

    def _data(self, text):
        kind, valid = None, True
        try:
            found = json.loads(text)
            first = found[0] if isinstance(found, list) and found else found
            kind = first.get("@type") if isinstance(first, dict) else None
            kind = kind[0] if isinstance(kind, list) and kind else kind
        except ValueError:
            valid = False
        self.page["structured_data"].append({"format": "json-ld", "schema_type": kind if isinstance(kind, str) else None, "data_json": text.strip(), "is_valid": valid})

    def finish(self) -> dict:
        for c in self.capture:
            self._close(c)
        if self.title is not None:
            self.page["title"] = " ".join("".join(self.title).split())
        p, body = self.page, " ".join(" ".join(self.text).split())
        words = body.split(" ") if body else []
        first = [h["text"] for h in p["headings"] if h["level"] == 1]
        return p | {
            "h1": first[0] if first else None,
            "h1_count": len(first),
            "h2_count": sum(h["level"] == 2 for h in p["headings"]),
            "word_count": len(words),
            "sentence_count": sum(len(s.strip()) > 3 for s in re.split(r"[.!?]+", body)),
            "text_length": len(body),
            "content_hash": hashlib.md5(body.encode("utf-8", "surrogatepass")).hexdigest(),
            "body_text": body,
        }


def parse(html: str | None) -> dict:
    parser = PageParser()
    parser.whole(html or "")
    return parser.finish()


def parse_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` and the struct ``page`` for each row; ``columns`` limits the struct to what the caller needs."""
    fields = [f for f in PAGE.fields if columns is None or f.name in columns]
    shape = T.StructType(fields)
    schema = T.StructType([*[pages.schema[k] for k in keep], T.StructField("page", shape)])
    names = [f.name for f in fields]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [parse(h) for h in part.column(html).to_pylist()]
                rows = pa.array([{n: list(x[n].items()) if isinstance(x[n], dict) else x[n] for n in names} for x in found], type=target.field("page").type)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], rows], schema=target)

    return pages.select(*keep, html).mapInArrow(run, schema)


def child(parsed: DataFrame, name: str, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A child relation with its position in the document from 0."""
    return parsed.select(*keep, F.posexplode(f"page.{name}").alias("position", "_c")).select(*keep, "position", "_c.*")


def properties_of(parsed: DataFrame, name: str, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The Open Graph (``og``) or card (``twitter``) map as rows."""
    return parsed.select(*keep, F.explode(f"page.{name}").alias("property", "content"))


def header_links(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Canonical, next and prev targets of a ``Link`` header in a map of lower-cased names."""
    link = F.try_element_at(F.transform_keys(headers, lambda k, v: F.lower(k)), F.lit("link"))
    of = lambda rel: F.nullif(F.regexp_extract(link, rf'<([^>]*)>[^,]*;\s*rel="?{rel}"?', 1), F.lit(""))
    return df.withColumns({"http_canonical": of("canonical"), "http_next": of("next"), "http_prev": of("prev")})


def unsafe_links(parsed: DataFrame) -> DataFrame:
    """Links that open a new window without ``noopener`` or ``noreferrer``: page, href and the text, cut to 80 characters as shown."""
    d = child(parsed, "links").where("tag = 'a' and target = '_blank'")
    rel = F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+")
    href = F.trim(F.coalesce("href", F.lit("")))
    d = d.where(~F.array_contains(rel, "noopener") & ~F.array_contains(rel, "noreferrer") & (href != "") & ~href.rlike("^(javascript:|#|mailto:|tel:)"))
    return d.select("page_id", "url", href.alias("href"), F.substring(F.coalesce(F.nullif("text", F.lit("")), href), 1, 80).alias("text"))


def mixed_content(parsed: DataFrame) -> DataFrame:
    """What pages over HTTPS load over HTTP: images, scripts, style sheets and frames."""
    part = lambda name, column, kind: child(parsed, name).select("page_id", "url", F.col(column).alias("src"), kind.alias("kind"))
    rows = part("images", "src", F.lit("img")).unionByName(part("iframes", "src", F.lit("iframe"))).unionByName(_resource_rows(parsed))
    return rows.where(F.lower("url").startswith("https://") & F.lower(F.trim("src")).startswith("http://"))


def _resource_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("page_id", "url", F.explode("page.resources").alias("_c"))
    return rows.select("page_id", "url", F.col("_c.url").alias("src"), F.when(F.col("_c.resource_type") == "css", "link").otherwise("script").alias("kind"))


SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[~^$*|]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)$")
PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([~^$*|]?)=(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]")


class Selector:
    """A CSS selector of tags, classes, ids, attributes, descendants, children and commas; anything else is refused."""

    def __init__(self, text: str):
        self.choices = []
        for choice in text.split(","):
            steps, direct = [], False
            for token in re.sub(r"\s*>\s*", " > ", choice.strip()).split():
                if token == ">":
                    direct = True
                    continue
                m = SIMPLE.match(token)
                if not m:
                    raise ValueError(f"selector {text!r} is not supported")
                tests = [("class" if p[1] == "." else "id", "~" if p[1] == "." else "=", p[2]) if p[1] else (p[3].lower(), (p[4] or "=") if p[5] is not None or p[6] is not None or p[7] is not None else "", p[5] or p[6] or p[7] or "") for p in PART.finditer(m[2] or "")]
                steps.append((direct, (m[1] or "*").lower(), tests))
                direct = False
            if not steps:
                raise ValueError(f"selector {text!r} is empty")
            self.choices.append(steps)

    @staticmethod
    def _fits(node, step) -> bool:
        tag, attrs = node
        if step[1] not in ("*", tag):
            return False
        for name, how, value in step[2]:
            have = attrs.get(name)
            if have is None:
                return False
            ok = {"": True, "=": have == value, "~": value in have.split(), "^": have.startswith(value), "$": have.endswith(value), "*": value in have, "|": have == value or have.startswith(value + "-")}[how]
            if not ok:
                return False
        return True

    def matches(self, path: list) -> bool:
        """Whether the last element of a path of (tag, attributes) is chosen."""
        return any(self._ends(path, len(path) - 1, steps, len(steps) - 1) for steps in self.choices)

    def _ends(self, path, at, steps, k) -> bool:
        if at < 0 or not self._fits(path[at], steps[k]):
            return False
        if k == 0:
            return True
        return any(self._ends(path, up, steps, k - 1) for up in ([at - 1] if steps[k][0] else range(at - 1, -1, -1)))


class Chosen(Markup):
    """Text, markup or an attribute of the first elements that each selector chooses."""

    def __init__(self, rules: list[tuple], most: int):
        super().__init__()
        self.rules, self.most, self.path = rules, most, []
        self.found: list[list] = [[] for _ in rules]
        self.open: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        a = {k: self.plain(v) for k, v in reversed(attrs)}
        raw = self.plain(self.get_starttag_text())
        for _, parts, kind in self.open:
            if kind == "html":
                parts.append(raw)
        self.path.append((tag, a))
        for k, (selector, kind, name) in enumerate(self.rules):
            if len(self.found[k]) < self.most and selector.matches(self.path):
                parts = [raw] if kind == "html" else []
                self.found[k].append([a.get(name, "")] if kind == "attribute" else parts)
                if kind != "attribute" and tag not in VOID:
                    self.open.append((len(self.path), parts, kind))
        if tag in VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        for at in range(len(self.path) - 1, -1, -1):
            if self.path[at][0] == tag:
                for depth, parts, kind in self.open:
                    if kind == "html":
                        parts.append(f"</{tag}>")
                self.open = [o for o in self.open if o[0] <= at]
                del self.path[at:]
                break

    def handle_data(self, data):
        data = self.plain(data)
        for _, parts, kind in self.open:
            parts.append(data if kind == "html" else data.strip())

    def results(self) -> list[str]:
        return [" | ".join(v for v in ("".join(p).strip() for p in f) if v) for f in self.found]


def custom_extract(df: DataFrame, rules: list[dict], html: str = "html", most: int = 5, between: str = " | ") -> DataFrame:
    """One column for each rule, what it finds first (``most``) joined: regular expressions as expressions of the plan,
    CSS selectors and XPath (text, html or an attribute) in one pass of a parser for all of either. A rule that is none gives empty texts."""
    out, chosen, paths = df, [], []
    for r in rules:
        name, kind, expr = r["name"], r.get("type", "css"), r["expression"]
        if kind == "css":
            try:
                chosen.append((name, Selector(expr), r.get("extract_type", "text"), r.get("attribute_name", "")))
            except ValueError:
                out = out.withColumn(name, F.lit(""))
            continue
        if kind == "xpath":
            try:
                xpath.compiled(expr)
                paths.append((name, expr, r.get("extract_type", "text"), r.get("attribute_name", "")))
            except ValueError:
                out = out.withColumn(name, F.lit(""))
            continue
        if not is_pattern(expr):
            out = out.withColumn(name, F.lit(""))
            continue
        groups = re.compile(expr).groups
        found = F.regexp_extract_all(F.col(html), F.lit(f"(?is){expr}"), F.lit(1 if groups else 0))
        out = out.withColumn(name, F.array_join(F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most), between))
    if paths:
        out = _by_path(out, paths, html, most, between)
    if not chosen:
        return out
    schema = T.StructType([T.StructField(n, S) for n, *_ in chosen])
    tests = [c[1:] for c in chosen]

    @F.pandas_udf(schema)
    def run(pages):
        import pandas as pd

        rows = []
        for page in pages:
            parser = Chosen(tests, most)
            parser.whole(page or "")
            rows.append(parser.results())
        return pd.DataFrame(rows, columns=schema.names)

    out = out.withColumn("_chosen", run(F.col(html)))
    return out.select(*[c for c in out.columns if c != "_chosen"], "_chosen.*")


def _by_path(df: DataFrame, rules: list[tuple], html: str, most: int, between: str) -> DataFrame:
    """A column for each XPath rule; the tree of a page is built once. What an expression can't do on a page (a step from a number) gives an empty text."""
    schema = T.StructType([T.StructField(n, S) for n, *_ in rules])

    @F.pandas_udf(schema)
    def run(pages):
        import pandas as pd

        compiled, rows = [xpath.compiled(e) for _, e, *_ in rules], []
        for page in pages:
            tree, row = xpath.Tree(page or ""), []
            for f, (_, _, kind, attribute) in zip(compiled, rules):
                try:
                    row.append(between.join(xpath.evaluate(f, tree, kind, attribute, most)))
                except (ValueError, TypeError):
                    row.append("")
            rows.append(row)
        return pd.DataFrame(rows, columns=schema.names)

    out = df.withColumn("_paths", run(F.col(html)))
    return out.select(*df.columns, "_paths.*")


def custom_search(df: DataFrame, rules: list[dict], html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row for each page and search rule: matched, count and a snippet of 40 characters around the first hit."""
    out = None
    for r in rules:
        pattern = r["pattern"] if r.get("regex") else re.escape(r["pattern"])
        # What is no valid expression is searched as plain text.
        if not is_pattern(pattern):
            pattern = re.escape(r["pattern"])
        pattern = pattern if r.get("case_sensitive") else f"(?i){pattern}"
        text = F.coalesce(F.col(html), F.lit(""))
        count = F.regexp_count(text, F.lit(pattern)).cast("long")
        at = F.regexp_instr(text, F.lit(pattern))
        hit = (count > 0) if r.get("mode", "contains") == "contains" else (count == 0)
        snippet = F.when((count > 0) & hit, F.substring(F.expr(f"substring({html}, greatest(1, _at - 40), 80 + {len(r['pattern'])})"), 1, 160)).otherwise("")
        rows = df.withColumn("_at", at).select(*keep, F.lit(r["name"]).alias("search_name"), hit.alias("matched"), count.alias("n_matches"), snippet.alias("snippet"))
        out = rows if out is None else out.unionByName(rows)
    return out
