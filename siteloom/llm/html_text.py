"""HTML main-text extraction by consensus paths of a host.

A page is read once into containers, each with the size of its text. What is no text (scripts, styles, forms' controls) and what is never
part of an article (navigation, asides, footers) is left out by its tag; elements whose class or id names such a thing (``comments``,
``sidebar-left``, but not ``has-sidebar`` or ``comments-open``) are left out too, unless they hold most of the page's text: the text decides
over the name. Containers are then scored by the text of their blocks, links not counted; the best container, or the ``article`` or ``main``
around it, votes with that score for its generalised path of tags and classes. Spark sums the votes of each host, and every page is
extracted again with the path that won on its host; a page without that path uses its own best container.

Defined results: a null or empty page has the empty text; a page without a container of text has the text of its
body less boilerplate; unclosed, misnested and cut-off markup is read as far as it goes; pages are read whole,
however long; a null URL, or one without ``://``, votes with the empty host; ties go to the path that sorts first; repeated rows vote and are
extracted each; an empty table gives no rows; other columns pass through; clashing names raise ``ValueError``.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import materialize
from .batches import map_rows
from .urls import host_of

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("body html li dt dd tr td th caption thead tbody tfoot br option legend".split())
#: What may hold a main text.
CONTAINER = frozenset("body article main section div td form".split())
#: Never part of a main text, whatever they hold.
DROP_TAGS = frozenset("head nav footer aside script style noscript template svg iframe button select textarea option dialog menu object embed canvas audio video map title".split())
#: Names of what is left out: as a class or id by itself, or as a part of one.
DROP_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe share sharing social related recommended masthead footer skyscraper toolbar pagination pager widget".split())
#: Readers' words: left out even if they are longer than the article.
READER_WORDS = frozenset("comment comments disqus replies responses respond".split())
#: Parts that may stand beside such a word in the name of the same thing.
BESIDE_WORDS = frozenset("area bar block box btn button buttons bottom col column container entry first float global group header icons inline inner item items last left line link links list main message mobile native panel post posts primary article articles right rail row secondary section signup site slot small stories strip text thread top unit wrap zone a b c 1 2 3 4 5 6 7 8 9 0".split())
#: Elements whose ids may name what they are.
PARTS_OF_PAGE = frozenset("div section ul ol dl form table details article main td".split())
#: Parts that make a name one of a state or a layout, not of what the element is.
STATE_WORDS = frozenset("no not non has have with without free open opened close closed off on enable enabled disable disabled is layout page site theme template full hide hidden show count style allow wrapper container inner outer body".split())
DROP_CLASSES = frozenset("header site-header page-header top-header global-header site-footer page-footer".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
KEEP_WORDS = frozenset("article content post entry story main body text".split())
#: Shares of the page's text from which an element stays in spite of its name; of readers' words; of a form.
MOSTLY, NEARLY_ALL = 0.5, 0.9
#: Within an article: the share of the page's text from which a named element stays, and of its own text in links from which it goes all the same.
SOME, LINKED = 0.2, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}


class Node:
    """An element. ``path`` is the number of its generalised path, ``box`` the nearest container, itself included."""

    __slots__ = ("tag", "parent", "path", "kind", "inside", "link", "own", "below", "linked", "score", "bonus", "dropped", "box")

    def __init__(self, tag, parent, path, kind, inside, link, bonus):
        self.tag, self.parent, self.path, self.kind, self.inside, self.link, self.bonus = tag, parent, path, kind, inside, link, bonus
        self.box = self if tag in CONTAINER else parent.box if parent is not None else None
        self.own = self.below = self.linked = 0
        self.score = 0.0
        self.dropped = False


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text else {}


#: How an element may be left out: never, by what it is, by its name, as reader comments.
PLAIN, HARD, NAMED, READERS = range(4)


@lru_cache(maxsize=4096)
def kind_of_name(name: str) -> int:
    """What a class or id says."""
    parts = WORD.findall(name)
    if name in DROP_CLASSES:
        return NAMED
    found = {p for p in parts if p in DROP_WORDS or p in READER_WORDS}
    if not found or any(p in STATE_WORDS for p in parts) and not all(p in DROP_WORDS or p in READER_WORDS or p in BESIDE_WORDS for p in parts):
        return PLAIN
    if not all(p in DROP_WORDS or p in READER_WORDS or p in BESIDE_WORDS or p.isdigit() for p in parts):
        return PLAIN
    return READERS if found & READER_WORDS else NAMED


def kind_of(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """Whether an element may be left out. ``inside``: it stands in an article or main."""
    if tag in DROP_TAGS:
        return HARD
    if tag == "header":
        return PLAIN if inside else HARD
    if attrs and tag not in ("body", "html"):
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROP_ROLES or NOT_SHOWN.search(attrs.get("style", "")):
            return HARD
        if tag != "main":
            kinds = {kind_of_name(n) for n in attrs.get("class", "").lower().split() if not (inside and n in DROP_CLASSES)}
            if tag in PARTS_OF_PAGE:
                of_id = {kind_of_name(n) for n in attrs.get("id", "").lower().split()}
                kinds |= of_id & {READERS} if inside else of_id
            if READERS in kinds:
                return READERS
            if NAMED in kinds and tag != "article":
                return NAMED
    return NAMED if tag == "form" else PLAIN


def step_of(tag: str, attrs: dict[str, str]) -> str:
    """The generalised step of a path: the tag with its sorted classes, runs of digits as one sign."""
    classes = sorted({re.sub(r"\d+", "#", c).replace(">", "") for c in attrs.get("class", "").lower().split()})
    return tag + "".join(f".{c}" for c in classes)


class Page:
    """A page read once: its elements in order, and its texts and block limits with the element they stand in."""

    def __init__(self, html: str):
        root = Node("", None, 0, PLAIN, False, False, 0.0)
        self.nodes, self.pieces = [root], []
        self.paths, self.steps = {}, [(0, "")]  # numbers of paths by (path above, step), and the way back
        stack, opened = [root], Counter()

        def leave(to):
            for node in stack[to:]:
                opened[node.tag] -= 1
            del stack[to:]

        at, end = 0, len(html)
        match, pieces = TOKEN.match, self.pieces
        while at < end:
            m = match(html, at)
            at = m.end()
            tag = m[2] or m[5]
            top = stack[-1]
            if tag is None:
                text = m[0]
                if (text[0] != "<" or len(text) == 1) and top.kind != HARD:
                    pieces.append((top, unescape(text) if "&" in text else text))
                    top.own += len(text.strip())
                continue
            tag = tag.lower()
            rest = m[3] or m[6]
            if m[1] or m[4]:
                if tag in BLOCK:
                    pieces.append((top, " "))
                if tag in VOID or not opened[tag]:
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        leave(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK and stack[k].tag != "p":
                        break
                    if tag not in CONTAINER and stack[k].tag in CONTAINER:
                        break
                continue
            if tag in CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        leave(k)
                        break
                    if stack[k].tag in CLOSES_P or stack[k].tag in CONTAINER:
                        break
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in same) else ():
                    if stack[k].tag in same:
                        leave(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "select", "tbody", "tr" if tag in ("td", "th") else "") or stack[k].tag in CONTAINER and tag not in ("tr", "td", "th"):
                        break
            top = stack[-1]
            if tag in BLOCK:
                pieces.append((top, " "))
            if tag in VOID:
                continue
            if tag in RAW:
                close = RAW_END[tag].search(html, at)
                at = close.end() if close else end
                continue
            attrs = attributes(rest) if rest else {}
            kind = HARD if top.kind == HARD else kind_of(tag, attrs, top.inside)
            if tag in CONTAINER:
                words = WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()) if attrs else ()
                step = top.path, step_of(tag, attrs)
                if step not in self.paths:
                    self.paths[step] = len(self.steps)
                    self.steps.append(step)
                node = Node(tag, top, self.paths[step], kind, top.inside or tag in ("article", "main"), top.link, 25.0 * (tag in ("article", "main")) + 10.0 * any(w in KEEP_WORDS for w in words))
            else:
                node = Node(tag, top, top.path, kind, top.inside, top.link or tag == "a", 0.0)
            self.nodes.append(node)
            stack.append(node)
            opened[tag] += 1
        self.judge()

    def path_of(self, node: Node) -> str:
        """The generalised path of a node, each step behind a ``>``."""
        out, at = [], node.path
        while at:
            at, step = self.steps[at]
            out.append(step)
        return "".join(f">{step}" for step in reversed(out))

    def number_of(self, path: str) -> int | None:
        """The number of a path, if this page has it."""
        at = 0
        for step in path.split(">")[1:]:
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at

    def judge(self) -> None:
        """Which elements are left out, and the score of each container."""
        for node in reversed(self.nodes):
            node.below += node.own
            node.linked += node.own if node.link else 0
            if node.parent is not None:
                node.parent.below += node.below
                node.parent.linked += node.linked
        whole = max(1, self.nodes[0].below)
        for node in self.nodes[1:]:
            least = {PLAIN: 0.0, HARD: 2.0, NAMED: MOSTLY, READERS: NEARLY_ALL}[node.kind]
            if node.kind == NAMED and node.inside and node.linked < LINKED * node.below:
                least = SOME
            node.dropped = node.parent.dropped or node.below < least * whole
            if node.tag in CONTAINER and not node.dropped:
                node.score = node.bonus
        for node in self.nodes:
            if node.own and not node.dropped and not node.link:
                at = node.box
                for given in range(3):
                    if at is None:
                        break
                    at.score += node.own / (1 << given)
                    at = at.parent.box if at.parent is not None else None

    def best(self) -> Node | None:
        """The container with the highest score, lifted to the outermost article or main around it, which takes its score."""
        found = max((n for n in self.nodes if n.tag in CONTAINER and not n.dropped), key=lambda n: n.score, default=None)
        if found is None or found.score <= 0:
            return None
        at, lifted = found, found
        while at is not None:
            if at.tag in ("article", "main"):
                lifted = at
            at = at.parent
        # A main that holds much besides its article is the layout, not the text.
        if lifted.tag == "main" and (inner := self._article(found, lifted)) is not None and inner.below >= MOSTLY * lifted.below:
            lifted = inner
        lifted.score = max(lifted.score, found.score)
        return lifted

    @staticmethod
    def _article(at: Node, limit: Node) -> Node | None:
        found = None
        while at is not limit:
            if at.tag == "article":
                found = at
            at = at.parent
        return found

    def text(self, path: str | int | None) -> str | None:
        """The text below the containers of ``path`` (or of its number), all kept text if that is None; None where no container has it."""
        wanted: dict[Node, bool] = {}
        met, number = path is None, self.number_of(path) if isinstance(path, str) else path
        for node in self.nodes:
            own = path is None or node.tag in CONTAINER and node.path == number
            met |= own and not node.dropped
            wanted[node] = not node.dropped and (own or node.parent is not None and wanted[node.parent])
        return " ".join("".join([t if t == " " or wanted[n] else "" for n, t in self.pieces]).split()) if met else None


def host_votes(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The sum of votes for each host and generalised path."""
    pages = df.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("pages", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(part: pa.RecordBatch) -> dict:
        pages, score = Counter(), Counter()
        for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
            if page and (best := (read := Page(page)).best()):
                path = read.path_of(best)
                pages[host, path] += 1
                score[host, path] += round(best.score)
        return {"host": [h for h, _ in pages], "path": [p for _, p in pages], "pages": list(pages.values()), "score": [float(score[k]) for k in pages]}

    return map_rows(pages, run, schema).groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("score").alias("score"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """host, path: the path with the largest score on each host; the first in sort order of equals."""
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("path"))


def extract(df: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Replace the column ``html`` by ``text``, the main text, with the path that was used in ``text_path``."""
    names = [c for c in df.columns if c != html]
    if taken := {text.lower(), "text_path"} & {c.lower() for c in names}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    winners = materialize(winning_paths(host_votes(df, url, html)), "paths").select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    # Hosts are many and pages large: Spark broadcasts the winners where their measured size allows, else AQE splits hot hosts.
    joined = df.withColumn("_host", host_of(F.col(url))).join(winners, "_host", "left").select(*names, F.col(html).alias("_html"), "_path")
    schema = T.StructType([*[f for f in df.schema.fields if f.name != html], T.StructField(text, T.StringType()), T.StructField("text_path", T.StringType())])

    def run(part: pa.RecordBatch) -> dict:
        found, paths = [], []
        for page, path in zip(part.column("_html").to_pylist(), part.column("_path").to_pylist()):
            body = ""
            if page:
                read = Page(page)
                body = read.text(path) if path else None
                if body is None:
                    best = read.best()
                    path = read.path_of(best) if best else None
                    body = read.text(path)
            found.append(body)
            paths.append(path if page else None)
        return {n: part.column(n) for n in names} | {text: found, "text_path": paths}

    return map_rows(joined, run, schema)
